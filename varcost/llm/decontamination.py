"""Benchmark decontamination: find short test items inside long documents.

Containment search by MinHash with items partitioned by size. An item of n distinct shingles is
contained in a document if the document has at least ``threshold`` of them. Documents are far larger
than items, so the MinHash sketch is made on the item's side: its shingles with the smallest hashes,
how many depending on the size partition. A document that contains an item lacks at most
(1 - threshold) * n of its shingles, so a sketch of one more than that always shares a shingle with
it: the search misses nothing. Candidates are then verified by exact shingle containment.

Only DataFrame functions run here; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varcost.llm.common import BLANK_RUN, BLANKS, FILE, ROW, place_of, positional, text_of, with_locator
from varcost.sinks.scratch import stage


def with_shingles(df: DataFrame, text_col: str, size: int, name: str) -> DataFrame:
    """Add distinct 64-bit hashes of all ``size`` consecutive lower-case words of a text.

    A text of fewer words, but at least one, has a single shingle of all its words.
    """
    bare, words = f"{name}_bare", f"{name}_words"
    starts = F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    )
    return (
        # Each step is a column of its own, so the words are not split again for every shingle.
        df.withColumn(bare, F.btrim(F.lower(text_of(text_col)), F.lit(BLANKS)))
        .withColumn(words, F.when(F.col(bare) == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN)))
        # Beyond the last word there is NULL, which the hash passes over.
        .withColumn(name, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))))
        .drop(bare, words)
    )


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(shingle, item_id, n_item): the MinHash sketch of each item, sized by its partition.

    Partition p holds the items of 2**p to 2**(p+1) - 1 shingles, and its sketches are large enough for
    the largest of them.
    """
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    length = F.floor((1 - threshold) * upper + 1e-9).cast("int") + 1
    # Shingles are hashes already; a second seed makes their order that of a MinHash permutation.
    ordered = F.sort_array(F.transform("item_shingles", lambda s: F.struct(F.xxhash64(s, F.lit(1)).alias("o"), s.alias("s"))))
    return items.select(
        "item_id", "n_item", F.explode(F.transform(F.slice(ordered, 1, length), lambda x: x["s"])).alias("shingle")
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle_words: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per document row and item it contains:
    ``doc_id, item_id, n_item, n_shared, containment`` and the row's locator ``__file, __row``.

    Words are compared in lower case. Items or documents without words contain nothing and are
    contained in nothing; an item of fewer words than a shingle is found only in a document that consists
    of just these words. Repeated document rows give a row each, repeated items with their own row too,
    NULL ids are carried. Empty tables give an empty result. Only ids and texts are used of both
    tables, so other columns may have any name.

    The documents are scanned twice: the search explodes their shingles and joins the staged sketches,
    which the planner broadcasts if their measured size allows it and else joins by shuffle; the
    verification then makes shingles only for the documents that are candidates.
    """
    items = stage(
        with_shingles(
            benchmark.select(
                F.monotonically_increasing_id().alias("item_row"), F.col(item_id_col).alias("item_id"),
                F.col(item_text_col).alias("item_text"),
            ),
            "item_text", shingle_words, "item_shingles",
        ).drop("item_text").withColumn("n_item", F.size("item_shingles")).filter("n_item > 0"),
        "items",
    )
    sketch = stage(
        sketches(items.withColumn("item_id", F.col("item_row")), threshold)
        .select("shingle", F.col("item_id").alias("item_row"), F.ceil(F.col("n_item") * threshold - 1e-9).alias("needed")),
        "sketches",
    )
    located = with_locator(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")), "documents")
    # Of explode() the optimiser would infer a filter on the array's size and compute the array twice.
    probes = (
        with_shingles(located.select(FILE, ROW, "doc_text"), "doc_text", shingle_words, "own")
        .select(FILE, ROW, F.size("own").alias("n_own"), F.explode_outer("own").alias("shingle"))
    )
    candidates = stage(
        probes.join(sketch, "shingle")
        .filter(F.col("n_own") >= F.col("needed"))  # a smaller document cannot hold the item
        .select(FILE, ROW, "item_row").distinct(),
        "candidates",
    )
    # The documents that have candidates, each with the list of its items, which is short.
    suspects = candidates.groupBy(FILE, ROW).agg(F.collect_list("item_row").alias("item_rows"))
    verified = (
        with_shingles(located.join(stage(suspects, "suspects"), [FILE, ROW]), "doc_text", shingle_words, "own")
        .select(FILE, ROW, "doc_id", "own", F.explode_outer("item_rows").alias("item_row"))
        .join(items, "item_row")
        .withColumn("n_shared", F.size(F.array_intersect("own", "item_shingles")))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .filter(F.col("containment") >= threshold)
    )
    return verified.select(FILE, ROW, "doc_id", "item_id", "n_item", "n_shared", "containment")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item of the benchmark, with all their columns."""
    plain = positional(docs)
    id_col, text_col = (place_of(docs, options.pop(k, v)) for k, v in (("id_col", "doc_id"), ("text_col", "text")))
    located = with_locator(plain, "documents")
    leaks = find_leaks(located, benchmark, id_col=id_col, text_col=text_col, **options)
    return located.join(stage(leaks.select(FILE, ROW).distinct(), "leaks"), [FILE, ROW], "left_anti").select(*plain.columns).toDF(*docs.columns)
