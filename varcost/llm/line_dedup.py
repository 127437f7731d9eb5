"""Line deduplication: lines that many documents share are dropped everywhere.

Only DataFrame functions run here; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varcost.llm.common import BLANKS, text_of
from varcost.sinks.scratch import stage

# The letters that are lower-cased in a line's key.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() agrees with A-Z only on plain ASCII, where it is much the faster.
    return F.when(bare.rlike("[^\\x00-\\x7F]"), F.translate(bare, _UPPER, _LOWER)).otherwise(F.lower(bare))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def frequent_lines(docs: DataFrame, text_col: str, min_documents: int, min_chars: int) -> DataFrame:
    """Digests of the keys found in at least ``min_documents`` rows, with their document counts.

    Each row first reduces its keys to distinct ones, so rows per key are documents per key; they
    are counted map-side before the shuffle, and a key that every document has costs one row a task.
    """
    keys = F.transform(F.split(text_of(text_col), "\n"), line_key)
    distinct = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    return (
        # Of explode() the optimiser would infer a filter on the array's size and compute the array twice.
        docs.select(F.explode_outer(F.transform(distinct, _digest)).alias("line_digest"))
        .filter("line_digest IS NOT NULL")
        .groupBy("line_digest").agg(F.count("*").alias("n_documents"))
        .filter(F.col("n_documents") >= min_documents)
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_documents: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_text``.

    Lines are split at ``\\n``; a NULL or empty text is one empty line. A line goes if its key has at
    least ``min_chars`` code points and occurs in at least ``min_documents`` rows (repeats inside one
    row count once; a repeated row is another document). All occurrences go, in every document.
    What stays is joined by ``\\n`` in the order of positions; a text that loses all lines is empty.
    Rows with a NULL or repeated id are documents of their own. An empty table gives an empty
    result. Only the id and the text are read, so other columns may have any name.

    The frequent keys are staged, so the planner knows their size: a small table is broadcast to the
    exploded lines, a large one joined by shuffle, where adaptive execution splits hot lines.
    ``docs`` is scanned twice and should be a table scan.
    """
    frequent = stage(frequent_lines(docs, text_col, min_documents, min_chars), "lines")
    lines = (
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")
        )
        .select("row", "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("position", "line"))
        .withColumn("key", line_key(F.col("line")))
        # A key that is too short never meets a frequent one; NULL digests do not join.
        .withColumn("line_digest", F.when(F.char_length("key") >= min_chars, _digest(F.col("key"))))
        .drop("key")
    )
    marked = lines.join(frequent, "line_digest", "left")
    dropped = F.col("n_documents").isNotNull()
    kept = F.sort_array(F.collect_list(F.when(~dropped, F.struct("position", "line"))))
    return (
        marked.groupBy("row", "doc_id")
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(dropped).alias("n_dropped"),
            F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("kept_text"),
        )
        .drop("row")
    )
