"""Exact deduplication by a stateful stream.

Documents stream by file through a keyed aggregation whose state is kept on disk (RocksDB) without
expiry. For every digest of a normalised text the state retains how many documents had it, and
of the one that stays the stable id and the content locator (file and row). Spark combines rows of
a digest map-side before they reach the state, so a text that a third of all documents share costs
one row per task and batch. The finished state is read with Spark's state data source.

Equal digests are only hits: full bytes are checked before any row is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varcost.llm.common import BLANK_RUN, FILE, ROW, place_of, positional, text_of
from varcost.sinks.scratch import scratch_folder, stage

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All state partitions of an executor share this much native memory.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Each state partition would reserve 4 MB for its list of files, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, BLANK_RUN, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _as_pattern(content: str) -> str:
    """A pattern for the path, because a stream does not take the path of a single file. What is a pattern already stays."""
    if any(c in content for c in "{}[]*?\\"):
        return content
    path = content.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _rows(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Digest, rank, id and locator of each row, and its normalised text."""
    text = text_of(text_col)
    return docs.select(
        normalised(text).alias("text"), F.col(id_col).alias("doc_id"), F.length(text).alias("n_points"),
        F.xxhash64(F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.row_index").alias(ROW),
    ).withColumn("digest", digest(F.col("text")))


def _classes(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and best row of each class: most code points, then smallest id, then first stored."""
    best = F.struct((-F.col("n_points")).alias("rank"), F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)
    return rows.groupBy(*keys).agg(F.count("*"), F.min(best))


def _stream_classes(
    spark: SparkSession, content: str, schema: T.StructType, id_col: str, text_col: str, digest, batch_bytes: int
) -> DataFrame:
    """Run the stream over all of ``content`` and stage its final state."""
    checkpoint = f"{scratch_folder(spark)}/exact-dedup-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in _STATE_CONF}
    for key, value in _STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        source = (
            spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes))
            .parquet(_as_pattern(content))
        )
        query = (
            _classes(_rows(source, id_col, text_col, digest), "digest")
            .writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if query.lastProgress is None:  # no file, hence no batch and no state
            empty = f"digest binary, group_size bigint, best struct<doc_id:{schema[id_col].dataType.simpleString()},{FILE}:bigint,{ROW}:bigint>"
            return spark.createDataFrame([], empty)
        state = spark.read.format("statestore").load(checkpoint)
        return stage(
            state.select(
                F.col("key.digest").alias("digest"), F.col("value.count").alias("group_size"),
                F.struct("value.min.doc_id", f"value.min.{FILE}", f"value.min.{ROW}").alias("best"),
            ),
            "classes",
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def exact_dedup(
    spark: SparkSession,
    content: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 256 << 20,
    digest=sha256,
) -> DataFrame:
    """One row per row of the Parquet table at ``content``:
    ``doc_id, keep_id, group_size, kept, digest`` and the locator ``__file, __row``.

    Texts are equal when identical after deleting blanks; NULL counts as empty, so NULL, empty and blank
    texts form one group. Of a group, the row with the most code points in its original text stays, then
    the one with the smallest id (a NULL id is the largest), then the first one stored, so exactly
    one row stays even if whole rows repeat. Texts of any length are compared in full. An empty table
    gives an empty result. Only the id and the text are read. ``content`` may end in a slash, or be a pattern, as Spark's
    readers take them.

    ``batch_bytes`` is the size of a micro-batch. ``digest`` maps the normalised text to a binary key; with a
    weak one the byte check splits what it confuses.
    """
    table = spark.read.parquet(content)
    found = _stream_classes(spark, content, table.schema, id_col, text_col, digest, batch_bytes)
    rows = _rows(table, id_col, text_col, digest)

    # Byte check of the hits. All texts of a class are equal if and only if the smallest equals the
    # largest. Hits grow with the input, so the join is by shuffle at any size. The renamed key keeps it
    # apart from the aggregation, so adaptive execution may split a hot class, whose rows are then
    # combined map-side.
    hits = stage(found.filter("group_size > 1").select("digest"), "hits")
    checked = (
        rows.select("digest", "text").join(hits.hint("merge"), "digest")
        .select(F.concat(F.lit(b""), "digest").alias("key"), "text")
        .groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    )
    confused = stage(checked.filter("least <> greatest").select(F.col("key").alias("digest")), "confused")

    narrow = rows.select("doc_id", "digest", FILE, ROW)
    out = narrow.join(found, "digest")
    if confused.limit(1).count():
        # Digest collisions: group these few classes by the text itself.
        mixed = rows.join(confused, "digest", "left_semi")
        by_text = (
            _classes(mixed, "digest", "text").toDF("digest", "text", "group_size", "best")
            .withColumn("best", F.struct("best.doc_id", f"best.{FILE}", f"best.{ROW}"))
        )
        split = mixed.select("doc_id", "digest", "text", FILE, ROW).join(by_text, ["digest", "text"]).drop("text")
        out = out.join(confused, "digest", "left_anti").unionByName(split)
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        ((F.col(FILE) == F.col(f"best.{FILE}")) & (F.col(ROW) == F.col(f"best.{ROW}"))).alias("kept"),
        "digest", FILE, ROW,
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of NULL, empty and blank texts one row stays, and of repeated rows one; an empty table gives an empty result. The rows are first written to the scratch folder, where the stream reads and locates them.
    """
    spark = docs.sparkSession
    content = f"{scratch_folder(spark)}/content-{uuid.uuid4().hex}"
    plain = positional(docs)
    plain.write.parquet(content)
    kept = exact_dedup(spark, content, place_of(docs, id_col), place_of(docs, text_col)).filter("kept").select(FILE, ROW)
    located = spark.read.schema(plain.schema).parquet(content).withColumns({
        FILE: F.xxhash64(F.col("_metadata.file_path")), ROW: F.col("_metadata.row_index"),
    })
    return located.join(kept, [FILE, ROW], "left_semi").select(*plain.columns).toDF(*docs.columns)
