"""Merkle manifest of a data set: one tree per group, one tree over the groups, and a proof for every row.

1. Leaves are digests of rows, sorted by group and id over many tasks. A leaf's place in its tree follows from the place of
   its row in its task's file and the rows of the tasks before, so no group is gathered anywhere.
2. Trees grow by blocks of ``2**BLOCK_LEVELS`` neighbouring nodes, each folded in one go. A block also tells the sibling of
   each of its nodes.
3. Proofs by pointer jumping: every node holds the siblings on the way to its parent and points to it. A self-join of
   nodes with those they point to doubles the distance and concatenates the segments, until every leaf points to its root.
   A join only takes the levels that leaves will still pass through.

A digest is SHA-256; inputs that are digests count as their lowercase hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.functions.joins import join_null_safe
from varcost.llm.sized import broadcast_if_small
from varcost.sinks.scratch import stage

BLOCK_LEVELS = 8
# A step of a proof: whether the sibling is on the left, on the right or missing, and its digest (zeros if missing).
LEFT, RIGHT, NONE = b"L", b"R", b"N"
STEP_BYTES = 33


# Leaves ------------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, so that fields cannot run into each other; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest (32 bytes) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*(field(f) for f in fields)), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _placed(spark: SparkSession, rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows sorted by group and ``keys``, with ``tree`` (the place of the group's first row), ``idx`` in it and ``n`` rows."""
    first = [F.col(c).asc_nulls_first() for c in ("grp", *keys)]
    rows = stage(rows, f"{name}-rows")
    sorted_rows = rows.repartitionByRange(*first).sortWithinPartitions(*first).withColumn("part", F.spark_partition_id())
    # A task writes one file, so a row's index in its file is its place among the task's rows.
    placed = stage(sorted_rows, f"{name}-sorted").withColumn("row", F.col("_metadata.row_index"))
    counts = stage(placed.groupBy("part", "grp").agg(F.min("row").alias("first"), F.count("*").alias("n")), f"{name}-counts")
    # One row per task of the sort, whatever the data.
    before, offsets = 0, []
    for part, n in sorted(map(tuple, counts.groupBy("part").agg(F.sum("n")).collect())):
        offsets.append((part, before))
        before += n
    parts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    trees = stage(
        counts.join(parts, "part").groupBy("grp")
        .agg(F.min(F.col("before") + F.col("first")).alias("tree"), F.sum("n").alias("n")),
        f"{name}-trees",
    )
    return join_null_safe(placed.join(parts, "part"), broadcast_if_small(trees), ["grp"], how="inner").withColumn(
        "idx", F.col("before") + F.col("row") - F.col("tree")
    ).drop("part", "row", "before")


# Trees -------------------------------------------------------------------------------------


def _digest(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def _height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def _fold_blocks(base: int, levels: int):
    """Fold the nodes of level ``base`` of each block up to ``levels`` levels, at most to the root."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, n, block, nodes in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = [x["hash"] for x in nodes]
                top = min(base + levels, _height(n))
                for level in range(base, top):
                    at = block << (base + levels - level)
                    for k in range(len(hashes)):
                        if k ^ 1 < len(hashes):
                            step = (LEFT if k & 1 else RIGHT) + hashes[k ^ 1]
                        else:
                            step = NONE + bytes(STEP_BYTES - 1)
                        rows.append((tree, n, level, at + k, step, None))
                    hashes = [_digest(*hashes[k:k + 2]) for k in range(0, len(hashes), 2)]
                rows.append((tree, n, top, block, None, hashes[0]))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "n", "level", "idx", "step", "hash"]
            )

    return fold


def grow(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame, int]:
    """Trees over ``tree, n, idx, hash``: the step of every node but the roots, the roots, and the largest height."""
    current, base, steps, roots = leaves, 0, None, None
    height = _height(leaves.agg(F.max("n")).first()[0] or 1)
    while True:
        block = F.shiftright("idx", block_levels).alias("block")
        folded = stage(
            current.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("nodes"))
            .mapInArrow(_fold_blocks(base, block_levels), "tree long, n long, level int, idx long, step binary, hash binary"),
            f"nodes{base}",
        )
        found = folded.filter("step IS NOT NULL").select("tree", "level", "idx", "step")
        tops = folded.filter("hash IS NOT NULL").select("tree", "n", "level", "idx", "hash")
        steps = found if steps is None else steps.unionByName(found)
        base += block_levels
        # A tree is done where one block was left of it.
        one = F.col("n") <= F.expr("shiftleft(1L, level)")
        done = tops.filter(one).select("tree", "hash")
        roots = done if roots is None else roots.unionByName(done)
        if base >= height:
            return steps, stage(roots, "roots"), height
        current = tops.filter(~one).select("tree", "n", "idx", "hash")


def climb(steps: DataFrame, height: int) -> DataFrame:
    """Pointer jumping: ``tree, idx, path`` of every leaf, its path being the steps up to the root."""
    nodes = stage(steps.withColumnRenamed("step", "path"), "paths1")
    distance = 1
    while distance < height:
        # Leaves stop at multiples of twice the distance from now on; the others are the ancestors they point to.
        here = F.col("level") % (2 * distance)
        lower = nodes.filter(here == 0).withColumn("to", F.shiftright("idx", distance))
        upper = nodes.filter(here == distance).select(
            "tree", (F.col("level") - distance).alias("level"), F.col("idx").alias("to"), F.col("path").alias("onwards")
        )
        # The higher the ancestors, the fewer they are, and the more nodes point to one.
        joined = lower.join(broadcast_if_small(upper), ["tree", "level", "to"], "left")
        distance *= 2
        # The paths of the next round, written so that both of its sides read them.
        nodes = stage(joined.select("tree", "level", "idx", F.concat("path", F.coalesce("onwards", F.lit(b""))).alias("path")), f"paths{distance}")
    return nodes.filter("level = 0").select("tree", "idx", "path")


# Proofs ------------------------------------------------------------------------------------


def _steps(path: Column) -> Column:
    last = (F.length(path) / STEP_BYTES).cast("int") - 1
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))


def _part(path: Column, at: Column, start: int, size: int) -> Column:
    return F.substring(path, at * STEP_BYTES + 1 + start, F.lit(size))


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) has by the siblings of a ``path`` column."""

    def up(digest: Column, at: Column) -> Column:
        side, sibling = _part(path, at, 0, 1), hex_of(_part(path, at, 1, STEP_BYTES - 1))
        pair = (
            F.when(side == F.lit(LEFT), F.concat(sibling, digest))
            .when(side == F.lit(RIGHT), F.concat(digest, sibling)).otherwise(digest)
        )
        return F.sha2(pair, 256)

    return F.aggregate(_steps(path), leaf, up)


def siblings(path: Column) -> Column:
    """The siblings (hex, concatenated) of a ``path`` column, from leaf to root."""
    present = F.filter(_steps(path), lambda at: _part(path, at, 0, 1) != F.lit(NONE))
    return F.array_join(F.transform(present, lambda at: hex_of(_part(path, at, 1, STEP_BYTES - 1))), "")


def merkle_proofs(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    also: Mapping[str, Column] | None = None,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per input row: the id, the columns ``also`` (short expressions over the row), ``leaf``, ``subroot``, ``root``
    (hex) and ``path``, the steps from the leaf to the root.

    Leaves of a group ascend by id, NULL first; rows that share an id are ordered by digest, so rows that are the same
    in all fields have neighbouring leaves and the result does not depend on how rows are stored. A NULL group is a group, the first.
    While several nodes remain, every two neighbours become the digest of both, a last single one the digest of itself; what remains is
    the group's subroot, and the subroots in bytewise order of their groups become the root alike. NULL and empty values
    have different digests. Texts of any length are hashed whole. An empty table gives an empty result. Only the columns
    named are read.
    """
    spark = docs.sparkSession
    also = dict(also or {})
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf_digest([F.col(f) for f in fields]).alias("hash"),
        F.struct(*(c.alias(n) for n, c in also.items()), F.lit(0).alias("_")).alias("also"),
    )
    leaves = stage(_placed(spark, rows, ["id", "hash"], "leaves"), "leaves")
    steps, subroots, height = grow(leaves.select("tree", "n", "idx", "hash"), block_levels)
    paths = climb(steps, height)

    # The tree over the subroots, whose trees are numbered in the order of their groups.
    tops = stage(
        _placed(spark, subroots.select(F.lit(0).alias("grp"), F.col("tree").alias("id"), "hash"), ["id"], "subroots"), "subroots"
    )
    top_steps, roots, top_height = grow(tops.select("tree", "n", "idx", "hash"), block_levels)
    top_paths = climb(top_steps, top_height)
    ends = stage(
        tops.select(F.col("id").alias("tree"), F.col("tree").alias("top"), "idx", F.col("hash").alias("subroot"))
        .join(top_paths.select("idx", F.col("path").alias("onwards")), "idx", "left")
        .join(F.broadcast(roots.select(F.col("tree").alias("top"), F.col("hash").alias("root"))), "top")  # one row
        .drop("idx", "top"),
        "ends",
    )
    empty = F.lit(b"")
    return (
        leaves.join(paths, ["tree", "idx"], "left").join(broadcast_if_small(ends), "tree")
        .select(
            F.col("id").alias(id_col), *(F.col("also")[n].alias(n) for n in also), hex_of(F.col("hash")).alias("leaf"),
            hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
            F.concat(F.coalesce("path", empty), F.coalesce("onwards", empty)).alias("path"),
        )
    )
