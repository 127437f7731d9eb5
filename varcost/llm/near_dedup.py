"""Near-duplicate detection by ProbMinHash.

1. Every text becomes weighted shingles (five words; the weight is how often the text has it) and a
   ProbMinHash signature. Each shingle is a Poisson process of arrivals whose rate is its weight; a
   register keeps the shingle of its earliest arrival. Two texts agree in a register with the
   probability Jaccard similarity of their weighted shingles. Arrivals later than all registers are
   never generated.
2. Texts with the same words are one *node*, named by a digest of the words, so copies cost nothing later.
3. Registers are banded. In each bucket of a band every node is paired with one pivot, so pairs grow with
   the nodes, not with the square of a bucket.
4. Pairs are verified on the exact probability Jaccard of the texts.
5. What pivots leave open is completed exactly by a prefix join. A node of a bucket that still holds several classes orders
   its shingles by how rare they are among all such nodes. If two of them are similar, the parts that they do not share weigh
   at most one minus the threshold, so the rarest shingle they share lies within that much weight of the rarest end of both.
   Only these prefixes are joined; a node whose own shingles, that no other has, weigh more has none. What lies before the
   rarest shared shingle is not shared in either text, and each bit that differs between their sketches of parities needs a shingle
   that they do not share; the join takes no pair for which either rules out the threshold, and a pair seldom more than once.
6. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varcost.llm.common import FILE, ROW, Words, mix, place_of, positional, record_batch, text_slices, with_locator
from varcost.sinks.scratch import stage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
# A pair of similarity s shares a bucket with probability 1 - (1 - s**4)**20: 0.99997 at 0.8.
BANDS, BAND_ROWS = 20, 4
# Pivots that all nodes of a bucket are compared with before the exact completion.
PIVOTS = 2
# Words of 64 bits that sketch the shingles of a node, to bound what two nodes share.
BIT_WORDS = 16
# Shingles of a prefix that each entry knows to come before it.
RECENT = 8
# Rounding that the sum of a similarity may have; a pair at the threshold is similar.
ROUNDING = 1e-9

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice: (text, hash, weight), ordered by text and hash."""
    hashes, bounds = Words(data, offsets).shingles(size)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes))).astype(np.float64)


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, a row per text; a text without shingles has zeros."""
    earliest = np.full(n_texts * registers, np.inf)
    held = np.zeros(n_texts * registers, np.uint64)
    state, time = hashes.copy(), np.zeros(len(hashes))
    with np.errstate(over="ignore"):
        while len(owner):
            # The next arrival of each process still of interest, and the register it falls into.
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(uniform) / weights
            register = owner * registers + (mix(state) % np.uint64(registers)).astype(np.int64)
            before = earliest[register]
            np.minimum.at(earliest, register, time)
            won = (time < before) & (time == earliest[register])
            held[register[won]] = hashes[won]
            # Early termination: a process is over once it is later than every register of its text.
            limit = earliest.reshape(n_texts, registers).max(axis=1)
            alive = time < limit[owner]
            owner, hashes, weights, state, time = owner[alive], hashes[alive], weights[alive], state[alive], time[alive]
    return held.reshape(n_texts, registers)


def _nodes(size: int, bands: int, rows: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(3)):
                n = len(offsets) - 1
                owner, hashes, weights = weighted_shingles(data, offsets, size)
                held = signatures(owner, hashes, weights, n, bands * rows).reshape(n, bands, rows)
                keys = np.broadcast_to(salt, (n, bands)).copy()
                for k in range(rows):
                    keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + held[:, :, k])
                words = data.tobytes().translate(_LOWER)
                digests = [
                    hashlib.blake2b(b" ".join(words[a:b].split()), digest_size=16).digest()
                    for a, b in zip(offsets[:-1], offsets[1:])
                ]
                yield record_batch([
                    *((name, batch.column(k).slice(first, n)) for k, name in enumerate((FILE, ROW, "doc_id"))),
                    ("node", pa.array(digests, pa.binary())),
                    ("n_shingles", pa.array(np.bincount(owner, minlength=n))),
                    ("keys", pa.ListArray.from_arrays(np.arange(0, (n + 1) * bands, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))),
                ])

    return describe


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two sets of (sorted hashes, weights).

    A shared element d has probability 1 / sum(max(u / u_d, v / v_d)) of being the first arrival of both;
    where u / v is at least u_d / v_d the first term is the larger, so sorted ratios give all sums.
    """
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    u, v = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - u.sum(), wb.sum() - v.sum()
    if (u == v).all():
        # All ratios are equal: the larger term is u for a's own elements and v for b's. Weights are whole numbers, so
        # their sums are exact and one division is right to the last bit, also at the threshold.
        return float(u.sum() / (u.sum() + only_a + only_b))
    ratio = u / v
    order = np.argsort(ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    above = np.concatenate([np.cumsum(u[::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(v)])
    at = np.searchsorted(ratio, ratio, side="left")
    return float((1.0 / ((above[at] + only_a) / u + (below[at] + only_b) / v)).sum())


def _verify(size: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def shingles(node: bytes, text: pa.Scalar):
            if node not in seen:
                if len(seen) >= 64:  # a pivot meets many texts in a row
                    seen.clear()
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                _, hashes, weights = weighted_shingles(data, np.array([0, len(data)]), size)
                seen[node] = hashes, weights
            return seen[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            similar = [
                probability_jaccard(shingles(x, s), shingles(y, t))
                for x, y, s, t in zip(a, b, batch.column(2), batch.column(3))
            ]
            yield record_batch([("a", batch.column(0)), ("b", batch.column(1)), ("similarity", pa.array(similar, pa.float64()))])

    return verify


def _scored(pairs: DataFrame, texts: DataFrame, size: int, name: str) -> DataFrame:
    """Similarity of each pair of nodes (``a``, ``b``); texts are joined by shuffle at any size, hot pivots are split."""
    pairs = stage(pairs, f"{name}-pairs")
    used = stage(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), f"{name}-used")
    needed = stage(texts.join(used.hint("merge"), "node", "left_semi"), f"{name}-texts")
    left, right = needed.toDF("a", "text_a"), needed.toDF("b", "text_b")
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return stage(joined.mapInArrow(_verify(size), "a binary, b binary, similarity double"), f"{name}-scored")


def components(links: DataFrame) -> DataFrame:
    """``node, class``: the smallest node of each connected component of ``links`` (``a``, ``b``).

    Every round points each node to the smallest of itself and its neighbours, and on to where that one points. Links between
    what is left are carried into the next round, where repeated ones and loops are gone, so rounds work on ever
    smaller tables. Nodes are digests: along a path they are in random order, so runs that fall from node to node are short, and
    rounds grow with the logarithm of the nodes. Minima and distinct links are combined map-side, so a pivot with very
    many links costs a row per task; the joins have staged tables on both sides, so a hot node's rows may be split.
    """
    edges, classes = stage(links.select("a", "b"), "links"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).withColumnRenamed("a", "node"), "low")
        onward = low.toDF("at", "class")
        step = stage(low.join(onward, F.col("low") == F.col("at")).select("node", "class"), "step")
        if classes is None:
            classes = step
        else:
            moved = classes.join(step.toDF("class", "next"), "class", "left")
            classes = stage(moved.select("node", F.coalesce("next", "class").alias("class")), "classes")
        ends = edges.join(step.toDF("a", "class_a"), "a").join(step.toDF("b", "class_b"), "b").filter("class_a <> class_b")
        edges = stage(ends.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct(), "links")
        if not edges.limit(1).count():
            return classes


def _beside_pivot(members: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Each member's similarity to its bucket's pivot, and the pivot as its class where the two are linked."""
    known = scored.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "similarity")
    known = known.union(known.select("pivot", "node", "similarity"))
    linked = F.col("similarity") >= threshold - ROUNDING
    return members.join(known, ["node", "pivot"], "left").withColumn("class", F.when(linked, F.col("pivot")).otherwise(F.col("node")))


def _in_class(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _unsettled(spread: DataFrame) -> DataFrame:
    """Members of the buckets that hold several classes."""
    several = spread.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    return spread.join(several.select("band", "key"), ["band", "key"])


def _next_pivots(spread: DataFrame) -> DataFrame:
    """Give each bucket the pivot that is most similar to its first one."""
    best = F.max_by("node", F.struct("similarity", "node"))
    others = spread.filter(F.col("node") != F.col("pivot")).groupBy("band", "key").agg(best.alias("pivot"))
    return spread.drop("pivot", "similarity").join(others, ["band", "key"])


def _shingles(size: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2)):
                owner, hashes, weights = weighted_shingles(data, offsets, size)
                n = len(offsets) - 1
                total = np.bincount(owner, weights, minlength=n).astype(np.int64)
                at = pa.array(first + owner)
                yield record_batch([
                    ("id", batch.column(0).take(at)), ("class", batch.column(1).take(at)), ("shingle", pa.array(hashes.view(np.int64))),
                    ("weight", pa.array(weights.astype(np.int64))), ("total", pa.array(total[owner])),
                    ("bits", pa.nulls(len(owner), pa.list_(pa.int64()))),
                ])
                # And a row per node: each shingle flips a bit, by its hash. Shared ones flip the same bits in both nodes.
                place = (mix(hashes) % np.uint64(64 * BIT_WORDS)).astype(np.int64)
                bits = np.zeros((n, BIT_WORDS), np.uint64)
                np.bitwise_xor.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
                yield record_batch([
                    ("id", batch.column(0).slice(first, n)), ("class", batch.column(1).slice(first, n)), ("shingle", pa.nulls(n, pa.int64())),
                    ("weight", pa.nulls(n, pa.int64())), ("total", pa.array(total)),
                    ("bits", pa.ListArray.from_arrays(np.arange(0, (n + 1) * BIT_WORDS, BIT_WORDS, dtype=np.int32), pa.array(bits.ravel().view(np.int64)))),
                ])

    return explode


def _meetings(prefix: DataFrame, threshold: float) -> DataFrame:
    """Nodes of different classes that share a shingle of their prefixes and may be as similar as the threshold; few pairs repeat."""
    words = [f"bits{k}" for k in range(BIT_WORDS)]

    def side(name: str) -> DataFrame:
        return prefix.select("shingle", F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("class", "before", "recent", "total", *words)))

    # Parts p and q that are not shared leave a similarity of at most (1 - p)(1 - q) / (1 - pq). Nothing before the first shingle that
    # two nodes share is shared, so a similar pair passes there; at later ones it need not.
    p, q = (F.col(f"before_{name}") / F.col(f"total_{name}") for name in "ab")
    possible = (1 - p) * (1 - q) >= threshold * (1 - p * q) - ROUNDING
    # Of parts that add up to c, equal ones leave the most: (2 - c) / (2 + c). A bit that differs takes a shingle not shared.
    differing = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    possible &= differing <= (2 * (1 - threshold) / (1 + threshold) + ROUNDING) * F.greatest("total_a", "total_b")
    # Nodes that share a shingle shortly before this one have met there; the first that they share is never left out.
    possible &= ~F.arrays_overlap("recent_a", "recent_b")
    apart = F.expr("a < b AND class_a <> class_b")
    return side("a").join(side("b").withColumnRenamed("shingle", "same"), (F.col("shingle") == F.col("same")) & apart & possible).select("a", "b")


def _prefix_pairs(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs of ``nodes`` (``node``, ``class``, ``text``) of different classes that may be as similar as the threshold, none missing.

    Nodes and classes go by 64-bit hashes here.
    """
    named = stage(nodes.select("node", F.xxhash64("node").alias("id"), F.xxhash64("class").alias("class"), "text"), "open")
    exploded = stage(
        named.select("id", "class", "text").mapInArrow(
            _shingles(size), "id long, class long, shingle long, weight long, total long, bits array<long>"
        ),
        "entries",
    )
    entries = exploded.filter("shingle IS NOT NULL").drop("bits")
    words = [f"bits{k}" for k in range(BIT_WORDS)]
    sketches = exploded.filter("shingle IS NULL").select("id", *(F.col("bits")[k].alias(w) for k, w in enumerate(words)))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    # What no other node has comes first, then the rarest; equal ones by hash, the same order for every node.
    held = entries.join(shared, "shingle")
    own = Window.partitionBy("id")
    rarer = own.orderBy("n", "shingle")
    alone = F.col("total") - F.sum("weight").over(own)
    before = alone + F.coalesce(F.sum("weight").over(rarer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    recent = F.collect_list("shingle").over(rarer.rowsBetween(-RECENT, -1))
    prefix = held.withColumns({"before": before, "recent": recent}).filter(F.col("before") <= (1 - threshold + ROUNDING) * F.col("total"))
    prefix = stage(prefix.select("id", "class", "shingle", "before", "recent", "total").join(sketches, "id"), "prefix")

    pairs = _meetings(prefix, threshold).distinct()
    names = named.select("id", "node")
    return (
        pairs.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept`` and the locator ``__file, __row``.

    Words are lower-cased (A-Z). Two texts are linked if the probability Jaccard similarity of their shingles, each
    weighted by its count, is at least ``threshold``; without repeated shingles that is the
    Jaccard similarity of the sets. A text of fewer words than a shingle has one shingle of all its words. Texts with
    the same words are always one class, so NULL, empty and blank texts form a class. Classes are
    connected components; ``class_id`` is the smallest id in it (NULL is the largest) and the first stored row with
    that id stays, also if rows or ids repeat. Whole texts of any length are compared. An empty table
    gives an empty result. Only the id and the text are read.
    """
    located = with_locator(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "documents")
    kind = located.schema["doc_id"].dataType.simpleString()
    rows = stage(
        located.select(FILE, ROW, "doc_id", "text").mapInArrow(
            _nodes(shingle_words, bands, band_rows),
            f"{FILE} bigint, {ROW} bigint, doc_id {kind}, node binary, n_shingles bigint, keys array<bigint>",
        ),
        "nodes",
    )
    # A node's smallest locator names the row that lends its text.
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct(FILE, ROW)).alias("at"), F.first("keys").alias("keys"))
    buckets = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    # Buckets of several nodes only, each with its pivot.
    shared = buckets.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = stage(buckets.join(shared, ["band", "key"]), "members")
    at = nodes.select("node", F.col(f"at.{FILE}").alias(FILE), F.col(f"at.{ROW}").alias(ROW))
    lenders = stage(members.select("node").distinct().join(at, "node"), "lenders")
    texts = stage(located.select(FILE, ROW, "text").join(lenders.hint("merge"), [FILE, ROW]).select("node", "text"), "texts")

    # Pivots: first the smallest node, then the one most similar to it, which the group may be copies of.
    spread, links = members.withColumn("class", F.col("node")), None
    for turn in range(PIVOTS):
        pivots = spread.filter(F.col("node") == F.col("pivot")).select("band", "key", F.col("class").alias("pivot_class"))
        pairs = (
            spread.join(pivots, ["band", "key"]).filter(F.col("class") != F.col("pivot_class"))
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        )
        scored = _scored(pairs, texts, shingle_words, f"star{turn}")
        found = scored.filter(F.col("similarity") >= threshold - ROUNDING).select("a", "b")
        links = found if links is None else links.unionByName(found)
        if turn + 1 < PIVOTS:
            spread = stage(_next_pivots(_unsettled(_beside_pivot(spread.drop("class"), scored, threshold))), f"pivots{turn}")
    classes = components(links)
    spread = _in_class(spread.drop("class"), classes)

    # Nodes that some bucket still holds together with another class.
    open_nodes = stage(_unsettled(spread).select("node", "class").distinct(), "unsettled")
    open_pairs = _prefix_pairs(open_nodes.join(texts, "node"), shingle_words, threshold)
    completed = _scored(open_pairs, texts, shingle_words, "rest").filter(F.col("similarity") >= threshold - ROUNDING).select("a", "b")

    # The last links are between classes, which are few: these become the nodes.
    known = open_nodes.select("node", "class")
    between = completed.join(known.toDF("a", "class_a"), "a").join(known.toDF("b", "class_b"), "b")
    merged = components(between.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct())
    named = _in_class(rows, classes).join(merged.toDF("class", "merged"), "class", "left").withColumn("class", F.coalesce("merged", "class"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)
    heads = stage(named.groupBy("class").agg(F.min(first).alias("head"), F.count("*").alias("class_size")), "heads")
    return named.join(heads, "class").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "class_size",
        ((F.col("head")[FILE] == F.col(FILE)) & (F.col("head")[ROW] == F.col(ROW))).alias("kept"), FILE, ROW,
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which one stays per class, with all their columns."""
    plain = positional(docs)
    located = with_locator(plain, "documents")
    found = near_dedup(located, place_of(docs, id_col), place_of(docs, text_col), **options)
    kept = stage(found.filter("kept").select(FILE, ROW), "kept")
    return located.join(kept, [FILE, ROW], "left_semi").select(*plain.columns).toDF(*docs.columns)
