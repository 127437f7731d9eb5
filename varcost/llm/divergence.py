"""How far the vocabularies of sources drift apart, by chunk factorization.

1. Texts are read in *blocks*. A block keeps its different whitespace chunks, without the bytes around them that no term holds, and
   of each document how often it has which.
2. The chunks of all blocks are counted, and each globally distinct chunk is cut into terms once.
3. A term cannot be in more documents than its chunks are, so terms that cannot reach the limit are dropped there, before
   anything moves back. No term is lost by that.
4. The terms of the other chunks are joined back to the blocks that have them. A block adds up, per document, the chunks that
   share a term, and hands over distinct documents and occurrences per group and term.
5. Shares and divergences are whole numbers throughout. Pairs of sources are compared in tiles of ``TILE`` by
   ``TILE`` sources over a bucket of terms; a task holds no more, however many sources or terms there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varcost.llm.chunks import chunk_spans, distinct_chunks, lowered, packed, unpacked
from varcost.llm.common import record_batch, text_of, text_slices
from varcost.llm.sized import broadcast_if_small
from varcost.sinks.scratch import stage

# Fixed value: a term is a run of letters and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Fixed value: shares are counted in units of one over this.
SCALE = 1_000_000_000
_TERM_BYTE = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
MIN_DOCS = 10
TOP_TERMS = 10
# Text that one block takes, and that is cut into chunks at once.
BLOCK_BYTES, SLICE_BYTES = 32 << 20, 4 << 20
# Sources on each side of a tile, and terms of a bucket (on average).
TILE, BUCKET_TERMS = 256, 4096
# Chunks that are handed over at once.
BATCH_ROWS = 1 << 16


# Blocks ------------------------------------------------------------------------------------


class _Block:
    """The chunks of a block, and the chunks of each of its documents."""

    def __init__(self, name: int):
        self.name, self.size = name, 0
        self._place: dict[bytes, int] = {}
        self._docs = np.zeros(1 << 16, np.int64)
        self._groups: dict[tuple[str, str], int] = {}
        self._parts: list[tuple[np.ndarray, ...]] = []

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        data = lowered(data)
        starts, ends, texts = trimmed(data, *chunk_spans(data, offsets))
        found, index = distinct_chunks(data, starts, ends)
        place = np.fromiter((self._place.setdefault(c, len(self._place)) for c in found), np.int64, len(found))
        # Each document's chunks, with their counts.
        doc = np.repeat(np.arange(len(langs)), np.diff(texts))
        pairs, times = np.unique(doc * max(1, len(found)) + index, return_counts=True)
        doc, chunk = pairs // max(1, len(found)), place[pairs % max(1, len(found))]
        if len(self._docs) < len(self._place):
            self._docs = np.concatenate([self._docs, np.zeros(2 * len(self._place) - len(self._docs), np.int64)])
        np.add.at(self._docs, chunk, 1)
        groups = [self._groups.setdefault(g, len(self._groups)) for g in zip(langs, sources)]
        # Chunks of a document rise, so that differences of neighbours are small.
        order = np.lexsort((chunk, doc))
        chunk, times, sizes = chunk[order], times[order], np.bincount(doc, minlength=len(langs))
        step = np.diff(chunk, prepend=0)
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        step[begin] = chunk[begin]
        self._parts.append((np.array(groups, np.int64), sizes, step, times))
        self.size += len(data)

    def rows(self) -> Iterator[pa.RecordBatch]:
        chunks = list(self._place)
        for at in range(0, len(chunks), BATCH_ROWS):
            part = chunks[at:at + BATCH_ROWS]
            yield _row(
                self.name, place=pa.array(np.arange(at, at + len(part))), chunk=pa.array(part, pa.binary()).cast(pa.string()),
                docs=pa.array(self._docs[at:at + len(part)]), n=len(part),
            )
        payload = {k: pa.array([packed(np.concatenate(p))], pa.binary()) for k, p in zip(_PAYLOAD, zip(*self._parts))}
        langs, sources = zip(*self._groups)
        lists = {"langs": pa.array([langs], pa.list_(pa.string())), "sources": pa.array([sources], pa.list_(pa.string()))}
        yield _row(self.name, n=1, **payload, **lists)


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks from their first to their last byte that terms are made of; chunks without such a byte go."""
    of_term = _TERM_BYTE[data]
    at, before = np.flatnonzero(of_term), np.concatenate([[0], np.cumsum(of_term)])
    some = before[starts] < before[ends]
    first, last = at[before[starts[some]]], at[before[ends[some]] - 1] + 1
    return first, last, np.concatenate([[0], np.cumsum(some)])[texts]


_PAYLOAD = ("doc_groups", "doc_sizes", "pair_steps", "pair_times")
_BLOCK_TYPES = {
    "block": pa.int64(), "place": pa.int64(), "chunk": pa.string(), "docs": pa.int64(), **{k: pa.binary() for k in _PAYLOAD},
    "langs": pa.list_(pa.string()), "sources": pa.list_(pa.string()),
}
_BLOCK_SCHEMA = (
    "block long, place long, chunk string, docs long, " + ", ".join(f"{k} binary" for k in _PAYLOAD) + ", langs array<string>, sources array<string>"
)


def _row(block: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    columns["block"] = pa.array([block] * n, pa.int64())
    return record_batch([(name, columns.get(name, pa.nulls(n, kind))) for name, kind in _BLOCK_TYPES.items()])


def _read_blocks(block_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, data, offsets in text_slices(batch.column(2), SLICE_BYTES):
                rows = slice(first, first + len(offsets) - 1)
                block.add(langs[rows], sources[rows], data, offsets)
                if block.size >= block_bytes:
                    yield from block.rows()
                    block = _Block(block.name + 1)
        if block._parts:
            yield from block.rows()

    return read


def _count_terms(terms: pa.Table, blocks: pa.Table) -> pa.Table:
    """Distinct documents and occurrences per group and term of one block, from the terms of its chunks."""
    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "docs": pa.int64(), "occurrences": pa.int64()}
    if not terms.num_rows or not blocks.num_rows:
        return pa.table({k: pa.array([], t) for k, t in kinds.items()})
    row = blocks.to_pylist()[0]
    groups, sizes, steps, times = (unpacked(row[k]) for k in _PAYLOAD)
    chunks = np.cumsum(steps)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    chunks -= np.repeat(chunks[begin] - steps[begin], sizes[sizes > 0])
    lists = terms["terms"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    ids, vocabulary = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    n_terms = len(vocabulary)
    # The terms of the chunk at each place: a range of ``ids``.
    length = np.diff(lists.offsets.to_numpy())
    begin, count = np.zeros(chunks.max(initial=0) + 1, np.int64), np.zeros(chunks.max(initial=0) + 1, np.int64)
    place = terms["place"].to_numpy()
    begin[place], count[place] = np.cumsum(length) - length, length
    doc = np.repeat(np.arange(len(sizes)), sizes)
    repeat = count[chunks]
    total = np.cumsum(repeat) - repeat
    term = ids[np.repeat(begin[chunks] - total, repeat) + np.arange(repeat.sum())]
    # Chunks of a document that share a term count as one document.
    key, index = np.unique(np.repeat(doc, repeat) * n_terms + term, return_inverse=True)
    occurrences = np.bincount(index, np.repeat(times, repeat)).astype(np.int64)
    key, index = np.unique(groups[key // n_terms] * n_terms + key % n_terms, return_inverse=True)
    group = pa.array(key // n_terms)
    return pa.table({
        "lang": pa.array(row["langs"], pa.string()).take(group), "source": pa.array(row["sources"], pa.string()).take(group),
        "term": vocabulary.take(pa.array(key % n_terms)), "docs": pa.array(np.bincount(index)),
        "occurrences": pa.array(np.bincount(index, occurrences).astype(np.int64)),
    })


# Pairs of sources --------------------------------------------------------------------------


def _compare(shares: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over the terms of a bucket, for the pairs of sources of a tile."""
    kinds = {"lang": pa.string(), "a": pa.int64(), "b": pa.int64(), "value": pa.int64()}
    if not shares.num_rows or not sources.num_rows:
        return pa.table({k: pa.array([], t) for k, t in kinds.items()})
    number = sources["nr"].to_numpy()
    order = np.argsort(number)
    number, absent = number[order], sources["absent"].to_numpy()[order]
    term = shares["term"].combine_chunks().dictionary_encode()
    share = np.repeat(absent[:, None], len(term.dictionary), axis=1)
    share[np.searchsorted(number, shares["number"].to_numpy()), term.indices.to_numpy(zero_copy_only=False)] = shares["share"].to_numpy()
    low, high = sources["low"][0].as_py(), sources["high"][0].as_py()
    left, right = np.flatnonzero(number // TILE == low), np.flatnonzero(number // TILE == high)
    a, b, values = [], [], []
    for k in left:
        others = right[number[right] > number[k]]
        if len(others):
            p, q = share[k][None, :], share[others]
            a.append(np.full(len(others), number[k]))
            b.append(number[others])
            values.append(((p - q) * (p - q) // (p + q)).sum(axis=1))
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, values)]
    lang = pa.array([sources["its_lang"][0].as_py()] * len(columns[0]), pa.string())
    return pa.table({"lang": lang, **{k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "value"), columns)}})


def _share(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * terms)), without rounding at any size."""
    part = F.lit(scale).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = (total + 2 * terms).cast("decimal(20,0)")
    return F.when(whole > 0, F.lit(1) + F.floor((part - part % whole) / whole).cast("long"))


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
    bucket_terms: int = BUCKET_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how a source's terms differ from the other sources' and the language's.

    NULL texts, languages and sources count as empty. A language keeps the terms (A-Z lower-cased) in at least ``min_docs`` of its
    documents. The share of a kept term is ``1 + floor(scale * (count + 2) / (N + 2 V))``; N is the sum of counts over the V kept
    terms. Two shares p and q differ by ``floor((p - q)**2 / (p + q))``. Part ``pair`` adds that up over all kept terms for
    each other source of the language (0 if none is kept); part ``term`` has the ``top`` terms that the source has and
    favours over its language. Ranks start at 1, by value (falling) and then item (bytewise). Sources whose documents have no
    terms count as others. Repeated rows count each; whole texts of any length are read. An empty table gives an empty result.
    Only the three columns are read.
    """
    narrow = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), F.col(text_col).alias("text"))
    groups = stage(narrow.groupBy("lang", "source").agg(F.count("*").alias("documents")), "groups")
    blocks = stage(narrow.mapInArrow(_read_blocks(block_bytes), _BLOCK_SCHEMA), "blocks")
    chunks = blocks.filter("chunk IS NOT NULL").select("block", "place", "chunk", "docs")

    # Each distinct chunk is cut once. A term has at most as many documents as its chunks together.
    cut = stage(
        chunks.groupBy("chunk").agg(F.sum("docs").alias("docs"))
        .select("chunk", "docs", F.explode(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).alias("term")),
        "cut",
    )
    possible = stage(cut.groupBy("term").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs).select("term"), "possible")
    wanted = cut.join(broadcast_if_small(possible), "term", "left_semi").groupBy("chunk").agg(F.collect_list("term").alias("terms"))
    back = chunks.select("block", "place", "chunk").join(wanted, "chunk").select("block", "place", "terms")
    payload = blocks.filter("chunk IS NULL").select(F.col("block").alias("owner"), *_PAYLOAD, "langs", "sources")
    found = back.groupBy("block").cogroup(payload.groupBy("owner")).applyInArrow(
        _count_terms, "lang string, source string, term string, docs long, occurrences long"
    )

    # One exchange for both: the counts of a term's sources, and what they add up to in the language.
    whole = Window.partitionBy("lang", "term")
    counted = (
        found.repartition("lang", "term").groupBy("lang", "term", "source")
        .agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("n"))
        .withColumns({"lang_docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole), "first": F.min("source").over(whole)})
        .filter(F.col("lang_docs") >= min_docs)
    )
    kept = stage(counted.select("lang", "term", "source", "n", "lang_n", (F.col("first") == F.col("source")).alias("first")), "kept")

    # Totals of the groups, with the number of each source in its language.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    by_lang = Window.partitionBy("lang")
    totals = (
        groups.select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
        .withColumns({
            "terms": F.sum("firsts").over(by_lang), "lang_total": F.sum("total").over(by_lang),
            "number": F.row_number().over(by_lang.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(by_lang),
        })
    )
    totals = stage(
        totals.withColumn("absent", _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), scale)).drop("firsts"), "totals"
    )
    shared = kept.join(broadcast_if_small(totals), ["lang", "source"]).select(
        "lang", "source", "term", "number", "sources",
        _share(F.col("n"), F.col("total"), F.col("terms"), scale).alias("share"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), scale).alias("lang_share"),
    )

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
        return rows.withColumn("rank", F.row_number().over(order))

    gap = F.col("share") - F.col("lang_share")
    favoured = shared.filter(gap > 0).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        F.expr("(share - lang_share) * (share - lang_share) div (share + lang_share)").alias("value"),
    )
    favoured = ranked(favoured).filter(F.col("rank") <= top)

    # Pairs: every tile of sources meets every bucket of terms that one of its sources has.
    most = totals.agg(F.max("terms")).first()[0] or 0
    buckets = max(1, -(-most // bucket_terms))
    tile = F.floor(F.col("number") / TILE)
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / TILE))
    ends = F.transform(tiles, lambda t: F.struct(F.least(t, tile).alias("low"), F.greatest(t, tile).alias("high")))
    left = shared.filter("sources > 1").select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "term", "number", "share", F.explode(ends).alias("t")
    ).select("*", "t.low", "t.high").drop("t")
    right = totals.filter("sources > 1").select(F.col("lang").alias("its_lang"), F.col("number").alias("nr"), "absent", F.explode(ends).alias("t")).withColumn(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))
    ).select("*", "t.low", "t.high").drop("t")
    tiled = ["bucket", "low", "high"]
    compared = left.groupBy("lang", *tiled).cogroup(right.groupBy("its_lang", *tiled)).applyInArrow(_compare, "lang string, a long, b long, value long")
    compared = compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = totals.select("lang", "source", F.col("number").alias("mine"))
    other = totals.select("lang", F.col("source").alias("item"), F.col("number").alias("its"))
    pairs = one.join(other, "lang").filter("mine <> its").withColumns({"a": F.least("mine", "its"), "b": F.greatest("mine", "its")})
    pairs = pairs.join(compared, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    return ranked(pairs).unionByName(favoured)
