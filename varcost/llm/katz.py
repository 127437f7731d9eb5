"""Language-model scoring by Katz backoff.

Counts of n-grams are discounted after Good and Turing, with smoothed counts of counts; what the discounts free is given to the words not seen after a
context, in proportion to the next shorter model, with weights that normalise exactly. Tokens are the
lower-case (A-Z) words of a text and one end.

Texts are read in *blocks*, once; every row gets a number there, in the same pass that reads its text. A block keeps its tokens as
numbers into its own list of distinct words, the most frequent first. Counting is an exchange: each block sends every n-gram it has
once, as a sorted array of 64-bit hashes with its training counts, to the bucket of the hash. The bucket adds the blocks' counts,
keeps them as its part of the n-gram table, answers each block with the totals in the same order, and names one block the n-gram's
owner. No n-gram takes more than a row's part per block, however frequent, and no table of all n-grams
is ever collected or broadcast. A token that backs off needs its contexts' weights; those are a table joined by context.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.llm.chunks import packed, unpacked
from varcost.llm.common import Words, mix, record_batch, text_of, text_slices
from varcost.sinks.scratch import stage

ORDER = 2
# Counts above this are reliable and not discounted (Katz).
RELIABLE = 5
# Every context keeps this much count back, so that contexts whose counts are all reliable leave mass, too.
RESERVE = 0.1
# Fixed value of the base model: what is added to each count.
ADDED = 0.1
# Text that one block takes, and n-grams that one bucket takes.
BLOCK_BYTES = 4 << 20
BUCKET_GRAMS = 2_000_000
# Rows of results that are handed over at once.
BATCH_ROWS = 1 << 16

END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)


# Blocks ------------------------------------------------------------------------------------


# A row of a block, and before that one row per text: its number, id and whether it is learned from.
_BLOCK = {
    "block": pa.int64(), "rows": pa.binary(), "train": pa.binary(), "sizes": pa.binary(), "words": pa.binary(), "tokens": pa.binary(),
    "n_tokens": pa.int64(), "row": pa.int64(), "learn": pa.bool_(),
}
_BLOCK_SCHEMA = "block long, rows binary, train binary, sizes binary, words binary, tokens binary, n_tokens long, row long, learn boolean"


def _read_blocks(block_bytes: int):
    def row_of(n: int, doc_ids: pa.Array, **columns: pa.Array) -> pa.RecordBatch:
        return record_batch([("doc_id", doc_ids), *((k, columns.get(k, pa.nulls(n, kind))) for k, kind in _BLOCK.items())])

    def flush(block: int, docs: list, parts: list, kind: pa.DataType) -> pa.RecordBatch:
        ids, train, sizes = (np.concatenate([d[k] for d in docs]) for k in range(3))
        words, index, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        binary = {"rows": ids.tobytes(), "train": train.tobytes(), "sizes": sizes.tobytes(), "words": words[order].tobytes(), "tokens": packed(rank[index])}
        return row_of(
            1, pa.nulls(1, kind), block=pa.array([block], pa.int64()), n_tokens=pa.array([len(index)], pa.int64()),
            **{k: pa.array([v], pa.binary()) for k, v in binary.items()},
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = TaskContext.get().partitionId() << 32
        docs, parts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            yield row_of(batch.num_rows, batch.column(0), row=pa.array(rows), learn=batch.column(1))
            for first, data, offsets in text_slices(batch.column(2)):
                words, n = Words(data, offsets), len(offsets) - 1
                counts = np.diff(words.bounds) + 1
                tokens = np.full(int(counts.sum()), END, np.uint64)
                inside = np.ones(len(tokens), bool)
                inside[np.cumsum(counts) - 1] = False
                tokens[inside] = words.hashes
                docs.append((rows[first:first + n], train[first:first + n], counts.astype(np.int64)))
                parts.append(tokens)
                size += len(data)
                if size >= block_bytes:
                    yield flush(block, docs, parts, kind)
                    docs, parts, size, block = [], [], 0, block + 1
        if docs:
            yield flush(block, docs, parts, kind)

    return read


class Block:
    """The tokens of a block, and its n-grams of each length, named by hash."""

    def __init__(self, row: dict):
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.train = np.frombuffer(row["train"], bool)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.tokens = np.frombuffer(row["words"], np.uint64)[unpacked(row["tokens"])]
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        start = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.position = np.arange(len(self.tokens), dtype=np.int32) - start[self.doc]

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n-gram that ends at each token; before a text there are begin marks."""
        out = np.full(len(self.tokens), n, np.uint64)
        for back in range(n - 1, -1, -1):
            out *= np.uint64(0xD6E8FEB86659FD93)
            word = np.full_like(out, BEGIN)
            np.copyto(word[back:], self.tokens[:len(out) - back], where=self.position[back:] >= back)
            out += word
            out = mix(out)
        return out

    def contexts(self, n: int) -> np.ndarray:
        """Hash of the n - 1 tokens before each token; 0 if all of them are begin marks."""
        before = self.grams(n - 1)
        out = np.zeros_like(before)
        out[1:] = before[:-1]
        out[self.position == 0] = 0
        return out


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    for batch in batches:
        for k in range(batch.num_rows):  # one block at a time, each is large
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            yield row["block"], row


# Counting ----------------------------------------------------------------------------------


def _send(orders: Sequence[int], buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, row in _block_rows(batches):
            block = Block(row)
            trained = block.train[block.doc]
            for n in orders:
                keys, index = np.unique(block.grams(n), return_inverse=True)
                counts = np.bincount(index, weights=trained, minlength=len(keys)).astype(np.uint32)
                # Sorted keys cut into buckets are ranges; differences of neighbours are small numbers.
                edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(int)
                for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if b > a:
                        yield record_batch([
                            ("n", pa.array([n], pa.int32())), ("bucket", pa.array([bucket], pa.int32())),
                            ("block", pa.array([name], pa.int64())), ("keys", pa.array([_differences(keys[a:b])], pa.binary())),
                            ("counts", pa.array([_narrow(counts[a:b])], pa.binary())),
                        ])

    return send


def _differences(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, first all lowest bytes and last all highest, which are mostly 0 and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _sums(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(values: np.ndarray) -> bytes:
    """Small numbers in one byte each; the others follow with their places."""
    big = np.flatnonzero(values >= 255)
    short = np.minimum(values, 255).astype(np.uint8)
    return len(values).to_bytes(8, "little") + short.tobytes() + big.astype(np.uint32).tobytes() + values[big].astype(np.uint64).tobytes()


def _wide(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    values = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    big = (len(data) - 8 - n) // 12
    at = np.frombuffer(data, np.uint32, big, 8 + n)
    values[at] = np.frombuffer(data[8 + n + 4 * big:], np.uint64).astype(np.int64)
    return values


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of one bucket, for each block in the order of its keys (lowest bit: whether it is the owner); and the bucket's part of
    the n-gram table, without a block: the n-grams that training has, in order, and their counts."""
    keys = [_sums(k) for k in table["keys"].to_pylist()]
    counts = [_wide(c) for c in table["counts"].to_pylist()]
    sizes = [len(k) for k in keys]
    grams, first, index = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(index, weights=np.concatenate(counts)).astype(np.int64)
    owner = np.zeros(len(index), np.int64)
    owner[first] = 1
    answer = np.split(total[index] * 2 + owner, np.cumsum(sizes)[:-1])
    seen = total > 0
    n, bucket = table["n"].to_pylist(), table["bucket"].to_pylist()
    return pa.table({
        "n": pa.array([*n, n[0]], pa.int32()), "bucket": pa.array([*bucket, bucket[0]], pa.int32()),
        "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
        "grams": pa.array([*[None] * len(n), _differences(grams[seen])], pa.binary()),
        "totals": pa.array([*map(_narrow, answer), _narrow(total[seen])], pa.binary()),
    })


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per n and count: how many n-grams of the table have it. Different counts are few, at most the root of twice the tokens."""
    found: dict[int, Counter] = defaultdict(Counter)
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = _wide(data)
            # Nearly all counts are small: those are not sorted.
            small = np.bincount(seen[seen < 256], minlength=256)
            counts, kinds = np.unique(seen[seen >= 256], return_counts=True)
            found[n].update({r: int(small[r]) for r in np.flatnonzero(small).tolist() if r})
            found[n].update(dict(zip(counts.tolist(), kinds.tolist())))
    for n, kinds in found.items():
        yield record_batch([
            ("n", pa.array([n] * len(kinds), pa.int32())), ("count", pa.array(list(kinds), pa.int64())),
            ("kinds", pa.array(list(kinds.values()), pa.int64())),
        ])


def slope(kinds: np.ndarray, counts: np.ndarray) -> float:
    """Slope of log n[r] against log r over all counts r (rising), after Simple Good-Turing: n[r] is first spread over the gap
    to its neighbours, so that the counts nobody has weigh in. NaN for fewer than two counts."""
    if len(counts) < 2:
        return np.nan
    before = np.concatenate([[0], counts[:-1]])
    after = np.append(counts[1:], 2 * counts[-1] - counts[-2])
    x, y = np.log(counts), np.log(kinds / (0.5 * (after - before)))
    x = x - x.mean()
    return float((x * y).sum() / (x * x).sum())


def discounts(kinds: Sequence[int], reliable: int = RELIABLE, counts: Sequence[int] | None = None) -> np.ndarray:
    """Katz's factors d[r] for counts r up to ``reliable`` (index 0 unused), 1 beyond.

    ``kinds[k]`` n-grams have the count ``counts[k]``, or k. Good-Turing counts (r + 1) n[r+1] / n[r], scaled so that counts
    beyond ``reliable`` stay, with n[r] smoothed to a power of r (``slope``). They lie strictly between 0 and 1 for every r
    if the slope is below -1. A factor that does not is replaced by that of an absolute discount n1 / (n1 + 2 n2).
    """
    n, at = np.asarray(kinds, float), np.arange(len(kinds)) if counts is None else np.asarray(counts, np.int64)
    order = np.argsort(at)
    order = order[(n[order] > 0) & (at[order] > 0)]
    n, at = n[order], at[order]
    power = slope(n, at) + 1
    r = np.arange(1, reliable + 1)
    # (r + 1) n[r+1] / (r n[r]), and (reliable + 1) n[reliable + 1] / n[1].
    left, over = (1 + 1 / r) ** power, (reliable + 1.0) ** power
    with np.errstate(divide="ignore", invalid="ignore"):
        factors = (left - over) / (1 - over)
    one, two = (float(n[at == k].sum()) for k in (1, 2))
    cut = one / (one + 2 * two) if one and two else 0.5
    d = np.ones(reliable + 2)
    d[1:reliable + 1] = np.where((left < 1) & (factors > 0) & (factors < 1), factors, (r - cut) / r)
    return d


class Model:
    """Numbers that hold for all of the corpus: training tokens, words and texts, discounts of each order, and the
    probability of the unknown word."""

    def __init__(self, tokens: int, words: int, docs: int, factors: dict[int, np.ndarray], unknown: float):
        self.tokens, self.words, self.docs, self.factors, self.unknown = tokens, words, docs, factors, unknown

    def discounted(self, n: int, counts: np.ndarray) -> np.ndarray:
        d = self.factors[n]
        return counts * d[np.minimum(counts, len(d) - 1)]

    def seen(self, n: int, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Discounted probability of n-grams with these counts after contexts with these counts."""
        return self.discounted(n, counts) / (contexts + RESERVE)


# Scoring -----------------------------------------------------------------------------------


def _counts(block: Block, answers: list[dict], orders: Sequence[int], docs: int):
    """Per order: total count of the n-gram at each token, of its context, and a mark on one token per owned n-gram."""
    out = {}
    for n in orders:
        mine = sorted((a for a in answers if a["n"] == n), key=lambda a: a["bucket"])
        values = np.concatenate([_wide(a["totals"]) for a in mine]) if mine else np.zeros(0, np.int64)
        keys, first, index = np.unique(block.grams(n), return_index=True, return_inverse=True)
        owned = first[(values & 1) == 1]
        out[n] = (values >> 1)[index], owned
    total = {n: out[n][0] for n in orders}
    context = {}
    for n in orders[1:]:
        before = np.zeros_like(total[n - 1])
        before[1:] = total[n - 1][:-1]
        before[block.position == 0] = docs
        context[n] = before
    return total, context, {n: out[n][1] for n in orders}


def _score(model: Model, order: int):
    """Per row of a text: its counts, base score and what is known of its score; per context: mass seen after it;
    per (row, context) that a token backs off from: how often."""
    orders = range(1, order + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        for _, row in _block_rows(batches):
            block = Block(row)
            total, context, owned = _counts(block, row["answers"], orders, model.docs)
            c = total[1]
            docs = len(block.sizes)
            sums = lambda x: np.bincount(block.doc, weights=x, minlength=docs)
            base = sums(np.log10((c + ADDED) / (model.tokens + ADDED * (model.words + 1))))
            level = np.ones(len(c), np.int8)
            direct = {1: np.where(c > 0, model.seen(1, c, model.tokens), model.unknown)}
            best = direct[1].copy()
            for n in orders[1:]:
                direct[n] = model.seen(n, total[n], context[n])
                np.copyto(level, n, where=total[n] > 0)
                np.copyto(best, direct[n], where=total[n] > 0)
            yield from _rows("text", block.rows, {
                "x": base, "y": sums(np.log10(best)), "n": block.sizes, "m": sums(c > 0).astype(np.int64),
            })
            for n in orders[1:]:
                names = block.contexts(n)
                at = owned[n][total[n][owned[n]] > 0]
                if len(at):
                    keys, index = np.unique(names[at], return_inverse=True)
                    yield from _rows("context", keys.view(np.int64), {
                        "x": np.bincount(index, weights=direct[n][at]), "y": np.bincount(index, weights=direct[n - 1][at]),
                        "n": np.full(len(keys), n), "m": np.zeros(len(keys), np.int64),
                    })
                # Weights are needed where the n-gram is unseen but its context is known.
                off = np.flatnonzero((level < n) & (context[n] > 0))
                if len(off):
                    doc, name = block.doc[off], names[off].view(np.int64)
                    by = np.lexsort((name, doc))
                    doc, name = doc[by], name[by]
                    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])]))
                    times = np.diff(np.append(at, len(doc)))
                    yield from _rows("backoff", block.rows[doc[at]], {"x": times, "y": np.zeros(len(times)), "n": np.full(len(times), n), "m": name[at]})

    return score


def _rows(kind: str, keys: np.ndarray, values: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """In batches of bounded size: a batch is in memory on both sides at once."""
    for at in range(0, len(keys), BATCH_ROWS):
        part = slice(at, at + BATCH_ROWS)
        n = len(keys[part])
        yield record_batch([
            ("kind", pa.array([kind] * n, pa.string())), ("key", pa.array(np.ascontiguousarray(keys[part]))),
            ("x", pa.array(values["x"][part].astype(float))), ("y", pa.array(values["y"][part].astype(float))),
            ("n", pa.array(values["n"][part].astype(np.int64))), ("m", pa.array(np.ascontiguousarray(values["m"][part]))),
        ])


@contextmanager
def _single_rows(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python one by one: a block with its answers is large enough for a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def katz_scores(
    docs: DataFrame,
    train,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    bucket_grams: int = BUCKET_GRAMS,
) -> DataFrame:
    """One row per input row: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` is a condition on the row: whether the model learns from it (NULL: it does not). ``score`` is the log10
    probability of the whole text. NULL, empty and blank texts have one token, the end. A word never seen in
    training has the probability of the one unknown word. Without any training token every score is that of an
    unknown word with probability 1. Rows with a NULL or repeated id are texts of their own. An empty
    table gives an empty result. Only the columns of ``train``, the id and the text are read.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("learn"), text_of(text_col).alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    # Numbers, ids and texts of the rows come from one pass, so they belong together however the rows are made.
    read = stage(keyed.mapInArrow(_read_blocks(block_bytes), f"doc_id {kind}, {_BLOCK_SCHEMA}"), "blocks")
    names = read.filter("row IS NOT NULL").select("row", "doc_id", F.col("learn").alias("train"))
    blocks = read.filter("block IS NOT NULL").select("block", "rows", "train", "sizes", "words", "tokens", "n_tokens")
    grams = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-grams // bucket_grams))
    orders = list(range(1, order + 1))
    counted = stage(
        blocks.mapInArrow(_send(orders, buckets), "n int, bucket int, block bigint, keys binary, counts binary")
        .groupBy("n", "bucket").applyInArrow(_add_up, "n int, bucket int, block bigint, grams binary, totals binary"),
        "ngrams",
    )
    answers, ngrams = counted.filter("block IS NOT NULL").drop("grams"), counted.filter("block IS NULL")
    kinds = (
        ngrams.select("n", "totals").mapInArrow(_histogram, "n int, count bigint, kinds bigint")
        .groupBy("n", "count").agg(F.sum("kinds").alias("kinds"))
    )
    stats = {n: {} for n in orders}
    for s in kinds.collect():  # a row per order and count that occurs
        stats[s["n"]][s["count"]] = s["kinds"]
    trained = names.filter("train").count()
    factors = {n: discounts(list(found.values()), counts=list(found)) for n, found in stats.items()}
    one = stats[1]
    tokens = sum(r * k for r, k in one.items())
    cut = sum(one.get(r, 0) * r * (1 - factors[1][r]) for r in range(1, RELIABLE + 1))
    # What the words seen leave goes to the one unknown word.
    model = Model(tokens, sum(one.values()), trained, factors, (cut + RESERVE) / (tokens + RESERVE))

    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "totals")).alias("answers"))
    with _single_rows(docs.sparkSession):
        scored = stage(
            blocks.join(gathered.hint("merge"), "block")
            .mapInArrow(_score(model, order), "kind string, key bigint, x double, y double, n bigint, m bigint"),
            "scored",
        )
    weights = (
        scored.filter("kind = 'context'").groupBy("n", F.col("key").alias("context"))
        .agg(F.sum("x").alias("seen"), F.sum("y").alias("below"))
        .select("n", "context", F.log10((1 - F.col("seen")) / F.greatest(1 - F.col("below"), F.lit(1e-12))).alias("weight"))
    )
    backoff = (
        scored.filter("kind = 'backoff'").select(F.col("key").alias("row"), "x", "n", F.col("m").alias("context"))
        .join(weights.hint("merge"), ["n", "context"]).groupBy("row").agg(F.sum(F.col("x") * F.col("weight")).alias("backoff"))
    )
    return (
        scored.filter("kind = 'text'").select(F.col("key").alias("row"), F.col("x").alias("base_score"), F.col("y").alias("known"), F.col("n").alias("n_tokens"), F.col("m").alias("n_known"))
        .join(names, "row").join(backoff, "row", "left")
        .select(
            "doc_id", "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
            "base_score", (F.col("known") + F.coalesce("backoff", F.lit(0.0))).alias("score"),
        )
    )
