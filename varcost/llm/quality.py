"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A text is described by statistics of its bytes, words and lines. Random cosine features of the scaled statistics
approximate a Gaussian kernel; the normal equations of a ridge regression on the labels are summed
partition by partition and solved once. Isotonic regression on labelled texts that the ridge has not
seen turns its scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varcost.llm.common import RunningHash, Words, record_batch, text_slices
from varcost.sinks.scratch import stage

FEATURES = 256
# Columns of ``statistics``.
STATISTICS = 22
RIDGE = 1e-3
SEED = 20
# Labelled rows that the classifier is fitted on at most, chosen by hash.
MAX_FIT_ROWS = 200_000
FIT_PARTITIONS = 16
CALIBRATION_BINS = 10_000

# Classes of bytes.
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_BLANK, _STOPS = (32, 9, 10, 11, 12, 13), b".,;:!?'\"-()"
_OTHER = [b for b in range(33, 127) if not (b in _UPPER or b in _LOWER or b in _DIGIT or b in _STOPS)]


def _flags(bytes_) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(bytes_)] = 1
    return table


_CLASSES = [_flags(k) for k in (_UPPER, _LOWER, _DIGIT, _BLANK, _STOPS, _OTHER, range(128, 256), b"\n", b"!")]


def _spread(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: share of distinct values, and of the most frequent one."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, owner[at], np.diff(np.append(at, len(owner))))
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.bincount(owner[at], minlength=n) / total, top / total


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics per text; all of an empty text's are 0."""
    out = []
    for _, data, offsets in text_slices(texts):
        n, sizes = len(offsets) - 1, np.diff(offsets)
        size = np.maximum(sizes, 1)
        sums = [np.diff(np.concatenate([[0], np.cumsum(k[data])])[offsets]) for k in _CLASSES]
        words = Words(data, offsets)
        counts = np.diff(words.bounds)
        owner = np.repeat(np.arange(n), counts)
        many = np.maximum(counts, 1)
        distinct, top = _spread(owner, words.hashes, n)
        pairs, bounds = words.shingles(2)
        distinct_pairs, top_pair = _spread(np.repeat(np.arange(n), np.diff(bounds)), pairs, n)
        last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
        odd = np.bincount(owner, weights=_CLASSES[5][last], minlength=n)
        loud = np.bincount(owner, weights=last == 33, minlength=n)
        lengths = (words.ends - words.starts).astype(float)
        mean = np.bincount(owner, weights=lengths, minlength=n) / many
        square = np.bincount(owner, weights=lengths**2, minlength=n) / many
        # Lines: after each newline and at the start of each text that is not empty.
        begins = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
        begins = begins[begins < len(data)]
        line_owner = np.searchsorted(offsets, begins, side="right") - 1
        ends = np.minimum(np.append(begins[1:], len(data)), offsets[line_owner + 1])
        distinct_lines, top_line = _spread(line_owner, RunningHash(data).of(begins, ends), n)
        out.append(np.column_stack([
            *(s / size for s in sums), np.log1p(sizes), np.log1p(counts), np.log1p(sums[7]),
            distinct, top, distinct_pairs, top_pair, odd / many, loud / many, mean, np.sqrt(np.maximum(square - mean**2, 0)),
            distinct_lines, top_line,
        ]) * (sizes > 0)[:, None])
    return np.concatenate(out) if out else np.zeros((0, STATISTICS))


def text_statistics(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(pa.array(texts, pa.string(), from_pandas=True))))

    return described(text)


class Scorer:
    """Fitted classifier: probability of label 1 from statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n_features: int, seed: int):
        self.mean, self.scale = mean, scale
        draw = np.random.default_rng(seed)
        # Width of the kernel: the usual distance of scaled statistics.
        self.directions = draw.normal(size=(len(mean), n_features)) / np.sqrt(2 * len(mean))
        self.phases = draw.uniform(0, 2 * np.pi, n_features)
        self.weights = np.zeros(n_features + 1)
        self.steps = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)
        return np.column_stack([phi, np.ones(len(phi))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -0.5, 1.5)

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.steps)


def isotonic(scores: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing rates for sorted scores: pool neighbours that violate the order.

    Returns the pools' mean scores and rates, to be interpolated.
    """
    pools: list[list[float]] = []
    for s, p, t in zip(scores, positives, totals):
        pools.append([s * t, p, t])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([s / t for s, _, t in pools]), np.array([p / t for _, p, t in pools])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), float).reshape(batch.num_rows, -1)


def fit(
    described: DataFrame, n_features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED, max_fit_rows: int = MAX_FIT_ROWS,
    unlearned: float = 0.5,
) -> Scorer:
    """Fit on rows ``key, stats, label``; rows without a label are ignored, and beyond ``max_fit_rows`` rows a share
    is chosen by hash of the key. A quarter of the rows, also by hash, is kept for the calibration.

    Without rows every score is ``unlearned``. What comes to the driver is of fixed size: sums, two matrices' worth of normal
    equations per partition, of which there are at most ``FIT_PARTITIONS``, and binned counts.
    """
    known = described.filter("label IS NOT NULL AND stats IS NOT NULL")
    n = known.count()
    if n > max_fit_rows:
        known = known.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(max_fit_rows / n * (1 << 30)))
    known = stage(known.withColumn("calibrate", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(4)) == 0).coalesce(FIT_PARTITIONS), "fit")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            if len(x):
                yield record_batch([("n", pa.array([len(x)], pa.int64())), ("total", pa.array([x.sum(axis=0).tolist()])), ("square", pa.array([(x**2).sum(axis=0).tolist()]))])

    parts = known.select("stats").mapInArrow(moments, "n bigint, total array<double>, square array<double>").collect()
    if not parts:
        scorer = Scorer(np.zeros(STATISTICS), np.ones(STATISTICS), n_features, seed)
        scorer.steps = np.array([0.0]), np.array([unlearned])
        return scorer
    count = sum(p["n"] for p in parts)
    mean = sum(np.array(p["total"]) for p in parts) / count
    variance = sum(np.array(p["square"]) for p in parts) / count - mean**2
    scorer = Scorer(mean, np.where(variance > 1e-12, np.sqrt(np.maximum(variance, 1e-12)), 1.0), n_features, seed)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for batch in batches:
            phi = scorer.features(_matrix(batch))
            gram += phi.T @ phi
            right += phi.T @ batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        yield record_batch([("gram", pa.array([gram.tobytes()], pa.binary())), ("right", pa.array([right.tobytes()], pa.binary()))])

    summed = known.filter("NOT calibrate").select("stats", "label").mapInArrow(equations, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(p["gram"]) for p in summed).reshape(n_features + 1, -1)
    right = sum(np.frombuffer(p["right"]) for p in summed)
    scorer.weights = np.linalg.solve(gram + ridge * max(count, 1) / n_features * np.eye(n_features + 1), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.round((scorer.raw(_matrix(batch)) + 0.5) / 2 * CALIBRATION_BINS).astype(np.int64)
            yield record_batch([("bin", pa.array(place)), ("label", batch.column("label"))])

    def rates(rows: DataFrame) -> list:
        return (
            rows.select("stats", F.col("label").cast("double").alias("label"))
            .mapInArrow(binned, "bin bigint, label double")
            .groupBy("bin").agg(F.sum("label").alias("positives"), F.count("*").alias("total")).orderBy("bin").collect()
        )

    # With very few labels none may be kept for the calibration; then the fitted ones serve.
    bins = rates(known.filter("calibrate")) or rates(known)
    scorer.steps = isotonic(
        np.array([b["bin"] / CALIBRATION_BINS * 2 - 0.5 for b in bins]), np.array([b["positives"] for b in bins]),
        np.array([float(b["total"]) for b in bins]),
    )
    return scorer


def score_column(scorer: Scorer, stats: str) -> Column:
    @F.pandas_udf("double")
    def probability(values: pd.Series) -> pd.Series:
        return pd.Series(scorer.probability(np.array(values.tolist(), float).reshape(len(values), -1)))

    return probability(F.col(stats))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **options,
) -> DataFrame:
    """The rows of ``docs`` with their columns and ``score``, the probability of label 1.

    The classifier learns from the labelled rows for which ``learn`` is true. Label, id and all columns but the text are no
    inputs of a score. NULL and empty texts have the same score, from statistics that are all 0. Of a repeated
    label the largest counts; NULL labels and ids are not learned from. Repeated rows are scored alike. Without
    labels every score is 0.5, or the option ``unlearned``. An empty table gives an empty result. A column named ``score`` is replaced.
    """
    columns = [c for c in docs.columns if c != "score"]
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    # The statistics are made first, so that the join moves them and not the texts; at any size it goes by shuffle.
    taught = docs.filter(F.coalesce(learn, F.lit(False)))
    described = stage(
        taught.select(F.col(id_col).alias("key"), text_statistics(F.col(text_col)).cast("array<float>").alias("stats")), "statistics"
    )
    scorer = fit(stage(described.join(known.hint("merge"), "key"), "labelled"), **options)
    stats = "__stats"
    while stats in columns:
        stats += "_"
    return (
        docs.select(*columns).withColumn(stats, text_statistics(F.col(text_col)))
        .withColumn("score", score_column(scorer, stats)).drop(stats)
    )
