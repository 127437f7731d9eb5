"""Each step of the quality classifier against plain computations."""

import collections
import math
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from varcost.llm import quality  # noqa: E402
from workload.local import prepare  # noqa: E402

AWKWARD = [
    None, "", " \t\n", "\n\n", "one", "One one ONE", "a b a b a", "line\nline\nline", "line\nother\n", "!!! wow!! 1+1=2 <b>",
    "é À 日本語 \x00  x", "x" * 5000, "w " * 3000, "A,b.C;d:e!f?g'h\"i-j(k)",
]


def share(items):
    counts = collections.Counter(items)
    total = max(sum(counts.values()), 1)
    return len(counts) / total, max(counts.values(), default=0) / total


def plain_statistics(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * quality.STATISTICS
    words = [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in data.split()]
    stops = b".,;:!?'\"-()"
    classes = [
        lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b in b" \t\n\x0b\x0c\r",
        lambda b: b in stops,
        lambda b: 33 <= b <= 126 and not chr(b).isalnum() and b not in stops,
        lambda b: b >= 128, lambda b: b == 10, lambda b: b == 33,
    ]
    pairs = list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)] * len(words)
    sizes = [len(w) for w in words]
    many = max(len(words), 1)
    mean = sum(sizes) / many
    return [
        *(sum(map(c, data)) / len(data) for c in classes),
        math.log1p(len(data)), math.log1p(len(words)), math.log1p(data.count(b"\n")),
        *share(words), *share(pairs),
        sum(classes[5](w[-1]) for w in words) / many, sum(w[-1] == 33 for w in words) / many,
        mean, math.sqrt(max(sum(n * n for n in sizes) / many - mean**2, 0)),
        *share(re.findall(rb"[^\n]*\n|[^\n]+", data)),
    ]


@pytest.fixture(scope="module")
def documents(spark, small):
    prepare(spark)
    return spark.read.parquet(f"{small}/documents.parquet")


def test_statistics_of_given_and_awkward_texts(documents):
    texts = [r["text"] for r in documents.select("text").collect()] + AWKWARD
    got = quality.statistics(pa.array(texts, pa.string()))
    want = np.array([plain_statistics(t) for t in texts])
    assert got.shape == want.shape == (len(texts), quality.STATISTICS)
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-9)
    # A text has the same statistics beside any other texts.
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in AWKWARD])
    np.testing.assert_allclose(alone, got[-len(AWKWARD):], rtol=1e-9)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, quality.STATISTICS)


def test_features_approximate_the_gaussian_kernel():
    draw = np.random.default_rng(3)
    points = draw.normal(size=(40, quality.STATISTICS))
    scorer = quality.Scorer(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), 20_000, 1)
    phi = scorer.features(points)[:, :-1]
    apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    kernel = np.exp(-apart / (4 * quality.STATISTICS))
    assert np.abs(phi @ phi.T - kernel).max() < 0.04


def pooled(rates, totals):
    """Isotonic regression by its max-min formula."""
    sums, counts = np.cumsum([0, *(r * t for r, t in zip(rates, totals))]), np.cumsum([0, *totals])
    n = len(rates)
    return [
        max(min((sums[b + 1] - sums[a]) / (counts[b + 1] - counts[a]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)
    ]


def test_isotonic_matches_the_max_min_formula():
    draw = np.random.default_rng(8)
    for _ in range(100):
        n = int(draw.integers(1, 30))
        scores, totals = np.sort(draw.random(n)), draw.integers(1, 6, n).astype(float)
        positives = np.array([draw.integers(0, t + 1) for t in totals])
        where, rates = quality.isotonic(scores, positives, totals)
        want = pooled(positives / totals, totals)
        np.testing.assert_allclose(rates, sorted(set(np.round(want, 12))), atol=1e-9)
        assert (np.diff(where) > 0).all() and len(where) == len(rates)


def test_fit_solves_the_ridge_of_all_learning_rows(spark, small, documents):
    """Sums over partitions give the weights that one dense solution of the same rows has; calibration never sees those rows."""
    labels = spark.read.parquet(f"{small}/labels.parquet").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    described = (
        documents.select(F.col("doc_id").alias("key"), quality.text_statistics(F.col("text")).cast("array<float>").alias("stats"))
        .join(labels, "key").repartition(5)
    )
    scorer = quality.fit(described, n_features=64)
    held = F.pmod(F.xxhash64("key", F.lit(quality.SEED + 1)), F.lit(4)) == 0
    rows = described.filter("label IS NOT NULL").select("stats", "label", held.alias("held")).collect()
    stats, label = np.array([r["stats"] for r in rows], float), np.array([r["label"] for r in rows], float)
    held = np.array([r["held"] for r in rows])
    assert 0 < held.sum() < len(rows)
    spread = stats.std(axis=0)
    plain = quality.Scorer(stats.mean(axis=0), np.where(spread > 1e-6, spread, 1.0), 64, quality.SEED)
    phi = plain.features(stats[~held])
    # Ridge as least squares with one more row per weight.
    penalty = math.sqrt(quality.RIDGE * len(rows) / 64)
    plain.weights = np.linalg.lstsq(
        np.vstack([phi, penalty * np.eye(65)]), np.concatenate([label[~held], np.zeros(65)]), rcond=None
    )[0]
    np.testing.assert_allclose(scorer.raw(stats), plain.raw(stats), atol=1e-5)

    place = np.round((scorer.raw(stats[held]) + 0.5) / 2 * quality.CALIBRATION_BINS)
    bins = sorted(set(place))
    rates = pooled([label[held][place == b].mean() for b in bins], [float((place == b).sum()) for b in bins])
    np.testing.assert_allclose(scorer.steps[1], sorted(set(np.round(rates, 12))), atol=1e-9)
    scores = scorer.probability(stats)
    assert ((scores >= 0) & (scores <= 1)).all()
