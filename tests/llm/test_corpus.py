"""The corpus operators against SQL, brute force and round trips, with the awkward inputs."""

import collections
import hashlib
import io
import math
import sys
import zlib
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from varcost.llm import decontamination, exact_dedup, katz, line_dedup, near_dedup, packing, quality, repeats, token_counts, warc  # noqa: E402
from varcost.llm.common import with_locator  # noqa: E402
from varcost.llm.queries import QUERIES, VOCABULARY  # noqa: E402
from varcost.sinks.scratch import scratch_folder  # noqa: E402
from workload.local import prepare  # noqa: E402

PROSE = " ".join(f"word{k % 97}x{k % 31}" for k in range(400))
LONG = " ".join(f"t{k}" for k in range(30_000))
# NULLs, empty and blank texts, ties, repeated rows and ids, copies and near copies, a very long text.
ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE.replace(" ", "  ")), (4, PROSE.replace("word5x5", "other", 1)), (None, PROSE),
    (5, None), (6, ""), (7, " \t\n"), (8, "short"), (8, "other text"), (9, LONG), (10, "é\nÀ\nnul\x00\n" + PROSE[:300]),
]
SCHEMA = "doc_id bigint, text string, lang string, score string, __file string, row string, source string, n_chars bigint"
OPERATORS = [n for n in QUERIES if n.startswith("op")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    prepare(spark)
    base = tmp_path_factory.mktemp("tables")
    for name, rows in (("full", ROWS), ("empty", [])):
        spark.createDataFrame([(i, t, "en", "s", "f", "r", "a", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(2).write.parquet(f"{base}/{name}/documents.parquet")
        spark.createDataFrame([(i, None if i == 5 else f"http://x/{i} \r\n", t) for i, t in rows], "page_id bigint, url string, html string").write.parquet(f"{base}/{name}/pages.parquet")
        items = [(1, PROSE[700:1000]), (2, None), (3, "short")] if rows else []
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{base}/{name}/benchmark.parquet")
        marks = [(1, 1, 0), (9, 0, 0), (None, 1, 0), (8, None, 0)] if rows else []
        spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/{name}/labels.parquet")
    return str(base)


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, tables, name):
    n = QUERIES[name](spark, f"{tables}/full").count()
    # Pieces, found passages and differences between sources (there is one) have counts of their own.
    least = {"op9_packing": 6, "op10_decontamination": 6, "op12_windows": len(ROWS), "op13_divergence": 0}
    assert n >= least[name] if name in least else n == len(ROWS)
    assert QUERIES[name](spark, f"{tables}/empty").count() == 0


def test_pipeline_keeps_columns_and_one_of_each(spark, tables):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        got = function(spark, docs, f"{tables}/full")
        assert got.columns == docs.columns and all(r["__file"] == "f" and r["score"] == "s" for r in got.collect())
    kept = corpus_pipeline.drop_near_copies(spark, docs, tables).collect()
    assert sum(PROSE[:50] in (r["text"] or "") and len(r["text"]) > 1000 for r in kept) == 1
    assert corpus_pipeline.run(spark, f"{tables}/empty").count() == 0


def test_weak_digests_are_told_apart_by_bytes(spark, tables):
    path = f"{tables}/full/documents.parquet"
    key = lambda r: (r["__file"], r["__row"], r["keep_id"], r["group_size"], r["kept"])
    strong = exact_dedup.exact_dedup(spark, path, batch_bytes=1000).collect()
    weak = exact_dedup.exact_dedup(spark, path, digest=lambda t: F.unhex(F.substring(F.md5(t), 1, 1))).collect()
    assert sorted(map(key, strong)) == sorted(map(key, weak))
    assert sum(r["kept"] for r in strong) == len({"".join((t or "").split()) for _, t in ROWS})


def test_near_classes_match_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    words = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    sets = {i: collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else {} for i, w in words.items()}

    def similarity(a, b):
        every = set(a) | set(b)
        return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in a if d in b)

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for d in s:
            holders[d].append(i)
    shared = collections.Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.5 * min(len(sets[a]), len(sets[b])) and (words[a] == words[b] or similarity(sets[a], sets[b]) >= 0.8):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op3_near_dedup"](spark, small).collect()}
    assert got == {i: find(i) for i in docs}


def test_rows_of_exploded_united_and_moved_frames_have_locators_of_their_own(spark, tables):
    prepare(spark)
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    scan = with_locator(docs.filter("doc_id < 9").withColumn("x", F.lit(1)), "t")
    assert "Parquet" in scan._jdf.queryExecution().executedPlan().toString() and scan.select("__file").distinct().count() <= 2
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    for frame, n in ((twice, 2), (docs.unionByName(docs), 2), (docs.repartition(6), 1), (docs.join(twice.select("doc_id", "copy"), "doc_id"), None)):
        frame = frame.withColumnsRenamed({"__file": "f", "row": "r"})
        located = with_locator(frame, "t").select("__file", "__row").collect()
        assert len({tuple(r) for r in located}) == len(located) == (n * len(ROWS) if n else len(located))
    once = near_dedup.near_dedup(docs).filter("kept").count()
    found = near_dedup.near_dedup(twice).collect()
    assert len(found) == 2 * len(ROWS) and sum(r["kept"] for r in found) == once
    assert near_dedup.without_near_copies(docs.unionByName(docs)).count() == once
    assert exact_dedup.without_copies(twice).count() == exact_dedup.without_copies(docs).count()
    items = spark.read.parquet(f"{tables}/full/benchmark.parquet")
    assert decontamination.without_leaks(twice, items).count() == 2 * decontamination.without_leaks(docs, items).count()


def _prefix_pair(shared, union, name):
    """Texts of distinct words, the second a prefix of the first: this many shingles shared and in all."""
    words = [f"{name}w{k}" for k in range(union + 4)]
    return " ".join(words), " ".join(words[:shared + 4])


def test_components_match_union_find(spark):
    name = lambda k: hashlib.blake2b(str(k).encode(), digest_size=16).digest()
    rng = np.random.default_rng(5)
    links = [(k, k + 1) for k in range(60)]  # a path
    links += [(100, k) for k in range(101, 180)] + [(k, 100) for k in range(101, 110)]  # a star with repeated links
    links += [(200 + k, 200 + (k + 1) % 9) for k in range(9)]  # a ring
    links += [(300 + int(a), 300 + int(b)) for a, b in rng.integers(0, 150, (110, 2)) if a != b]
    parent = {}

    def top(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in links:
        parent[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for k in list(parent):
        groups[top(k)].append(name(k))
    wanted = {node: min(group) for group in groups.values() for node in group}
    rows = [(bytearray(name(a)), bytearray(name(b))) for a, b in links]
    found = near_dedup.components(spark.createDataFrame(rows, "a binary, b binary")).collect()
    assert len(found) == len(wanted) and {bytes(r["node"]): bytes(r["class"]) for r in found} == wanted
    assert near_dedup.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_pairs_at_the_threshold_are_similar(spark):
    prepare(spark)
    sizes = [(4 * k, 5 * k) for k in (3, 12, 16, 32, 100)]
    below = [(79, 100), (11, 14)]
    rows = [(10 * i + j, t) for i, s in enumerate(sizes + below) for j, t in enumerate(_prefix_pair(*s, f"p{i}"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs).collect()}
    for i in range(len(sizes)):
        assert got[10 * i + 1] == 10 * i, sizes[i]
    for i in range(len(sizes), len(rows) // 2):
        assert got[10 * i + 1] == 10 * i + 1


def test_equal_weights_are_exact_at_the_threshold():
    for k in range(1, 401):
        hashes = np.arange(5 * k, dtype=np.uint64)
        weights = np.ones(5 * k)
        assert near_dedup.probability_jaccard((hashes, weights), (hashes[:4 * k], weights[:4 * k])) == 0.8


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 300).astype(np.uint64)
    u, v = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    a, b = np.arange(0, 220), np.arange(60, 300)
    m = 4096
    held = [near_dedup.signatures(np.zeros(len(x), int), hashes[x], w[x], 1, m)[0] for x, w in ((a, u), (b, v))]
    sort = lambda x, w: (np.sort(hashes[x]), w[x][np.argsort(hashes[x])])
    assert abs((held[0] == held[1]).mean() - near_dedup.probability_jaccard(sort(a, u), sort(b, v))) < 0.04


def test_katz_probabilities_sum_to_one(spark):
    prepare(spark)
    texts = ["a b a c", "a b", "b c a", "d a b c"] * 3 + ["c e"]
    words = ["a", "b", "c", "d", "e", "unknown"]
    rows = [*enumerate(texts), *((100 + k, w) for k, w in enumerate(words)), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # A unigram model gives log P(w) + log P(end) for a text of one word.
    got = {r["doc_id"]: 10 ** r["score"] for r in katz.katz_scores(docs, F.col("doc_id") < 100, order=1).collect()}
    assert sum(got[100 + k] / got[200] for k in range(len(words))) + got[200] == pytest.approx(1)
    # Of a longer model, all texts of up to n words cannot be likelier than 1 together.
    probes = [(1000, "")] + [(1001 + k, w) for k, w in enumerate(words)]
    probes += [(2000 + 10 * i + j, f"{v} {w}") for i, v in enumerate(words) for j, w in enumerate(words)]
    docs = spark.createDataFrame([*enumerate(texts), *probes], "doc_id bigint, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in katz.katz_scores(docs, F.col("doc_id") < 100).collect() if r["doc_id"] >= 1000}
    assert 0.2 < sum(got.values()) < 1
    counts = [0, 5, 4, 2, 1, 1, 1, 3]
    assert (katz.discounts(counts)[1:6] > 0).all() and (katz.discounts(counts)[1:6] <= 1).all()


def test_katz_scores_do_not_depend_on_how_rows_are_stored(spark, small):
    prepare(spark)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scan, moved = (
        {r["doc_id"]: (r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in katz.katz_scores(d, train=F.col("doc_id") % 10 != 0).collect()}
        for d in (docs, docs.repartition(6))
    )
    assert scan == moved and len(scan) == docs.count()


def test_katz_learns(spark, small):
    rows = QUERIES["op5_katz"](spark, small).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    docs = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: (t or "").translate(lower).encode().split() + [b"\n"] for i, t in docs.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for r in rows:
        mine = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in mine)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(counts[w] > 0 for w in mine), total)
        assert r["base_score"] == pytest.approx(base)


def _tokens(text):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    return (text or "").encode().translate(lower).split() + [b"\n"]


def _katz_brute_force(texts, trained, order):
    """log10 probability of each text by the recursive definition, and the factors of each order."""
    grams = {n: collections.Counter() for n in range(order + 1)}
    after = collections.defaultdict(set)
    for k in trained:
        padded = [None] * (order - 1) + _tokens(texts[k])
        for at in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                gram = tuple(padded[at - n + 1:at + 1])
                grams[n][gram] += 1
                after[gram[:-1]].add(gram[-1])
    factors = {}
    for n in range(1, order + 1):
        kinds = collections.Counter(grams[n].values())
        rs = sorted(kinds)
        edges = [0, *rs, 2 * rs[-1] - rs[-2]]
        z = [math.log(kinds[r] / ((edges[k + 2] - edges[k]) / 2)) for k, r in enumerate(rs)]
        fitted = np.polyfit(np.log(rs), z, 1)
        smooth = {r: math.exp(np.polyval(fitted, math.log(r))) for r in range(1, 7)}
        over = 6 * smooth[6] / smooth[1]
        factors[n] = {r: ((r + 1) * smooth[r + 1] / smooth[r] / r - over) / (1 - over) for r in range(1, 6)}
    total = sum(grams[1].values())
    free = sum(c * (1 - factors[1].get(c, 1)) for c in grams[1].values())
    context_count = collections.Counter()
    for n in range(1, order + 1):
        for gram, c in grams[n].items():
            context_count[gram[:-1]] += c
    weights = {}

    def direct(gram):
        c = grams[len(gram)][gram]
        return c * factors[len(gram)].get(c, 1) / (context_count[gram[:-1]] + 0.1)

    def probability(gram):
        if len(gram) == 1:  # the model of single words gives no begin mark
            return direct(gram) if grams[1][gram] else (free + 0.1) / (total + 0.1)
        if grams[len(gram)][gram]:
            return direct(gram)
        context = gram[:-1]
        if context not in weights:
            weights[context] = 1.0
            if context_count[context]:
                seen = after[context]
                weights[context] = (1 - sum(direct((*context, w)) for w in seen)) / (1 - sum(direct((*context[1:], w)) for w in seen))
        return weights[context] * probability(gram[1:])

    scores = []
    for text in texts:
        padded = [None] * (order - 1) + _tokens(text)
        scores.append(sum(math.log10(probability(tuple(padded[at - order + 1:at + 1]))) for at in range(order - 1, len(padded))))
    return scores, factors


@pytest.mark.parametrize("order", [2, 3])
def test_katz_matches_brute_force(spark, small, order):
    prepare(spark)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    trained = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    ids = list(texts)
    learned = [k for k, i in enumerate(ids) if zlib.crc32(str(i).encode()) % 10]
    expected, factors = _katz_brute_force([texts[i] for i in ids], learned, order)
    # Good-Turing factors hold without any fallback.
    assert all(0 < d < 1 for by_count in factors.values() for d in by_count.values())
    got = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs, trained, order=order, block_bytes=1 << 17, bucket_grams=20_000).collect()}
    assert [got[i] for i in ids] == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_tables_take_good_turing_factors(table, small):
    docs = pq.read_table(f"{Path(small).parent}/{table}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    words, pairs = collections.Counter(), collections.Counter()
    for i, text in zip(docs["doc_id"], docs["text"]):
        if zlib.crc32(str(i).encode()) % 10:
            tokens = _tokens(text)
            words.update(tokens)
            pairs.update(zip([None, *tokens], tokens))
    for counts in (words, pairs):
        kinds = collections.Counter(counts.values())
        d = katz.discounts(list(kinds.values()), counts=list(kinds))[1:6]
        absolute = 1 - kinds[1] / (kinds[1] + 2 * kinds[2]) / np.arange(1, 6)
        assert (np.diff(d) > 0).all() and d[0] > 0 and d[-1] < 1 and (abs(d - absolute) > 1e-3).all()
        rs = np.array(sorted(kinds))
        assert katz.slope(np.array([float(kinds[r]) for r in rs]), rs) < -1


def test_automaton_matches_greedy_search():
    rng = np.random.default_rng(2)
    letters = [b"a", b"b", b"c"]
    for _ in range(60):
        make = lambda n: b"".join(rng.choice(letters, n))
        pieces = {make(rng.integers(1, 5)) for _ in range(8)} | {b" " + make(rng.integers(1, 4)) for _ in range(5)}
        pieces |= set(letters) | {b" "} if rng.random() < 0.7 else set()
        automaton = token_counts.Automaton(pieces)
        for _ in range(40):
            word = make(rng.integers(1, 12))
            rest, n = b" " + word, 0
            while rest:
                best = max((p for p in pieces if rest.startswith(p)), key=len, default=None)
                if best is None:
                    n = 1
                    break
                rest, n = rest[len(best):], n + 1
            assert automaton.count(word) == n
    assert token_counts.Automaton(token_counts.read_ranks(VOCABULARY)).count("überall".encode()) >= 2


def test_packing_is_whole_and_fits(spark, small):
    rows = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), shard_pieces=50).collect()
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) + 1 for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sums, bins = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sums[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append(r)
    assert sums == words
    for rows in bins.values():
        rows.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
        filled = sum(r["n_tokens"] for r in rows)
        assert rows[0]["capacity"] == min(c for c in packing.CAPACITIES if c >= filled)


def packed_cost(sizes, cost=packing.sequence_cost):
    return sum(map(cost, sizes))


def scanning_best_fit(lengths, opened, cost, capacities):
    """Best-fit that looks at every open bin and at every piece to come."""
    bins, size, where = [], [], []
    for i, n in enumerate(lengths):
        fitting = [(size[b] - sum(bins[b]), -last, b) for b, last in ((b, max(k for k, w in enumerate(where) if w == b)) for b in range(len(bins))) if size[b] - sum(bins[b]) >= n]
        if fitting:
            target = min(fitting)[2]
        else:
            def price(capacity):
                room = capacity
                for m in lengths[i:]:
                    room -= m if m <= room else 0
                return cost(capacity) / (capacity - room), capacity

            target = len(bins)
            size.append(min((c for c in opened if c >= n), key=price))
            bins.append([])
        where.append(target)
        bins[target].append(n)
    return bins, [min(c for c in capacities if c >= sum(b)) for b in bins]


def cheapest(lengths, capacities, cost):
    """Least cost over all ways to deal the pieces to bins."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = math.inf
    for mask in range(1 << len(rest)):
        beside = [n for k, n in enumerate(rest) if mask >> k & 1]
        total = first + sum(beside)
        if total <= capacities[-1]:
            others = [n for k, n in enumerate(rest) if not mask >> k & 1]
            best = min(best, cost(min(c for c in capacities if c >= total)) + cheapest(others, capacities, cost))
    return best


def test_best_fit_scans_alike_and_is_near_the_optimum():
    random = np.random.default_rng(5)
    capacities = [8, 16, 32, 64]

    def cost(c):
        return c * (1 + c / 96) + 2

    ratios = []
    for _ in range(150):
        lengths = sorted(random.integers(1, random.integers(3, 65), random.integers(1, 8)).tolist(), reverse=True)
        bins, offsets, sizes = packing.best_fit(lengths, capacities, cost)
        held = collections.defaultdict(list)
        for b, offset, n in zip(bins, offsets, lengths):
            assert offset == sum(held[b])
            held[b].append(n)
        assert [min(c for c in capacities if c >= sum(held[b])) for b in range(len(sizes))] == sizes
        sets = [[c for k, c in enumerate(capacities) if mask >> k & 1] for mask in range(1, 16)]
        every = [scanning_best_fit(lengths, opened, cost, capacities) for opened in sets if opened[-1] >= lengths[0]]
        assert math.isclose(packed_cost(sizes, cost), min(packed_cost(s, cost) for _, s in every))
        assert any(sorted(map(sorted, found)) == sorted(map(sorted, held.values())) for found, _ in every)
        ratios.append(packed_cost(sizes, cost) / cheapest(lengths, capacities, cost))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.3 and sum(ratios) / len(ratios) < 1.03


def test_lengths_compete(small):
    """Several lengths cost less than any one, and all of them are opened."""
    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"])["text"].to_pylist()
    words = [len((t or "").encode().split()) + 1 for t in texts]
    lengths = sorted((min(n - k, 4096) for n in words for k in range(0, n, 4096)), reverse=True)
    _, _, sizes = packing.best_fit(lengths, packing.CAPACITIES)
    alone = packed_cost(packing.best_fit(lengths, [4096])[2])
    one = packed_cost(min(c for c in packing.CAPACITIES if c >= u) for u in packing._fill_bins(lengths, (4096,), packing.sequence_cost)[2])
    assert packed_cost(sizes) < 0.85 * one <= 0.85 * alone
    assert len(set(sizes)) >= 4
    # A cost that knows no attention asks for the longest sequences alone.
    flat = packing.best_fit(lengths, packing.CAPACITIES, lambda c: c + 512)[2]
    assert collections.Counter(flat).most_common(1)[0][0] == 4096


def test_packing_of_ties_long_texts_and_bad_lengths(spark, tables):
    assert packing.best_fit([], [4, 8]) == ([], [], [])
    for lengths, capacities in (([9], [1]), ([9], []), ([1], range(1, 10))):
        with pytest.raises(ValueError):
            packing.best_fit(lengths, capacities)
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    first = sorted(map(str, packing.pack(docs).collect()))
    assert first == sorted(map(str, packing.pack(docs).collect()))
    pieces = sorted((r["piece"], r["start"], r["n_tokens"]) for r in packing.pack(docs).filter("doc_id = 9").collect())
    # 30,000 words and an end.
    assert pieces == [(k, 4096 * k, min(4096, 30_001 - 4096 * k)) for k in range(8)]
    blank = packing.pack(docs).filter("doc_id IN (5, 6, 7)").collect()
    assert [r["n_tokens"] for r in blank] == [1, 1, 1] and sum(r["doc_id"] is None for r in packing.pack(docs).collect()) == 1


def test_warc_round_trip_and_damage(spark, tables):
    pages = spark.read.parquet(f"{tables}/full/pages.parquet")
    records = warc.read_warc(warc.write_warc(pages, min_revisit_bytes=10), with_payload=True).collect()
    assert sorted(bytes(r["payload"]) for r in records if r["record_type"] == "response") == sorted(
        t.encode() for t in [*{t for _, t in ROWS if len(t or "") >= 10}, *[t or "" for _, t in ROWS if len(t or "") < 10]]
    )
    good = warc.encode_record("1", "u", b"payload" * 99, None, False, "2020-01-01T00:00:00Z", 6)
    assert len(list(warc.read_records(io.BytesIO(good * 2)))) == 2
    plain = bytearray(zlib.decompress(good, 31))
    plain[plain.index(b"payload")] ^= 1
    for bad in (good[:-9], zlib.compress(bytes(plain), wbits=31), zlib.compress(bytes(plain[:-3]), wbits=31)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


@pytest.mark.parametrize("group_contexts", [2000, 1])
def test_repeats_match_brute_force(spark, tables, group_contexts):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ROWS) if t != LONG] + [(50, "ab" * 150)], "doc_id bigint, text string")
    data = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    count = collections.Counter(d[p:p + 200] for d in data.values() for p in range(len(d) - 199))
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, group_contexts=group_contexts).collect()}
    for i, d in data.items():
        keep = np.ones(len(d), bool)
        for p in range(len(d) - 199):
            if count[d[p:p + 200]] > 1:
                keep[p:p + 200] = False
        assert (got[i]["n_removed"], bytes(got[i]["kept"])) == (int((~keep).sum()), bytes(np.frombuffer(d, np.uint8)[keep]))


@pytest.mark.parametrize("length", [1001, 31, 0])
def test_lengths_that_do_not_fit_are_refused(length):
    with pytest.raises(ValueError):
        repeats.remove_repeats(None, length=length)


def test_paths_of_exact_dedup(spark, tables):
    content = f"{tables}/full/documents.parquet"
    want = sorted(map(str, exact_dedup.exact_dedup(spark, content).select("doc_id", "keep_id", "kept").collect()))
    assert len(want) == len(ROWS)
    for path in (content + "/", f"{tables}/fu?l/documents.parquet", f"{tables}/full/document{{s,z}}.parquet"):
        assert sorted(map(str, exact_dedup.exact_dedup(spark, path).select("doc_id", "keep_id", "kept").collect())) == want


def test_empty_and_missing_page_ids_are_told_apart(spark):
    body = "the same payload " * 20
    rows = [("", "u", body), (None, "u", body), ("x", "u", body), (None, "v", "alone" * 50), ("a<b>%", "w", "own" * 90)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(warc.write_warc(pages, min_revisit_bytes=10)).collect()}
    assert got == {("", "response", None), (None, "revisit", ""), ("x", "revisit", ""), (None, "response", None), ("a<b>%", "response", None)}


def test_long_words_are_counted_but_not_kept(spark):
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b" a", b"abab"]
    automaton = token_counts.Automaton(pieces)
    memory = token_counts._Memory(automaton)
    long = b"ab" * 40
    assert memory[long] == automaton.count(long) and memory[b"abab"] == automaton.count(b"abab")
    assert list(memory) == [b"abab"]


@pytest.mark.parametrize("column", ["n_words", "n_tokens"])
def test_token_counts_of_a_table(spark, tables, column):
    pieces = [bytes([b]) for b in range(256)] + [b" w", b"word", b" t", b"ot", b"other", b" s", b"hort"]

    def greedy(word):
        rest, n = b" " + word, 0
        while rest:
            rest, n = rest[max(len(p) for p in pieces if rest.startswith(p)):], n + 1
        return n

    want = [
        len((t or "").encode().split()) if column == "n_words" else sum(map(greedy, (t or "").encode().split())) for _, t in ROWS
    ]
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    assert sorted(r[column] for r in token_counts.token_counts(docs, pieces).collect()) == sorted(want)


def test_lines_by_position(spark):
    prepare(spark)
    docs = spark.createDataFrame([(k, f"a{k}\n  SAME line \nb{k}\n\n") for k in range(3)], "doc_id bigint, text string")
    got = line_dedup.line_dedup(docs, min_documents=3).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got] == [(5, 1, f"a{k}\nb{k}\n\n") for k in range(3)]


def test_leaks(spark, tables):
    leaks = decontamination.find_leaks(spark.read.parquet(f"{tables}/full/documents.parquet"), spark.read.parquet(f"{tables}/full/benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (None, 1), (8, 3)}


def test_quality_on_held_out_documents(spark):
    rows = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 2, 1, 3, 4]), np.full(5, 4.0))
    assert (np.diff(y) > 0).all() and len(x) == len(y) == 4


def test_prefixes_lose_no_similar_pair(spark):
    prepare(spark)
    rng = np.random.default_rng(5)
    texts = []
    for repeat in (1, 1, 3):  # with and without repeated shingles
        base = [f"w{k}" for k in rng.integers(0, 500, 80)] * repeat
        for changes in (0, 1, 1, 2, 2, 4, 8, 20):
            words = list(base)
            for at in rng.integers(0, len(words), changes):
                words[at] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(words[: len(words) - int(rng.integers(0, 8))]))
    texts += [t for pair in ((4, 5), (12, 15), (80, 100), (79, 100)) for t in _prefix_pair(*pair, f"p{pair[1]}")]
    name = [bytes([k]) for k in range(len(texts))]
    rows = [(bytearray(n), bytearray(n), t) for n, t in zip(name, texts)]
    nodes = spark.createDataFrame(rows, "node binary, class binary, text string")
    kept = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in near_dedup._prefix_pairs(nodes, 5, 0.8).collect()}

    def shingles(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return near_dedup.weighted_shingles(data, np.array([0, len(data)]), 5)[1:]

    known = [shingles(t) for t in texts]
    likeness = {(i, j): near_dedup.probability_jaccard(known[i], known[j]) for j in range(len(texts)) for i in range(j)}
    similar = {pair for pair, s in likeness.items() if s >= 0.8 - 1e-9}
    assert similar and similar <= kept and len(kept) < 2 * len(similar)
    one = nodes.withColumn("class", F.lit(b"x"))
    assert near_dedup._prefix_pairs(one, 5, 0.8).count() == 0 and near_dedup._prefix_pairs(nodes.limit(0), 5, 0.8).count() == 0


def test_a_large_group_of_texts_below_the_threshold_gives_few_candidates(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(3)
    base, texts = [f"w{k}" for k in range(400)], []
    for _ in range(40):  # similarities about 0.74, edits that several texts share
        words = list(base)
        for at in rng.integers(0, 400, 6):
            words[at] = f"new{at % 3}"
        texts.append(" ".join(words))
    texts += [" ".join(base), " ".join(base[:-7])]
    rows = [(bytearray([k]), bytearray([k]), t) for k, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node binary, class binary, text string")
    staged, stage = {}, near_dedup.stage

    def keep(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(near_dedup, "stage", keep)
    kept = [(bytes(r["a"])[0], bytes(r["b"])[0]) for r in near_dedup._prefix_pairs(nodes, 5, 0.8).collect()]
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(similar) >= 40 and similar <= set(kept)
    assert len(kept) == len(set(kept)) < len(texts) * (len(texts) - 1) / 4
    assert near_dedup._meetings(staged["prefix"], 0.8).count() < 3 * len(kept)


def test_long_header_lines_are_read():
    url = "http://x/" + "\u6f22" * 230_000  # nine characters each
    record = warc.encode_record("1", url, b"payload", None, False, "2020-01-01T00:00:00Z", 6)
    found = list(warc.read_records(io.BytesIO(record * 2), with_payload=True))
    assert [(unquote(r["target_uri"]), r["payload"]) for r in found] == [(url, b"payload")] * 2
    assert len(found[0]["target_uri"]) > 2_000_000


def test_quality_with_few_or_no_labels(spark, tables, tmp_path):
    prepare(spark)
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.quality_scores(docs, none, F.lit(True)).collect()
    assert len(got) == len(ROWS) and {r["score"] for r in got} == {0.5}
    none.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.reject_low_quality(spark, docs, str(tmp_path)).count() == len(ROWS)
    # One label that is not kept for the calibration.
    stats = [0.0] * quality.STATISTICS
    keys = spark.range(50).filter(F.pmod(F.xxhash64("id", F.lit(quality.SEED + 1)), F.lit(4)) != 0).limit(1)
    scorer = quality.fit(keys.select(F.col("id").alias("key"), F.lit(1).alias("label"), F.array(*map(F.lit, stats)).alias("stats")))
    assert scorer.probability(np.zeros((1, quality.STATISTICS)))[0] == 1


def test_pipeline_stages_match_brute_force(spark, small):
    scratch = Path(scratch_folder(spark).removeprefix("file:"))
    before = set(scratch.glob("pipeline-*"))
    packed = corpus_pipeline.run(spark, small).collect()
    (folder,) = set(scratch.glob("pipeline-*")) - before
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [{r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/{k}").collect()} for k in range(4)]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = quality.quality_scores(docs, labels, learn=F.crc32(F.col("doc_id").cast("string")) % 4 != 2).collect()
    assert set(kept[0]) == {r["doc_id"] for r in scored if r["score"] >= 0.7} and 0 < len(kept[0]) < len(scored)

    groups = collections.defaultdict(list)
    for i, t in kept[0].items():
        groups[b"".join(t.encode().split())].append((-len(t), i))
    assert set(kept[1]) == {min(g)[1] for g in groups.values()}

    def shingles(text, lower):
        w = lower(text).split()
        return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else {}

    near = {i: shingles(t, lambda t: t.encode().lower()) for i, t in kept[1].items()}
    ids, classes = sorted(near), {i: i for i in near}
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = near[i], near[j]
            both = [d for d in a if d in b]
            if len(both) < 0.5 * min(len(a), len(b)):
                continue
            every = set(a) | set(b)
            similar = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in both)
            if similar >= 0.8 - 1e-9 or not (a or b):
                low, high = sorted((classes[i], classes[j]))
                classes = {k: low if c == high else c for k, c in classes.items()}
    assert set(kept[2]) == set(classes.values())

    items = [set(shingles(r["text"] or "", str.lower)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    own = {i: set(shingles(t, str.lower)) for i, t in kept[2].items()}
    assert set(kept[3]) == {i for i, s in own.items() if not any(m and len(m & s) >= 0.8 * len(m) for m in items)}
    sums = collections.Counter()
    for r in packed:
        sums[r["doc_id"]] += r["n_tokens"]
    assert sums == {i: len(t.encode().split()) + 1 for i, t in kept[3].items()}
