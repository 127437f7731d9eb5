"""Removal of repeated byte strings with an enhanced suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. All texts cannot be
sorted in one place, so suffixes are dealt out such that equal strings meet:

1. *Anchors.* Each string of ``length`` bytes (a window) has one anchor: the piece of ``SEED`` bytes inside it
   with the smallest hash. Equal windows have equal anchors at equal offsets, and neighbouring windows mostly
   share theirs, so an anchor stands for a short range of windows: its *context*.
2. Anchors whose seed occurs once cannot belong to a repeat and are left out. Contexts that are equal as a
   whole are collapsed to one with a count, map-side, so that copies and frequent passages
   cost one row per task.
3. *Suffix arrays.* The distinct contexts of a seed meet in one task, which sorts their suffixes, computes
   common prefixes and stack-scans them into the intervals of the common-prefix tree. Intervals of
   at least ``length`` bytes whose occurrences differ in the byte to the left are maximal repeats; every
   occurrence of each (not just neighbours) marks the bytes it covers.
4. A seed may have more distinct contexts than a task should sort. Those contexts are cut into single windows,
   whose digests are counted instead, which needs no group in one task.
5. Marks are united per text, and the bytes they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varcost.llm.common import FILE, ROW, RunningHash, mix, record_batch, text_slices, with_locator
from varcost.sinks.scratch import stage

LENGTH = 200
# Offsets of windows are packed in ten bits each.
MAX_LENGTH = 1000
SEED = 32
# Distinct contexts of one seed that one suffix array takes; more are counted by window.
GROUP_CONTEXTS = 2000
# Contexts of several seeds sorted together; bounds a task's arrays.
BLOCK_CONTEXTS = 1024


# Anchors -----------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """The anchors of a slice of texts, in order: (text, seed hash, position, first and last window).

    Positions are counted from the start of the text.
    """
    none = tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    hashes = RunningHash(data)
    at = np.arange(len(data) - seed + 1)
    seeds = hashes.of(at, at + seed)
    # Order by scrambled hash, then by position: leftmost of equal ones, the same in equal windows.
    # The number of bits for positions is the same for all slices, or they would break ties differently.
    bits = np.uint64(max(24, int(len(seeds)).bit_length()))
    ranked = (seeds >> bits << bits) | at.astype(np.uint64)
    span, width, least = length - seed + 1, 1, ranked
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Windows must not reach beyond their text.
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:len(place)]
    start = np.arange(len(place))
    good = start + length <= offsets[owner + 1]
    start, owner, place = start[good], owner[good], place[good]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    base = offsets[owner[first]]
    return owner[first], seeds[place[first]], place[first] - base, start[first] - base, start[last] - base


def _pack(position: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Position, and how far the first and last window start before it, in one integer."""
    return (position << 20) | ((position - low) << 10) | (position - high)


def _find_anchors(length: int, seed: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, data, offsets in text_slices(batch.column(2)):
                owner, seeds, position, low, high = anchors(data, offsets, length, seed)
                if not len(owner):
                    continue
                base = offsets[owner]
                whole = RunningHash(data).of(base + low, base + high + length)
                # The same bytes around another offset are another context.
                whole = mix(whole + (position - low).astype(np.uint64))
                yield record_batch([
                    (FILE, pa.array(files[first + owner])), (ROW, pa.array(rows[first + owner])),
                    ("seed", pa.array(seeds.view(np.int64))), ("context", pa.array(whole.view(np.int64))),
                    ("place", pa.array(_pack(position, low, high))),
                ])

    return find


# Suffix arrays -----------------------------------------------------------------------------


def maximal_repeats(
    prefixes: np.ndarray, left: np.ndarray, minimum: int
) -> Iterator[tuple[int, int, int]]:
    """Maximal repeats of at least ``minimum`` bytes: (bytes, first and last index in the suffix array).

    ``prefixes[i]`` is the common prefix of suffixes i - 1 and i (0 for the first), ``left[i]`` the byte before
    suffix i, or a value of its own where there is none. A stack holds the open intervals of the
    common-prefix tree; one is put out when it closes, if its suffixes differ in the byte before.
    """
    differs = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]) if len(left) else np.zeros(0, np.int64)
    # Runs of suffixes with long common prefixes; those with one byte on the left are inside longer repeats.
    long = np.append(prefixes >= minimum, False)
    starts = np.flatnonzero(long[1:] & ~long[:-1])
    ends = np.flatnonzero(long[:-1] & ~long[1:])
    for a, b in zip(starts, ends):
        if differs[a] == differs[b]:
            continue
        stack: list[tuple[int, int]] = []
        for i in range(a + 1, b + 2):
            common = int(prefixes[i]) if i <= b else 0
            begin = i - 1
            while stack and stack[-1][0] > common:
                size, begin = stack.pop()
                if size >= minimum and differs[begin] != differs[i - 1]:
                    yield size, begin, i - 1
            if common >= minimum and (not stack or stack[-1][0] < common):
                stack.append((common, begin))


def _suffix_array(contexts: list[bytes], starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Suffix array of the contexts over their first ``starts`` positions.

    Returns context and offset of each suffix in sorted order, its common prefix with the one before, and the byte
    before it (a value of its own at the start of a context, where the next context goes on).
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    widest = int(sizes.max())
    data = np.zeros(int(sizes.sum()) + widest, np.uint8)
    data[:len(data) - widest] = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(sizes) - sizes
    context = np.repeat(np.arange(len(contexts)), starts)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(starts) - starts, starts)
    at, room = base[context] + offset, sizes[context] - offset
    suffixes = np.lib.stride_tricks.sliding_window_view(data, widest)[at]
    suffixes[np.arange(widest) >= room[:, None]] = 0
    order = np.argsort(suffixes.view(f"S{widest}").ravel(), kind="stable")
    context, offset, at, room, suffixes = context[order], offset[order], at[order], room[order], suffixes[order]
    common = np.zeros(len(at), np.int64)
    if len(at) > 1:
        differs = suffixes[1:] != suffixes[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), widest)
        common[1:] = np.minimum(first, np.minimum(room[1:], room[:-1]))
    before = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - context)
    return context, offset, common, before


def marked_spans(contexts: list[bytes], starts: np.ndarray, copies: np.ndarray, length: int) -> list[list[dict]]:
    """Spans of each context's bytes that repeats of at least ``length`` bytes cover, from its start.

    A context that occurs more than once is covered as a whole.
    """
    context, offset, common, before = _suffix_array(contexts, starts, length)
    reach = np.zeros(len(context), np.int64)
    for size, low, high in maximal_repeats(common, before, length):
        np.maximum(reach[low:high + 1], size, out=reach[low:high + 1])
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.cumsum(sizes + 1) - (sizes + 1)  # a gap after each keeps spans apart
    change = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    hit = reach > 0
    np.add.at(change, base[context[hit]] + offset[hit], 1)
    np.add.at(change, base[context[hit]] + offset[hit] + reach[hit], -1)
    whole = copies > 1
    np.add.at(change, base[whole], 1)
    np.add.at(change, base[whole] + sizes[whole], -1)
    inside = np.concatenate([[False], np.cumsum(change) > 0]).astype(np.int8)
    step = np.diff(inside)
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.searchsorted(base, begins, side="right") - 1
    spans: list[list[dict]] = [[] for _ in contexts]
    for k, b, e in zip(owner.tolist(), (begins - base[owner]).tolist(), (ends - base[owner]).tolist()):
        spans[k].append({"start": b, "end": e})
    return spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _mark_blocks(length: int, block: int):
    """Over partitions sorted by seed: sort whole seeds together, about ``block`` contexts at a time."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        spans = marked_spans(
            [r[3] for r in rows], np.array([len(r[3]) - length + 1 for r in rows]), np.array([r[2] for r in rows]), length
        )
        return record_batch([
            ("seed", pa.array([r[0] for r in rows], pa.int64())), ("context", pa.array([r[1] for r in rows], pa.int64())),
            ("spans", pa.array(spans, SPANS)),
        ])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= block and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    return mark


def _cut_windows(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, context, copies, body in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(body) - length + 1
                yield record_batch([
                    ("seed", pa.array([seed] * n, pa.int64())), ("context", pa.array([context] * n, pa.int64())),
                    ("copies", pa.array([copies] * n, pa.int64())), ("start", pa.array(range(n), pa.int64())),
                    ("window", pa.array([hashlib.blake2b(body[i:i + length], digest_size=16).digest() for i in range(n)], pa.binary())),
                ])

    return cut


def _lend(length: int):
    """Bytes of the contexts that a text lends."""

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_py().encode()
                bodies = []
                for w in wanted:
                    low, high = (w["place"] >> 20) - (w["place"] >> 10 & 1023), (w["place"] >> 20) - (w["place"] & 1023)
                    bodies.append(data[low:high + length])
                yield record_batch([
                    *((name, pa.array([w[name] for w in wanted], pa.int64())) for name in ("seed", "context", "copies", "contexts")),
                    ("body", pa.array(bodies, pa.binary())),
                ])

    return lend


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, removed, runs = [], [], [], []
        for text, spans in zip(batch.column(3), batch.column(4).to_pylist()):
            data, parts, at, n = (text.as_py() or "").encode(), [], 0, 0
            merged: list[list[int]] = []
            for span in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            for start, end in merged:
                parts.append(data[at:start])
                at, n = end, n + end - start
            parts.append(data[at:])
            kept.append(b"".join(parts))
            sizes.append(len(data))
            removed.append(n)
            runs.append(len(merged))
        yield record_batch([
            *((name, batch.column(k)) for k, name in enumerate((FILE, ROW, "doc_id"))),
            ("n_bytes", pa.array(sizes, pa.int64())), ("n_removed", pa.array(removed, pa.int64())),
            ("n_spans", pa.array(runs, pa.int64())), ("kept", pa.array(kept, pa.binary())),
        ])


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    seed: int = SEED,
    group_contexts: int = GROUP_CONTEXTS,
    block_contexts: int = BLOCK_CONTEXTS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` and the locator ``__file, __row``.

    Texts are UTF-8 bytes, NULL is empty. A byte is removed if any ``length``-byte string over it also starts anywhere
    else, in another row or the same, also overlapping; all on the input as it is. ``n_spans`` counts the maximal runs
    removed, and ``kept`` is the rest, joined, which may split a character. Texts shorter than ``length`` keep all.
    Copies of a row, whatever their ids, are repeats of each other. An empty table gives an empty result. Only
    the id and the text are read. ``length`` may be from ``seed`` to ``MAX_LENGTH``; others raise an error.
    """
    if not seed <= length <= MAX_LENGTH:
        raise ValueError(f"length must be from {seed} to {MAX_LENGTH}, not {length}")
    located = with_locator(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "documents")
    kind = located.schema["doc_id"].dataType.simpleString()
    found = located.select(FILE, ROW, "text").mapInArrow(
        _find_anchors(length, seed), f"{FILE} bigint, {ROW} bigint, seed bigint, context bigint, place bigint"
    )
    again = stage(found.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "seeds")
    # Joins with tables that grow with the input go by shuffle at any size.
    repeated = stage(found.join(again.hint("merge"), "seed", "left_semi"), "anchors")

    distinct = repeated.groupBy("seed", "context").agg(F.count("*").alias("copies"), F.min(F.struct(FILE, ROW, "place")).alias("at"))
    per_seed = distinct.groupBy("seed").agg(F.count("*").alias("contexts"))
    wanted = (
        distinct.join(per_seed.hint("merge"), "seed")
        .groupBy(F.col(f"at.{FILE}").alias(FILE), F.col(f"at.{ROW}").alias(ROW))
        .agg(F.collect_list(F.struct("seed", "context", "copies", "contexts", "at.place")).alias("wanted"))
    )
    bodies = stage(
        located.select(FILE, ROW, "text").join(wanted.hint("merge"), [FILE, ROW]).select("text", "wanted")
        .mapInArrow(_lend(length), "seed bigint, context bigint, copies bigint, contexts bigint, body binary"),
        "contexts",
    )
    columns = ["seed", "context", "copies", "body"]
    small = (
        bodies.filter(F.col("contexts") <= group_contexts).select(*columns)
        .repartition("seed").sortWithinPartitions("seed")
        .mapInArrow(_mark_blocks(length, block_contexts), "seed bigint, context bigint, spans array<struct<start:bigint,end:bigint>>")
    )
    windows = (
        bodies.filter(F.col("contexts") > group_contexts).select(*columns)
        .mapInArrow(_cut_windows(length), "seed bigint, context bigint, copies bigint, start bigint, window binary")
    )
    often = windows.groupBy("seed", "window").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    large = (
        windows.join(often, ["seed", "window"]).groupBy("seed", "context")
        .agg(F.collect_list(F.struct("start", (F.col("start") + length).alias("end"))).alias("spans"))
    )
    marks = stage(small.unionByName(large).filter(F.size("spans") > 0), "marks")
    low = F.shiftright("place", 20) - F.shiftright("place", 10).bitwiseAND(1023)
    spans = (
        repeated.join(marks.hint("merge"), ["seed", "context"])
        .select(FILE, ROW, F.transform("spans", lambda s: F.struct((s["start"] + low).alias("start"), (s["end"] + low).alias("end"))).alias("own"))
        .groupBy(FILE, ROW).agg(F.flatten(F.collect_list("own")).alias("spans"))
    )
    return (
        located.join(spans.hint("merge"), [FILE, ROW], "left").select(FILE, ROW, "doc_id", "text", "spans")
        .mapInArrow(_remove, f"{FILE} bigint, {ROW} bigint, doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    )
