"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt at random, by hash, into shards of a bounded number of pieces; each shard is packed
best-fit-decreasing by one task. Bins hold a few pieces each, so what a shard's last open bins waste
is a small, constant share at any input size.

A sequence costs more per token the longer it is (attention) and the shorter it is (overhead), so the permitted
lengths compete:

1. A piece that fits no open bin opens one of the length that costs least per token it would hold. What it would hold is
   found by filling it with pieces that are still to come, largest first.
2. Which lengths to open at all is chosen for the shard as a whole: it is packed once for each set of permitted lengths
   that can hold its largest piece, and the cheapest packing stays. A single length is one of these sets, so the
   packing never costs more than best-fit with any one length.
3. Every bin shrinks to the smallest permitted length that holds its contents, before the packings are compared.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varcost.llm.common import BLANK_RUN, BLANKS, text_of
from varcost.sinks.scratch import stage

# Permitted sequence lengths.
CAPACITIES = (256, 512, 1024, 2048, 4096)
# A sequence of this length spends as much on attention as on everything else.
ATTENTION = 6144
# What a sequence costs beside its tokens, in tokens.
OVERHEAD = 32
SHARD_PIECES = 4096
# Sets of lengths double with each one.
MAX_CAPACITIES = 8


def sequence_cost(capacity: int) -> float:
    """Work of a padded sequence, in tokens of a very short one."""
    return capacity * (1 + capacity / ATTENTION) + OVERHEAD


def _prospect(falling: Sequence[int], lengths: Sequence[int], i: int, room: int) -> int:
    """Tokens that piece ``i`` and those after it put into ``room``, always the largest that still fits."""
    filled, j = 0, i
    while j < len(lengths):
        filled += lengths[j]
        room -= lengths[j]
        j = max(j + 1, bisect_left(falling, -room, j + 1))
    return filled


def _fill_bins(
    lengths: Sequence[int], opened: Sequence[int], cost: Callable[[int], float]
) -> tuple[list[int], list[int], list[int]]:
    """Best-fit with bins of the lengths ``opened``: the bin and offset of each piece, and what the bins hold."""
    falling = [-n for n in lengths]
    price = {c: cost(c) for c in opened}
    rooms: dict[int, list[int]] = {}
    free = 0  # bit r is set if some bin has room r
    used: list[int] = []
    size: list[int] = []
    bins, offsets = [], []
    for i, n in enumerate(lengths):
        fitting = free >> n
        if n and fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            target = rooms[room].pop()
            if not rooms[room]:
                free &= ~(1 << room)
        else:
            holding = [c for c in opened if c >= n]
            target = len(used)
            used.append(0)
            size.append(
                holding[0] if len(holding) == 1
                else min(holding, key=lambda c: (price[c] / max(_prospect(falling, lengths, i, c), 1), c))
            )
        bins.append(target)
        offsets.append(used[target])
        used[target] += n
        room = size[target] - used[target]
        if room:
            rooms.setdefault(room, []).append(target)
            free |= 1 << room
    return bins, offsets, used


def best_fit(
    lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float] = sequence_cost
) -> tuple[list[int], list[int], list[int]]:
    """Pack ``lengths``, which must fall; returns the bin and offset of each, and the bins' capacities.

    A piece goes into the open bin that it fills best (the smallest room it fits in, then the one last used). Of equally
    cheap lengths of a new bin the smallest is opened, and of equally cheap packings that with the fewest lengths stays.
    Lengths must not exceed the largest capacity; no lengths give no bins.
    """
    capacities = sorted(set(capacities))
    if not capacities or len(capacities) > MAX_CAPACITIES:
        raise ValueError(f"1 to {MAX_CAPACITIES} permitted lengths are needed, not {len(capacities)}")
    if not len(lengths):
        return [], [], []
    if lengths[0] > capacities[-1]:
        raise ValueError(f"a piece of {lengths[0]} is longer than {capacities[-1]}")
    best = None
    for k in range(1, len(capacities) + 1):
        for opened in combinations(capacities, k):
            if opened[-1] < lengths[0]:
                continue
            bins, offsets, used = _fill_bins(lengths, opened, cost)
            sizes = [capacities[bisect_left(capacities, u)] for u in used]
            total = sum(map(cost, sizes))
            if best is None or total < best[0]:
                best = (total, bins, offsets, sizes)
    return best[1:]


def word_length(text_col: str):
    """Words of the text, and one end."""
    bare = F.btrim(text_of(text_col), F.lit(BLANKS))
    return F.when(bare == "", F.lit(1)).otherwise(F.size(F.split(bare, BLANK_RUN)) + 1)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    shard_pieces: int = SHARD_PIECES,
    length=None,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """One row per piece of a document:
    ``doc_id, piece, start, n_tokens, bin_id, bin_offset, capacity, bin_tokens``.

    A document's length is its words and one end, or the ``length`` column given, so NULL, empty and blank texts
    have length 1. A document longer than the largest capacity is cut into pieces of that length and a
    rest; no token is lost and none is packed twice. Rows with a NULL or repeated id are packed like others. An
    empty table gives an empty result. Only the id and the text are read. ``cost`` is what a sequence of a
    permitted length costs; their sum is what the packing lowers.

    Lengths are staged first: the number of shards follows from the number of pieces. Within a shard, ties are
    ordered by id, piece and position, so a recomputed shard packs alike.
    """
    capacities = sorted(set(capacities))
    largest = capacities[-1]
    lengths = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
            (length if length is not None else word_length(text_col)).cast("long").alias("length"),
        ),
        "lengths",
    )
    total = lengths.agg(F.sum(F.ceil(F.greatest(F.col("length"), F.lit(1)) / largest))).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length"), F.lit(1)) - 1, F.lit(largest).cast("long"))
    pieces = (
        lengths.select("row", "doc_id", "length", F.posexplode(starts).alias("piece", "start"))
        .withColumn("n_tokens", F.least(F.col("length") - F.col("start"), F.lit(largest)))
        .drop("length")
        .withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    )
    kind = lengths.schema["doc_id"].dataType.simpleString()

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        lengths = table["n_tokens"].to_pylist()
        bins, offsets, sizes = best_fit(lengths, capacities, cost)
        filled = np.bincount(bins, weights=lengths, minlength=len(sizes)).astype(np.int64)
        shard = table["shard"][0].as_py()
        at = np.asarray(bins, np.int64)
        return pa.table({
            "doc_id": table["doc_id"], "piece": table["piece"], "start": table["start"], "n_tokens": table["n_tokens"],
            "bin_id": pa.array((shard << 32) + at), "bin_offset": pa.array(offsets, pa.int64()),
            "capacity": pa.array(np.asarray(sizes, np.int64)[at]), "bin_tokens": pa.array(filled[at]),
        })

    return pieces.groupBy("shard").applyInArrow(
        pack_shard,
        f"doc_id {kind}, piece int, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, capacity bigint, bin_tokens bigint",
    )
