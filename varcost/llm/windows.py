"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenized and packed where they are scanned: a task gathers them into *shards* of a bounded number of
tokens and partitions each shard, so nothing is shuffled and a recomputed task packs alike.

1. A document is cut at every full window; such windows are done. Its rest is an item.
2. Items are merged by largest differencing. A partial partition is the sums of its ``k`` windows; the two partitions
   with the largest imbalance are merged with opposing imbalances, the fullest window of one with the emptiest of the other,
   until one partition, of near-equal windows, remains.
3. While the fullest window exceeds the capacity, the number of windows rises and the shard is partitioned anew.
4. The emptiest windows are then taken apart and cut to fill the little room of the others. What remains goes into the next
   shard; the rest of a task's last shard goes into windows that are powers of two long, which need no padding.

Words are tokenized once per worker as long as they are remembered: the tokenizer drops white space and never
joins what stands on both sides of it, so a text's ids are those of its whitespace chunks in a row.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varcost.llm.chunks import chunk_spans, distinct_chunks
from varcost.llm.common import text_slices

CAPACITY = 4096
END_ID = 2
# Tokens that are partitioned at once, and text that is tokenized at once.
SHARD_TOKENS = 1 << 20
SLICE_BYTES = 4 << 20
# What a worker remembers of words is forgotten when there are this many, or this many bytes of them.
MEMORY_WORDS, MEMORY_BYTES = 1 << 20, 64 << 20
# Bounds what is broadcast: a tokenizer file is of fixed size, whatever the data.
MAX_TOKENIZER_BYTES = 64 << 20

# How the tokenizer cuts normalised words before it looks for pieces; words are joined by one blank here.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+| ")
_LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+| ")
# Words they are used for: printable ASCII, and the Latin blocks up to U+024F in UTF-8, whose classes are settled.
_ASCII = re.compile(rb"[!-~]+")
_LATIN = re.compile(rb"(?:[!-~]|\xc2[\xa1-\xbf]|[\xc3-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")


# Tokens ------------------------------------------------------------------------------------


class _Pieces(dict):
    """Number of each piece of a word seen so far; 0 is the blank between words. Their ids come from a tokenizer's model."""

    def __init__(self, model):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__({" ": 0})
        self._model, self._bytes = model, ByteLevel(add_prefix_space=False, use_regex=False)
        self._ids, self._ends = array("I"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        spelled = piece if piece.isascii() else self._bytes.pre_tokenize_str(piece)[0][0]
        self._ids.extend([t.id for t in self._model.tokenize(spelled)])
        self._ends.append(len(self._ids))
        return number

    def cut(self, pattern, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words joined by one blank, and how many each word has."""
        parts = pattern.findall(text)
        number = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        ends = np.array(self._ends)
        sizes = np.diff(ends, prepend=0)[number]
        total = np.cumsum(sizes)
        at = np.repeat(ends[number] - total, sizes) + np.arange(total[-1])
        last = np.append(np.flatnonzero(number == 0), len(number) - 1)
        return np.array(self._ids, np.uint32)[at], np.diff(total[last], prepend=0)


class Encoder:
    """Ids of texts by a tokenizer that drops white space, remembering the words it has seen.

    Words of printable ASCII and Latin letters are normalised together, cut here, and their pieces go to the tokenizer's model;
    all others go through the whole tokenizer. Strings of special tokens are ordinary text.
    """

    def __init__(self, definition: str, memory_words: int = MEMORY_WORDS, memory_bytes: int = MEMORY_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        self._tokenizer.encode_special_tokens = True
        self._limits = memory_words, memory_bytes
        self._forget()

    def _forget(self) -> None:
        self._place: dict[bytes, int] = {}
        self._pieces = _Pieces(self._tokenizer.model)
        self._bytes = 0
        # Ids of all words remembered, and where each word's begin (one more than there are words).
        self._ids, self._bounds = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _learn(self, chunks: list[bytes]) -> None:
        kinds: tuple[list[bytes], ...] = ([], [], [])
        for chunk in chunks:
            kinds[0 if _ASCII.fullmatch(chunk) else 1 if _LATIN.fullmatch(chunk) else 2].append(chunk)
        ascii_words, latin, others = kinds
        if ascii_words:
            self._add(ascii_words, *self._pieces.cut(_ASCII_WORDS, b" ".join(ascii_words).decode().lower()))
        if latin:
            text = self._tokenizer.normalizer.normalize_str(b" ".join(latin).decode())
            self._add(latin, *self._pieces.cut(_LATIN_WORDS, text))
        if others:
            found = self._tokenizer.encode_batch_fast([c.decode() for c in others], add_special_tokens=False)
            lists = [e.ids for e in found]
            self._add(others, np.array([i for ids in lists for i in ids], np.uint32), np.array([len(ids) for ids in lists]))

    def _add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, filled = len(self._place), int(self._bounds[len(self._place)])
        self._bounds = _grown(self._bounds, n + len(chunks) + 1)
        self._bounds[n + 1:n + len(chunks) + 1] = filled + np.cumsum(sizes)
        self._ids = _grown(self._ids, filled + len(ids))
        self._ids[filled:filled + len(ids)] = ids
        self._place.update(zip(chunks, range(n, n + len(chunks))))
        self._bytes += sum(map(len, chunks))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text of a slice, each followed by ``end``, in one array, and the texts' bounds in it."""
        starts, ends, texts = chunk_spans(data, offsets)
        chunks, index = distinct_chunks(data, starts, ends)
        if len(self._place) >= self._limits[0] or self._bytes >= self._limits[1]:
            self._forget()
        new = [c for c in chunks if c not in self._place]
        if new:
            self._learn(new)
        place = np.fromiter(map(self._place.__getitem__, chunks), np.int64, len(chunks))[index]
        at, sizes = self._bounds[place], self._bounds[place + 1] - self._bounds[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = total[texts] + np.arange(len(texts))  # one end after each text before
        out = np.full(int(bounds[-1]), end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = self._ids[np.repeat(at - total[:-1], sizes) + np.arange(total[-1])]
        return out, bounds


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if len(array) >= size else np.concatenate([array, np.zeros(2 * size - len(array), array.dtype)])


_encoders: dict[int, Encoder] = {}


# Windows -----------------------------------------------------------------------------------


def difference(lengths: Sequence[int], windows: int) -> np.ndarray:
    """The window of each item, by largest differencing into ``windows`` subsets of near-equal sums.

    A partial partition holds its sums in falling order, less the smallest. Ties go to the partition made first.
    """
    n = len(lengths)
    if windows == 1 or not n:
        return np.zeros(n, np.int64)
    sums: list[np.ndarray | None] = []
    heap = []
    for k, length in enumerate(lengths):
        leaf = np.zeros(windows, np.int64)
        leaf[0] = length
        sums.append(leaf)
        heap.append((-int(length), k))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), len(sums)))
        sums.append(both)
    # From the last partition back to the items: which window each place of a partition became.
    became: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(windows)}
    for made in range(len(merges) - 1, -1, -1):
        a, b, order = merges[made]
        place = np.empty(windows, np.int64)
        place[order] = became.pop(n + made)
        became[a], became[b] = place, place[::-1]
    return np.array([became[k][0] for k in range(n)], np.int64)


def near_equal_windows(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item, and the number of windows: the first count at which none exceeds the capacity.

    The count rises by 1, 2, 4 and so on, so items that fill little more than half a window do not take a trial each.
    """
    windows, step = max(1, -(-int(lengths.sum()) // capacity)), 1
    while True:
        window = difference(lengths, windows)
        if np.bincount(window, lengths, windows).max(initial=0) <= capacity:
            return window, windows
        windows, step = min(windows + step, len(lengths)), step * 2


class Piece(NamedTuple):
    """A run of a document's ids."""

    doc: int
    start: int
    length: int


def fill(windows: list[list[Piece]], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Take the emptiest windows apart to fill the others; returns full windows, and pieces of less than one window."""
    load = [sum(p.length for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda k: -load[k])
    spare: list[Piece] = []
    have, full, low, high = 0, [], 0, len(order) - 1
    while low <= high:
        k = order[low]
        room = capacity - load[k]
        while have < room and high > low:
            spare += windows[order[high]]
            have += load[order[high]]
            high -= 1
        if have < room:  # the last window, and not enough left to fill it
            spare += windows[k]
            have += load[k]
            break
        taken, spare = cut(spare, room)
        have -= room
        full.append(windows[k] + taken)
        low += 1
    while have >= capacity:
        taken, spare = cut(spare, capacity)
        have -= capacity
        full.append(taken)
    return full, spare


def cut(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The last pieces that hold so many tokens, one of them cut if need be, and the others."""
    taken, rest = [], list(pieces)
    while tokens:
        p = rest.pop()
        n = min(tokens, p.length)
        taken.append(Piece(p.doc, p.start + p.length - n, n))
        if n < p.length:
            rest.append(Piece(p.doc, p.start, p.length - n))
        tokens -= n
    return taken, rest


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows whose lengths are the powers of two that add up to the pieces' tokens."""
    windows, tokens = [], sum(p.length for p in pieces)
    while tokens:
        size = 1 << (tokens.bit_length() - 1)
        taken, pieces = cut(pieces, size)
        windows.append(taken)
        tokens -= size
    return windows


class _Packer:
    """Gathers documents and hands over the pieces of full windows."""

    def __init__(self, capacity: int, shard_tokens: int, kind: pa.DataType):
        self._capacity, self._shard_tokens, self._kind = capacity, shard_tokens, kind
        self._ids: dict[int, tuple[object, np.ndarray]] = {}
        self._items: list[Piece] = []
        self._rows: list[tuple] = []
        self._tokens = self._count = 0
        self._sequence = TaskContext.get().partitionId() << 32

    def add(self, doc_id, ids: np.ndarray) -> bool:
        """Whether a shard is full."""
        doc, whole = self._count, len(ids) - len(ids) % self._capacity
        self._count += 1
        self._ids[doc] = doc_id, ids
        for start in range(0, whole, self._capacity):
            self._emit([Piece(doc, start, self._capacity)])
        if whole < len(ids):
            self._items.append(Piece(doc, whole, len(ids) - whole))
        self._tokens += len(ids)
        return self._tokens >= self._shard_tokens

    def _emit(self, window: list[Piece]) -> None:
        offset = 0
        for p in window:
            doc_id, ids = self._ids[p.doc]
            part = np.ascontiguousarray(ids[p.start:p.start + p.length], "<u4")
            self._rows.append((doc_id, p.start, p.length, zlib.crc32(part), len(ids), self._sequence, offset))
            offset += p.length
        self._sequence += 1

    def flush(self, last: bool) -> pa.RecordBatch:
        items = sorted(self._items, key=lambda p: (-p.length, p.doc, p.start))
        window, count = near_equal_windows(np.array([p.length for p in items], np.int64), self._capacity)
        windows: list[list[Piece]] = [[] for _ in range(count)]
        for p, k in zip(items, window):
            windows[k].append(p)
        full, spare = fill([w for w in windows if w], self._capacity)
        for w in full:
            self._emit(w)
        if last:
            for w in powers_of_two(spare):
                self._emit(w)
            spare = []
        self._items, self._tokens = spare, sum(p.length for p in spare)
        held = {p.doc for p in spare}
        self._ids = {doc: self._ids[doc] for doc in held}
        columns = list(zip(*self._rows)) or [()] * 7
        self._rows = []
        kinds = [self._kind, *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(COLUMNS))


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_windows(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the tokenizer's ids of its whole text and ``end_id``, so NULL, empty and blank texts have one token. Every
    id lies in exactly one piece; windows hold at most ``capacity`` ids and are full or a power of two long. ``ids_crc32``
    is of the piece's ids as little-endian integers of four bytes. Rows with a NULL or repeated id are packed like others;
    ties go to the row scanned first. An empty table gives an empty result. Only the id and the text are read.

    ``capacity`` must be a power of two. The tokenizer at ``tokenizer_path`` (read by the driver, shipped to the tasks) must
    drop white space, lower-case, and cut words as ``_ASCII_WORDS`` does; its file is checked for that much by encoding a sample.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"the capacity {capacity} is not a power of two")
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    if len(definition) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"the tokenizer has {len(definition)} characters, more than {MAX_TOKENIZER_BYTES}")
    _check(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    key = hash(definition)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:  # one per worker, which Spark reuses for many tasks
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        packer = None
        for batch in batches:
            packer = packer or _Packer(capacity, shard_tokens, batch.schema.field(0).type)
            ids = batch.column(0).to_pylist()
            for first, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                tokens, bounds = _encoders[key].encode(data, offsets, end_id)
                for k in range(len(offsets) - 1):
                    if packer.add(ids[first + k], tokens[bounds[k]:bounds[k + 1]]):
                        yield packer.flush(last=False)
        if packer is not None:
            yield packer.flush(last=True)

    return narrow.mapInArrow(pack, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COLUMNS[1:]))


# A text that shows whether a tokenizer cuts and lower-cases as assumed.
_SAMPLE = "Don't  STOP\tat 42, it's \"o.k.\"<|x|>À la crème--we'll\n see A1b2 _x_ 世界 İß"


def _check(definition: str) -> None:
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(definition)
    whole.encode_special_tokens = True
    data = np.frombuffer(_SAMPLE.encode(), np.uint8)
    ids, _ = Encoder(definition).encode(data, np.array([0, len(data)]), 0)
    if ids[:-1].tolist() != whole.encode(_SAMPLE, add_special_tokens=False).ids:
        raise ValueError("the tokenizer does not cut words at white space as this operator needs")
