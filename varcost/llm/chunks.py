"""Whitespace chunks of texts, found and told apart in bulk.

A *chunk* is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``. Chunks of up to ``SHORT`` bytes are compared as
whole numbers made of their bytes, so equal numbers mean equal bytes; longer ones are compared as byte strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from varcost.llm.common import BLANKS, mix

# Bytes that fit into the numbers a chunk is compared by.
SHORT = 24

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each chunk of a slice of texts, and where each text's chunks begin (one more than texts)."""
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A chunk also begins and ends where its text does.
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    ends = begins[begins > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _numbers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The bytes of each short chunk as integers of eight bytes, filled up with zeros."""
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    at_byte = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,))
    parts = []
    for k in range(0, SHORT, 8):
        bits = (np.clip(sizes - k, 0, 8) * 8).astype(np.uint64)
        keep = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
        parts.append(at_byte[starts + k] & keep)
    return parts


def distinct_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different chunks of a slice, and for each chunk its place among them."""
    raw = data.tobytes()
    sizes = ends - starts
    short = np.flatnonzero(sizes <= SHORT)
    index = np.zeros(len(starts), np.int64)
    parts = _numbers(data, starts[short], sizes[short])
    name = sizes[short].astype(np.uint64)
    for part in parts:
        name = mix(name * np.uint64(0xD6E8FEB86659FD93) + part)
    _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
    same = sizes[short] == sizes[short][first][inverse]
    for part in parts:
        same &= part == part[first][inverse]
    index[short] = inverse
    at, to = starts[short][first].tolist(), ends[short][first].tolist()
    found = [raw[a:b] for a, b in zip(at, to)]
    # Long chunks, and any short one whose name is that of another.
    others = np.concatenate([np.flatnonzero(sizes > SHORT), short[~same]])
    known: dict[bytes, int] = {}
    for k in others.tolist():
        chunk = raw[starts[k]:ends[k]]
        place = known.get(chunk)
        if place is None:
            place = known[chunk] = len(found)
            found.append(chunk)
        index[k] = place
    return found, index


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2**32, all lowest bytes first and all highest, which are mostly 0, last; compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
