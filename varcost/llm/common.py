"""What the corpus operators share: whitespace, row locators, and vectorised text arrays.

A *word* is a maximal run of characters other than ``[\\x20\\x09-\\x0D]``. A NULL text counts as
an empty one everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varcost.sinks.scratch import stage

# The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

FILE, ROW = "__file", "__row"


def text_of(column: str | Column) -> Column:
    """The text with NULL as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % buckets


# What a frame may be made of so that every row is a row of a file: a scan, with columns computed and rows filtered.
_ONE_TO_ONE = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _is_scan(df: DataFrame) -> bool:
    """Whether the frame is one scan of files, and no operator multiplies, joins, unites or moves its rows."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ONE_TO_ONE:
        children = plan.children()
        if children.isEmpty():
            return bool(df.inputFiles())
        plan = children.head()
    return False


def with_locator(docs: DataFrame, name: str) -> DataFrame:
    """Add where each row is stored: ``__file`` (64-bit hash of the path) and ``__row``. Every row has a locator of its own.

    Both come from the file scan, so any later scan of the same files gives a row the same
    locator. Rows that do not come straight from a file, each as it is there, are first written to the scratch folder.
    """
    where = {
        FILE: F.xxhash64(F.col("_metadata.file_path")),
        ROW: F.col("_metadata.row_index"),
    }
    if _is_scan(docs):
        try:
            return docs.withColumns(where)
        except AnalysisException:  # its columns hide the scan's
            pass
    return stage(docs, name).withColumns(where)


def positional(docs: DataFrame) -> DataFrame:
    """The same columns under names that clash with nothing: ``c0``, ``c1`` and so on."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def place_of(docs: DataFrame, column: str) -> str:
    return f"c{docs.columns.index(column)}"


# Vectorised text ---------------------------------------------------------------------------

# Bytes that are handled at once inside a task; bounds the size of the arrays below.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into slices of about ``limit`` bytes.

    Yields the first row of the slice, its bytes, and the offsets of its rows in them (one more
    than there are rows). A single text may exceed the limit; it is never cut. NULLs are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of a well-known splittable generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


class RunningHash:
    """Hash of any substring of one byte array in constant time, equal for equal bytes.

    A polynomial hash modulo 2**64 over scrambled byte codes: prefix sums of code * base**i, and
    a substring's difference divided by base**start (the base is odd, so it has an inverse).
    """

    def __init__(self, data: np.ndarray):
        size = 1 << max(20, int(len(data) + 1).bit_length())
        power, self._inverse = _powers(size)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * power[:len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a slice of texts: hash of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        inside = ~_BLANK[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        # A word also ends where its text ends.
        starts_at = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[starts_at] = inside[starts_at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[starts_at[starts_at > 0] - 1] |= inside[starts_at[starts_at > 0] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.starts, self.ends = starts, ends
        self.hashes = RunningHash(data).of(starts, ends)
        self.bounds = np.searchsorted(starts, offsets)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``size`` consecutive words of each text, and the texts' bounds.

        A text of fewer words, but at least one, has a single shingle of all its words.
        """
        n = np.diff(self.bounds)
        count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
        bounds = np.concatenate([[0], np.cumsum(count)])
        owner = np.repeat(np.arange(len(n)), count)
        at = self.bounds[owner] + np.arange(bounds[-1]) - bounds[owner]
        length = np.minimum(n, size)[owner]
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            part = k < length
            out[part] = mix(out[part] * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at[part] + k] + np.uint64(k + 1))
        return out, bounds


def record_batch(columns: Sequence[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])
