"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie over bytes. Where the next byte has no edge, the automaton does not step back
in the text: each node has a failure link to the node of what remains of its string after greedy
matching, and the number of pieces that this pops. Counts are sums of these numbers, so no piece
is ever built, and each byte is read once.

A word is matched with one blank before it, so pieces that begin words begin with a blank.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds what is broadcast: a vocabulary is of fixed size, whatever the data.
MAX_VOCABULARY_BYTES = 64 << 20
# Words whose counts a worker keeps; the memory is emptied when it is full.
MEMORY_WORDS = 1 << 19
# Longer words are counted anew each time, which bounds the bytes that a worker keeps.
MEMORY_WORD_BYTES = 64

ROOT, DEAD = 0, -1


class Automaton:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, pieces: Iterable[bytes]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = ROOT
            for byte in piece:
                if (child := edges[node].get(byte)) is None:
                    child = edges[node][byte] = len(edges)
                    edges.append({})
                    final.append(False)
                node = child
            final[node] = node != ROOT
        self._edges = edges
        self._fail, self._pops = [DEAD] * len(edges), [0] * len(edges)
        queue = deque([ROOT])
        while queue:
            node = queue.popleft()
            for byte, child in edges[node].items():
                queue.append(child)
                if final[child]:  # the whole string is a piece, nothing remains
                    self._fail[child], self._pops[child] = ROOT, 1
                    continue
                # What remains of the parent, extended by the byte.
                at, pops = self._fail[node], self._pops[node]
                while at != DEAD and byte not in edges[at]:
                    at, pops = self._fail[at], pops + self._pops[at]
                if at != DEAD:
                    self._fail[child], self._pops[child] = edges[at][byte], pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy match of a blank and ``word``; 1 (one unknown) if it has none."""
        edges, fail, pops = self._edges, self._fail, self._pops
        node, total = ROOT, 0
        for byte in b" " + word:
            while (child := edges[node].get(byte)) is None:
                if fail[node] == DEAD:
                    return 1
                total += pops[node]
                node = fail[node]
            node = child
        while node != ROOT:
            if fail[node] == DEAD:
                return 1
            total += pops[node]
            node = fail[node]
        return total


class _Memory(dict):
    """Counts of words seen by this worker."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self._count = automaton.count

    def __missing__(self, word: bytes) -> int:
        if len(word) > MEMORY_WORD_BYTES:
            return self._count(word)
        if len(self) >= MEMORY_WORDS:
            self.clear()
        count = self[word] = self._count(word)
        return count


_memories: dict[int, _Memory] = {}


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file with lines of base64 and rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_tokens``.

    Every word counts with as many pieces as the greedy longest match has; a word that cannot be matched to its
    end counts as one. A NULL, empty or blank text has no words and no tokens. Texts are taken whole, at
    any length; rows with a NULL or repeated id count for themselves; an empty table gives an empty
    result. Only the id and the text are read. No shuffle: each row is counted where it is scanned.
    """
    size = sum(map(len, pieces))
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {size} bytes, more than {MAX_VOCABULARY_BYTES}")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _memories:  # one automaton per worker, which Spark reuses for many tasks
            _memories.clear()
            _memories[key] = _Memory(Automaton(shared.value))
        of = _memories[key].__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                # bytes.split() cuts exactly at runs of the blanks.
                words = text.as_py().encode().split() if text.is_valid else []
                n_words.append(len(words))
                n_tokens.append(sum(map(of, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"doc_id {kind}, n_words bigint, n_tokens bigint")
