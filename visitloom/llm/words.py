"""Words of whole Arrow batches at once: byte classes, lower-cased words, rows and pieces.

Texts come as Arrow binary (null counts as empty). A table of 256 byte classes says which bytes
make words; A-Z is lower-cased and nothing else. UTF-8 never uses a byte below 0x80 inside a
longer character, so splitting bytes at ASCII characters equals splitting the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step takes at a time, so that its arrays stay small.
STEP_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def classes(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    """0 for bytes of words, 1 for separators, 2 for separators that also end a piece."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(separators)] = 1
    out[list(breaks)] = 2
    return out


@dataclass
class Words:
    """Words of a run of texts, in order."""

    values: pa.Array  # lower-cased, large_binary
    lengths: np.ndarray  # bytes of each word
    row: np.ndarray  # row of each word, ascending
    piece: np.ndarray  # number of separators of class 2 before each word
    rows: int

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(place of each word in the second, distinct words)."""
        told = self.values.dictionary_encode()
        return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary

    def linked(self, n: int) -> np.ndarray:
        """Where n words in a row begin, all of one row and one piece."""
        if len(self.row) < n:
            return np.zeros(0, dtype=np.int64)
        first, last = slice(None, len(self.row) - n + 1), slice(n - 1, None)
        return np.flatnonzero((self.row[first] == self.row[last]) & (self.piece[first] == self.piece[last]))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a binary array without nulls."""
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data


def split(texts: pa.Array, table: np.ndarray) -> Words:
    """Words of all texts."""
    offsets, data = _bytes(texts)
    kind = table[data]
    inside = kind == 0
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False  # a text's first byte follows nothing
    start = np.flatnonzero(inside & ~before)
    kept = _LOWER[data[inside]]
    ends = np.concatenate([np.cumsum(inside, dtype=np.int64)[start] - 1, [len(kept)]]) if len(start) else np.zeros(1, dtype=np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
    broken = np.flatnonzero(kind == 2)
    return Words(values, np.diff(ends), row, np.searchsorted(broken, start), len(texts))


def listed(values: pa.Array) -> list[bytes]:
    """The values of a large_binary array without nulls; much faster than ``to_pylist``."""
    if not len(values):
        return []
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    held = data.to_pybytes()
    return [held[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def steps(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; one longer text is a run of its own."""
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        offsets, _ = _bytes(part.column(column))
        at = 0
        while at < part.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield part.slice(at, to - at)
            at = to


class Distinct:
    """Sums by integer key, gathered run by run and merged as they grow."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.merged = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        told, n = _summed(keys, np.ones(len(keys), dtype=np.int64) if counts is None else counts)
        self.runs.append((told, n))
        self.held += len(told)
        if self.held > 2 * self.merged + (1 << 20):
            self.runs = [self.all()]
            self.held = self.merged = len(self.runs[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(self.runs) == 1:
            return self.runs[0]
        return _summed(np.concatenate([k for k, _ in self.runs]), np.concatenate([n for _, n in self.runs]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys.astype(np.int64), counts.astype(np.int64)
    if len(counts) and (counts == 1).all():  # sorting bare keys is much faster than ordering them
        told, n = np.unique(keys, return_counts=True)
        return told.astype(np.int64), n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first].astype(np.int64), np.add.reduceat(counts, first).astype(np.int64)


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """Where each of distinct 64-bit keys stands: open addressing, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        left, home, tried = np.arange(len(keys), dtype=np.int32), self._home(keys), 0
        while len(left):
            at = (home[left] + tried) & ((1 << self.bits) - 1)
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left, tried = left[self.table[at] != left], tried + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The place of each asked key, -1 for keys that are not held."""
        asked = np.ascontiguousarray(asked, dtype=np.int64)
        if not len(self.keys):
            return np.full(len(asked), -1, dtype=np.int64)
        home = self._home(asked)
        out = self.table[home].astype(np.int64)
        open_, tried = np.flatnonzero((out >= 0) & (self.keys[out] != asked)), 1
        while len(open_):
            out[open_] = self.table[(home[open_] + tried) & ((1 << self.bits) - 1)]
            told = out[open_]
            open_, tried = open_[(told >= 0) & (self.keys[told] != asked[open_])], tried + 1
        return out
