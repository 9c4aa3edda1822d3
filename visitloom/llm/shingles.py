"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CHUNK = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a space before each, and where each text starts; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    n = len(column)
    framed = np.full(len(data) + n + 1, 0x20, dtype=np.uint8)
    framed[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
    return framed, offsets[:-1] - offsets[0] + np.arange(n)


def word_hashes(framed: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, A-Z folded, words split at white space."""
    space = _SPACE[framed]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(~space)
    size = np.diff(np.append(np.searchsorted(at, begin), len(at)))
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    power = np.ones(size.max(), dtype=np.uint64)
    power[1:] = _BASE
    np.multiply.accumulate(power, out=power)
    h = np.add.reduceat(_BYTE[_FOLD[framed[at]]] * power[place], first)
    return mix(h + size.astype(np.uint64)), np.searchsorted(starts, begin, side="right") - 1


def shingle_sets(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct k-word shingles of each text, sorted.

    A text of fewer than k words is one shingle; without words it has none.
    """
    h, doc = word_hashes(*texts_of(column))
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    weight = mix(np.arange(11, 11 + k, dtype=np.uint64))| np.uint64(1)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    s = sum(padded[j : j + len(h)] * weight[j] for j in range(k))
    inside = np.zeros(len(h), dtype=bool)
    if len(h) >= k:
        inside[: len(h) - k + 1] = doc[: len(h) - k + 1] == doc[k - 1 :]
    words = np.bincount(doc)
    short = np.flatnonzero((words > 0) & (words < k))
    first = np.searchsorted(doc, short)
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        take = words[short] > j
        whole[take] += h[first[take] + j] * weight[j]
    whole += words[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    d = np.concatenate([doc[inside], short])
    s = mix(np.concatenate([s[inside], whole]))
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[new], s[new]


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK bytes of text each, one row at least."""
    size = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if total and total + s > CHUNK:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    if begin < len(size):
        yield batch.slice(begin)
