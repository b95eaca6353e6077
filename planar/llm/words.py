"""Words of whole texts as numpy arrays, for tasks that receive Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those bytes never
occur inside a UTF-8 sequence, so words are cut on the encoded text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
# Any fixed random values and odd multipliers do; they only have to stay the same.
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def word_array(text: str | Column) -> Column:
    """The words of a text as an array column; NULL has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != F.lit(""))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a uint64 hash over all of it."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(33)
    h *= _MIX[1]
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of several texts in order. ``first[i]:first[i + 1]`` are text ``i``'s."""

    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # where each text starts, and the end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Which text each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        return hash_runs(self.data, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the ``n + 1`` offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    _, at, data = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array) -> Words:
    data, at = text_bytes(texts)
    solid = ~_GAP[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner], after[inner - 1] = True, True
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run ``data[start:end]`` (none is empty)."""
    length = end - start
    if not len(length):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    within = np.arange(begin[-1] + length[-1]) - np.repeat(begin, length)
    power = np.multiply.accumulate(np.full(int(length.max()), _STEP))
    terms = _BYTE[data[np.repeat(start, length) + within]] * power[within]
    return mix(np.add.reduceat(terms, begin) ^ (length.astype(np.uint64) * _MIX[0]))


def hash_windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive entries of ``h``."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out ^= h[j : j + n]
        out *= _STEP
        out ^= out >> np.uint64(29)
    return mix(out)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words at which a window of ``width`` words fits its text."""
    room = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.cumsum(room) - room
    return np.arange(int(room.sum())) - np.repeat(begin - first[:-1], room)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text each, one row at least;
    bounds what numpy needs beside the batch."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + most_bytes, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
