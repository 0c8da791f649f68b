"""Vectorised helpers over the UTF-8 bytes of an Arrow string column.

They run inside ``mapInArrow`` tasks.  A null text counts as empty.  Memory is
bounded by ``CHUNK_BYTES`` of text (or one longer text) at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by the numpy helpers.
CHUNK_BYTES = 2 << 20
#: Words hashed at once (bounds the temporaries for very long texts).
SPAN_BLOCK = 1 << 16

#: White space of every contract: space and U+0009..U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte map that lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_NORMAL = LOWER.copy()
_WORDY = np.ones(256, bool)
_WORDY[:128] = False
_WORDY[np.r_[48:58, 65:91, 97:123]] = True
_NORMAL[~_WORDY] = 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets of the texts in them."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes (at least one row each)."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the n+1 word offsets of the texts."""
    n = len(off) - 1
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(n + 1, np.int64)
    solid = ~SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    first[edges] = True
    last = np.empty(len(raw), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    inner = off[1:-1]
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        a = np.full(size, base, np.uint64)
        a[0] = 1
        have = np.cumprod(a, dtype=np.uint64)
        if n <= CHUNK_BYTES * 2:
            _POWERS[base] = have
    return have


def mix64(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (an invertible avalanche)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span (equal bytes, equal hash); spans are sorted and disjoint."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), SPAN_BLOCK):
        s, e = starts[i:i + SPAN_BLOCK], ends[i:i + SPAN_BLOCK]
        lo, hi = int(s[0]), int(e[-1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, hi - lo)[:hi - lo], out=total[1:])
        h = (total[e - lo] - total[s - lo]) * _powers(_INVERSE, hi - lo + 1)[s - lo]
        out[i:i + SPAN_BLOCK] = mix64(h + (e - s).astype(np.uint64))
    return out


def segments(counts: np.ndarray) -> np.ndarray:
    """Owner of each element: 0 repeated counts[0] times, 1 repeated counts[1] times, ..."""
    return np.repeat(np.arange(len(counts)), counts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 of all i, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal bytes of the texts, their offsets, and the original place of each kept byte."""
    b = _NORMAL[raw]
    keep = _WORDY[raw]
    first = np.zeros(len(raw), bool)
    first[off[:-1][off[:-1] < len(raw)]] = True
    keep[1:] |= keep[:-1].copy() & ~first[1:]       # the first separator after a word stays
    at = np.flatnonzero(keep)
    return b[at], np.searchsorted(at, off), at
