"""Vectorised text kernels over Arrow string buffers: word spans, span hashes and shingles.

Everything works on a whole record batch at once with numpy; no Python object is made per word.
Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(_SLICE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _pow_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        base = (_BASE * 0x2545F4914F6CDD1D) & _MASK | 1
        _tables["pow"], _tables["inv"] = _powers(base), _powers(pow(base, -1, 1 << 64))
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    power, inverse = _pow_tables()
    i = 0
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(ends, low + _SLICE, side="right"))
        if j <= i:  # one span longer than a slice
            digest = hashlib.blake2b(raw[low : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
            continue
        part = raw[low : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        at = starts[i:j] - low
        out[i:j] = (total[ends[i:j] - low] - total[at]) * inverse[at]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_WEIGHTS = [int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little") | 1 for k in range(64)]


def combine(hashes: np.ndarray, at: np.ndarray, picks: tuple[int, ...], seed: int) -> np.ndarray:
    """Hash of the words ``at + pick`` for each pick, in order."""
    total = np.full(len(at), seed * 0x9E3779B97F4A7C15 & _MASK, np.uint64)
    for k, pick in enumerate(picks):
        total += hashes[at + pick] * np.uint64(_WEIGHTS[k % 64])
    return mix(total, len(picks))


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the row offsets into them.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    count = np.diff(rows)
    made = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    out = np.empty(offsets[-1], np.uint64)
    row = np.repeat(np.arange(len(count)), made)
    at = rows[:-1][row] + np.arange(offsets[-1]) - offsets[:-1][row]
    short = count[row] < width
    full = ~short
    out[full] = combine(hashes, at[full], tuple(range(width)), 7)
    for size in range(1, width):
        some = short & (count[row] == size)
        if some.any():
            out[some] = combine(hashes, at[some], tuple(range(size)), 7 + size)
    return out, offsets
