"""Word and shingle hashes over whole Arrow columns.

Words are hashed with numpy over the UTF-8 bytes of many texts at once: a polynomial prefix sum gives
each word's hash without a Python loop over words. White space is ASCII (0x20, 0x09-0x0D), which never
occurs inside a multi-byte UTF-8 sequence, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SHINGLE = 0xD6E8FEB86659FD93 | 1
_CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        _powers[base] = have
    return have[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each; a null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(texts: pa.Array, limit: int = _CHUNK_BYTES, most: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of `most` rows or fewer that hold about `limit` bytes; a longer text stands alone."""
    raw, off = text_bytes(texts)
    first, rows = 0, len(off) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        last = min(last, first + most, rows)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def words(raw: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word with the total at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[_FOLD[raw] if fold else raw] * _power(_BASE, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _power(_BASE_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, off)


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of `width` words, from runs of 1, 2, 4, ... words."""
    many, part, at = len(hashes) - width + 1, hashes, 0
    out, size = np.zeros(many, dtype=np.uint64), 1
    while True:
        if width & size:
            out += part[at : at + many] * U64(pow(_SHINGLE, at, 1 << 64))
            at += size
        if at == width:
            return out
        part = part[:-size] + part[size:] * U64(pow(_SHINGLE, size, 1 << 64))
        size *= 2


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `width` words, index of each text's first run). A text of fewer words has one run, all its words; a text without words none."""
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(runs)))
    out = np.zeros(begin[-1], dtype=np.uint64)
    if not len(out):
        return out, begin
    with np.errstate(over="ignore"):
        if len(hashes) >= width:
            rolled = _rolled(hashes, width)
            long = count >= width
            take = np.ones(int(count[long].sum()), dtype=bool)
            tail = np.cumsum(count[long])
            for k in range(1, width):
                take[tail - k] = False
            at = np.flatnonzero(np.repeat(long, count))[take]
            out[np.repeat(long, runs)] = mix(rolled[at])
        for t in np.flatnonzero((count > 0) & (count < width)):
            own = hashes[first[t] : first[t + 1]]
            out[begin[t]] = mix(mix(sum((own[k : k + 1] * U64(pow(_SHINGLE, k, 1 << 64)) for k in range(len(own))), start=np.zeros(1, np.uint64)) + U64(len(own))))[0]
    return out, begin


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in row order."""
    for _, raw, off in chunks(texts):
        runs, begin = shingles(*words(raw, off), width)
        for k in range(len(begin) - 1):
            yield np.unique(runs[begin[k] : begin[k + 1]])
