"""Hashed word shingles of whole texts, straight from Arrow buffers.

A text is lower-cased (A-Z only) and cut into words `[^\\x20\\x09-\\x0D]+`. Its set holds a 64-bit hash of every run of `width`
words; a text with fewer words counts as one shingle of all its words; a text without words has the empty set. Hashes
depend on the words alone, so they are the same in every task and run. A text of any length is worked through in pieces
that end at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
WIDTH = 5
U64 = np.uint64
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, U64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(1, 2**63, dtype=U64)) | 1
_PLACES = _rng.integers(1, 2**63, 64, U64) | U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest piece so far needs."""

    up = down = np.zeros(0, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        return cls.up[:n], cls.down[:n]


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges of at most about PIECE bytes with the rows they touch: whole rows, or parts of one long row."""
    row, n = 0, len(bounds) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PIECE, "right")) - 1)
        lo, hi = int(bounds[row]), int(bounds[last])
        while hi - lo > PIECE:
            cut = lo + PIECE
            while cut < hi and not (gap := np.flatnonzero(_GAPS[data[cut : min(cut + 4096, hi)]])).size:
                cut += 4096
            if cut >= hi:
                break
            yield lo, cut + int(gap[0]), row, last
            lo = cut + int(gap[0])
        yield lo, hi, row, last
        row = last


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, and how many words each row has."""
    hashes, counts = [np.zeros(0, U64)], np.zeros(len(bounds) - 1, np.int64)
    for lo, hi, row, last in _pieces(data, bounds):
        if hi == lo:
            continue
        part = data[lo:hi]
        word = ~_GAPS[part]
        edge = np.zeros(hi - lo + 1, bool)
        edge[[0, -1]] = True
        inner = bounds[row : last + 1]
        edge[inner[(inner > lo) & (inner < hi)] - lo] = True
        edge[1:-1] |= word[1:] != word[:-1]
        cuts = np.flatnonzero(edge)
        starts = cuts[:-1]
        kept = word[starts]
        starts, ends = starts[kept], cuts[1:][kept]
        up, down = _Powers.of(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)))
        counts[row:last] += np.bincount(np.searchsorted(bounds[row + 1 : last], starts + lo, "right"), minlength=last - row)
    return np.concatenate(hashes), counts


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows in order, repeated ones too, and how many each row has."""
    words, counts = word_hashes(data, bounds)
    ends = np.cumsum(counts)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = ends - counts
    if not runs.sum():
        return np.zeros(0, U64), runs
    at = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    out = np.zeros(len(at), U64)
    for k in range(width):
        short = np.repeat(np.minimum(counts, width), runs)
        take = at + k
        out += np.where(k < short, words[np.minimum(take, len(words) - 1)], U64(0)) * _PLACES[k]
    return mixed(out + np.repeat(np.minimum(counts, width), runs).astype(U64)), runs


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row bounds, without a copy; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def row_groups(column: pa.Array, size: int = 2 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of rows of about `size` bytes; a longer row comes alone."""
    data, bounds = text_buffer(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        yield row, last, data, bounds[row : last + 1]
        row = last
