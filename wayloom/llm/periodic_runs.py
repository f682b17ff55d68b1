"""Periodic runs of words: stretches that repeat with a fixed period, found by minimizers at several scales."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
LEAST_LENGTH = 24
LEAST_TIMES = 3
DIRECT = 8
GROUP_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_RUN = "struct<start:long,length:long,period:long>"


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest group so far needs."""

    up = down = np.zeros(0, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            both = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=U64))
            cls.up, cls.down = both
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class Sequence:
    """Word ids with prefix hashes: hashes of any stretch, and how far two places agree."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        up, self.down = _Powers.of(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_mixed(ids.astype(U64) + U64(1)) * up[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each place on."""
        n = len(self.ids) - k + 1
        return _mixed((self.sums[k:] - self.sums[:n]) * self.down[:n])

    def agree(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from i and j on (or before them) are equal, by halving; i < j."""
        low, high = np.zeros(len(i), np.int64), (len(self.ids) - j if ahead else i).astype(np.int64)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            a, b = (i, j) if ahead else (i - middle, j - middle)
            same = self.hashes(a, middle) == self.hashes(b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low


def _window(values: np.ndarray, width: int, fold: np.ufunc) -> np.ndarray:
    """The fold (minimum or maximum) of every `width` neighbours, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out = fold(out[:-done], out[done:])
        done *= 2
    return out if done == width else fold(out[: len(values) - width + 1], out[width - done :])


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each stretch of True."""
    edges = np.flatnonzero(np.diff(np.r_[False, same, False].view(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _least(period: np.ndarray | int, length: int, times: int) -> np.ndarray | int:
    return np.maximum(length, times * period)


def short_periods(ids: np.ndarray, most: int, length: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches (start, length, period) by a direct scan of each lag up to `most`."""
    for lag in range(1, min(most, len(ids) - 1) + 1):
        at, n = _stretches(ids[lag:] == ids[:-lag])
        long = n + lag >= _least(lag, length, times)
        if long.any():
            yield at[long], n[long] + lag, np.full(int(long.sum()), lag, np.int64)


def scale_seeds(seq: Sequence, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring equal minimizers whose distance is a period of this scale, from `low` to `high`: (place, distance).

    A gram of `high` words holds a whole period, so inside a run it comes again after one period and not before. Windows of
    2 * low - high + 1 grams span less than two periods: of a run of three, two windows one period apart lie inside, and
    have the same minimum.
    """
    if len(seq.ids) < high + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = seq.grams(high)
    width = min(2 * low - high + 1, len(grams))
    least = _window(grams, width, np.minimum)
    padded = np.r_[np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)]
    at = np.flatnonzero(_window(padded, width, np.maximum) == grams)
    at = at[np.argsort(grams[at], kind="stable")]
    gap = np.diff(at)
    good = (grams[at[1:]] == grams[at[:-1]]) & (gap >= low) & (gap <= high)
    return at[:-1][good], gap[good]


def _confirmed(ids: np.ndarray, at: np.ndarray, n: np.ndarray, lag: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches found by hashes, compared word by word: where a hash has lied, the true stretch around the seed."""
    at, n = at.copy(), n.copy()
    for i in range(len(at)):
        same = ids[at[i] : at[i] + n[i]] == ids[at[i] + lag[i] : at[i] + n[i] + lag[i]]
        if same.all():
            continue
        own = int(seed[i] - at[i])
        before, after = np.flatnonzero(~same[:own]), np.flatnonzero(~same[own:])
        start = int(before[-1]) + 1 if len(before) else 0
        stop = own + int(after[0]) if len(after) else len(same)
        at[i], n[i] = at[i] + start, stop - start
    return at, n


def long_periods(ids: np.ndarray, lengths: np.ndarray, above: int, length: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches (start, length, period) with periods over `above`: scales of half as many words again, each over the texts
    that are long enough for it; every text ends with an id of its own."""
    starts = np.cumsum(lengths) - lengths
    live, seq, offsets = np.arange(len(lengths)), Sequence(ids), starts
    low = above + 1
    while True:
        high = low + low // 2
        long = lengths[live] - 1 >= _least(low, length, times)
        if not long.any():
            return
        if lengths[live[~long]].sum() * 4 > len(seq.ids):
            live = live[long]
            seq = Sequence(np.concatenate([ids[starts[d] : starts[d] + lengths[d]] for d in live]))
            offsets = np.cumsum(lengths[live]) - lengths[live]
        at, lag = scale_seeds(seq, low, high)
        if len(at):
            back, on = seq.agree(at, at + lag, False), seq.agree(at, at + lag, True)
            good = back + on + lag >= _least(lag, length, times)
            found = np.unique(np.stack([at[good] - back[good], back[good] + on[good], lag[good]], axis=1), axis=0, return_index=True)
            if len(found[1]):
                begin, n, gap = found[0].T
                begin, n = _confirmed(seq.ids, begin, n, gap, at[good][found[1]])
                good = n + gap >= _least(gap, length, times)
                if good.any():
                    doc = np.searchsorted(offsets, begin[good], "right") - 1
                    yield begin[good] - offsets[doc] + starts[live[doc]], n[good] + gap[good], gap[good]
        low = high + 1


def runs_of(ids: np.ndarray, lengths: np.ndarray, length: int = LEAST_LENGTH, times: int = LEAST_TIMES, direct: int = DIRECT) -> np.ndarray:
    """All runs of a group of texts, rows (start, length, period) by start and period.

    `ids` holds the words of all texts, each text closed by an id that stands nowhere else; `lengths` counts them, the
    closing id included. A stretch that is long enough for a multiple of its period is found under both; the smallest stays.
    """
    parts = [np.stack(x, axis=1) for x in (*short_periods(ids, direct, length, times), *long_periods(ids, lengths, direct, length, times))]
    if not parts:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(parts), axis=0)
    first = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(runs: np.ndarray) -> np.ndarray | None:
    """The run with the greatest length / period, exactly; of equal ones the first, then the one of the smallest period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-9)]
    return max(near, key=lambda r: (Fraction(int(r[1]), int(r[2])), -int(r[0]), -int(r[2])))


def kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


def periodic_runs(docs: DataFrame, length: int = LEAST_LENGTH, times: int = LEAST_TIMES, direct: int = DIRECT) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_words, n_runs, best (start, length, period), runs, runs_sha256, collapsed.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0 and compared byte by byte. A run is a stretch of words
    with smallest period q and at least max(length, times * q) words that no neighbour extends; `times` is 3 or more. `best`
    has the greatest length / period (ties: first start, then smallest period) and is null without runs. `runs` lists all by
    start, then period; `runs_sha256` is of their lines `start,length,period`. `collapsed` joins by one space the words
    that stand in no run beyond its first period.

    A null, empty or blank text has no words and no runs, and an empty `collapsed`. Rows are independent: repeated or null ids
    change nothing, no rows give no rows, further columns are not read. Texts are taken in groups of a few MB; one longer text
    is worked through alone, in memory that is a multiple of its own size.
    """
    if times < 3:
        raise ValueError("a run needs three periods at least: with fewer, windows of minimizers do not fit")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row = batch.column("text"), 0
            while row < batch.num_rows:
                words: list[list[bytes]] = []
                size, first = 0, row
                while row < batch.num_rows and (size < GROUP_BYTES or row == first):
                    text = texts[row].as_buffer()
                    data = b"" if text is None else text.to_pybytes()
                    size += len(data)
                    words.append(data.split())
                    row += 1
                yield _answers(batch.column("doc_id")[first:row], words, length, times, direct)

    schema = f"doc_id long, n_words long, n_runs long, best {_RUN}, runs array<{_RUN}>, runs_sha256 string, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, schema)


def _answers(doc_ids: pa.Array, words: list[list[bytes]], length: int, times: int, direct: int) -> pa.RecordBatch:
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    ids = np.empty(int(lengths.sum()), np.int64)
    ends = np.cumsum(lengths)
    for own, end in zip(words, ends, strict=True):
        ids[end - 1 - len(own) : end - 1] = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
    ids[ends - 1] = len(numbers) + np.arange(len(words))
    runs = runs_of(ids, lengths, length, times, direct)
    doc = np.searchsorted(ends, runs[:, 0], "right")
    runs[:, 0] -= (ends - lengths)[doc]
    bounds = np.searchsorted(doc, np.arange(len(words) + 1))
    best, digests, collapsed = [], [], []
    for d, own in enumerate(words):
        mine = runs[bounds[d] : bounds[d + 1]]
        top = strongest(mine)
        best.append(None if top is None else dict(zip(("start", "length", "period"), map(int, top), strict=True)))
        digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in mine.tolist()).encode()).hexdigest())
        collapsed.append(b" ".join(compress(own, kept_words(mine, len(own))) if len(mine) else own).decode())
    found = pa.StructArray.from_arrays([pa.array(runs[:, k].copy()) for k in range(3)], ["start", "length", "period"])
    columns = [
        doc_ids.cast(pa.int64()), pa.array(lengths - 1), pa.array(np.diff(bounds)), pa.array(best, found.type),
        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found), pa.array(digests), pa.array(collapsed, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_runs", "best", "runs", "runs_sha256", "collapsed"])
