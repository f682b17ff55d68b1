"""Line dedup by a segment-partition join under an edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.bits import bit_filter, passes
from wayloom.llm.shared import components, stored
from wayloom.llm.shingles import U64, mixed

EDITS = 2
FUZZY_FROM = 40
#: (characters, edits): from so many characters of the shorter line on, so many edits. Up to 7 edits, rising with the length.
LIMITS = ((2, 1), (40, 2), (160, 3), (320, 4))
SMALL = 64
BLOCK = 1024
_BATCH = 1 << 18
_rng = np.random.default_rng(20240602)
_BASE = int(_rng.integers(1, 2**63, dtype=U64)) | 1
_BACK = pow(_BASE, -1, 2**64)
_SALT = U64(0x9E3779B97F4A7C15)
_LINE = "doc_id long, text_hash long, line_no int, n_chars int, x long, y long"


class _Tables:
    """A random number for each code point, and powers of the base and its inverse, made once in each process."""

    points = np.zeros(0, U64)
    classes = np.zeros(0, np.uint8)
    up = down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(cls.points):
            cls.points = mixed(np.arange(1, 0x110001, dtype=U64) * _SALT)
            cls.classes = (cls.points >> U64(59)).astype(np.uint8)
        if len(cls.up) < n:
            up, down = np.full(n, _BASE, U64), np.full(n, _BACK, U64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return cls.points, cls.up[:n], cls.down[:n]


class Lines:
    """The trimmed lines of some texts as spans of one array of code points, with hashes of any part of them."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        table, up, self._down = _Tables.of(len(self.points) + 1)
        self._sums = np.zeros(len(self.points) + 1, U64)
        np.cumsum(table[self.points] * up[:-1], out=self._sums[1:])
        ends = np.r_[np.flatnonzero(self.points == 10), len(self.points)]
        starts = np.r_[0, ends[:-1] + 1]
        sizes = np.array([t.count("\n") + 1 for t in texts])
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.number = np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.start, self.end = self._trimmed(starts, ends)
        self.length = self.end - self.start
        middle = (self.start + self.end) // 2
        h, a, b = (self.hashes(*p) for p in ((self.start, self.end), (self.start, middle), (middle, self.end)))
        # The whole and both halves: two texts of one length agree in both only if both halves do.
        self.x, self.y = mixed(h + self.length.astype(U64)).view(np.int64), mixed(a * _SALT + b + self.length.astype(U64)).view(np.int64)

    def _trimmed(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without spaces, tabs and the like at their ends: step by step where there are few, else by a search."""
        padded = np.append(self.points, np.uint32(0))

        def gap(p: np.ndarray) -> np.ndarray:
            return (p == 32) | ((p >= 9) & (p <= 13))

        for _ in range(4):
            left, right = (starts < ends) & gap(padded[starts]), (starts < ends) & gap(padded[ends - 1])
            if not left.any() and not right.any():
                return starts, ends
            starts = starts + left
            ends = np.maximum(ends - right, starts)
        solid = np.append(np.flatnonzero(~gap(self.points)), len(self.points))
        first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        full = last > first
        return np.where(full, solid[np.minimum(first, len(solid) - 1)], starts), np.where(full, solid[last - 1] + 1, starts)

    def bags(self, chosen: np.ndarray) -> np.ndarray:
        """For each line how often characters of 32 classes occur, each count modulo 4 in two bits."""
        sizes = self.length[chosen]
        at = np.repeat(self.start[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        slots = np.repeat(np.arange(len(chosen)) * 32, sizes) + _Tables.classes[self.points[at]]
        counts = np.bincount(slots, minlength=32 * len(chosen)).reshape(-1, 32) & 3
        return (counts.astype(U64) << (U64(2) * np.arange(32, dtype=U64))).sum(axis=1, dtype=U64).view(np.int64)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self._sums[b] - self._sums[a]) * self._down[a]


def _batches(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about a megabyte of text."""
    held, size, at = [], 0, 0
    for i, t in enumerate(batch.column(column).to_pylist()):
        if held and size + len(t or "") > _BATCH:
            yield batch.slice(at, len(held)), held
            held, size, at = [], 0, i
        held.append(t or "")
        size += len(t or "")
    if held:
        yield batch.slice(at, len(held)), held


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: doc_id, text_hash, line_no (from 0), n_chars and 128 bits (x, y) that name its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _batches(batch):
                lines = Lines(texts)
                keep = np.flatnonzero(lines.length > 0)
                own = pa.array(lines.text[keep])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(own), part.column("text_hash").take(own), pa.array(lines.number[keep].astype(np.int32)), pa.array(lines.length[keep].astype(np.int32)), pa.array(lines.x[keep]), pa.array(lines.y[keep])],
                    ["doc_id", "text_hash", "line_no", "n_chars", "x", "y"],
                )

    return _texts(docs).mapInArrow(work, _LINE)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def limit_of(length: np.ndarray, limits: tuple) -> np.ndarray:
    """Edits that lines of some lengths allow; 0 where only equal lines are linked."""
    return np.r_[0, [k for _, k in limits]][np.searchsorted([n for n, _ in limits], length, side="right")]


def length_classes(limits: tuple, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest lengths of the classes of lengths up to `most`, and the edits allowed in each. A class is an eighth of its smallest length wide,
    or one, and none reaches across a step of `limits`. Lengths that do not exceed their edits have no class."""
    starts, edits = [], []
    for (at, k), end in zip(limits, [n for n, _ in limits[1:]] + [most + 1], strict=True):
        at = max(at, k + 1)
        while at < end:
            starts.append(at)
            edits.append(k)
            at += max(1, at // 8)
    return np.array(starts, np.int64), np.array(edits, np.int64)


def places(edits: int, size: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(segment, unmoved, rows, starts) of the substrings of lines of some lengths that may equal a segment of a line that is shorter by `least` to
    `most` characters. Segments of a line are edits + 1 stretches of `size` characters, the first half of them counted from its start, the
    others from its end, so that they lie at one place in lines of any length.

    Two lines within the edits share a segment i with at most i edits before it and edits - i behind it. So it has moved by no more than i
    against the start, and by no more than edits - i against the end."""
    for i in range(edits + 1):
        head, before, behind = 2 * i <= edits, i, edits - i
        reach = before if head else behind
        for moved in range(-reach, reach + 1):
            low, high = (moved - behind, moved + behind) if head else (-before - moved, before - moved)
            at = (i * size if head else length - (edits + 1 - i) * size) + moved
            rows = np.flatnonzero((np.maximum(least, low) <= np.minimum(most, high)) & (at >= 0) & (at + size <= length))
            yield i, moved == 0, rows, at[rows]


def segment_keys(lines: Lines, chosen: np.ndarray, limits: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of chosen, key, indexed) of lines: their segments, and the substrings that may equal a segment of a line that is shorter
    by no more than its own limit. Strings within the limit of the shorter one share one of these keys, the shorter one (or either, in
    one class of lengths) being indexed under it. A key is of one class of lengths of the indexed line, whose segments are all of one
    size; its low three bits are the edits allowed there.

    A line is posted in its own class, and in a class below only where a line shorter by the edits may be in it. A substring is only
    taken where a segment can have moved to, given how many edits fit before and after it.
    """
    rows, keys, indexed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    start, length = lines.start[chosen], lines.length[chosen]
    starts, allowed = length_classes(limits, int(length.max(initial=0)))
    own_class = np.searchsorted(starts, length, side="right") - 1
    for below in range(int(allowed.max(initial=0)) + 1):
        inside = np.flatnonzero(own_class >= below)
        chosen_class = own_class[inside] - below
        least = length[inside] - (starts[chosen_class + 1] - 1 if below else length[inside])
        near = least <= allowed[chosen_class]
        inside, chosen_class, least = inside[near], chosen_class[near], least[near]
        for edits in np.unique(allowed[chosen_class]).tolist():
            here = allowed[chosen_class] == edits
            own, smallest = inside[here], starts[chosen_class[here]]
            size = smallest // (edits + 1)
            for i, unmoved, taken, at in places(edits, size, length[own], least[here], np.minimum(edits, length[own] - smallest)):
                h = lines.hashes(start[own[taken]] + at, start[own[taken]] + at + size[taken])
                key = mixed(h + (smallest[taken] * (edits + 1) + i).astype(U64) * _SALT)
                keys.append((key & ~U64(7) | U64(edits)).view(np.int64))
                rows.append(own[taken])
                indexed.append(np.full(len(taken), below == 0 and unmoved))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(indexed)


def alike(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether two bags may belong to lines within the edits of their key: an edit changes the counts of two classes at most."""
    differ = (a ^ b).view(U64)
    return np.bitwise_count((differ | (differ >> U64(1))) & U64(0x5555555555555555)) <= 2 * (keys & 7)


def postings(docs: DataFrame, limits: tuple) -> DataFrame:
    """(key, x, y, indexed, bag) of all lines that `limits` allows edits; a line repeated in one batch comes once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch):
                lines = Lines(texts)
                long = np.flatnonzero(limit_of(lines.length, limits) > 0)
                if not len(long):
                    continue
                long = long[np.unique(lines.x[long], return_index=True)[1]]
                rows, keys, indexed = segment_keys(lines, long, limits)
                bags = lines.bags(long)
                for at in range(0, len(rows), 1 << 17):
                    cut = slice(at, at + (1 << 17))
                    own = long[rows[cut]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[cut]), pa.array(lines.x[own]), pa.array(lines.y[own]), pa.array(indexed[cut]), pa.array(bags[rows[cut]])], ["key", "x", "y", "indexed", "bag"])

    return _texts(docs).mapInArrow(work, "key long, x long, y long, indexed boolean, bag long")


def met(posts: DataFrame, small: int = SMALL) -> DataFrame:
    """What meets under the keys: pairs of lines with like bags (tag 0), or for a key of more than `small` lines, pairs with one indexed line
    and (tag 1) the lines themselves. Rows of a key pass by in order; no more than `small` of them are held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        hub: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column("key").to_numpy(), batch.column("x").to_numpy(), batch.column("y").to_numpy(), batch.column("indexed").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("bag").to_numpy()], axis=1)
            rows = new if rest is None else np.concatenate([rest, new])
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if rows[0, 0] != rows[-1, 0] else 0
            if cut:
                found, hub = _paired(rows[:cut], hub, small)
                if len(found):
                    yield _pair_batch(found)
            rest = rows[cut:]
            if len(rest) > 4 * small:
                # One key alone: its lines go out, and only the first indexed one is kept.
                found, hub = _paired(rest, hub if hub and hub[0] == rest[0, 0] else None, small, True)
                if len(found):
                    yield _pair_batch(found)
                rest = rest[-1:]
        if rest is not None and len(rest):
            found, hub = _paired(rest, hub, small)
            if len(found):
                yield _pair_batch(found)

    return posts.repartition("key").sortWithinPartitions("key", F.col("indexed").desc(), "x", "y").mapInArrow(work, "tag int, key long, ax long, ay long, bx long, by long, indexed boolean, bag long")


def _pair_batch(found: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(found[:, 0].astype(np.int32))] + [pa.array(found[:, i]) for i in range(1, 6)] + [pa.array(found[:, 6].astype(bool)), pa.array(found[:, 7])]
    return pa.RecordBatch.from_arrays(cols, ["tag", "key", "ax", "ay", "bx", "by", "indexed", "bag"])


def _paired(rows: np.ndarray, hub: tuple | None, small: int, open_key: bool = False) -> tuple[np.ndarray, tuple | None]:
    """Rows (tag, key, a, b, indexed, bag) of whole keys in order, indexed lines first; `hub` is the line that a key began with earlier."""
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    sizes = np.diff(np.r_[starts, len(rows)])
    out = [np.zeros((0, 8), np.int64)]
    begun = hub is not None and hub[0] == rows[0, 0]
    two = np.flatnonzero((sizes == 2) & (rows[starts, 3] == 1))
    if begun:
        two = two[two > 0]
    if len(two):
        a, b = rows[starts[two]], rows[starts[two] + 1]
        near = alike(a[:, 4].copy(), b[:, 4].copy(), a[:, 0])
        a, b = a[near], b[near]
        out.append(np.c_[np.zeros(len(a), np.int64), a[:, 0], a[:, 1:3], b[:, 1:5]])
    others = np.flatnonzero(sizes > 2)
    if begun or open_key:
        others = np.unique(np.r_[0, others])
    for g in others:
        own = np.unique(rows[starts[g] : starts[g] + sizes[g]], axis=0)
        own = own[np.argsort(-own[:, 3], kind="stable")]
        first = g == 0 and begun
        lead = hub[1] if first else own[0]
        if not lead[3]:
            continue
        if len(own) > small or first or open_key:
            near = own[alike(np.full(len(own), lead[4]), own[:, 4].copy(), own[:, 0])]
            out.append(np.c_[np.zeros(len(near), np.int64), near[:, 0], np.broadcast_to(lead[1:3], (len(near), 2)), near[:, 1:5]])
            out.append(np.c_[np.ones(len(own), np.int64), own[:, 0], own[:, 1:3], own[:, 1:5]])
            if open_key:
                hub = (int(own[0, 0]), lead)
        else:
            n = int(own[:, 3].sum())
            i, j = np.nonzero(np.arange(n)[:, None] < np.arange(len(own))[None, :])
            near = alike(own[i, 4], own[j, 4], own[i, 0])
            i, j = i[near], j[near]
            out.append(np.c_[np.zeros(len(i), np.int64), own[i, 0], own[i, 1:3], own[j, 1:5]])
    if open_key and not len(others):
        hub = None
    return np.concatenate(out), hub


def within(xs: list[str], ys: list[str], edits: int) -> np.ndarray:
    """Which pairs have an edit distance of `edits` at most (below 31), by a bit vector that slides along the diagonal.

    Bit 63 stands for the cell `edits` below the diagonal. Vertical differences of the band are kept as two bit vectors; all
    pairs go through a column at once. The distance is followed down that diagonal to the last row, and then along it.
    """
    k, one = edits, U64(1)
    nx, ny = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    out = np.zeros(len(xs), bool)
    near = np.flatnonzero(np.abs(nx - ny) <= k)
    tiny = near[np.minimum(nx, ny)[near] <= k]
    out[tiny] = [_plain(xs[i], ys[i]) <= k for i in tiny]
    near = near[np.minimum(nx, ny)[near] > k]
    near = near[np.argsort(nx[near], kind="stable")]
    at = 0
    while at < len(near):
        take = near[at : at + max(1, min(4096, (1 << 21) // max(1, int(nx[near[min(len(near) - 1, at + 4095)]]))))]
        at += len(take)
        wide = int(max(nx[take].max(), ny[take].max()))
        a, b = np.full((len(take), wide + 2 * k), 0xFFFFFFFF, np.uint32), np.full((len(take), wide), 0xFFFFFFFE, np.uint32)
        for r, i in enumerate(take):
            a[r, k : k + nx[i]] = np.frombuffer(xs[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            b[r, : ny[i]] = np.frombuffer(ys[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        lx, ly = nx[take], ny[take]
        vp, vn = np.full(len(take), np.uint64((2**64 - 1) << (63 - k) & (2**64 - 1))), np.zeros(len(take), U64)
        dist, low = np.full(len(take), k), np.full(len(take), one << U64(62))
        for i in range(wide):
            pm = np.zeros(len(take), U64)
            for d in range(2 * k + 1):
                pm |= (a[:, i + d] == b[:, i]).astype(U64) << U64(63 - 2 * k + d)
            d0 = (((pm & vp) + vp) ^ vp) | pm | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            down = i < lx - k
            along = ~down & (i < ly)
            dist += np.where(down, (d0 >> U64(63)) == 0, 0) + np.where(along, ((hp & low) > 0).astype(np.int64) - ((hn & low) > 0), 0)
            low = np.where(along, low >> one, low)
            x = d0 >> one
            vp, vn = hn | ~(x | hp), x & hp
        out[take] = dist <= k
    return out


def _plain(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, y, line) of the lines that `wanted` (x, y) names. Others are kept back where they are read, by a bit filter of fixed size."""
    bits = bit_filter(wanted, "x")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch):
                lines = Lines(texts)
                take = np.flatnonzero(passes(bits, lines.x.view(U64)) & (lines.length > 0))
                if not len(take):
                    continue
                take = take[np.unique(lines.x[take], return_index=True)[1]]
                found = [lines.points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(lines.start[take], lines.end[take], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.x[take]), pa.array(lines.y[take]), pa.array(found)], ["x", "y", "line"])

    return _texts(docs).mapInArrow(work, "x long, y long, line string").join(wanted, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.min("line").alias("line"))


def verified(pairs: DataFrame, texts: DataFrame, limits: tuple) -> DataFrame:
    """The pairs (a, b) of line names whose texts are within the edits that the shorter one allows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, lb = batch.column("la").to_pylist(), batch.column("lb").to_pylist()
            allowed = limit_of(np.array([min(len(a), len(b)) for a, b in zip(la, lb, strict=True)], np.int64), limits)
            for edits in np.unique(allowed[allowed > 0]).tolist():
                own = np.flatnonzero(allowed == edits)
                ok = own[within([la[i] for i in own], [lb[i] for i in own], edits)]
                yield batch.select(["ax", "ay", "bx", "by"]).take(pa.array(ok))

    left = texts.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("line").alias("la"))
    right = texts.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("line").alias("lb"))
    both = pairs.join(left, ["ax", "ay"]).join(right, ["bx", "by"]).select("ax", "ay", "bx", "by", "la", "lb")
    return _named(both.mapInArrow(work, "ax long, ay long, bx long, by long"))


def _block_links(left: pa.Table, right: pa.Table, limits: tuple) -> pa.Table:
    """Links between the lines of two blocks of a key that join what is still apart, verified on the texts.

    Each line brings all its large keys. A pair that meets under several of them is verified under one, drawn by hash, so that the
    work of a group of lines is spread over the keys that they share."""
    key = U64(left.column("key")[0].as_py() % 2**64)
    (ax, ay, abag, ai), (bx, by, bbag, bi) = ([t.column(c).to_numpy() for c in ("x", "y", "bag", "indexed")] for t in (left, right))
    roots = np.concatenate([np.stack([t.column(c).to_numpy() for c in ("root_x", "root_y")], axis=1) for t in (left, right)])
    part = np.unique(roots, axis=0, return_inverse=True)[1].reshape(-1)
    left_part, right_part = part[: len(ax)], part[len(ax) :]
    once = left.column("main").to_numpy()[:, None] | (ax[:, None] < bx) | ((ax[:, None] == bx) & (ay[:, None] < by))
    near = alike(np.repeat(abag[:, None], len(bx), axis=1), np.repeat(bbag[None, :], len(ax), axis=0), key.view(np.int64))
    i, j = np.nonzero((left_part[:, None] != right_part) & once & (ai[:, None] | bi) & near)

    def holders(table: pa.Table) -> dict[int, tuple[list[int], list[int]]]:
        out: dict[int, tuple[list[int], list[int]]] = {}
        for r, keys in enumerate(table.column("keys").to_pylist()):
            for k in keys:
                held = out.setdefault(k["key"], ([], []))
                held[0].append(r)
                if k["indexed"]:
                    held[1].append(r)
        return out

    def flags(rows: list[int], n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        out[rows] = True
        return out

    others = holders(right)
    for k, (any_a, first_a) in holders(left).items():
        if k in others and k % 2**64 != int(key):
            any_b, first_b = others[k]
            drawn = (ax[i] ^ bx[j]).view(U64)
            met_there = flags(any_a, len(ax))[i] & flags(any_b, len(bx))[j] & (flags(first_a, len(ax))[i] | flags(first_b, len(bx))[j])
            here = ~(met_there & (mixed(drawn ^ U64(k % 2**64)) < mixed(drawn ^ key)))
            i, j = i[here], j[here]
    la, lb = left.column("line").to_pylist(), right.column("line").to_pylist()
    found = []
    for at in range(0, len(i), 4096):
        own_i, own_j = i[at : at + 4096], j[at : at + 4096]
        apart = part[own_i] != part[len(ax) + own_j]
        xs, ys = [la[r] for r in own_i[apart]], [lb[r] for r in own_j[apart]]
        allowed = limit_of(np.array([min(len(x), len(y)) for x, y in zip(xs, ys, strict=True)], np.int64), limits)
        for edits in np.unique(allowed[allowed > 0]).tolist():
            own = np.flatnonzero(allowed == edits)
            ok = own[within([xs[r] for r in own], [ys[r] for r in own], edits)]
            for r, q in zip(own_i[apart][ok].tolist(), own_j[apart][ok].tolist(), strict=True):
                if part[r] != part[len(ax) + q]:
                    part[part == part[r]] = part[len(ax) + q]
                    found.append((r, q))
    r, q = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"ax": ax[r], "ay": ay[r], "bx": bx[q], "by": by[q]})


def _rest(members: DataFrame, roots: DataFrame, texts: DataFrame, limits: tuple, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of lines of large keys that are in different components so far: every indexed line meets every other, block by block,
    in a task that holds the lines of two blocks and gives links only. A block holds so many lines, or so many kilobytes, on average."""
    line = F.struct("x", "y")
    own = members.select("key", F.col("bx").alias("x"), F.col("by").alias("y"), "indexed", "bag").groupBy("key", "x", "y").agg(F.max("indexed").alias("indexed"), F.min("bag").alias("bag"))
    own = own.join(roots.withColumnRenamed("node", "_node"), line == F.col("_node"), "left").withColumn("root", F.coalesce("root", line)).drop("_node").join(texts, ["x", "y"])
    parts = own.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
    lists = parts.groupBy("key").agg(F.max(F.struct("n", "root", "chars")).alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("roots")).filter("roots > 1")

    def blocks(n: str, chars: str):
        return F.ceil(F.greatest(F.expr(n) / block, F.expr(chars) / (1024 * block), F.lit(1.0))).cast("int")

    cut = own.join(lists.select("key", F.col("main.root").alias("main"), blocks("n", "chars").alias("xs"), blocks("n - main.n", "chars - main.chars").alias("ys")), "key")
    cut = stored(cut.withColumn("main", F.col("root") == F.col("main")), "line-crowded")
    keys = cut.groupBy("x", "y").agg(F.collect_list(F.struct("key", "indexed")).alias("keys"))
    sent = cut.join(keys, ["x", "y"]).withColumn("h", F.xxhash64("x", "y"))
    fields = ["key", "p", "q", "x", "y", "root.x AS root_x", "root.y AS root_y", "main", "indexed", "bag", "line", "keys"]
    left = sent.withColumns({"p": F.expr("cast(pmod(h, xs) AS int)"), "q": F.explode(F.expr("sequence(0, ys - 1)"))}).selectExpr(*fields)
    # Named anew: a cogroup does not tell columns of one origin apart.
    right = sent.filter("not main").withColumns({"p": F.explode(F.expr("sequence(0, xs - 1)")), "q": F.expr("cast(pmod(h, ys) AS int)")}).selectExpr(*fields)
    right = right.toDF(*right.columns)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("ax", "ay", "bx", "by")})
        return _block_links(a, b, limits)

    found = left.groupBy("key", "p", "q").cogroup(right.groupBy("key", "p", "q")).applyInArrow(work, "ax long, ay long, bx long, by long")
    return _named(found)


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("a"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("b"))


def line_classes(docs: DataFrame, edits: int = EDITS, fuzzy_from: int = FUZZY_FROM, small: int = SMALL, limits: tuple | None = None) -> DataFrame:
    """Every line of docs (doc_id, text) that is not blank: doc_id, text_hash, line_no, n_chars, class_doc_id, class_line_no, class_size, kept.

    Lines end at \\n and are trimmed of spaces, tabs and the like. Two lines are linked when they are equal, or when their edit distance
    in code points is at most what `limits` allows the shorter one: pairs (characters, edits), from so many characters on so many
    edits. Without `limits` it is `edits` from `fuzzy_from` characters on. A class is what links reach. The first line of a class,
    by (doc_id, hash of the text, line_no), is kept. line_no counts from 0 and blank lines too.

    Lines have one segment more than their edits: if two are within the distance, a segment of the shorter one is unchanged in the
    other, not far from its place. Each line is posted under its segments and under those of its substrings that may equal a
    segment of a line as long or shorter, once for all lengths of a class; pairs that meet, and whose counts of characters differ no more than the edits can make
    them, are verified on their texts. Of a key with very many lines, all are
    first paired with one of them, and only what is still in different classes is paired in full.

    Null and empty texts have no lines. A null doc_id comes first in the order. Rows equal in doc_id and text are one document.
    """
    limits = limits or ((max(fuzzy_from, edits + 1), edits),)
    docs = docs.select("doc_id", "text")
    lines = stored(hashed_lines(docs), "line-hashes")
    meeting = stored(met(postings(docs, limits), small).filter("tag = 1 or ax <> bx or ay <> by"), "line-pairs")
    pairs = meeting.filter("tag = 0").select(F.least(F.struct("ax", "ay"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"))).alias("a"), F.greatest(F.struct("ax", "ay"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"))).alias("b")).distinct()
    pairs = stored(pairs.select("a.ax", "a.ay", F.col("b.ax").alias("bx"), F.col("b.ay").alias("by")), "line-candidates")
    members = meeting.filter("tag = 1")
    ends = [pairs.select(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"] + [members.select(F.col("bx").alias("x"), F.col("by").alias("y"))]
    wanted = stored(ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct(), "line-wanted")
    texts = stored(line_texts(docs, wanted), "line-texts")
    links = stored(verified(pairs, texts, limits), "line-links")
    roots = components(links)
    more = _rest(members, roots, texts, limits)
    roots = components(links.unionByName(more)).select(F.col("node.x").alias("x"), F.col("node.y").alias("y"), "root")
    classed = lines.join(roots, ["x", "y"], "left").withColumn("root", F.coalesce("root", F.struct("x", "y")))
    own = F.struct("doc_id", "text_hash", "line_no")
    first = classed.groupBy("root").agg(F.min(own).alias("first"), F.count("*").alias("class_size"))
    return classed.join(first, "root").select(
        "doc_id", "text_hash", "line_no", "n_chars", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "class_size", own.eqNullSafe(F.col("first")).alias("kept")
    )


def dedup_lines(docs: DataFrame, edits: int = EDITS, fuzzy_from: int = FUZZY_FROM, limits: tuple | None = None) -> DataFrame:
    """The rows of docs with the lines that are not kept taken out of text; a text that loses none, or is null, stays as it is."""
    gone = line_classes(docs, edits, fuzzy_from, limits=limits).filter(~F.col("kept")).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    joined = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_hash")), "left")
    left = F.expr("array_join(filter(split(d.text, '\\n', -1), (l, i) -> not array_contains(g.gone, i)), '\\n')")
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(left).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
