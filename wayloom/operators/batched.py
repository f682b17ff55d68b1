"""Fits of many repetitions, folds and models at once: shared folds, shared normal equations, shared bins.

A row carries the fold it is tested in, one for each repetition; a fit (repetition, fold) trains on the rows of all other folds.
Linear models take one aggregate per iteration for all fits together. Trees are binned once for all fits; then each fit is a
task of its own, on all its training rows. Tables of more than `most_rows` rows are grown on in passes, a level of all fits at a time,
so what a task holds does not grow with the table.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.closures import block_label
from wayloom.session import checkpointed

BINS = 255
MOST_ROWS = 1_000_000
PASS_ROWS, BLOCK_ROWS, KEPT_TREES = 131_072, 16_384, 15
TOLERANCE = 1e-10
SCORED = "row_id string, y double, block long, model string, repetition int, prediction double"


def dealt_folds(rows: DataFrame, repeats: int, folds: int, seed: int = 0, cell: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds `folds`, an array with the fold of each repetition: whole spatial blocks, whose grid is shifted from repetition to
    repetition, dealt evenly in hash order. `row_id` names the rows. Blocks are parts of a fixed grid, so few."""
    row, col = cell or (F.col("fila"), F.col("col"))
    labels = [
        F.struct(F.lit(r).alias("r"), block_label(row, col, 4, (seed + r) % 4, (seed + r) // 4 % 4).alias("b")) for r in range(repeats)
    ]
    long = rows.select("row_id", F.explode(F.array(*labels)).alias("_l")).select("row_id", "_l.r", "_l.b")
    order = Window.partitionBy("r").orderBy(F.md5(F.concat_ws(":", (F.col("r") + seed).cast("string"), F.col("b").cast("string"))), "b")
    dealt = long.select("r", "b").distinct().withColumn("fold", (F.row_number().over(order) - 1) % folds)
    own = long.join(dealt, ["r", "b"]).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("r", "fold"))).alias("_f"))
    return rows.join(own.select("row_id", F.col("_f.fold").alias("folds")), "row_id")


def left_out_means(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of y over the training rows of each fit: (repetition, fold, keys, mean), the sums of all folds less the own one."""
    keys = list(keys)
    long = rows.select("y", *keys, F.posexplode("folds").alias("repetition", "fold"))
    sums = long.groupBy("repetition", "fold", *keys).agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    every = Window.partitionBy("repetition", *keys)
    rest = sums.withColumns({"s": F.sum("s").over(every) - F.col("s"), "n": F.sum("n").over(every) - F.col("n")})
    return rest.select("repetition", "fold", *keys, (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))


def scored_means(rows: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Test predictions of the training mean, by keys where given; a key without training rows takes the overall mean."""
    keys = list(keys)
    tested = rows.select("row_id", "y", "block", *keys, F.posexplode("folds").alias("repetition", "fold"))
    tested = tested.join(left_out_means(rows).withColumnRenamed("mean", "_all"), ["repetition", "fold"])
    prediction = F.col("_all")
    if keys:
        tested = tested.join(left_out_means(rows, keys), ["repetition", "fold", *keys], "left")
        prediction = F.coalesce("mean", "_all")
    return tested.select("row_id", "y", "block", F.lit(name).alias("model"), "repetition", prediction.alias("prediction"))


# --- linear models ---------------------------------------------------------------------------------------------------
@dataclass
class Linear:
    """A linear model: its columns, those left as they are (not scaled), its family, and a penalty beside the mean loss or, for
    `on_mean` false, beside the summed one."""

    columns: list[str]
    plain: list[str] = field(default_factory=list)
    family: str = "poisson"
    penalty: float = 1e-3
    on_mean: bool = True

    def inputs(self) -> list[str]:
        return [*self.columns, *self.plain]


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], axis=1) if names else np.zeros((batch.num_rows, 0))


def _folds(batch: pa.RecordBatch, repeats: int) -> np.ndarray:
    return batch.column("folds").flatten().to_numpy().reshape(batch.num_rows, repeats)


def _training(folds: np.ndarray, fold_count: int) -> np.ndarray:
    """Which rows each fit trains on: rows by (repetition, fold)."""
    return (folds[:, :, None] != np.arange(fold_count)).reshape(len(folds), -1)


def _summed(rows: DataFrame, width: int, sums) -> np.ndarray:
    """Sums of arrays over all batches, place by place: tasks add up, Spark adds the tasks, the driver gets `width` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += sums(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["place", "v"])

    out = np.zeros(width)
    table = rows.mapInArrow(add, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out[table["place"].to_numpy()] = table["v"].to_numpy()
    return out


def filled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unknown numbers become the median of the column; a column without any known number becomes zero."""
    known = [F.percentile_approx(c, 0.5, 10_000).alias(c) for c in columns]
    medians = rows.agg(*known).first() if known else {}
    return rows.fillna({c: float(medians[c]) if medians[c] is not None else 0.0 for c in columns})


def fit_linear(rows: DataFrame, models: dict[str, Linear], repeats: int, folds: int, most: int = 50) -> dict[str, np.ndarray]:
    """Coefficients of every model and fit, intercept first, on the columns as they are: arrays (fits, 1 + columns).

    Iteratively reweighted least squares. An iteration is one pass over the rows that sums the normal equations of all models and
    fits; the small systems are then solved here. Columns are scaled to the mean and deviation of the fit's training rows."""
    fits = repeats * folds
    sizes = {m: len(spec.inputs()) for m, spec in models.items()}
    width = sum(fits * (2 + 2 * p) for p in sizes.values())

    def moments(batch):
        train, out = _training(_folds(batch, repeats), folds).astype(float), []
        y = batch.column("y").to_numpy()
        for spec in models.values():
            x = _matrix(batch, spec.inputs())
            out += [train.sum(axis=0), train.T @ y, (train.T @ x).ravel(), (train.T @ (x * x)).ravel()]
        return np.concatenate(out)

    flat, at = _summed(rows, width, moments), 0
    scale, betas, counts = {}, {}, {}
    for m, spec in models.items():
        p = sizes[m]
        n, sy, sx, sxx = (flat[at + o : at + o + w] for o, w in ((0, fits), (fits, fits), (2 * fits, fits * p), (2 * fits + fits * p, fits * p)))
        at += fits * (2 + 2 * p)
        n1 = np.maximum(n, 1)[:, None]
        mean = sx.reshape(fits, p) / n1
        sd = np.sqrt(np.maximum(sxx.reshape(fits, p) / n1 - mean**2, 0))
        sd[sd < 1e-12] = 1.0
        for j, c in enumerate(spec.inputs()):
            if c in spec.plain:
                mean[:, j], sd[:, j] = 0.0, 1.0
        start = np.clip(sy / np.maximum(n, 1), 1e-6, None if spec.family == "poisson" else 1 - 1e-6)
        betas[m] = np.concatenate([np.log(start if spec.family == "poisson" else start / (1 - start))[:, None], np.zeros((fits, p))], axis=1)
        scale[m], counts[m] = (mean, sd), n
    live = {m: np.ones(fits, bool) for m in models}
    for _ in range(most):
        raw = {m: _raw(betas[m], *scale[m]) for m in models}

        def normal(batch):
            train, out, y = _training(_folds(batch, repeats), folds), [], batch.column("y").to_numpy()
            for m, spec in models.items():
                x = np.concatenate([np.ones((batch.num_rows, 1)), _matrix(batch, spec.inputs())], axis=1)
                eta = np.clip(x @ raw[m].T, -30, 30)
                mu = np.exp(eta) if spec.family == "poisson" else 1 / (1 + np.exp(-eta))
                w = np.where(train, mu if spec.family == "poisson" else np.maximum(mu * (1 - mu), 1e-12), 0.0)
                slope = np.where(train, y[:, None] - mu, 0.0)
                out += [np.einsum("nk,ni,nj->kij", w, x, x, optimize=True).ravel(), (slope.T @ x).ravel()]
            return np.concatenate(out)

        flat, at = _summed(rows, sum(fits * (1 + p) * (2 + p) for p in sizes.values()), normal), 0
        for m, spec in models.items():
            q = 1 + sizes[m]
            gram, score = flat[at : at + fits * q * q].reshape(fits, q, q), flat[at + fits * q * q : at + fits * q * (q + 1)].reshape(fits, q)
            at += fits * q * (q + 1)
            to = _scaling(*scale[m])
            gram, score = to.transpose(0, 2, 1) @ gram @ to, np.einsum("kji,kj->ki", to, score)
            ridge = spec.penalty * (counts[m] if spec.on_mean else np.ones(fits))
            penalty = ridge[:, None] * np.r_[0.0, np.ones(q - 1)]
            step = np.linalg.solve(gram + np.einsum("ki,ij->kij", penalty + 1e-12, np.eye(q)), (score - penalty * betas[m])[:, :, None])[:, :, 0]
            step *= np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(axis=1), 1e-300))[:, None]
            betas[m] = betas[m] + step * live[m][:, None]
            live[m] &= np.abs(step).max(axis=1) > TOLERANCE * (1 + np.abs(betas[m]).max(axis=1))
        if not any(x.any() for x in live.values()):
            break
    return {m: _raw(betas[m], *scale[m]) for m in models}


def _scaling(mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """For each fit the matrix from coefficients on scaled columns to those on the columns as they are."""
    fits, p = mean.shape
    out = np.zeros((fits, p + 1, p + 1))
    out[:, 0, 0] = 1
    out[:, 0, 1:] = -mean / sd
    out[:, np.arange(1, p + 1), np.arange(1, p + 1)] = 1 / sd
    return out


def _raw(beta: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.einsum("kij,kj->ki", _scaling(mean, sd), beta)


def scored_linear(rows: DataFrame, models: dict[str, Linear], repeats: int, folds: int) -> DataFrame:
    """Test predictions of linear models, each row by the fit that has not seen it."""
    betas = fit_linear(rows, models, repeats, folds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = _folds(batch, repeats) + np.arange(repeats) * folds
            for m, spec in models.items():
                x = np.concatenate([np.ones((batch.num_rows, 1)), _matrix(batch, spec.inputs())], axis=1)
                eta = np.clip(np.einsum("nrj,nj->nr", betas[m][fit], x), -30, 30)
                yield _long(batch, m, np.exp(eta) if spec.family == "poisson" else 1 / (1 + np.exp(-eta)))

    return rows.mapInArrow(score, SCORED)


def _long(batch: pa.RecordBatch, name: str, predictions: np.ndarray) -> pa.RecordBatch:
    n, repeats = predictions.shape
    each = pa.array(np.repeat(np.arange(n), repeats))
    columns = [batch.column("row_id").take(each), batch.column("y").take(each), batch.column("block").take(each), pa.repeat(pa.scalar(name), n * repeats), pa.array(np.tile(np.arange(repeats, dtype=np.int32), n)), pa.array(predictions.ravel())]
    return pa.RecordBatch.from_arrays(columns, ["row_id", "y", "block", "model", "repetition", "prediction"])


# --- boosted trees ---------------------------------------------------------------------------------------------------
@dataclass
class Boosting:
    """Settings of boosted trees by binned features."""

    columns: list[str]
    family: str = "poisson"
    rounds: int = 200
    depth: int = 3
    rate: float = 0.05
    leaf: int = 20
    ridge: float = 1.0
    subsample: float = 1.0


def cut_points(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending cut values of each column, quantiles of all rows; unknown values have the last bin to themselves."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    found = rows.agg(*[F.array_distinct(F.percentile_approx(c, shares, 10_000)).alias(c) for c in columns]).first()
    return [np.unique(np.array(found[c] or [], np.float64)) for c in columns]


def binned(rows: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """(row_id, y, block, folds, bins): a byte for each column, how many cuts are below the value, BINS for an unknown one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, columns)
            codes = np.stack([np.where(np.isnan(x[:, j]), BINS, np.searchsorted(c, x[:, j])) for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("y"), batch.column("block"), batch.column("folds"), pa.array([r.tobytes() for r in codes], pa.binary())], ["row_id", "y", "block", "folds", "bins"])

    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    return rows.select("row_id", "y", "block", "folds", *numbers).mapInArrow(cut, "row_id string, y double, block long, folds array<int>, bins binary")


def _slopes(score: np.ndarray, y: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss at the scores."""
    mu = np.exp(score) if family == "poisson" else 1 / (1 + np.exp(-score))
    return mu - y, mu if family == "poisson" else np.maximum(mu * (1 - mu), 1e-12)


def _start(mean, family: str) -> np.ndarray:
    mean = np.clip(mean, 1e-6, None if family == "poisson" else 1 - 1e-6)
    return np.log(mean) if family == "poisson" else np.log(mean / (1 - mean))


def _drawn(ids: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree of a fit learns from: by a hash of row, fit and tree, so wherever and in whatever order the rows are."""
    if share >= 1:
        return np.ones(len(ids), bool)
    z = ids.astype(np.uint64) + np.array([seed * 100_003 + tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 < share


class _Laid:
    """Codes of rows, a column each, for sums by (node, column, code). Columns of a few codes are summed as their combinations,
    from which the sums of each follow."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns, n = columns, len(columns[0])
        seen = [np.flatnonzero(np.bincount(c, minlength=BINS + 1)) for c in columns]
        few = [j for j, v in enumerate(seen) if len(v) <= 4]
        kinds = key = None
        if len(few) > 1 and np.prod([len(seen[j]) for j in few], dtype=float) < 2**31:
            place, key = np.zeros(BINS + 1, np.int64), np.zeros(n, np.int64)
            for j in few:
                place[seen[j]] = np.arange(len(seen[j]))
                key = key * len(seen[j]) + place[columns[j]]
            _, first, key = np.unique(key, return_index=True, return_inverse=True)
            kinds = np.stack([columns[j][first] for j in few], axis=1) if len(first) <= 4 * (BINS + 1) else None
        self.few = few if kinds is not None else []
        self.key, self.wide = key, [j for j in range(len(columns)) if j not in self.few]
        if self.few:
            self.spread = np.zeros((len(kinds), len(few), BINS + 1))
            self.spread[np.arange(len(kinds))[:, None], np.arange(len(few)), kinds] = 1.0

    def sums(self, used: np.ndarray, node: np.ndarray, nodes: int, weights: Sequence[np.ndarray | None]) -> np.ndarray:
        """(weight, node, column, code): sums over the rows `used`, whose nodes and weights are given; None counts them."""
        span, out = BINS + 1, np.zeros((len(weights), nodes, len(self.columns), BINS + 1))
        for j in self.wide:
            at = node * span + self.columns[j][used]
            for i, w in enumerate(weights):
                out[i, :, j] = np.bincount(at, w, nodes * span).reshape(nodes, span)
        if self.few:
            at = node * len(self.spread) + self.key[used]
            for i, w in enumerate(weights):
                out[i][:, self.few] = np.tensordot(np.bincount(at, w, nodes * len(self.spread)).reshape(nodes, -1), self.spread, 1)
        return out

    def below(self, node: np.ndarray, columns: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """Nodes of the next level, by the column and the last code that goes left of each node of this one."""
        right = np.zeros(len(node), bool)
        for i, (column, last) in enumerate(zip(columns, lasts)):
            if last < BINS:
                right |= (self.columns[column] > last) & (node == i)
        return 2 * node + right

    def leaves(self, columns: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """The leaf of every row in a tree."""
        node = np.zeros(len(self.columns[0]), np.int64)
        for level in range(int(np.log2(len(columns) + 1))):
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            node = self.below(node, columns[own], lasts[own])
        return node


def _split(sums: np.ndarray, spec: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best column and last code that goes left of each node, by sums of gradients, curvatures and counts, and the values that
    the two sides of each node would have as leaves. A node that is not split keeps its rows left."""
    nodes = sums.shape[1]
    gl, hl, cl = sums.cumsum(axis=3)
    ga, ha, ca = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
    gain = gl**2 / (hl + spec.ridge + 1e-300) + (ga - gl) ** 2 / (ha - hl + spec.ridge + 1e-300) - ga**2 / (ha + spec.ridge + 1e-300)
    gain = np.where((cl >= spec.leaf) & (ca - cl >= spec.leaf), gain, 0.0).reshape(nodes, -1)
    best, own = gain.argmax(axis=1), np.arange(nodes)
    split = gain[own, best] > 1e-12
    columns, lasts = np.where(split, best // (BINS + 1), 0), np.where(split, best % (BINS + 1), BINS)
    gs, hs = (np.stack([left[own, columns, lasts], left[own, columns, -1] - left[own, columns, lasts]], axis=1) for left in (gl, hl))
    return columns, lasts, (-spec.rate * gs / (hs + spec.ridge + 1e-300)).ravel()


def grown(codes: np.ndarray, y: np.ndarray, spec: Boosting, seed: int, ids: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Start score, and for each tree the column, the last bin that goes left, and the value of every node (a complete tree;
    a node that is not split keeps its rows left).

    A level is one histogram of gradients, curvatures and counts over (node, column, bin)."""
    n, inner = len(codes), 2**spec.depth - 1
    ids = np.arange(n) if ids is None else ids
    laid = _Laid([np.ascontiguousarray(c) for c in codes.T])
    start = float(_start(y.mean(), spec.family))
    score = np.full(n, start)
    columns, lasts, values = np.zeros((spec.rounds, inner), np.int16), np.full((spec.rounds, inner), BINS, np.int16), np.zeros((spec.rounds, 2**spec.depth))
    for t in range(spec.rounds):
        used = np.flatnonzero(_drawn(ids, seed, t, spec.subsample))
        g, h = _slopes(score[used], y[used], spec.family)
        node = np.zeros(n, np.int64)
        for level in range(spec.depth):
            own = slice(2**level - 1, 2 ** (level + 1) - 1)
            columns[t, own], lasts[t, own], values[t, : 2 ** (level + 1)] = _split(laid.sums(used, node[used], 2**level, (g, h, None)), spec)
            node = laid.below(node, columns[t, own], lasts[t, own])
        score = score + values[t][node]
    return start, columns, lasts, values


@dataclass
class _Block:
    """Some rows of a table that is grown on in passes: ids, targets, codes by column, folds and, when written, scores by fit."""

    ids: np.ndarray
    y: np.ndarray
    codes: np.ndarray
    folds: np.ndarray
    scores: np.ndarray | None = None

    SCHEMA = "ids binary, y binary, codes binary, folds binary, scores binary"

    def packed(self) -> pa.RecordBatch:
        parts = [self.ids, self.y, self.codes, self.folds, np.zeros(0) if self.scores is None else self.scores]
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], ["ids", "y", "codes", "folds", "scores"])

    @staticmethod
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, y, codes, folds, scores = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(batch.columns, (np.int64, np.float64, np.uint8, np.uint8, np.float64)))
                yield _Block(ids, y, codes.reshape(-1, len(y)), folds.reshape(len(y), -1), scores.reshape(-1, len(y)) if len(scores) else None)


def grown_in_passes(coded: DataFrame, spec: Boosting, cuts: Sequence[np.ndarray], repeats: int, folds: int, seed: int, rows: int) -> dict[tuple[int, int], tuple]:
    """The models that `grown` makes of the training rows of every fit, for tables of any size: rows stay where they are, and a level
    of one tree of all fits is one pass. Tasks sum what they hold, the sums of a fit meet in one task, which answers with its
    splits. Scores are written every `KEPT_TREES` trees; later trees are walked again in each pass."""
    fits, p, inner = [(r, f) for r in range(repeats) for f in range(folds)], len(spec.columns), 2**spec.depth - 1
    parts = max(coded.sparkSession.sparkContext.defaultParallelism, rows // PASS_ROWS + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            own = np.concatenate([_folds(b, repeats) for b in held]).astype(np.uint8)
            return _Block(t["id"].to_numpy(), t["y"].to_numpy(), _codes(t["bins"], p).T, own).packed()

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    blocks = checkpointed(coded.select(F.xxhash64("row_id").alias("id"), "y", "bins", "folds").repartition(parts).mapInArrow(pack, _Block.SCHEMA))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, len(fits)))
        for b in _Block.read(batches):
            train = _training(b.folds, folds)
            out += np.stack([train.sum(axis=0), b.y @ train])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits))), pa.array(out[0]), pa.array(out[1])], ["k", "n", "y"])

    sums = blocks.mapInArrow(totals, "k long, n double, y double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("k")
    start = _start(sums["y"].to_numpy() / np.maximum(sums["n"].to_numpy(), 1), spec.family)
    columns, lasts = np.zeros((len(fits), spec.rounds, inner), np.int16), np.full((len(fits), spec.rounds, inner), BINS, np.int16)
    values = np.zeros((len(fits), spec.rounds, 2**spec.depth))
    places = np.concatenate([j * (BINS + 1) + np.r_[: len(c) + 1, BINS] for j, c in enumerate(cuts)])
    written = 0

    def one_pass(t: int, level: int):
        trees, at = (columns[:, :t + 1].copy(), lasts[:, :t + 1].copy(), values[:, :t].copy(), written), 2**level

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(fits), 3, at, len(places)))
            for b in _Block.read(batches):
                laid = _Laid(list(b.codes))
                for k, (r, f) in enumerate(fits):
                    used = np.flatnonzero((b.folds[:, r] != f) & _drawn(b.ids, (seed + r) * 1000 + f, t, spec.subsample))
                    s = _scored(b, laid, k, start, trees, t)
                    node = np.zeros(len(b.y), np.int64)
                    for up in range(level):
                        own = slice(2**up - 1, 2 ** (up + 1) - 1)
                        node = laid.below(node, trees[0][k, t, own], trees[1][k, t, own])
                    g, h = _slopes(s[used], b.y[used], spec.family)
                    total[k] += laid.sums(used, node[used], at, (g, h, None)).reshape(3, at, -1)[:, :, places]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits))), pa.array([x.tobytes() for x in total], pa.binary())], ["k", "sums"])

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            sums = np.zeros((3, at, p * (BINS + 1)))
            sums[:, :, places] = sum(np.frombuffer(x, np.float64) for x in table["sums"].to_pylist()).reshape(3, at, -1)
            c, last, v = _split(sums.reshape(3, at, p, BINS + 1), spec)
            return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([c.tolist()], pa.list_(pa.int64())), "l": pa.array([last.tolist()], pa.list_(pa.int64())), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

        found = blocks.mapInArrow(add, "k long, sums binary").groupBy("k").applyInArrow(choose, "k long, c array<long>, l array<long>, v array<double>").toArrow().to_pylist()
        own = slice(at - 1, 2 * at - 1)
        for x in found:
            columns[x["k"], t, own], lasts[x["k"], t, own], values[x["k"], t, : 2 * at] = x["c"], x["l"], x["v"]

    def rewritten() -> DataFrame:
        trees, until = (columns.copy(), lasts.copy(), values.copy(), written), t

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _Block.read(batches):
                laid = _Laid(list(b.codes))
                b.scores = np.stack([_scored(b, laid, k, start, trees, until) for k in range(len(fits))])
                yield b.packed()

        return checkpointed(blocks.mapInArrow(add, _Block.SCHEMA))

    for t in range(spec.rounds):
        if t - written == KEPT_TREES:
            blocks, written = rewritten(), t
        for level in range(spec.depth):
            one_pass(t, level)
    return {fit: (float(start[k]), columns[k], lasts[k], values[k]) for k, fit in enumerate(fits)}


def _scored(b: _Block, laid: _Laid, k: int, start: np.ndarray, trees: tuple, until: int) -> np.ndarray:
    """Scores of a fit before tree `until`: those written, and the trees since."""
    columns, lasts, values, written = trees
    out = np.full(len(b.y), start[k]) if b.scores is None else b.scores[k].copy()
    for t in range(written, until):
        out += values[k, t][laid.leaves(columns[k, t], lasts[k, t])]
    return out


def _codes(bins: pa.ChunkedArray, p: int) -> np.ndarray:
    """Rows by columns of the bytes that `binned` packed."""
    found = []
    for c in bins.chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        found.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(found).reshape(-1, p) if found else np.zeros((0, p), np.uint8)


def tree_scores(codes: np.ndarray, model: tuple[float, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    start, columns, lasts, values = model
    score, rows = np.full(len(codes), start), np.arange(len(codes))
    depth = int(np.log2(values.shape[1]))
    for t in range(len(values)):
        node = np.zeros(len(codes), np.int64)
        for level in range(depth):
            at = 2**level - 1 + node
            node = 2 * node + (codes[rows, columns[t, at]] > lasts[t, at])
        score += values[t][node]
    return score


def scored_boosting(rows: DataFrame, name: str, spec: Boosting, repeats: int, folds: int, seed: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """Test predictions of boosted trees, each row by the fit that has not seen it. Every fit learns from all its training rows.

    Up to `most_rows` rows they go to the task of each fit as bytes; larger tables are grown on in passes, where no task holds
    the rows of a fit. Either way the trees are the same."""
    cuts, p = cut_points(rows, spec.columns), len(spec.columns)
    coded, n = binned(rows, spec.columns, cuts), rows.count()

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        model, out = grown(_codes(table["bins"], p), table["y"].to_numpy(), spec, (seed + key[0].as_py()) * 1000 + key[1].as_py(), table["id"].to_numpy()), io.BytesIO()
        np.savez(out, start=model[0], columns=model[1], lasts=model[2], values=model[3])
        return pa.table({"r": pa.array([key[0].as_py()], pa.int32()), "f": pa.array([key[1].as_py()], pa.int32()), "model": pa.array([out.getvalue()], pa.binary())})

    if n <= most_rows:
        fits = [F.struct(F.lit(r).alias("r"), F.lit(f).alias("f")) for r in range(repeats) for f in range(folds)]
        training = coded.select(F.xxhash64("row_id").alias("id"), "y", "bins", "folds", F.explode(F.array(*fits)).alias("fit")).filter(F.expr("folds[fit.r] <> fit.f"))
        # Many more parts than fits: else two or three large fits meet in one task while cores are idle.
        training = training.select("fit.r", "fit.f", "id", "y", "bins").repartition(4 * len(fits), "r", "f")
        trained = training.groupBy("r", "f").applyInArrow(fit, "r int, f int, model binary").toArrow()
        packed = dict(zip(zip(trained["r"].to_pylist(), trained["f"].to_pylist()), trained["model"].to_pylist(), strict=True))
    else:
        packed = {}
        for key, model in grown_in_passes(coded, spec, cuts, repeats, folds, seed, n).items():
            np.savez(out := io.BytesIO(), start=model[0], columns=model[1], lasts=model[2], values=model[3])
            packed[key] = out.getvalue()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {}
        for key, data in packed.items():
            with np.load(io.BytesIO(data)) as z:
                models[key] = float(z["start"]), z["columns"], z["lasts"], z["values"]
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, p)
            own, out = _folds(batch, repeats), np.full((len(codes), repeats), np.nan)
            for (r, f), model in models.items():
                tested = np.flatnonzero(own[:, r] == f)
                out[tested, r] = tree_scores(codes[tested], model)
            yield _long(batch, name, np.exp(out) if spec.family == "poisson" else 1 / (1 + np.exp(-out)))

    return coded.mapInArrow(score, SCORED)
