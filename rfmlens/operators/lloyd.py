"""KMeans for many (k, restart) pairs at once (M6, M13): one pass over the customers an iteration.

Distinct points with weights are packed into blocks of neighbours, cached as arrays. A pass sends the centres of
all sets that haven't converged to every block and adds up, for each centre, the weight and the sum of the points nearest to it:

* **bounds**: a centre that doesn't beat the one nearest to a block's middle at any corner of the block's box is nearest to
  none of its points (the difference of two squared distances is linear). Where one centre is left, the block counts as a whole,
  by its sums; only the other blocks' points are compared, and only for the sets that need it;
* **dropping out**: a set whose centres moved at most ``tol`` is done, and later passes don't hold it;
* **seeding** is greedy k-means++: a point is drawn with probability as its weight times its squared distance to the
  centres so far, as the least of the keys -log(u) / (w * d^2), where u is a hash of seed, draw and the point itself, so the
  draw doesn't depend on partitions or order; of a few such draws the one that leaves the least cost is taken. The sets of one restart
  share their first centres: k of a restart's are the first of those for a larger k.

A task returns one row of sums, whose size follows the centres, not the rows. Up to ``HELD`` points, a job for each pass costs more than
its work: then every task holds the points and runs the same passes over them for its share of the restarts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 256                # points of a block
TOGETHER = 64              # blocks whose bounds are found at a time
POINTS_PER_TASK = 1 << 17  # at most; few points are spread over the session's cores, ``LEAST`` in a task
LEAST = 1 << 10
HELD = 1 << 16             # points that a task holds as a whole (2 MB for three features)
DIRECT = 64                # tasks whose sums the driver adds itself; those of more are added by an aggregate first
_U = np.uint64


@dataclass
class Centres:
    """A fitted set."""
    points: np.ndarray
    cost: float
    seed: int
    iterations: int


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


Block = tuple[np.ndarray, np.ndarray]          # (points, d) features and (points,) weights


class Spread:
    """Blocks as a table: every pass is a job."""

    def __init__(self, rows: DataFrame, tasks: int, points: int, d: int):
        self.rows, self.tasks, self.points, self.d = rows, tasks, points, d

    def add(self, total: Callable[[Iterator[Block]], np.ndarray]) -> np.ndarray:
        """Sum over the tasks of the array that ``total`` makes of a task's blocks."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch([pa.array([total(_blocks(batches, d))], pa.list_(pa.float64()))], ["v"])
        parts = self.rows.mapInArrow(run, "v array<double>")
        if self.tasks <= DIRECT:
            return np.sum([r[0] for r in parts.collect()], axis=0)
        rows = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(rows))
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    def least(self, draw: Callable[[Iterator[Block]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, points): the least key of each draw over the tasks, and its point."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, point = draw(_blocks(batches, d))
            yield pa.record_batch([pa.array([key.ravel()], pa.list_(pa.float64())), pa.array([point.ravel()], pa.list_(pa.float64()))], ["key", "point"])
        parts = self.rows.mapInArrow(run, "key array<double>, point array<double>")
        pairs = F.transform("key", lambda v, i: F.struct(v.alias("key"), F.slice("point", i * d + 1, d).alias("point")))
        best = parts.select(F.posexplode(pairs).alias("i", "v")).groupBy("i").agg(F.min("v").alias("v")).select("i", "v.key", "v.point").collect()
        best.sort(key=lambda r: r["i"])
        return np.array([r["key"] for r in best]), np.array([r["point"] for r in best])


class Held:
    """Blocks in a task's memory: every pass is a loop."""

    def __init__(self, blocks: list[Block]):
        self.blocks, self.d = blocks, blocks[0][0].shape[1]

    def add(self, total: Callable[[Iterator[Block]], np.ndarray]) -> np.ndarray:
        return total(iter(self.blocks))

    def least(self, draw: Callable[[Iterator[Block]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, point = draw(iter(self.blocks))
        return key.ravel(), point.reshape(-1, self.d)


def pack(df: DataFrame, cols: list[str]) -> Spread:
    """Blocks of up to ``BLOCK`` distinct points that lie close together: x (their features, point by point), w (rows of
    each). Cached; rows with a null or NaN feature are left out."""
    d = len(cols)
    fs = [f"f{i}" for i in range(d)]
    points = (df.select(*[(F.col(c).cast("double") + 0.0).alias(f) for c, f in zip(cols, fs)])
              .where(" AND ".join(f"{f} IS NOT NULL AND NOT isnan({f})" for f in fs)).groupBy(*fs).agg(F.count(F.lit(1)).alias("w")))
    box = points.agg(F.count(F.lit(1)).alias("n"), *[g(f).alias(f"{m}{f}") for f in fs for g, m in ((F.min, "lo"), (F.max, "hi"))]).first()
    n = box["n"]
    cells = 2 ** math.ceil(math.log2(max(2, n / BLOCK)) / d)
    width = [(box[f"hi{f}"] - box[f"lo{f}"]) / cells or 1.0 for f in fs] if n else [1.0] * d
    cell = [F.least(F.floor((F.col(f) - box[f"lo{f}"]) / w), F.lit(cells - 1)).alias(f"k{f}") for f, w in zip(fs, width)] if n else []
    keys = [f"k{f}" for f in fs] if n else []
    tasks = max(1, -(-n // POINTS_PER_TASK), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(d)], axis=1)
            w = batch.column(d).to_numpy().astype(float)
            cuts = range(0, len(x), BLOCK)
            yield pa.record_batch([pa.array([x[i:i + BLOCK].ravel() for i in cuts], pa.list_(pa.float64())),
                                   pa.array([w[i:i + BLOCK] for i in cuts], pa.list_(pa.float64()))], ["x", "w"])
    if n:
        points = points.select(*fs, "w", *cell).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys, *fs)
    return Spread(points.select(*fs, "w").mapInArrow(run, "x array<double>, w array<double>").cache(), tasks, n, d)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Block]:
    for batch in batches:
        for x, w in zip(batch.column(0), batch.column(1)):
            yield x.values.to_numpy().reshape(-1, d), w.values.to_numpy()


def _step(x: np.ndarray, w: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """(sets, k, 2 + d): weight, cost and weighted sums of a block's points by nearest centre, for ``sets`` (sets, k, d)."""
    return _steps([(x, w)], sets)


def _steps(blocks: Sequence[Block], sets: np.ndarray) -> np.ndarray:
    """``_step``, added up over blocks: the bounds of all at once, then the points of those whose boxes lie between centres."""
    s, k, d = sets.shape
    sizes = np.array([len(w) for _, w in blocks])
    starts = np.cumsum(sizes) - sizes
    x, w = np.concatenate([x for x, _ in blocks]), np.concatenate([w for _, w in blocks])
    total, first = np.add.reduceat(w, starts), np.add.reduceat(w[:, None] * x, starts, axis=0)
    middle = first / total[:, None]
    u = x - np.repeat(middle, sizes, axis=0)
    square = w * (u ** 2).sum(axis=1)
    parts = np.column_stack([w, square, w[:, None] * u])
    lo, hi = np.minimum.reduceat(u, starts, axis=0), np.maximum.reduceat(u, starts, axis=0)
    ends = [sets[:, :, i] - middle[:, i, None, None] for i in range(d)]            # (blocks, sets, k) each
    to_middle = sum(e ** 2 for e in ends)
    best = to_middle.argmin(axis=2)[:, :, None]
    # a centre is nearest to a point only if it beats the middle's nearest one at its best corner of the block's box
    reach = 0
    for i, e in enumerate(ends):
        apart = 2 * (e - np.take_along_axis(e, best, axis=2))
        reach = reach + np.maximum(apart * lo[:, i, None, None], apart * hi[:, i, None, None])
    near = to_middle - np.take_along_axis(to_middle, best, axis=2) <= reach * (1 + 1e-9) + 1e-12
    alone = near.sum(axis=2) == 1
    block, of = np.nonzero(alone)
    which = best[block, of, 0]
    place, n = of * k + which, s * k
    whole = np.column_stack([total, np.add.reduceat(square, starts), first])[block]
    whole[:, 1] += total[block] * to_middle[block, of, which]
    out = np.stack([np.bincount(place, v, minlength=n) for v in whole.T], axis=1).reshape(s, k, 2 + d).astype(float)
    for i in np.flatnonzero(~alone.all(axis=1)):
        rest, mine = np.flatnonzero(~alone[i]), slice(starts[i], starts[i] + sizes[i])
        some = sets[rest] - middle[i]
        norm = to_middle[i, rest]
        far = (some.reshape(-1, d) @ (-2 * u[mine]).T).reshape(len(rest), k, -1)   # less |u|^2
        far += norm[:, :, None]
        at = far <= far.min(axis=1, keepdims=True)
        if np.count_nonzero(at) > len(rest) * sizes[i]:                            # of equal distances the first counts
            at = np.arange(k)[:, None] == far.argmin(axis=1)[:, None]
        v = (at.reshape(len(rest) * k, -1).astype(float) @ parts[mine]).reshape(len(rest), k, 2 + d)
        v[:, :, 1] = np.maximum(v[:, :, 1] - 2 * (v[:, :, 2:] * some).sum(axis=2) + v[:, :, 0] * norm, 0)
        v[:, :, 2:] += v[:, :, :1] * middle[i]
        out[rest] += v
    return out


def _pass(data: Spread | Held, sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set (k, d) its (k, 2 + d) weights, costs and sums."""
    d = data.d
    groups: dict[int, list[int]] = {}
    for i, c in enumerate(sets):
        groups.setdefault(len(c), []).append(i)
    stacked = {k: np.stack([sets[i] for i in of]) for k, of in groups.items()}

    def total(blocks: Iterator[Block]) -> np.ndarray:
        sums = {k: np.zeros((*c.shape[:2], 2 + d)) for k, c in stacked.items()}
        for some in batched(blocks, TOGETHER):
            for k, c in stacked.items():
                sums[k] += _steps(some, c)
        return np.concatenate([v.ravel() for v in sums.values()])
    flat, at = data.add(total), 0
    out: list[np.ndarray] = [np.zeros(0)] * len(sets)
    for k, of in groups.items():
        for i in of:
            out[i] = flat[at:at + k * (2 + d)].reshape(k, 2 + d)
            at += k * (2 + d)
    return out


def _squares(x: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """(points, sets, centres): squared distances, each from its difference, so that a centre's own is 0."""
    out = np.zeros((len(x), *sets.shape[:2]))
    for i in range(x.shape[1]):
        out += (x[:, i, None, None] - sets[:, :, i]) ** 2
    return out


def _least(x: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """(points, sets): least squared distance to a set's centres, 1 without any."""
    return _squares(x, sets).min(axis=2) if sets.shape[1] else np.ones((len(x), len(sets)))


def seeds(data: Spread | Held, k: int, restarts: list[int]) -> list[np.ndarray]:
    """Greedy k-means++ centres (k, d) for each restart's seed, from two passes for each centre. Fewer distinct points than
    ``k`` repeat as centres."""
    d, draws = data.d, 2 + int(math.log(k))
    chosen = np.zeros((len(restarts), 0, d))
    for turn in range(k):
        at = np.array(restarts, np.int64).astype(_U)[:, None] * _U(1 << 20) + np.arange(turn * draws, turn * draws + draws).astype(_U)
        salts, now = _mix(at * _U(0x9E3779B97F4A7C15) + _U(1)), chosen

        def draw(blocks: Iterator[Block], salts=salts, now=now) -> tuple[np.ndarray, np.ndarray]:
            key = np.full(salts.shape, np.inf)
            point = np.zeros((*salts.shape, d))
            for x, w in blocks:
                bits = np.ascontiguousarray(x).view(_U)
                own = np.zeros(len(x), _U)
                for i in range(d):
                    own = _mix(own * _U(0x9E3779B97F4A7C15) + bits[:, i] + _U(1))
                weight = w[:, None] * _least(x, now)
                u = ((_mix(own[:, None, None] ^ salts) >> _U(11)).astype(float) + 0.5) / 2.0 ** 53
                with np.errstate(divide="ignore"):
                    keys = -np.log(u) / weight[:, :, None]
                first = keys.argmin(axis=0)
                best = np.take_along_axis(keys, first[None], axis=0)[0]
                better = best < key
                key[better] = best[better]
                point[better] = x[first[better]]
            return key, point
        key, point = data.least(draw)
        key, found = key.reshape(salts.shape), point.reshape(*salts.shape, d)
        if turn:                   # a key without a bound: every point is a centre already
            found = np.where(np.isfinite(key)[:, :, None], found, now[:, :1])

        def left(blocks: Iterator[Block], found=found, now=now) -> np.ndarray:
            cost = np.zeros(found.shape[:2])
            for x, w in blocks:
                far = _squares(x, found)
                if now.shape[1]:
                    far = np.minimum(far, _least(x, now)[:, :, None])
                cost += np.tensordot(w, far, axes=1)
            return cost.ravel()
        # sums of parts in another order differ in their last digits
        cost = np.array([float(f"{v:.10g}") for v in data.add(left)]).reshape(salts.shape)
        chosen = np.concatenate([now, np.take_along_axis(found, cost.argmin(axis=1)[:, None, None], axis=1)], axis=1)
    return list(chosen)


def fit_all(data: Spread | Held, starts: list[np.ndarray], max_iter: int, tol: float) -> list[Centres]:
    """Lloyd's iterations from each start, all in the same passes. A centre without points stays where it is. The seed of a
    result is its place in ``starts``."""
    centres = [s.copy() for s in starts]
    steps = [0] * len(starts)
    live = list(range(len(starts)))
    while live:
        sums = _pass(data, [centres[i] for i in live])
        going = []
        for i, v in zip(live, sums):
            new = np.where(v[:, :1] > 0, v[:, 2:] / np.maximum(v[:, :1], 1e-300), centres[i])
            moved = np.sqrt(((new - centres[i]) ** 2).sum(axis=1)).max()
            centres[i] = new
            steps[i] += 1
            if moved > tol and steps[i] < max_iter:
                going.append(i)
        live = going
    costs = [float(v[:, 1].sum()) for v in _pass(data, centres)] if centres else []
    return [Centres(c, cost, i, n) for i, (c, cost, n) in enumerate(zip(centres, costs, steps))]


def _fits(data: Spread | Held, ks: list[int], restarts: list[int], max_iter: int, tol: float) -> list[tuple[int, Centres]]:
    """(k, fit) for each k and restart."""
    chains = seeds(data, max(ks), restarts)
    fits = fit_all(data, [c[:k] for k in ks for c in chains], max_iter, tol)
    which = [(k, s) for k in ks for s in restarts]
    return [(k, Centres(f.points, f.cost, s, f.iterations)) for (k, s), f in zip(which, fits)]


def _held_fits(data: Spread, ks: list[int], restarts: list[int], max_iter: int, tol: float) -> list[tuple[int, Centres]]:
    """``_fits`` of points that every task can hold (``HELD`` at most, checked by the caller): the restarts are dealt to the tasks instead of
    the points, which saves a job for each pass."""
    spark = data.rows.sparkSession
    blocks = [(np.array(r["x"]).reshape(-1, data.d), np.array(r["w"])) for r in data.rows.collect()]
    points = spark.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [s for b in batches for s in b.column(0).to_pylist()]
        if mine:
            got = _fits(Held(points.value), ks, mine, max_iter, tol)
            yield pa.RecordBatch.from_pylist([{"k": k, "points": f.points.ravel(), "cost": f.cost, "seed": f.seed, "iterations": f.iterations}
                                              for k, f in got], schema)
    schema = pa.schema([("k", pa.int64()), ("points", pa.list_(pa.float64())), ("cost", pa.float64()), ("seed", pa.int64()), ("iterations", pa.int64())])
    tasks = min(len(restarts), spark.sparkContext.defaultParallelism)
    dealt = spark.range(0, len(restarts), 1, tasks).select((F.col("id") + restarts[0]).alias("seed"))
    rows = dealt.mapInArrow(run, "k long, points array<double>, cost double, seed long, iterations long").collect()
    return [(r["k"], Centres(np.array(r["points"]).reshape(-1, data.d), r["cost"], r["seed"], r["iterations"])) for r in rows]


def best_fits(df: DataFrame, cols: list[str], ks: list[int], restarts: int, max_iter: int, tol: float, seed: int) -> dict[int, Centres]:
    """M6 for each k of ``ks``: the fit of least cost of ``restarts`` (ties: the first seed). An empty table has no fit."""
    data = pack(df, cols)
    try:
        if not data.points:
            raise ValueError("no rows to cluster")
        each = [seed + r for r in range(max(1, restarts))]
        fits = (_held_fits if data.points <= HELD else _fits)(data, ks, each, max_iter, tol)
    finally:
        data.rows.unpersist()
    return {k: min((f for j, f in fits if j == k), key=lambda f: (float(f"{f.cost:.12g}"), f.seed)) for k in ks}
