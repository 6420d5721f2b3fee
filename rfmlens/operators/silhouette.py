"""Euclidean silhouette (M9, M10) without comparing every pair of customers.

A row's silhouette needs its mean distance to the rows of every cluster. Those sums come from a tree of
cells (an octree for three features) over the distinct points:

* a cell with more than ``leaf`` points is split; counts and bounding boxes of the cells are aggregates of a few depths at a
  time, of which the driver sees the split cells' children only, whose number ``leaf`` bounds;
* **exact part**: the points of a leaf meet the points of the leaves near it in numpy, a region of neighbouring leaves at a
  time, so a point is sent to the few regions around it, not to each leaf. Small tables have one leaf and are exact throughout;
* **far part**: the points of a far cell are replaced by weights on a grid of Chebyshev nodes of their bounding box, with fewer
  nodes along its thinner sides (one where all values are equal). A polynomial
  that interpolates |x - y| at the nodes is off by less than a bound that follows from the gap between the two boxes (the
  distance is analytic in the box up to its branch points, ``_error``); cells are used where that is at most ``eps``,
  else their children. The weights are one aggregate, and are broadcast: ``FAR_BYTES`` bounds them, beyond which
  leaves get larger;
* **certified**: the bounds of the cells used add up to one on each sum, and so on each silhouette. ``eps`` is lowered
  until the mean of them is at most ``tol``.

Equal points are one point with a weight, so a hot value costs nothing. Rows move once to their region and once to each region
near it; no row of a pair of customers exists anywhere.

Defined results: rows with a null or NaN feature or a null cluster count for nothing and have a null silhouette; a row
alone in its cluster has 0, as have all rows of a single cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rfmlens.session import checkpoint_dir

EUCLIDEAN = "silhouette_euclidean"
DEPTH = 16                 # halvings of the features' range, at most
LEVELS = 4                 # depths counted in one aggregate
LEAF = 1024                # points of a leaf, at least this many may stay together
REGION = 1 << 15           # points that get their sums in one group, at most
REGIONS = 256              # groups, about, of tables with fewer points
TILE = (64, 512)           # points whose distances are held at a time
FAR_BYTES = 128 << 20      # weights of far cells that are broadcast
CLUSTERS = 256             # clusters, at most: the driver holds a row for each


class Tree:
    """Cells by number: depth, corner (in units of the cell's own size), points, box of the points (the whole cell, if it isn't
    given), children."""

    def __init__(self, lo: list[float], side: float, rows: list[tuple], leaf: int, nodes: int):
        d = len(lo)
        rows = sorted(rows)
        self.depth = np.array([r[0] for r in rows])
        self.corner = np.array([r[1:1 + d] for r in rows], np.int64).reshape(len(rows), d)
        self.points = np.array([r[1 + d] for r in rows])
        self.lo, self.side, self.nodes = np.array(lo), side, nodes
        if len(rows[0]) > 2 + d:
            box = np.array([r[2 + d:] for r in rows], float)
            self.half, self.center = (box[:, d:] - box[:, :d]) / 2, (box[:, d:] + box[:, :d]) / 2
        else:
            size = (side / 2.0 ** self.depth)[:, None]
            self.half, self.center = np.repeat(size / 2, d, axis=1), self.lo + (self.corner + 0.5) * size
        self.number = {(r[0], *r[1:1 + d]): i for i, r in enumerate(rows)}
        self.inner = (self.points > leaf) & (self.depth < DEPTH)
        self.children: list[list[int]] = [[] for _ in rows]
        self.parent = np.full(len(rows), -1)
        for i, r in enumerate(rows):
            if r[0]:
                self.parent[i] = self.number[(r[0] - 1, *(c >> 1 for c in r[1:1 + d]))]
                self.children[self.parent[i]].append(i)
        #: nodes along each side: at a gap of one edge of the longest, about as good along all
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = 2 * self.half.max(axis=1, keepdims=True) / self.half
            ask = (nodes - 1) * np.arccosh(3) / np.arccosh(1 + gap)
        self.grids = np.where(self.half > 0, 1 + np.ceil(np.nan_to_num(ask) - 1e-9).clip(1, nodes - 1), 1).astype(int)
        #: cells that have weights: those with more points than weights, unless all points are in one leaf
        self.weighted = (self.points > self.grids.prod(axis=1)) & (len(rows) > 1)
        #: place of each cell along a curve on which neighbours are close
        code = self.corner << (DEPTH - self.depth)[:, None]
        along = sum(((code[:, i] >> bit) & 1) << (bit * d + i) for bit in range(DEPTH) for i in range(d))
        self.order = np.empty(len(rows), np.int64)
        self.order[np.argsort(along, kind="stable")] = np.arange(len(rows))

    def regions(self, most: int) -> np.ndarray:
        """For each cell the highest cell above it, or itself, with at most ``most`` points; leaves may have more."""
        out = np.arange(len(self.points))
        for i in range(len(out)):              # parents come first
            if self.parent[i] >= 0 and self.points[out[self.parent[i]]] <= most:
                out[i] = out[self.parent[i]]
        return out

    def place(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the cells of each depth that points lie in (rows: depths; -1 below the leaf)."""
        code = np.minimum(((x - self.lo) / self.side * 2.0 ** DEPTH).astype(np.int64), (1 << DEPTH) - 1)
        out = np.full((int(self.depth.max()) + 1, len(x)), -1)
        for level in range(len(out)):
            cells, at = np.unique(code >> (DEPTH - level), axis=0, return_inverse=True)
            numbers = np.array([self.number.get((level, *c), -1) for c in cells.tolist()])
            out[level] = numbers[at.ravel()]
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the leaves that points lie in."""
        return self.place(x).max(axis=0)

    def shared(self, target: int, eps: float, front: list[int]) -> tuple[list[int], list[int], np.ndarray]:
        """Far cells of ``front`` whose sums may be interpolated from the target's own nodes to all of its points, the cells that
        are left, and the far cells' errors a point."""
        if not self.weighted[target]:
            return [], front, np.zeros(0)
        far, rest, errors, front = [], [], [], np.array(front, np.int64)
        factor, own = self._lebesgue(np.array([target])).prod(), np.array([target])
        while len(front):
            # off by the target's interpolation, and by the cell's at the target's nodes
            error = self._error(front, own) + factor * self._error(target, front)
            use = self.weighted[front] & (error <= eps)
            far += front[use].tolist()
            errors += error[use].tolist()
            left = front[~use]
            split = self.inner[left] & (self.depth[left] <= self.depth[target])
            rest += left[~split].tolist()
            front = np.array([c for i in left[split].tolist() for c in self.children[i]], np.int64)
        return far, rest, np.array(errors)

    def plan(self, region: int, leaves: list[int], eps: float) -> Iterator[tuple[int, list[tuple], list[int]]]:
        """Each leaf of a region, what its sums come from as (cell whose nodes get the sums, or -1: the points themselves; far cells;
        errors a point), and its near leaves."""
        far, front, error = self.shared(region, eps, [0])
        whole = (region, far, error)
        for leaf in leaves:
            own, rest, e = self.shared(leaf, eps, front) if leaf != region else ([], front, np.zeros(0))
            far, near, errors = self.lists(leaf, eps, rest)
            yield leaf, [whole, (leaf, own, e), (-1, far, errors)], near

    def lists(self, target: int, eps: float, front: list[int] | None = None) -> tuple[list[int], list[int], np.ndarray]:
        """What a leaf needs of the cells of ``front`` (all): far cells, near leaves, and the far cells' errors a point."""
        far, near, errors, front = [], [], [], np.array([0] if front is None else front, np.int64)
        while len(front):
            error = self._error(target, front)
            use = self.weighted[front] & (error <= eps)
            far += front[use].tolist()
            errors += error[use].tolist()
            rest = front[~use]
            near += rest[~self.inner[rest]].tolist()
            front = np.array([c for i in rest[self.inner[rest]].tolist() for c in self.children[i]], np.int64)
        return far, near, np.array(errors)

    def _lebesgue(self, cells: np.ndarray) -> np.ndarray:
        """(cells, sides): bounds on the interpolation's Lebesgue constants."""
        return np.where(self.half[cells] > 0, 1 + 2 / np.pi * np.log(self.grids[cells]), 1)

    def _error(self, target: int | np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Bound on |x - y| less its interpolation, for x in the target and y in each cell.

        Along one axis the distance is analytic but at y = x +- i * (distance in the other axes), so inside an ellipse around the
        cell's edge with half-axis ``a`` (in half edges) and radius r = a + sqrt(a^2 - 1). With q nodes the interpolation of a
        function at most M there is off by 4 M r^(1-q) / (r - 1) at most; each further axis multiplies that by the
        Lebesgue constant, at most 1 + 2 / pi * log q."""
        q, h = self.grids[cells], self.half[cells]
        apart = np.abs(self.center[cells] - self.center[target])
        gap = np.maximum(apart - h - self.half[target], 0)
        wide = np.sqrt(((apart + h + self.half[target]) ** 2).sum(axis=1, keepdims=True))
        aside = np.sqrt(np.maximum((gap ** 2).sum(axis=1, keepdims=True) - gap ** 2, 0))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            gap, aside = gap / h, aside / h
            a = np.where(gap > 0, (np.hypot(gap, aside) + np.hypot(2 + gap, aside)) / 2, np.hypot(1, aside))
            r = a + np.sqrt(a * a - 1)
            axis = np.where(h > 0, 4 * (a * h + wide) * r ** (1.0 - q) / (r - 1), 0)
        # the sides in the order of their errors: each comes after those with larger ones
        by = np.argsort(-axis, axis=1, kind="stable")
        axis = np.take_along_axis(axis, by, axis=1)
        before = np.cumprod(np.take_along_axis(np.broadcast_to(self._lebesgue(cells), axis.shape), by, axis=1), axis=1)
        axis[:, 1:] = np.where(axis[:, 1:] > 0, axis[:, 1:] * before[:, :-1], 0)
        return axis.sum(axis=1)

    def chebyshev(self, q: int) -> np.ndarray:
        return np.cos((np.arange(q) + 0.5) * np.pi / q)

    def grid(self, cell: int) -> np.ndarray:
        """The nodes of a cell, one row each."""
        axes = [c + h * self.chebyshev(q) for c, h, q in zip(self.center[cell], self.half[cell], self.grids[cell])]
        return np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, len(axes))

    def bases(self, cell: int, x: np.ndarray) -> list[np.ndarray]:
        """(points, nodes) of each side: the nodes' interpolating polynomials at the points."""
        out = []
        for i, q in enumerate(self.grids[cell]):
            if q == 1:
                out.append(np.ones((len(x), 1)))
                continue
            orders = np.arange(q)
            at_nodes = np.cos(np.outer(np.arccos(self.chebyshev(q)), orders))
            u = np.clip((x[:, i] - self.center[cell, i]) / self.half[cell, i], -1, 1)
            values = np.cos(np.outer(np.arccos(u), orders))
            values[:, 0] /= 2
            out.append(2 / q * values @ at_nodes.T)
        return out

    def shares(self, cell: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weights on a cell's nodes that stand for its points x with weights w."""
        total, bases = w[:, None], self.bases(cell, x)
        for basis in bases[:-1]:
            total = (total[:, :, None] * basis[:, None, :]).reshape(len(x), -1)
        return (total.T @ bases[-1]).reshape(-1)

    def between(self, cell: int, x: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(points, columns): ``values`` (nodes, columns) of a cell's nodes, interpolated at its points x."""
        out = np.zeros((len(x), values.shape[1]))
        for at in range(0, len(x), TILE[1]):
            first, *rest = self.bases(cell, x[at:at + TILE[1]])
            part = (first @ values.reshape(first.shape[1], -1))
            for basis in rest:
                part = np.einsum("nq,nqr->nr", basis, part.reshape(len(part), basis.shape[1], -1))
            out[at:at + TILE[1]] = part
        return out


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of |x - y| * w over y, for each x and column of w."""
    out = np.zeros((len(x), w.shape[1]))
    here, there = np.empty(TILE), np.empty(TILE)
    xs, ys = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for at in range(0, len(x), TILE[0]):
        some = xs[:, at:at + TILE[0], None]
        for of in range(0, len(y), TILE[1]):
            part = ys[:, None, of:of + TILE[1]]
            square, step = (v[:some.shape[1], :part.shape[2]] for v in (here, there))
            np.subtract(some[0], part[0], out=square)
            np.multiply(square, square, out=square)
            for i in range(1, len(some)):
                np.subtract(some[i], part[i], out=step)
                np.multiply(step, step, out=step)
                np.add(square, step, out=square)
            np.sqrt(square, out=square)
            out[at:at + TILE[0]] += square @ w[of:of + TILE[1]]
    return out


def _far_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``_sums`` for y well apart from x, as products: |x - y|^2 = |x|^2 + |y|^2 - 2 x y loses digits only where x and y are close."""
    out = np.zeros((len(x), w.shape[1]))
    middle = x.mean(axis=0)
    x, y = x - middle, y - middle
    left = np.column_stack([x, (x ** 2).sum(axis=1), np.ones(len(x))])
    right = np.column_stack([-2 * y, np.ones(len(y)), (y ** 2).sum(axis=1)]).T
    for at in range(0, len(x), TILE[0]):
        for of in range(0, len(y), TILE[1]):
            square = left[at:at + TILE[0]] @ right[:, of:of + TILE[1]]
            out[at:at + TILE[0]] += np.sqrt(np.maximum(square, 0, out=square), out=square) @ w[of:of + TILE[1]]
    return out


def _columns(table, d: int, m: int, mark: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, clusters (a column for each clustering) and weights."""
    def stack(name: str, n: int) -> np.ndarray:
        return np.stack([table.column(f"{mark}{name}{i}").to_numpy() for i in range(n)], axis=1)
    return stack("f", d), stack("c", m), table.column(f"{mark}w").to_numpy().astype(float)


def _tree(points: DataFrame, d: int, box: list[float], side: float, n: int, clusters: int, nodes: int, leaf: int) -> Tree:
    """The cells with more than ``leaf`` points and their children; ``box`` is the least and the greatest value of each feature."""
    lo, root = box[:d], (0, *[0] * d, n, *box)
    if n <= leaf:
        return Tree(lo, side, [root], leaf, nodes)
    fs, keys = [f"f{i}" for i in range(d)], [f"k{i}" for i in range(d)]
    code = [F.least(F.floor((F.col(f) - lo[i]) / side * 2 ** DEPTH), F.lit((1 << DEPTH) - 1)).cast("long").alias(k) for i, (f, k) in enumerate(zip(fs, keys))]
    fine = points.select(*fs, *code)
    boxes = [g(f).alias(f"{m}{f}") for g, m in ((F.min, "lo"), (F.max, "hi")) for f in fs]
    spark, rows, big = points.sparkSession, [root], [root[1:1 + d]]
    for top in range(0, DEPTH, LEVELS):
        # points of the cells that are still to be split, counted in the cells of the next depths
        split = spark.createDataFrame(big, ", ".join(f"p{k} long" for k in keys))
        some = fine.select("*", *[F.shiftright(k, DEPTH - top).alias(f"p{k}") for k in keys]).join(F.broadcast(split), [f"p{k}" for k in keys])
        level = F.explode(F.sequence(F.lit(top + 1), F.lit(min(top + LEVELS, DEPTH)))).alias("level")
        cells = some.select(level, *fs, *keys).select("level", *fs, *[F.expr(f"shiftright({k}, {DEPTH} - level)").alias(k) for k in keys])
        cells = cells.groupBy("level", *keys).agg(F.count(F.lit(1)).alias("n"), *boxes).checkpoint()
        held = cells.where(F.col("n") > leaf).select((F.col("level") + 1).alias("level"), *[F.col(k).alias(f"p{k}") for k in keys])
        tops = spark.createDataFrame([(top + 1, *b) for b in big], held.schema)
        kids = cells.select("*", *[F.shiftright(k, 1).alias(f"p{k}") for k in keys]).join(F.broadcast(held.unionByName(tops)), ["level", *[f"p{k}" for k in keys]])
        found = [tuple(r) for r in kids.select("level", *keys, "n", *[f"{m}{f}" for m in ("lo", "hi") for f in fs]).collect()]
        rows += found
        big = [r[1:1 + d] for r in found if r[0] == top + LEVELS and r[1 + d] > leaf]
        if not big:
            break
    tree = Tree(lo, side, rows, leaf, nodes)
    while (tree.grids.prod(axis=1) * tree.weighted).sum() * clusters * 8 > FAR_BYTES:
        leaf *= 2
        held = {r[:1 + d] for r in rows if r[1 + d] > leaf}
        rows = [r for r in rows if not r[0] or (r[0] - 1, *(k >> 1 for k in r[1:1 + d])) in held]
        tree = Tree(lo, side, rows, leaf, nodes)
    return tree


def _weights(points: DataFrame, tree, d: int, m: int, k: int) -> dict[int, np.ndarray]:
    """(nodes, clusters) weights of each weighted cell."""
    spark = points.sparkSession
    names = [*(f"f{i}" for i in range(d)), *(f"c{i}" for i in range(m)), "w"]

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(t.order[t.leaves(_columns(batch, d, m)[0])], pa.int64())], [*batch.schema.names, "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held = tree.value, {}
        for batch in batches:
            x, c, w = _columns(batch, d, m)
            for row in t.place(x):
                for cell in np.unique(row):
                    if cell >= 0 and t.weighted[cell]:
                        here = np.flatnonzero(row == cell)
                        for cluster in np.unique(c[here]):
                            mine = here[(c[here] == cluster).any(axis=1)]
                            held[cell, cluster] = held.get((cell, cluster), 0) + t.shares(cell, x[mine], w[mine])
        for (cell, cluster), v in held.items():
            yield pa.record_batch([pa.array([int(cell)]), pa.array([int(cluster)]), pa.array([v])], ["cell", "c", "v"])
    # neighbours in one task: only the few cells that hold points of several tasks are added up from parts
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-int(tree.value.points[0]) // REGION)))
    near = points.select(*names).mapInArrow(ordered, f"{_point(d, m)}, place long").repartitionByRange(tasks, "place").sortWithinPartitions("place")
    parts = near.select(*names).mapInArrow(run, "cell long, c long, v array<double>")
    total = parts.select("cell", "c", F.posexplode("v").alias("i", "v")).groupBy("cell", "c", "i").agg(F.sum("v").alias("v"))
    packed = total.groupBy("cell", "c").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).select("cell", "c", F.col("v.v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in packed.toLocalIterator():
        out.setdefault(r["cell"], np.zeros((len(r["v"]), k)))[:, r["c"]] = r["v"]
    return out


def _point(d: int, m: int) -> str:
    return ", ".join([*(f"f{i} double" for i in range(d)), *(f"c{i} long" for i in range(m)), "w long"])


def distance_sums(points: DataFrame, d: int, m: int, k: int, tree: Tree, far: dict[int, np.ndarray], eps: float) -> DataFrame:
    """f0.., c0.., w, sums, errors (arrays by cluster) of each point (f0.., c0.., w): its sums of distances to all points of each
    of the k clusters of all clusterings, and bounds on what they are off by."""
    spark = points.sparkSession
    tree_, far_ = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(far)
    point, names = _point(d, m), [*(f"f{i}" for i in range(d)), *(f"c{i}" for i in range(m)), "w"]
    leaves = np.flatnonzero(~tree.inner)
    region = tree.regions(min(REGION, -(-int(tree.points[0]) // REGIONS)))
    blocks = {int(a): -(-int(tree.points[a]) // REGION) for a in np.unique(region[leaves])}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree_.value.leaves(_columns(batch, d, m)[0])
            yield pa.record_batch([*batch.columns, pa.array(leaf, pa.int64()), pa.array(region[leaf], pa.int64())], [*batch.schema.names, "leaf", "region"])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                near = sorted({b for *_, found in tree_.value.plan(a, leaves[region[leaves] == a].tolist(), eps) for b in found})
                pairs = np.array([(b, a, i) for b in near for i in range(blocks[a])], np.int64).reshape(-1, 3)
                yield pa.record_batch([pa.array(col) for col in pairs.T], ["leaf", "a", "block"])

    def evaluate(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t, held = tree_.value, {}
        x, c, w = _columns(left, d, m)
        at = left.column("leaf").to_numpy()
        y, cy, wy = _columns(right, d, m, "y_")
        member = np.zeros((len(y), k))
        for i in range(m):
            member[np.arange(len(y)), cy[:, i]] = wy
        of = right.column("y_leaf").to_numpy()
        by = np.argsort(of, kind="stable")
        of, y, member = of[by], y[by], member[by]

        def reached(to: np.ndarray, cells: list[int]) -> np.ndarray:
            """Sums of the cells at the points ``to``."""
            for cell in cells:
                if cell not in held:
                    held[cell] = t.grid(cell)
            return _far_sums(to, np.concatenate([held[i] for i in cells]), np.concatenate([far_.value[i] for i in cells]))
        sums, errors, a = np.zeros((len(x), k)), np.zeros((len(x), k)), key[0].as_py()
        for leaf, parts, near in t.plan(a, np.unique(at).tolist(), eps):
            mine = np.flatnonzero(at == leaf)
            some = np.concatenate([np.arange(*np.searchsorted(of, [b, b + 1])) for b in sorted(near)] or [np.zeros(0, np.int64)])
            sums[mine] += _sums(x[mine], y[some], member[some])
            for cell, cells, error in parts:
                if cells and cell != a:
                    sums[mine] += reached(x[mine], cells) if cell < 0 else t.between(cell, x[mine], reached(t.grid(cell), cells))
                errors[mine] += sum(e * far_.value[i].sum(axis=0) for i, e in zip(cells, error))
            whole = parts[0][1]
        if len(x) and whole:
            sums += t.between(a, x, reached(t.grid(a), whole))
        listed = pa.list_(pa.float64())
        return pa.table({**{f"f{i}": x[:, i] for i in range(d)}, **{f"c{i}": c[:, i] for i in range(m)}, "w": w.astype(np.int64), "sums": pa.array(list(sums), listed),
                         "errors": pa.array(list(errors), listed)})
    tasks = max(1, min(8 * spark.sparkContext.defaultParallelism, sum(blocks.values())))
    on_leaf = points.select(*names).mapInArrow(placed, f"{point}, leaf long, region long")
    at = spark.createDataFrame([(a,) for a in blocks], "a long").repartition(tasks).mapInArrow(needed, "leaf long, a long, block long")
    sizes = spark.createDataFrame(list(blocks.items()), "region long, blocks int")
    targets = on_leaf.join(F.broadcast(sizes), "region")
    targets = targets.withColumn("a", F.col("region")).withColumn("block", F.pmod(F.xxhash64(*[f"f{i}" for i in range(d)]), F.col("blocks")).cast("long")).drop("region", "blocks")
    sources = on_leaf.drop("region").join(F.broadcast(at), "leaf")
    sources = sources.toDF(*[f"y_{c}" for c in sources.columns])
    return (targets.repartition(tasks, "a", "block").groupBy("a", "block")
            .cogroup(sources.repartition(tasks, "y_a", "y_block").groupBy("y_a", "y_block"))
            .applyInArrow(evaluate, f"{point}, sums array<double>, errors array<double>"))


def _silhouette(own: Column, sizes: dict[int, int]) -> tuple[Column, Column]:
    """(silhouette, bound on its error) in one clustering: ``own`` is the row's cluster, ``sizes`` the rows of each of its clusters."""
    zero = F.lit(0.0)
    if len(sizes) < 2:
        return zero, zero
    count = F.element_at(F.create_map(*[F.lit(v) for i, n in sizes.items() for v in (i, float(n))]), own)
    place = own.cast("int")
    # distances to other clusters: lowest and highest value they can have
    others = F.filter(F.array(*[F.when(own != i, F.struct((F.get("sums", F.lit(i)) / n).alias("d"), (F.get("errors", F.lit(i)) / n).alias("e")))
                                for i, n in sizes.items()]), lambda x: x.isNotNull())
    a, ea = F.get("sums", place) / (count - 1), F.get("errors", place) / (count - 1)
    b = F.array_min(F.transform(others, lambda x: x["d"]))
    low, high = F.array_min(F.transform(others, lambda x: x["d"] - x["e"])), F.array_min(F.transform(others, lambda x: x["d"] + x["e"]))

    def s(p: Column, q: Column) -> Column:
        return F.when(p < q, 1 - p / q).when(p > q, q / p - 1).otherwise(zero)
    value = F.when(count <= 1, zero).otherwise(s(a, b))
    # the silhouette falls in a and rises in b
    error = F.when(count <= 1, zero).otherwise(F.greatest(s(F.greatest(a - ea, zero), high) - s(a, b), s(a, b) - s(a + ea, F.greatest(low, zero))))
    return value, error


def clustering_points(df: DataFrame, cols: list[str], clusterings: list[str], tol: float = 1e-6, leaf: int | None = None) -> DataFrame:
    """Distinct points: cols, clusterings, n (rows), silhouettes and errors (arrays by clustering), as a checkpointed table. The
    distances are computed once for all clusterings (columns of cluster ids). Errors are certified, and at most ``tol`` on average
    in each clustering."""
    spark, d, m = df.sparkSession, len(cols), len(clusterings)
    checkpoint_dir(spark)
    if not 1 <= d <= 3:
        raise ValueError("one to three features are needed")
    fs, gs = [f"f{i}" for i in range(d)], [f"g{i}" for i in range(m)]
    # -0.0 and 0.0 are one point
    points = (df.select(*[(F.col(c).cast("double") + 0.0).alias(f) for c, f in zip(cols, fs)], *[F.col(c).alias(g) for c, g in zip(clusterings, gs)])
              .where(" AND ".join([*(f"{f} IS NOT NULL AND NOT isnan({f})" for f in fs), *(f"{g} IS NOT NULL" for g in gs)]))
              .groupBy(*fs, *gs).agg(F.count(F.lit(1)).alias("w")).checkpoint())
    kinds = [points.schema[g].dataType.simpleString() for g in gs]
    empty = (f"{', '.join(f'`{c}` double' for c in cols)}, {', '.join(f'`{c}` {t}' for c, t in zip(clusterings, kinds))}, n long, "
             "silhouettes array<double>, errors array<double>")
    box = points.agg(F.count(F.lit(1)).alias("n"), *[g(f).alias(f"{k}{f}") for f in fs for g, k in ((F.min, "lo"), (F.max, "hi"))]).first()
    if not box["n"]:
        return spark.createDataFrame([], empty)
    ends = [box[f"{g}{f}"] for g in ("lo", "hi") for f in fs]
    side = max(b - a for a, b in zip(ends, ends[d:])) or 1.0
    sizes: list[dict[int, int]] = []       # rows by cluster number, for each clustering
    ids, first = [], 0
    for g in gs:
        rows = points.groupBy(g).agg(F.sum("w").alias("w")).limit(CLUSTERS + 1).collect()
        if len(rows) > CLUSTERS:
            raise ValueError(f"more than {CLUSTERS} clusters")
        rows.sort(key=lambda r: r[0])
        sizes.append({first + i: r["w"] for i, r in enumerate(rows)})
        ids.append({first + i: r[0] for i, r in enumerate(rows)})
        first += len(rows)
    k = first

    def numbers(g: str, of: dict) -> Column:
        return F.element_at(F.create_map(*[v for i, c in of.items() for v in (F.lit(c), F.lit(i).cast("long"))]), F.col(g))
    cs = [f"c{i}" for i in range(m)]
    points = points.select(*fs, *[numbers(g, of).alias(c) for g, of, c in zip(gs, ids, cs)], "w")
    nodes = max(4, int(np.ceil(-np.log10(tol))) + 4)
    tree = _tree(points, d, ends, side, box["n"], k, nodes, leaf or LEAF)
    far = _weights(points, spark.sparkContext.broadcast(tree), d, m, k) if tree.inner.any() else {}
    judged = [_silhouette(F.col(c), of) for c, of in zip(cs, sizes)]
    eps = tol * side
    while True:
        done = distance_sums(points, d, m, k, tree, far, eps).select(
            *fs, *cs, "w", F.array(*[v for v, _ in judged]).alias("s"), F.array(*[e for _, e in judged]).alias("e")).checkpoint()
        mean = max(done.agg(*[F.sum(F.get("e", F.lit(i)) * F.col("w")) / F.sum("w") for i in range(m)]).first())
        if mean <= tol:
            break
        eps *= 0.5 * tol / mean

    def back(c: str, of: dict) -> Column:
        return F.element_at(F.create_map(*[v for i, x in of.items() for v in (F.lit(i).cast("long"), F.lit(x))]), F.col(c))
    return done.select(*[F.col(f).alias(c) for f, c in zip(fs, cols)], *[back(c, of).alias(name) for c, of, name in zip(cs, ids, clusterings)],
                       F.col("w").alias("n"), F.col("s").alias("silhouettes"), F.col("e").alias("errors"))


def euclidean_points(df: DataFrame, cols: list[str], cluster_col: str = "Cluster", tol: float = 1e-6, leaf: int | None = None) -> DataFrame:
    """``clustering_points`` of one clustering: cols, cluster_col, n (rows), silhouette_euclidean, error."""
    return clustering_points(df, cols, [cluster_col], tol, leaf).select(
        *cols, cluster_col, "n", F.get("silhouettes", F.lit(0)).alias(EUCLIDEAN), F.get("errors", F.lit(0)).alias("error"))


def euclidean_rows(df: DataFrame, cols: list[str], cluster_col: str = "Cluster", points: DataFrame | None = None,
                   tol: float = 1e-6, out_col: str = EUCLIDEAN) -> DataFrame:
    """``df`` with each row's Euclidean silhouette (``points`` from ``euclidean_points``, if they are there already)."""
    points = points if points is not None else euclidean_points(df, cols, cluster_col, tol)
    keys = points.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(cols)], F.col(cluster_col).alias("_cluster"), F.col(EUCLIDEAN).alias(out_col))
    same = F.col(cluster_col) == F.col("_cluster")
    for i, c in enumerate(cols):
        same = same & (F.col(c).cast("double") == F.col(f"_f{i}"))
    return df.join(keys, same, "left").drop("_cluster", *[f"_f{i}" for i in range(len(cols))])


def euclidean_summary(points: DataFrame) -> dict:
    """M9: mean silhouette over all rows, rows below 0, certified bound on the mean's error."""
    r = points.agg(F.sum("n").alias("n"), F.sum(F.col(EUCLIDEAN) * F.col("n")).alias("s"), F.sum(F.col("error") * F.col("n")).alias("e"),
                   F.sum(F.when(F.col(EUCLIDEAN) < 0, F.col("n")).otherwise(0)).alias("neg")).first()
    n = r["n"] or 0
    return {EUCLIDEAN: float(r["s"]) / n if n else float("nan"), "euclidean_error": float(r["e"]) / n if n else 0.0, "n_negative_euclidean": int(r["neg"] or 0)}
