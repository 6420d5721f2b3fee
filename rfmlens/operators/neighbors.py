"""T3 for all customers: the k nearest of the same group, exactly and without comparing every pair.

Equal points are one point with its k + 1 least ids (no other id at that place can be among anyone's k nearest). A
k-d tree of each group, from a bounded sample, cuts its points into leaves of about ``LEAF``, dense regions into smaller boxes:

* first round: a leaf's points meet each other, which gives each its k nearest of the leaf; the last one's distance bounds the true one;
* second round: only points whose ball of that radius leaves their box go to the leaves it touches, and bring the nearest
  of each; the least of all are the result.

Distances are those of the definition (each difference divided by the column's range + eps), equal ones go to the lesser
id. Leaves meet in numpy, ``BLOCK`` points at a time; no row of a pair that isn't a leaf's nearest exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rfmlens import dims
from rfmlens.session import checkpoint_dir

LEAF = 256                 # distinct points of a leaf, about
BLOCK = 1024               # points that are answered together
SAMPLE = 500_000           # points that the trees are made of, about; leaves get larger beyond SAMPLE / 8 of them
GROUPS = 1_000             # groups, at most: the driver holds a tree for each


class Boxes:
    """A k-d tree: ``axis`` -1 marks a leaf, whose number is in ``cut``."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        d = sample.shape[1]
        self._grow(sample, leaves, np.full(d, -np.inf), np.full(d, np.inf))
        self.axis, self.cut = np.array(self.axis), np.array(self.cut)
        self.kids, self.lo, self.hi = np.array(self.kids), np.stack(self.lo), np.stack(self.hi)

    def _grow(self, x: np.ndarray, leaves: int, lo: np.ndarray, hi: np.ndarray) -> int:
        at = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.kids.append((at, at))
        self.lo.append(lo)
        self.hi.append(hi)
        wide = np.ptp(x, axis=0) if len(x) else np.zeros(len(lo))
        if leaves > 1 and wide.max() > 0:
            i = int(wide.argmax())
            values = np.sort(x[:, i])
            cut = float(values[len(values) // 2])
            cut = cut if cut > values[0] else float(values[values > values[0]][0])
            under = x[:, i] < cut
            below, above = hi.copy(), lo.copy()
            below[i] = above[i] = cut
            self.axis[at], self.cut[at] = i, cut
            self.kids[at] = (self._grow(x[under], leaves - leaves // 2, lo, below), self._grow(x[~under], leaves // 2, above, hi))
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.axis[at] >= 0).any():
            rows = np.flatnonzero(inner)
            axis = self.axis[at[rows]]
            at[rows] = self.kids[at[rows], (x[rows, axis] >= self.cut[at[rows]]).astype(int)]
        return at

    def touched(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves): the leaves no further than r from each point."""
        who, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves = [], []
        while len(who):
            apart = np.maximum(np.maximum(self.lo[at] - x[who], x[who] - self.hi[at]), 0)
            near = np.sqrt((apart ** 2).sum(axis=1)) <= r[who] * (1 + 1e-9) + 1e-12
            who, at = who[near], at[near]
            end = self.axis[at] < 0
            rows.append(who[end])
            leaves.append(at[end])
            who, at = np.repeat(who[~end], 2), self.kids[at[~end]].ravel()
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *leaves])


def _nearest(x: np.ndarray, y: np.ndarray, names: np.ndarray, width: np.ndarray, k: int) -> Iterator[tuple[list[str], list[float]]]:
    """For each x its (at most) k nearest rows of y, whose ids ``names`` ascend: ids and distances, by distance and id."""
    for a in range(0, len(x), BLOCK):
        part = x[a:a + BLOCK]
        far, which = np.zeros((len(part), 0)), np.zeros((len(part), 0), np.int64)
        for b in range(0, len(y), 4 * BLOCK):
            some = y[b:b + 4 * BLOCK]
            square = np.zeros((len(part), len(some)))
            for i in range(x.shape[1]):
                t = (part[:, i, None] - some[None, :, i]) / width[i]
                square += t * t
            far = np.concatenate([far, np.sqrt(square)], axis=1)
            which = np.concatenate([which, np.broadcast_to(np.arange(b, b + len(some)), square.shape)], axis=1)
            # a stable sort keeps the order of ids among equal distances
            order = np.argsort(far, axis=1, kind="stable")[:, :k]
            far, which = np.take_along_axis(far, order, axis=1), np.take_along_axis(which, order, axis=1)
        for f, w in zip(far.tolist(), which):
            yield names[w].tolist(), f


def nearest_neighbors(df: DataFrame, id_col: str, cols: list[str], group_col: str, k: int = 10, eps: float = dims.NORM_EPS,
                      leaf: int = LEAF) -> DataFrame:
    """id, group, rank (from 1), peer, distance for each row of ``df`` (ids unique, as text) and its ``k`` nearest rows of the same group
    (fewer where the group has fewer), itself excluded. Rows with a null id, group or feature (or NaN) have no neighbours and are none's."""
    spark, d = df.sparkSession, len(cols)
    checkpoint_dir(spark)
    fs = [f"f{i}" for i in range(d)]
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("g"),
                     *[(F.col(c).cast("double") + 0.0).alias(f) for c, f in zip(cols, fs)])
    box = rows.agg(*[g(f).alias(f"{m}{f}") for f in fs for g, m in ((F.min, "lo"), (F.max, "hi"))]).first()
    width = np.array([(box[f"hi{f}"] or 0.0) - (box[f"lo{f}"] or 0.0) + eps for f in fs])
    rows = rows.where(" AND ".join(["id IS NOT NULL", "g IS NOT NULL", *(f"{f} IS NOT NULL AND NOT isnan({f})" for f in fs)]))
    point = "g string, " + ", ".join(f"{f} double" for f in fs)

    def features(table, mark: str = "") -> np.ndarray:
        return np.stack([table.column(f"{mark}{f}").to_numpy() for f in fs], axis=1)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 least ids of each point of a batch: a hot point is a few rows from here on."""
        for batch in batches:
            held: dict[tuple, list[str]] = {}
            for i, *key in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(tuple(key), []).append(i)
            if held:
                yield pa.RecordBatch.from_pylist([{"g": key[0], **dict(zip(fs, key[1:])), "ids": sorted(ids)[:k + 1]} for key, ids in held.items()], ids_schema)
    ids_schema = pa.schema([("g", pa.string()), *((f, pa.float64()) for f in fs), ("ids", pa.list_(pa.string()))])
    points = (rows.select("id", "g", *fs).mapInArrow(combine, f"{point}, ids array<string>").groupBy("g", *fs)
              .agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).checkpoint())

    sizes = {r["g"]: r["n"] for r in points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(GROUPS + 1).collect()}
    if len(sizes) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    total = sum(sizes.values())
    step = max(1, total // SAMPLE)
    sample: dict[str, list[tuple]] = {g: [] for g in sizes}
    for r in points.where(F.pmod(F.xxhash64("g", *fs), F.lit(step)) == 0).select("g", *fs).collect():
        sample[r["g"]].append(tuple(r)[1:])
    trees = spark.sparkContext.broadcast({
        g: Boxes(np.array(sorted(sample[g])).reshape(-1, d) / width, min(-(-n // leaf), max(1, len(sample[g]) // 8))) for g, n in sizes.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, g = features(batch) / width, np.array(batch.column("g").to_pylist(), object)
            at = np.zeros(len(x), np.int64)
            for name in set(g.tolist()):
                mine = g == name
                at[mine] = trees.value[name].leaf(x[mine])
            yield pa.record_batch([*batch.columns, pa.array(at)], [*batch.schema.names, "leaf"])
    placed = points.mapInArrow(place, f"{point}, ids array<string>, leaf long").checkpoint()
    found = f"{point}, peers array<string>, distances array<double>"

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k + 1 nearest of a leaf's rows (own id among them) for each asking point."""
        ids = [i for row in right.column("y_ids").to_pylist() for i in row]
        y = np.repeat(features(right, "y_"), [len(row) for row in right.column("y_ids").to_pylist()], axis=0) if right.num_rows else np.zeros((0, d))
        order = sorted(range(len(ids)), key=ids.__getitem__)
        got = list(_nearest(features(left), y[order], np.array(ids, object)[order], width, k + 1)) if left.num_rows else []
        return left.select(["g", *fs]).append_column("peers", pa.array([p for p, _ in got], pa.list_(pa.string()))).append_column(
            "distances", pa.array([f for _, f in got], pa.list_(pa.float64())))

    def answers(asking: DataFrame) -> DataFrame:
        """``asking``: points and the leaf they ask."""
        asking = asking.withColumn("part", F.pmod(F.xxhash64(*fs), F.col("parts")))
        sources = placed.join(per_leaf, ["g", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        sources = sources.toDF(*[f"y_{c}" for c in sources.columns])
        on = ["g", "leaf", "part"]
        return asking.drop("parts").groupBy(*on).cogroup(sources.groupBy(*[f"y_{c}" for c in on])).applyInArrow(meet, found)
    # a leaf that many ask is answered in several groups
    per_leaf = placed.groupBy("g", "leaf").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("long").alias("parts"))
    first = answers(placed.drop("ids").join(per_leaf, ["g", "leaf"])).checkpoint()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The further leaves that a point's ball touches."""
        for batch in batches:
            x, g = features(batch) / width, np.array(batch.column("g").to_pylist(), object)
            r = np.array([f[-1] if len(f) > k else np.inf for f in batch.column("distances").to_pylist()])
            rows_, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for name in set(g.tolist()):
                mine, tree = np.flatnonzero(g == name), trees.value[name]
                row, at = tree.touched(x[mine], r[mine])
                other = at != tree.leaf(x[mine])[row]
                rows_.append(mine[row[other]])
                leaves.append(at[other])
            row = pa.array(np.concatenate(rows_))
            yield pa.record_batch([batch.column(c).take(row) for c in ["g", *fs]] + [pa.array(np.concatenate(leaves))], ["g", *fs, "leaf"])
    asking = first.mapInArrow(reach, f"{point}, leaf long").join(per_leaf, ["g", "leaf"])
    every = first.unionAll(answers(asking))
    pairs = F.flatten(F.collect_list(F.arrays_zip("distances", "peers")))
    best = every.groupBy("g", *fs).agg(F.slice(F.sort_array(pairs), 1, k + 1).alias("v"))
    same = [F.col("g").eqNullSafe(F.col("b_g")), *[F.col(f) == F.col(f"b_{f}") for f in fs]]
    named = best.toDF(*[f"b_{c}" for c in best.columns])
    mine = rows.join(named, same).select("id", "g", F.slice(F.filter("b_v", lambda p: p["peers"] != F.col("id")), 1, k).alias("v"))
    out = mine.select("id", "g", F.posexplode("v").alias("i", "p"))
    return out.select(F.col("id").alias(id_col), F.col("g").alias(group_col), (F.col("i") + 1).alias("rank"), F.col("p.peers").alias("peer"),
                      F.col("p.distances").alias("distance"))
