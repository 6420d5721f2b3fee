"""Euclidean silhouette against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from rfmlens.operators import silhouette as SL
from rfmlens.plans import base as B

COLS = ["a", "b", "d"]


def brute(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    _, c = np.unique(c, return_inverse=True)
    k, out = c.max() + 1, np.zeros(len(x))
    size = np.bincount(c, minlength=k)
    for i in range(len(x)):
        far = np.bincount(c, np.sqrt(((x - x[i]) ** 2).sum(axis=1)), minlength=k)
        if size[c[i]] > 1 and k > 1:
            a = far[c[i]] / (size[c[i]] - 1)
            b = min(far[j] / size[j] for j in range(k) if j != c[i])
            out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


def _table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    x[:n // 3] *= 0.1                                     # a dense corner
    x[n // 3:n // 2] = x[n // 3]                          # one point with a sixth of all rows
    x[n // 2:n // 2 + n // 10, 2] = 0.0                   # a plane
    c = (x.sum(axis=1) * 1.7).astype(int)
    c[-1] = 99                                            # alone in its cluster
    return x, c, spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "d": x[:, 2], "Cluster": c, "i": np.arange(n)}))


@pytest.mark.parametrize("n, leaf, tol", [(900, None, 1e-6), (3000, 60, 1e-4), (3000, 40, 1e-2)])
def test_every_row_within_its_certified_error(spark, n, leaf, tol):
    x, c, df = _table(spark, n)
    points = SL.euclidean_points(df, COLS, tol=tol, leaf=leaf)
    rows = SL.euclidean_rows(df, COLS, points=points).join(
        points.select(*[F.col(k).alias(f"p{k}") for k in COLS], F.col("Cluster").alias("pc"), "error"),
        F.expr("a = pa AND b = pb AND d = pd AND Cluster = pc")).orderBy("i").toPandas()
    want = brute(x, c)
    assert len(rows) == n
    assert (np.abs(rows[SL.EUCLIDEAN] - want) <= rows["error"] + 1e-9).all()
    got = SL.euclidean_summary(points)
    assert abs(got[SL.EUCLIDEAN] - want.mean()) <= got["euclidean_error"] + 1e-9 <= tol + 1e-9
    if leaf is None:
        assert got["euclidean_error"] == 0 and got["n_negative_euclidean"] == (want < 0).sum()


def test_distances_of_a_point_grow_slower_than_the_table():
    """Eight times the points, each with its list of far cells and near leaves."""
    rng, seen = np.random.default_rng(3), []
    for n in (32_000, 256_000):
        code = np.floor(rng.random((n, 3)) * 2 ** SL.DEPTH).astype(int)
        rows = []
        for level in range(7):
            cells, count = np.unique(code >> (SL.DEPTH - level), axis=0, return_counts=True)
            rows += [(level, *cell, int(m)) for cell, m in zip(cells.tolist(), count)]
        big = {r[:4] for r in rows if r[4] > 200}
        tree = SL.Tree([0.0] * 3, 1.0, [r for r in rows if r[0] == 0 or (r[0] - 1, *(v >> 1 for v in r[1:4])) in big], 200, 5)
        leaves = np.flatnonzero(~tree.inner)[::97]
        lists = [tree.lists(int(a), 3e-3) for a in leaves]
        assert all(sum(int(tree.points[i]) for i in far + near) == n for far, near, _ in lists)     # each point once
        seen.append(np.mean([len(far) * 5 ** 3 + sum(int(tree.points[b]) for b in near) for far, near, _ in lists]))
    assert seen[1] < 0.25 * 256_000 and seen[1] < 3.5 * seen[0]


def test_two_clusterings_in_one_pass(spark):
    x, c, df = _table(spark, 700, seed=2)
    df = df.withColumn("other", (F.col("a") > 0.3).cast("string"))
    both = SL.clustering_points(df, COLS, ["Cluster", "other"])
    rows = df.join(both.drop("Cluster", "other", "n"), COLS).groupBy("i").agg(F.first("silhouettes").alias("s")).orderBy("i").toPandas()
    s = np.stack(rows["s"])
    assert np.abs(s[:-1, 0] - brute(x, c)[:-1]).max() < 1e-9 and np.abs(s[:, 1] - brute(x, x[:, 0] > 0.3)).max() < 1e-9


def test_edge_cases(spark):
    schema = "a double, b double, d double, Cluster int"
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1), (-0.0, 0.0, 0.0, 1), (1.0, 0.0, 0.0, 2), (None, 0.0, 0.0, 1), (float("nan"), 0.0, 0.0, 2),
                                (0.5, 0.5, 0.5, None)], schema)
    got = SL.euclidean_rows(df, COLS).select(SL.EUCLIDEAN).collect()
    assert sorted((r[0] for r in got), key=str) == [0.0, 1.0, 1.0, None, None, None]
    assert [r[0] for r in SL.euclidean_rows(df.where("Cluster = 1 AND a IS NOT NULL"), COLS).select(SL.EUCLIDEAN).collect()] == [0.0, 0.0]
    assert SL.euclidean_points(df.limit(0), COLS).count() == 0
    assert np.isnan(SL.euclidean_summary(SL.euclidean_points(df.limit(0), COLS))[SL.EUCLIDEAN])
    flat = spark.createDataFrame([(1.0, 1.0, 1.0, i % 2) for i in range(10)], schema)        # all points equal
    assert {r[0] for r in SL.euclidean_rows(flat, COLS).select(SL.EUCLIDEAN).collect()} == {0.0}
    with pytest.raises(ValueError):
        SL.euclidean_points(spark.range(300).selectExpr("0.0 AS a", "0.0 AS b", "0.0 AS d", "id AS Cluster"), COLS)


def test_all_customers(spark):
    df, _ = B.scaled(spark, SF01)
    cols = ["Recency_s", "Frequency_s", "Monetary_s"]
    rows = df.select(*cols, "Cluster").toPandas()
    got = SL.euclidean_summary(SL.euclidean_points(df, cols))
    want = brute(rows[cols].values, rows["Cluster"].values)
    assert abs(got[SL.EUCLIDEAN] - want.mean()) < 1e-6 and got["n_negative_euclidean"] == (want < 0).sum()


def _planes(n: int, seed: int = 5) -> np.ndarray:
    """Points of a few values of the second feature, as counts of orders are."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.random(n), rng.integers(0, 18, n) / 18, rng.random(n)], axis=1)


def test_work_of_a_point_grows_slower_than_the_table_in_regions():
    """Eight times the points: what a point meets, of nodes and of other points, counted once each."""
    seen = []
    for n in (64_000, 512_000):
        x, held = _planes(n), {(0, 0, 0, 0)}
        code = np.floor(x * 2 ** SL.DEPTH).astype(int)
        rows = [(0, 0, 0, 0, n, *x.min(axis=0), *x.max(axis=0))]
        for level in range(1, 8):
            cells, at, count = np.unique(code >> (SL.DEPTH - level), axis=0, return_inverse=True, return_counts=True)
            by = np.argsort(at.ravel(), kind="stable")
            starts = np.concatenate([[0], np.cumsum(count)[:-1]])
            low, high = np.minimum.reduceat(x[by], starts), np.maximum.reduceat(x[by], starts)
            found = [(level, *c, int(m), *a, *b) for c, m, a, b in zip(cells.tolist(), count, low, high) if (level - 1, *(v >> 1 for v in c)) in held]
            held = {r[:4] for r in found if r[4] > 1024}
            rows += found
        tree = SL.Tree([0.0] * 3, 1.0, rows, 1024, 10)
        region, leaves, work, points = tree.regions(n // 64), np.flatnonzero(~tree.inner), 0, 0
        nodes = tree.grids.prod(axis=1)
        for a in np.unique(region[leaves])[::9].tolist():
            for i, (leaf, parts, near) in enumerate(tree.plan(a, leaves[region[leaves] == a].tolist(), 1e-6)):
                assert sum(int(tree.points[cells].sum()) for _, cells, _ in parts if cells) + int(tree.points[near].sum()) == n
                points += int(tree.points[leaf])
                work += int(tree.points[near].sum() * tree.points[leaf])
                for j, (cell, cells, _) in enumerate(parts):
                    if cells and (j or not i):
                        work += int(nodes[cells].sum() * (nodes[cell] if cell >= 0 else tree.points[leaf]))
        seen.append(work / points)
    assert seen[1] < 0.4 * 512_000 and seen[1] < 3.5 * seen[0]


def test_regions_of_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(SL, "REGIONS", 10)
    x = _planes(4000)
    c = (x[:, 0] * 2 + x[:, 1] * 2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "d": x[:, 2], "Cluster": c}))
    rows = SL.euclidean_points(df, COLS, tol=1e-2, leaf=40).toPandas()
    assert (rows["error"] > 0).any() and rows["n"].sum() == 4000
    want = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "d": x[:, 2], "want": brute(x, c)}).merge(rows, on=COLS)
    assert len(want) == 4000 and (np.abs(want[SL.EUCLIDEAN] - want["want"]) <= want["error"] + 1e-9).all()


def test_far_sums_equal_plain_sums():
    rng = np.random.default_rng(7)
    x, y, w = 0.03 * rng.random((130, 3)), rng.random((1100, 3)) + (0.06, 0, 0), rng.random((1100, 4))
    plain = (np.sqrt(((x[:, None] - y) ** 2).sum(axis=2))) @ w
    for f in (SL._sums, SL._far_sums):
        assert np.allclose(f(x, y, w), plain, rtol=1e-13, atol=0)
    assert np.array_equal(SL._sums(x, y[:0], w[:0]), np.zeros((130, 4)))
