"""All restarts in shared passes: seeding, bounds and convergence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rfmlens.operators import lloyd as LL
from rfmlens.operators.cluster import SCALED, assemble, fit_kmeans
from rfmlens.operators.transform import fit_transform
from rfmlens.plans import base as B

COLS = ["a", "b", "d"]


def _points(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 0.1, (n // 4, 3)) for m in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1))])
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0)])
    return x, spark.createDataFrame(pd.DataFrame(x, columns=COLS))


def _plain(x: np.ndarray, start: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    c = start.copy()
    for step in range(1, max_iter + 1):
        label = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1)).max()
        c = new
        if moved <= tol:
            break
    return c, ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum(), step


def test_step_equals_brute_force():
    rng = np.random.default_rng(2)
    for size, spread in ((256, 0.01), (100, 1.0), (1, 1.0), (7, 0.0)):
        x = 0.4 + spread * rng.random((size, 3))
        w = rng.integers(1, 5, size).astype(float)
        sets = rng.random((20, 6, 3))
        got = LL._step(x, w, sets)
        for s, c in zip(got, sets):
            far = ((x[:, None] - c) ** 2).sum(axis=2)
            label = far.argmin(axis=1)
            for j in range(6):
                mine = label == j
                assert np.allclose(s[j], [w[mine].sum(), (w * far.min(axis=1))[mine].sum(), *(w[mine] @ x[mine])], atol=1e-9)


def test_steps_of_blocks_add_up():
    rng = np.random.default_rng(3)
    blocks = [(m + 0.2 * rng.random((n, 3)), rng.integers(1, 5, n).astype(float)) for m, n in ((0.1, 256), (0.5, 90), (0.7, 1), (0.4, 256))]
    sets = rng.random((20, 4, 3))
    sets[3, 2] = sets[3, 0]                     # equal centres: the first has the points
    sets[4] = sets[4, 0]
    x, w = np.concatenate([x for x, _ in blocks]), np.concatenate([w for _, w in blocks])
    for s, c in zip(LL._steps(blocks, sets), sets):
        far = ((x[:, None] - c) ** 2).sum(axis=2)
        label = far.argmin(axis=1)
        for j in range(4):
            mine = label == j
            assert s[j, 0] == w[mine].sum()
            assert np.allclose(s[j], [w[mine].sum(), (w * far.min(axis=1))[mine].sum(), *(w[mine] @ x[mine])], atol=1e-9)


def test_points_are_compared_only_where_the_box_lies_between_centres(monkeypatch):
    compared, count = [], np.count_nonzero
    monkeypatch.setattr(LL.np, "count_nonzero", lambda v: compared.append(v.shape) or count(v))
    rng = np.random.default_rng(4)
    flat = rng.random((256, 3)) * (0.01, 2, 2)  # thin along x, wide along the others
    sets = np.array([[[0.0, 1, 1], [1.0, 1, 1]]])
    for at, blocks in ((0.3, 0), (0.495, 1), (0.6, 0)):
        compared.clear()
        got = LL._steps([(flat + (at, 0, 0), np.ones(256))], sets)
        assert len(compared) == blocks and got[0, :, 0].sum() == 256


@pytest.mark.parametrize("held", [0, 1 << 16])
def test_every_set_ends_where_a_fit_by_itself_does(spark, monkeypatch, held):
    monkeypatch.setattr(LL, "HELD", held)
    monkeypatch.setattr(LL, "LEAST", 500)
    x, df = _points(spark)
    data = LL.pack(df, COLS)
    assert data.points == 3000 and data.rows.selectExpr("sum(aggregate(w, 0D, (a, b) -> a + b))").first()[0] == 3200
    engine = data if not held else LL.Held([(np.array(r.x).reshape(-1, 3), np.array(r.w)) for r in data.rows.collect()])
    fits = LL._fits(engine, [3, 4], [5, 6, 7], 100, 1e-9)
    starts = LL.seeds(engine, 4, [5, 6, 7])
    for (k, fit), start in zip(fits, [s[:k] for k in (3, 4) for s in starts]):
        c, cost, steps = _plain(x, start, 100, 1e-9)
        assert len(fit.points) == k and np.allclose(fit.points, c, atol=1e-7) and abs(fit.cost - cost) < 1e-6 * cost and fit.iterations == steps
    data.rows.unpersist()


def test_seeds_do_not_depend_on_partitions(spark, monkeypatch):
    x, df = _points(spark, 1200)
    found = []
    for least, rows in ((50, df.repartition(9)), (5000, df.orderBy("d"))):
        monkeypatch.setattr(LL, "LEAST", least)
        data = LL.pack(rows, COLS)
        found.append(np.stack(LL.seeds(data, 5, list(range(8)))))
        data.rows.unpersist()
    assert np.array_equal(found[0], found[1])
    known = {tuple(p) for p in x}
    assert all(tuple(p) in known for p in found[0].reshape(-1, 3))


def test_first_draw_follows_weights_and_second_squared_distances():
    x = np.array([[0.0, 0, 0], [1.0, 0, 0], [3.0, 0, 0]])
    w = np.array([6.0, 3.0, 1.0])
    picks, after = np.zeros(3), np.zeros((3, 3))
    engine = LL.Held([(x, w)])
    n = 6000
    # one draw a centre, so that none is chosen for its cost
    old, LL.math = LL.math, type("m", (), {"log": staticmethod(lambda k: -1.0), "ceil": LL.math.ceil, "log2": LL.math.log2})
    try:
        chains = LL.seeds(engine, 2, list(range(n)))
    finally:
        LL.math = old
    for c in chains:
        a, b = (int(np.flatnonzero((x == p).all(axis=1))[0]) for p in c)
        picks[a] += 1
        after[a, b] += 1
    assert np.abs(picks / n - w / w.sum()).max() < 0.03
    for a in range(3):
        p = w * ((x - x[a]) ** 2).sum(axis=1)
        assert after[a, a] == 0 and np.abs(after[a] / after[a].sum() - p / p.sum()).max() < 0.06


def test_no_worse_than_separate_fits(spark):
    scaled, _ = fit_transform(B.rfm(spark, SF001))
    feats = assemble(scaled).cache()
    mine = LL.best_fits(feats, SCALED, [3, 4, 5], 10, 300, 1e-6, 42)
    for k, fit in mine.items():
        assert fit.cost <= 1.02 * fit_kmeans(feats, k, restarts=10, max_iter=300, tol=1e-6, seed=42).cost
    feats.unpersist()


def test_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 0.0, -0.0), (1.0, 0.0, 0.0), (None, 1.0, 1.0), (float("nan"), 0.0, 0.0), (2.0, 0.0, 0.0)], "a double, b double, d double")
    fits = LL.best_fits(df, COLS, [1, 2, 4], 2, 10, 1e-9, 0)
    assert sorted(fits[2].points[:, 0].tolist()) == [1.0, 2.0] and fits[4].points.shape == (4, 3) and fits[4].cost == 0
    assert np.allclose(fits[1].points, [[4 / 3, 0, 0]])
    with pytest.raises(ValueError):
        LL.best_fits(df.limit(0), COLS, [2], 2, 10, 1e-9, 0)
    assert df.where(F.col("a").isNull()).count() == 1
