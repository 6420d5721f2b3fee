"""Nearest neighbours of every row against all pairs, and kernel densities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rfmlens.operators.insights import density_curve
from rfmlens.operators.neighbors import Boxes, nearest_neighbors

COLS = ["a", "b", "d"]


def brute(rows: pd.DataFrame, k: int) -> set[tuple]:
    width = {c: rows[c].max() - rows[c].min() + 1e-9 for c in COLS}
    rows = rows.dropna()
    out = set()
    for _, part in rows.groupby("g"):
        x = part[COLS].to_numpy()
        ids = part["id"].astype(str).to_numpy()
        for i in range(len(part)):
            far = np.sqrt(sum(((x[i, j] - x[:, j]) / width[c]) ** 2 for j, c in enumerate(COLS)))
            best = sorted((f, n) for f, n in zip(far.tolist(), ids) if n != ids[i])[:k]
            out |= {(ids[i], rank, n, round(f, 9)) for rank, (f, n) in enumerate(best, 1)}
    return out


def _rows(n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.lognormal(0, 2, (n, 3))                      # most points in a corner of the range
    x[: n // 4] = np.round(x[: n // 4])                  # equal distances
    x[n // 4: n // 2] = x[0]                             # one place with a quarter of all rows
    return pd.DataFrame({"id": np.arange(n), "g": rng.choice(["x", "y", "z"], n, p=[0.8, 0.19, 0.01]), **{c: x[:, i] for i, c in enumerate(COLS)}})


@pytest.mark.parametrize("n, leaf, k", [(900, 20, 5), (300, 5, 10), (500, 1000, 3)])
def test_equal_to_all_pairs(spark, n, leaf, k):
    rows = _rows(n, n)
    got = nearest_neighbors(spark.createDataFrame(rows).repartition(5), "id", COLS, "g", k, leaf=leaf).collect()
    assert {(r.id, r["rank"], r.peer, round(r.distance, 9)) for r in got} == brute(rows, k) and len(got) == len(brute(rows, k))


def test_blocks(spark, monkeypatch):
    from rfmlens.operators import neighbors
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    rows = _rows(200, 3)
    got = nearest_neighbors(spark.createDataFrame(rows), "id", COLS, "g", 4, leaf=60).collect()
    assert {(r.id, r["rank"], r.peer, round(r.distance, 9)) for r in got} == brute(rows, 4)


def test_tree():
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 1, (3000, 3))
    tree = Boxes(x, 40)
    at = tree.leaf(x)
    assert np.bincount(at).max() <= 2 * 3000 / 40 and (tree.axis[at] < 0).all()
    r = rng.random(3000) * 0.2
    rows, leaves = tree.touched(x, r)
    pairs = set(zip(rows.tolist(), leaves.tolist()))
    for i in range(0, 3000, 50):
        near = np.sqrt(((x - x[i]) ** 2).sum(axis=1)) <= r[i]
        assert {(i, int(c)) for c in at[near]} <= pairs
    assert len(Boxes(np.zeros((50, 3)), 8).axis) == 1     # equal points are never parted


def test_missing_values(spark):
    df = spark.createDataFrame([("p", "x", 1.0, 1.0, 1.0), ("q", "x", 2.0, 1.0, 1.0), ("r", "x", None, 1.0, 1.0), ("s", None, 1.0, 1.0, 1.0),
                                (None, "x", 1.0, 1.0, 1.0), ("t", "x", float("nan"), 1.0, 1.0), ("u", "y", 1.0, 1.0, 1.0)],
                               "id string, g string, a double, b double, d double")
    got = nearest_neighbors(df.where("a = a AND NOT isnan(a) OR a IS NULL"), "id", COLS, "g").collect()
    assert sorted((r.id, r.peer) for r in got) == [("p", "q"), ("q", "p")]
    assert nearest_neighbors(df.limit(0), "id", COLS, "g").count() == 0


def test_density(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 400), rng.normal(6, 1, 400)])
    df = spark.createDataFrame([("s", float(x)) for x in v] + [("one", 3.0), ("flat", 2.0), ("flat", 2.0), ("null", None)], "Segment string, Monetary double")
    got = density_curve(df, "Monetary", 100)
    rows = sorted((r.x, r.density) for r in got.where("Segment = 's'").collect())
    h = 1.06 * v.std(ddof=1) * len(v) ** -0.2
    for x, d in rows:
        exact = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
        assert abs(d - exact) < 0.01 * max(r[1] for r in rows)
    step = rows[1][0] - rows[0][0]
    assert 0.9 < sum(d for _, d in rows) * step <= 1.0
    assert sorted((r.Segment, r.bin, r.density) for r in got.where("Segment <> 's'").collect()) == [("flat", 0, None), ("one", 0, None)]
    assert got.where(F.col("Segment") == "null").count() == 0
