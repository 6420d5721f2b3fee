import random

import numpy as np

from rfmlens.operators.ranks import (attach_ranks, exact_quantiles, exact_quantiles_by, feature_ranks,
                                     grouped_quantiles, value_ranks)
from rfmlens.operators.transform import midrank_column


def _data(n=500, seed=3):
    rnd = random.Random(seed)
    # a hot value holding a third of the rows, ties and a long tail
    return [(i, rnd.choice("abc"), 7.0 if i % 3 == 0 else float(rnd.randint(0, 60)) + rnd.random() * (i % 2))
            for i in range(n)]


def test_ranks_match_brute_force(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "id INT, g STRING, x DOUBLE")
    r = value_ranks(df, "x", buckets=5)
    xs = [x for _, _, x in rows]
    for row in r.df.collect():
        v = row["value"]
        assert row["n_less"] == sum(1 for x in xs if x < v)
        assert row["n_leq"] == sum(1 for x in xs if x <= v)
    assert r.n() == len(xs)


def test_quantiles_match_numpy(spark):
    rows = _data()
    df = spark.createDataFrame(rows, "id INT, g STRING, x DOUBLE")
    qs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.99, 1.0]
    got, n = exact_quantiles(df, "x", qs, buckets=4)
    assert np.allclose(got, np.quantile([x for _, _, x in rows], qs), rtol=0, atol=1e-9)
    by = exact_quantiles_by(df, "x", "g", [0.25, 0.5, 0.75], buckets=3)
    for g in "abc":
        ref = np.quantile([x for _, gg, x in rows if gg == g], [0.25, 0.5, 0.75])
        assert np.allclose(by[g], ref, atol=1e-9)


def test_feature_ranks_and_midrank(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 2.0, 6.0), (4, 5.0, 7.0)],
                               "id INT, a DOUBLE, b DOUBLE")
    fr = feature_ranks(df, ["a", "b"], buckets=2)
    q = grouped_quantiles(fr, [0.5])
    assert q == {"a": [2.0], "b": [5.5]}
    from rfmlens.operators.ranks import feature_table
    out = attach_ranks(df, "a", "p_", ranks=feature_table(fr, "a")).withColumn("m", midrank_column("p_"))
    assert [r["m"] for r in out.orderBy("id").collect()] == [0.0, 0.5, 0.5, 1.0]


def test_grouped_quantile_skewed(spark):
    rnd = random.Random(11)
    rows = [("hot", float(rnd.randint(0, 1000))) for _ in range(900)]
    rows += [(f"c{i % 40}", float(rnd.randint(0, 50))) for i in range(300)]
    rows += [("one", 5.0)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    from rfmlens.operators.ranks import grouped_quantile
    got = {r["g"]: r["quantile"] for r in grouped_quantile(df, "g", "x", 0.5, partitions=7).collect()}
    for g in {g for g, _ in rows}:
        ref = float(np.median([x for gg, x in rows if gg == g]))
        assert abs(got[g] - ref) < 1e-9, g
    q25 = {r["g"]: r["quantile"] for r in grouped_quantile(df, "g", "x", 0.25, partitions=3).collect()}
    assert abs(q25["hot"] - np.quantile([x for gg, x in rows if gg == "hot"], 0.25)) < 1e-9


def test_grouped_quantiles_with_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), (None, 9.0)], "g STRING, x DOUBLE")
    q = exact_quantiles_by(df, "x", "g", [0.5], buckets=2)
    assert q == {"a": [2.0], None: [7.0]}


def test_selection_equals_ranking(spark):
    """A few positions, by brackets and samples too small to be lucky, against all ranks."""
    import random

    from pyspark.sql import functions as F

    from rfmlens.operators.ranks import order_statistics, value_ranks
    from rfmlens.operators.selection import select
    rnd = random.Random(12)
    values = {"a": [rnd.gauss(0, 1) for _ in range(900)] + [0.25] * 500, "b": [10.0 ** rnd.uniform(-300, 300) for _ in range(700)],
              "c": [3.0] * 200, "d": [1.0, -0.0, 0.0], "e": [float(i % 2) for i in range(400)], "f": [float("nan"), None]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(7)
    wanted = {g: sorted({0, len(v) // 7, len(v) // 2, len(v) - 1}) for g, v in values.items() if g != "f"}
    want = order_statistics(value_ranks(df, "v", group="g"), [], group="g", group_positions=wanted)
    by_size = {len(v): wanted[g] for g, v in values.items() if g != "f"}
    for sample, left in ((20_000, 20_000), (40, 20), (5, 1)):
        got, sizes = select(df, "v", lambda n: by_size[n], "g", sample, left)
        assert got == want and sizes == {g: len(v) for g, v in values.items() if g != "f"}
    got, sizes = select(df.where("g = 'a'"), F.col("v") * 2, lambda n: [n // 2], sample=30, left=10)
    assert got[None][700] == 2 * sorted(values["a"])[700] and sizes == {None: 1400}
    assert select(df.where("g = 'f'"), "v", lambda n: [0]) == ({}, {})


def test_selection_shuffles_counts_only(spark):
    """What reaches the driver does not follow the number of distinct values."""
    from rfmlens.operators.selection import select
    n = 300_000
    df = spark.range(n).selectExpr("CAST(id * 7919 % 1000003 AS DOUBLE) AS v")
    got, _ = select(df, "v", lambda n: [0, n // 2, n - 1], sample=2_000, left=2_000)
    every = sorted(i * 7919 % 1000003 for i in range(n))
    assert got[None] == {p: float(every[p]) for p in (0, n // 2, n - 1)}
