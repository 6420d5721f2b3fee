"""Feature capping and the uniform quantile transform (M1-M5).

Fit (M3) and transform of the training rows (M4) use exact distributed ranks:
a value that occupies sorted positions a..b of n maps to (a + b) / 2 / (n - 1)
(the average of the left and right interpolation), the minimum to 0 and the
maximum to 1. The saved transformer keeps all of them: one knot (value, lo, hi) for
each distinct value of each feature, as a table that stays on the executors. Unseen rows
(M5) meet the knots in value order, bucket by bucket: each distinct value takes
the last knot at or below and the first at or above it, from its bucket or,
at a bucket's edge, from the next one that has any. So a training row gets the
same value from either, at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rfmlens.operators.ranks import (BROADCAST_VALUES, attach_ranks, bucket_of, capped_ranks, feature_ranks,
                                     feature_table, grouped_quantiles, split_points)
from rfmlens.session import checkpoint_dir

FEATURES = ["Recency", "Frequency", "Monetary"]


def fit_caps(rfm: DataFrame, features=FEATURES, q: float = 0.99,
             buckets: int | None = None, ranks=None) -> dict[str, float]:
    """M1: per-feature cap = exact linear ``q`` quantile (one ranked pass, or
    ``ranks`` from ``feature_ranks``)."""
    qs = grouped_quantiles(ranks if ranks is not None else feature_ranks(rfm, list(features), buckets), [q])
    return {f: float(qs[f][0]) for f in features}


def cap_report(rfm: DataFrame, caps: dict[str, float]) -> DataFrame:
    """M1: the cap and the number of customers above it, per feature."""
    wide = rfm.agg(*[F.count_if(F.col(f) > F.lit(c)).alias(f) for f, c in caps.items()])
    stack = ", ".join(f"'{f}', CAST({c!r} AS DOUBLE), `{f}`" for f, c in caps.items())
    return wide.selectExpr(f"stack({len(caps)}, {stack}) AS (feature, cap, n_capped)")


def apply_caps(df: DataFrame, caps: dict[str, float]) -> DataFrame:
    """M2: clip each feature that has a cap at that cap (others untouched)."""
    out = df
    for f, c in caps.items():
        if f in df.columns:
            out = out.withColumn(f, F.least(F.col(f).cast("double"), F.lit(float(c))))
    return out


def midrank_column(prefix: str) -> Column:
    """M4 from attached ranks: min -> 0, max -> 1, else mid-rank / (n-1)."""
    n_less, n_leq, n = (F.col(prefix + "n_less"), F.col(prefix + "n_leq"), F.col(prefix + "n"))
    mid = (n_less + n_leq - 1) / 2.0 / (n - 1)
    return (F.when(n <= 1, F.lit(0.0)).when(n_less == 0, F.lit(0.0))
            .when(n_leq == n, F.lit(1.0)).otherwise(mid))


KNOTS = "feature STRING, value DOUBLE, lo DOUBLE, hi DOUBLE"


@dataclass
class QuantileModel:
    """Saved transform: caps and the table of knots (feature, value and its
    reference positions lo, hi in [0, 1])."""
    caps: dict[str, float]
    knots: DataFrame
    n: int = 0


def fit_transform(rfm: DataFrame, features=FEATURES, cap_q: float = 0.99,
                  buckets: int | None = None, caps: dict[str, float] | None = None, ranks=None
                  ) -> tuple[DataFrame, QuantileModel]:
    """M1-M4: cap, then map each feature to [0, 1]. Returns the customers with
    ``{feature}_s`` columns and the model.

    One ranked pass over the raw features (or ``ranks``, shared with the
    quintile scores) gives the caps, and the ranks of the capped values are
    derived from it (``capped_ranks``) instead of ranking again."""
    raw = ranks if ranks is not None else feature_ranks(rfm, list(features), buckets)
    caps = caps if caps is not None else fit_caps(rfm, features, cap_q, buckets, raw)
    out = rfm
    for f in features:
        out = out.withColumn(f"_c_{f}", F.least(F.col(f).cast("double"), F.lit(float(caps[f]))))
    capped = capped_ranks(raw, {f: caps[f] for f in features})
    capped.df = capped.df.cache()              # read by the join back and as the model's knots
    place = lambda c: F.when(F.col("n") > 1, c / (F.col("n") - 1)).otherwise(F.lit(0.0))
    knots = capped.df.select(F.col("feature"), "value", place(F.col("n_less")).alias("lo"),
                             place(F.col("n_leq") - 1).alias("hi"))
    model = QuantileModel(caps, knots, capped.n(features[0]))
    for i, f in enumerate(features):
        p = f"_r{i}_"
        out = attach_ranks(out, f"_c_{f}", p, ranks=feature_table(capped, f)).withColumn(f"{f}_s", midrank_column(p)) \
            .drop(p + "n_less", p + "n_leq", p + "n")
    return out.drop(*[f"_c_{f}" for f in features]), model


def place_values(values: DataFrame, knots: DataFrame, buckets: int | None = None) -> DataFrame:
    """(feature, value, s) for distinct (feature, value) rows: equal to a knot ->
    the middle of its positions; between knots -> linear interpolation from the lower
    one's last to the upper one's first position; outside -> 0 or 1."""
    inner = split_points(knots, "value", knots.count(), buckets)
    knot = F.struct("value", "lo", "hi")
    both = (knots.select("feature", "value", knot.alias("knot"))
            .unionByName(values.select("feature", "value", F.lit(None).cast("struct<value:double,lo:double,hi:double>").alias("knot"))))
    both = bucket_of(both, "value", inner, "b")
    # nearest knots outside each bucket: a few rows a feature
    edges = both.groupBy("feature", "b").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    # "the nearest above" runs down from the top: a frame that starts at the row and ends with
    # the partition would be read anew for every row
    up, down = ([Window.partitionBy("feature").orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
                 for o in (F.asc("b"), F.desc("b"))])
    edges = edges.select(
        F.col("feature").alias("f2"), F.col("b").alias("b2"),
        F.last("last", ignorenulls=True).over(up).alias("under"), F.last("first", ignorenulls=True).over(down).alias("over"))
    rise, fall = ([Window.partitionBy("feature", "b").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)
                   for o in (F.asc("value"), F.desc("value"))])
    near = (both.withColumn("below", F.last("knot", ignorenulls=True).over(rise))
            .withColumn("above", F.last("knot", ignorenulls=True).over(fall))
            .where("knot IS NULL").join(edges, (F.col("feature") == F.col("f2")) & (F.col("b") == F.col("b2")))
            .select("feature", "value", F.coalesce("below", "under").alias("k0"), F.coalesce("above", "over").alias("k1")))
    least = knots.groupBy(F.col("feature").alias("f3")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    x = F.col("value")
    t = (x - F.col("k0.value")) / (F.col("k1.value") - F.col("k0.value"))
    s = (F.when(x <= F.col("least"), F.lit(0.0)).when(x >= F.col("most"), F.lit(1.0))
         .when(x == F.col("k0.value"), (F.col("k0.lo") + F.col("k0.hi")) / 2)
         .otherwise(F.col("k0.hi") + t * (F.col("k1.lo") - F.col("k0.hi"))))
    return near.join(least, F.col("feature") == F.col("f3")).select("feature", "value", s.alias("s"))


def transform(df: DataFrame, model: QuantileModel, features=FEATURES, suffix: str = "_s",
              buckets: int | None = None) -> DataFrame:
    """M2 + M5: cap and place the rows' distinct values among the saved knots, then
    join them back by value."""
    out = df
    for f in features:
        x = F.col(f).cast("double")
        if f in model.caps:
            x = F.least(x, F.lit(float(model.caps[f])))
        out = out.withColumn(f"_c_{f}", x)
    pairs = ", ".join(f"'{f}', `_c_{f}`" for f in features)
    values = out.selectExpr(f"stack({len(features)}, {pairs}) AS (feature, value)").where("value IS NOT NULL").distinct()
    checkpoint_dir(df.sparkSession)
    placed = place_values(values, model.knots, buckets).checkpoint()
    sizes = {r["feature"]: r["n"] for r in placed.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    for f in features:
        mine = placed.where(F.col("feature") == f).select(F.col("value").alias(f"_c_{f}"), F.col("s").alias(f + suffix))
        out = out.join(F.broadcast(mine) if sizes.get(f, 0) <= BROADCAST_VALUES else mine, f"_c_{f}", "left")
    return out.drop(*[f"_c_{f}" for f in features])
