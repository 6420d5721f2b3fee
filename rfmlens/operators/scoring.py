"""Quintile scores and value tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rfmlens import dims
from rfmlens.operators.ranks import exact_quantiles, feature_ranks, grouped_quantiles

QUINTILE_POINTS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
# feature -> (score column, higher value means higher score?)
SCORE_SPEC = [("Recency", "R_Score", False), ("Frequency", "F_Score", True),
              ("Monetary", "M_Score", True)]


def quintile_edges(df: DataFrame, col: str, buckets: int | None = None) -> list[float] | None:
    """The six edges (0, 20, ..., 100 %) of ``col``, linear interpolation, exact.
    None when two edges coincide: equal-count bins with five labels do not
    exist then, and the score is left NULL instead of failing (Q8)."""
    edges, n = exact_quantiles(df, col, QUINTILE_POINTS, buckets)
    if n == 0 or len(set(edges)) < len(edges):
        return None
    return edges


def quintile_edges_all(df: DataFrame, cols: list[str], buckets: int | None = None, ranks=None) -> dict:
    """``quintile_edges`` of several columns from one ranked pass (or from
    ``ranks``, a ``feature_ranks`` table of these columns)."""
    own = ranks is None
    r = feature_ranks(df, cols, buckets) if own else ranks
    q = grouped_quantiles(r, QUINTILE_POINTS)
    if own:
        r.release()
    out = {}
    for c in cols:
        e = q.get(c)
        out[c] = None if e is None or len(set(e)) < len(e) else e
    return out


def quintile_report(df: DataFrame, cols: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Q8: the six quintile edges of each feature and whether scores exist
    (edges distinct). Coinciding edges leave that score NULL instead of
    stopping the run; this table says which."""
    cols = cols or [f for f, _, _ in SCORE_SPEC]
    q = grouped_quantiles(feature_ranks(df, cols, buckets), QUINTILE_POINTS)
    rows = []
    for c in cols:
        e = q.get(c) or [None] * 6
        rows.append((c, *[None if v is None else float(v) for v in e],
                     e[0] is not None and len(set(e)) == len(e)))
    return df.sparkSession.createDataFrame(
        rows, "feature STRING, e0 DOUBLE, e20 DOUBLE, e40 DOUBLE, e60 DOUBLE, e80 DOUBLE, e100 DOUBLE, "
              "scored BOOLEAN")


def quintile_score(col: str, edges: list[float] | None, ascending: bool = True) -> Column:
    """Bin 1..5 with right-closed bins and the lowest edge included, i.e.
    1 + number of inner edges strictly below the value; reversed when a lower
    value is better (Recency). Plain comparisons with literal edges."""
    if edges is None:
        return F.lit(None).cast("int")
    above = sum((F.col(col) > F.lit(e)).cast("int") for e in edges[1:5])
    s = F.lit(1) + above
    return (s if ascending else F.lit(6) - s).cast("int")


def tier(total) -> Column:
    """>= 12 High Value, >= 7 Mid Value, else Low Value."""
    t = F.col(total) if isinstance(total, str) else total
    return (F.when(t.isNull(), F.lit(None).cast("string"))
            .when(t >= dims.TIER_HIGH, F.lit("High Value"))
            .when(t >= dims.TIER_MID, F.lit("Mid Value"))
            .otherwise(F.lit("Low Value")))


def add_rfm_scores(rfm: DataFrame, buckets: int | None = None,
                   edges: dict[str, list[float] | None] | None = None, ranks=None) -> DataFrame:
    """R/F/M quintile scores, RFM_Total and RFM_Tier.

    The edges are exact order statistics computed with distributed ranks (two
    small driver reads per feature); the scoring itself is a projection.
    """
    if edges is None:
        edges = quintile_edges_all(rfm, [f for f, _, _ in SCORE_SPEC], buckets, ranks)
    out = rfm
    for f, name, asc in SCORE_SPEC:
        out = out.withColumn(name, quintile_score(f, edges[f], asc))
    total = (F.col("R_Score") + F.col("F_Score") + F.col("M_Score")).cast("int")
    return out.withColumn("RFM_Total", total).withColumn("RFM_Tier", tier("RFM_Total"))


def tier_summary(scored: DataFrame) -> DataFrame:
    """The flagship question: customers, revenue and mean RFM_Total per value
    tier. Money is rounded to cents per customer and summed as DECIMAL so the
    total does not depend on the order of additions."""
    return (scored.groupBy("RFM_Tier")
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.sum(F.round("Monetary", 2).cast("decimal(18,2)")).alias("revenue"),
                 F.round(F.avg("RFM_Total"), 4).alias("avg_rfm_total")))
