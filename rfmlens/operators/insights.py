"""Segment analytics (G1-G17): the tables behind each dashboard chart.

Every aggregate is a partial + final hash aggregate over customers; anything
that then looks across segments (shares, running totals, min-max scaling)
works on the <= 8-row aggregate, never on the customer rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from rfmlens import dims
from rfmlens.functions import bround, cents_mean, day_text, format_currency, percent_text, safe_ratio
from rfmlens.operators.quality import SILHOUETTE, squared_limit
from rfmlens.operators.ranks import exact_quantiles_by
from rfmlens.session import small_side



def _all():
    """Window over a whole (tiny, per-segment) table."""
    return Window.partitionBy()


def overview_stats(scored: DataFrame) -> DataFrame:
    """G1: by (Segment, SegmentColor): Customers, Revenue, Avg_R/F/M,
    revenue order."""
    return (scored.groupBy("Segment", "SegmentColor")
            .agg(F.count(F.lit(1)).alias("Customers"), F.sum("Monetary").alias("Revenue"),
                 F.avg("Recency").alias("Avg_R"), F.avg("Frequency").alias("Avg_F"),
                 F.avg("Monetary").alias("Avg_M"))
            .orderBy(F.desc("Revenue"), "Segment"))


def champions_share(scored: DataFrame, name: str = "Champions") -> DataFrame:
    """Share (%) of revenue from the Champions and their count; 0 when the
    segment is absent, NULL share when there is no revenue at all."""
    is_c = F.col("Segment") == name
    return scored.agg(
        F.coalesce(safe_ratio(F.sum(F.when(is_c, F.col("Monetary")).otherwise(0.0)) * 100,
                              F.sum("Monetary")), F.lit(0.0)).alias("champions_share_pct"),
        F.count_if(is_c).alias("champions"))


def headcount(scored: DataFrame) -> DataFrame:
    """Customers per (Segment, SegmentColor)."""
    return scored.groupBy("Segment", "SegmentColor").agg(F.count(F.lit(1)).alias("Count"))


def segment_stats(scored: DataFrame, median: bool = True) -> DataFrame:
    """Customers, Total/Avg/Median revenue, Avg recency and frequency,
    revenue share (%) and CLV score per segment, by total revenue.

    Medians are exact, from distributed per-segment ranks (a segment may hold
    a third of all customers, so no single aggregator keeps its values).
    """
    base = (scored.groupBy("Segment", "SegmentColor")
            .agg(F.count(F.lit(1)).alias("Customers"), F.sum("Monetary").alias("Total_Rev"),
                 F.avg("Monetary").alias("Avg_Rev"), F.avg("Recency").alias("Avg_Rec"),
                 F.avg("Frequency").alias("Avg_Frq")))
    if median:
        meds = exact_quantiles_by(scored, "Monetary", "Segment", [0.5])
        spark = scored.sparkSession
        mdf = spark.createDataFrame([(k, float(v[0])) for k, v in meds.items()],
                                    "Segment STRING, Med_Rev DOUBLE")
        base = base.join(small_side(mdf), "Segment", "left")
    total = F.sum("Total_Rev").over(_all())
    return (base.withColumn("Rev_Share", bround(safe_ratio(F.col("Total_Rev"), total) * 100, 1))
            .withColumn("CLV_Score", bround(F.col("Avg_Rev") * F.col("Avg_Frq") / (F.col("Avg_Rec") + 1), 1))
            .orderBy(F.desc("Total_Rev"), "Segment"))


def pareto(scored: DataFrame) -> DataFrame:
    """Segments by revenue (desc) with share and running share (%)."""
    seg = scored.groupBy("Segment").agg(F.sum("Monetary").alias("Total_Rev"))
    order = Window.orderBy(F.desc("Total_Rev"), "Segment")
    run = F.sum("Total_Rev").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("Total_Rev").over(_all())
    return (seg.withColumn("Rev_Share", bround(safe_ratio(F.col("Total_Rev"), total) * 100, 1))
            .withColumn("Cum_Share", bround(safe_ratio(run, total) * 100, 1))
            .withColumn("position", F.row_number().over(order)))


def centroid_heatmap(scored: DataFrame) -> DataFrame:
    """Segment means min-max scaled across segments (+1e-9), Recency
    inverted, rounded to 2."""
    m = scored.groupBy("Segment").agg(*[F.avg(c).alias(c) for c in ("Recency", "Frequency", "Monetary")])
    out = m
    for c in ("Recency", "Frequency", "Monetary"):
        lo, hi = F.min(c).over(_all()), F.max(c).over(_all())
        out = out.withColumn(c, (F.col(c) - lo) / (hi - lo + dims.NORM_EPS))
    out = out.withColumn("Recency", 1 - F.col("Recency"))
    return out.select("Segment", *[bround(c, 2).alias(c) for c in ("Recency", "Frequency", "Monetary")])


def radar_profile(scored: DataFrame) -> DataFrame:
    """Customers min-max scaled over all customers (range 1 when flat),
    Recency inverted, then averaged per segment. Global min/max is a one-row
    aggregate read back as scalar subqueries."""
    feats = ("Recency", "Frequency", "Monetary")
    mm = scored.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in feats],
                             *[F.max(c).alias(f"hi_{c}") for c in feats])).scalar()
    cols = []
    for c in feats:
        lo, hi = mm[f"lo_{c}"], mm[f"hi_{c}"]
        den = F.when(hi != lo, hi - lo).otherwise(F.lit(1))
        v = (F.col(c) - lo) / den
        cols.append((1 - v if c == "Recency" else v).alias(c))
    norm = scored.select("Segment", *cols)
    return norm.groupBy("Segment").agg(F.avg("Recency").alias("Recency_Score"),
                                       F.avg("Frequency").alias("Frequency_Score"),
                                       F.avg("Monetary").alias("Revenue_Score"))


def cluster_quality(scored: DataFrame, silhouette_col: str | None = SILHOUETTE) -> DataFrame:
    """By (Cluster, Segment): N, share of customers (%), Avg R/F/M,
    Avg RFM_Total and mean silhouette, rounded to 2 (half-even), by Avg_M."""
    aggs = [F.count(F.lit(1)).alias("N"), F.avg("Recency").alias("Avg_R"),
            F.avg("Frequency").alias("Avg_F"), cents_mean("Monetary").alias("Avg_M"),
            F.avg("RFM_Total").alias("Avg_RFM")]
    if silhouette_col:
        aggs.append(F.avg(silhouette_col).alias("Sil_Score"))
    g = scored.groupBy("Cluster", "Segment").agg(*aggs)
    g = g.withColumn("Pct", F.col("N") * 100.0 / F.sum("N").over(_all()))
    rounded = [bround(c, 2).alias(c) for c in ("Avg_R", "Avg_F", "Avg_M", "Avg_RFM")]
    if silhouette_col:
        rounded.append(bround("Sil_Score", 2).alias("Sil_Score"))
    return g.select("Cluster", "Segment", "N", bround("Pct", 2).alias("Pct"), *rounded) \
        .orderBy(F.desc("Avg_M"), "Cluster")


def cluster_warnings(quality: DataFrame, low: float = squared_limit(dims.LOW_SIL)) -> DataFrame:
    """Clusters under 3 % of customers and clusters whose mean silhouette
    is under ``low``, one row per warning. ``low`` is a limit on the form of the silhouette that the
    quality table holds: ``dims.LOW_SIL`` for the Euclidean one. The share is compared as counts (not as the rounded
    percentage, which hides 2.996 %)."""
    share = F.col("N") * 100.0 / F.sum("N").over(_all())
    small = quality.withColumn("share", share).where(F.col("share") < dims.SMALL_CLUSTER_PCT).select(
        "Cluster", "Segment", F.lit("small_cluster").alias("warning"), F.col("Pct").cast("double").alias("value"))
    bad = quality.where(F.col("Sil_Score") < low).select(
        "Cluster", "Segment", F.lit("low_silhouette").alias("warning"), F.col("Sil_Score").cast("double").alias("value"))
    return small.unionByName(bad)


def box_stats(scored: DataFrame, feature: str) -> DataFrame:
    """Per segment q1, median, q3, 1.5*IQR fences and the number of
    customers outside them (the numbers behind a box/violin plot). Quartiles
    are exact distributed order statistics; the outlier count is one more
    aggregate after a broadcast join of <= 8 rows."""
    q = exact_quantiles_by(scored, feature, "Segment", [0.25, 0.5, 0.75])
    spark = scored.sparkSession
    rows = [(g, float(v[0]), float(v[1]), float(v[2])) for g, v in q.items()]
    qdf = (spark.createDataFrame(rows, "Segment STRING, q1 DOUBLE, median DOUBLE, q3 DOUBLE")
           .withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
           .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    j = scored.select("Segment", F.col(feature).cast("double").alias("x")).join(small_side(qdf), "Segment")
    out = j.groupBy("Segment").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("lower_fence").alias("lower_fence"), F.first("upper_fence").alias("upper_fence"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        F.count_if((F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))).alias("outliers"))
    return out.withColumn("feature", F.lit(feature))


def density_curve(scored: DataFrame, feature: str, bins: int = 64) -> DataFrame:
    """The outline of a violin: per segment a Gaussian kernel density at the middles of ``bins`` bins
    from its least to its greatest value. One aggregate by (segment, bin); the bandwidth, 1.06 * deviation * n^(-1/5), comes from the
    segment's moments; the bins' counts (``bins`` numbers a segment) are then convolved. A segment of one value
    has one row without a density."""
    rng = scored.groupBy("Segment").agg(
        F.min(F.col(feature).cast("double")).alias("lo"), F.max(F.col(feature).cast("double")).alias("hi"),
        F.count(feature).alias("n"), F.stddev_samp(F.col(feature).cast("double")).alias("sd")).where("n > 0")
    rng = rng.withColumn("h", F.when(F.col("hi") > F.col("lo"), 1.06 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))))
    x = F.col(feature).cast("double")
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counts = (scored.where(F.col(feature).isNotNull()).join(F.broadcast(rng.select("Segment", "lo", "hi")), "Segment")
              .groupBy("Segment", at.cast("int").alias("at")).agg(F.count(F.lit(1)).alias("c")))
    held = counts.groupBy("Segment").agg(F.sort_array(F.collect_list(F.struct("at", "c"))).alias("held"))
    step = (F.col("hi") - F.col("lo")) / bins
    rows = (held.join(rng, "Segment").withColumn("step", step)
            .withColumn("bin", F.explode(F.when(F.col("h").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1))))))
    total = F.aggregate("held", F.lit(0.0), lambda a, v: a + v["c"] * F.exp(-0.5 * F.pow((F.col("bin") - v["at"]) * F.col("step") / F.col("h"), F.lit(2.0))))
    return rows.select("Segment", F.lit(feature).alias("feature"), "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).alias("x"),
                       (total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"), (F.col("hi") - F.col("lo")).alias("width"))


def color_map(scored: DataFrame) -> DataFrame:
    """Segment -> SegmentColor."""
    return scored.select("Segment", "SegmentColor").distinct()


def summary_text(stats: DataFrame, symbol: str = "$") -> DataFrame:
    """The segment summary as display text (H1, H5)."""
    return stats.select(
        "Segment", "Customers",
        format_currency("Total_Rev", symbol).alias("Total"),
        format_currency("Avg_Rev", symbol).alias("Avg_Rev"),
        format_currency("Med_Rev", symbol).alias("Median"),
        day_text("Avg_Rec").alias("Avg_Recency"),
        bround("Avg_Frq", 2).alias("Avg_Freq"),
        percent_text("Rev_Share").alias("Rev_Pct"),
        F.format_string("%.1f", F.col("CLV_Score")).alias("CLV"))


def composition(scored: DataFrame) -> DataFrame:
    """Customers and revenue per segment with their shares (%)."""
    g = scored.groupBy("Segment", "SegmentColor").agg(F.count(F.lit(1)).alias("Customers"),
                                                     F.sum("Monetary").alias("Revenue"))
    return (g.withColumn("Customer_Share", F.col("Customers") * 100.0 / F.sum("Customers").over(_all()))
            .withColumn("Revenue_Share", safe_ratio(F.col("Revenue") * 100.0, F.sum("Revenue").over(_all()))))


def segment_strip(scored: DataFrame, symbol: str = "$") -> DataFrame:
    """Per segment emoji, colour and rounded means as display text
    (the emoji is carried through the grouping, Q15)."""
    g = (scored.groupBy("Segment", "SegmentColor")
         .agg(F.first("SegmentEmoji").alias("SegmentEmoji"), F.avg("Recency").alias("Avg_R"),
              F.avg("Frequency").alias("Avg_F"), F.avg("Monetary").alias("Avg_M"),
              F.sum("Monetary").alias("Revenue")))
    return g.select("Segment", "SegmentColor", "SegmentEmoji",
                    day_text("Avg_R").alias("R_text"),
                    F.format_string("%.1f", bround("Avg_F", 1)).alias("F_text"),
                    format_currency("Avg_M", symbol).alias("M_text"), "Revenue") \
        .orderBy(F.desc("Revenue"), "Segment")
