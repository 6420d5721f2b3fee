"""Segment naming (W1-W3) and lookup joins to dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rfmlens import dims
from rfmlens.functions import format_currency
from rfmlens.session import small_side


def cluster_means(df: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """Mean R/F/M per cluster: at most k rows (k <= 8)."""
    return df.groupBy(cluster_col).agg(F.mean("Recency").alias("mean_R"),
                                       F.mean("Frequency").alias("mean_F"),
                                       F.mean("Monetary").alias("mean_M"))


def _avg_rank(col: str):
    """Average rank of ties (1-based), over the tiny cluster table."""
    w = Window.orderBy(col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(col)) - 1) / 2.0


def assign_segment_labels(df: DataFrame, n_clusters: int,
                          cluster_col: str = "Cluster") -> DataFrame:
    """Cluster -> segment template.

    Score = -rank(mean R) + rank(mean F) + rank(mean M); clusters in score
    order (ties by cluster id, Q9) take the first ``n_clusters`` templates in
    turn. Windows here run over <= 8 rows after the per-cluster aggregate.
    """
    spark = df.sparkSession
    means = cluster_means(df, cluster_col)
    scored = (means.withColumn("Score", -_avg_rank("mean_R") + _avg_rank("mean_F") + _avg_rank("mean_M"))
              .withColumn("order_pos", F.row_number().over(
                  Window.orderBy(F.desc("Score"), F.asc(cluster_col))) - 1))
    n_templates = max(1, min(int(n_clusters), len(dims.SEGMENTS)))
    templates = dims.segment_templates_df(spark).where(F.col("rank_pos") < n_templates)
    return (scored.withColumn("rank_pos", F.pmod("order_pos", F.lit(n_templates)))
            .join(small_side(templates), "rank_pos")
            .select(F.col(cluster_col).cast("int").alias("Cluster"), "Score", "order_pos",
                    "Segment", "SegmentEmoji", "SegmentColor", "Description", "Action"))


def apply_labels(df: DataFrame, cluster_map: DataFrame, cluster_col: str = "Cluster") -> DataFrame:
    """Attach Segment, SegmentEmoji, SegmentColor by a broadcast join
    on a <= 8-row map; a cluster without a mapping gets the default record."""
    m = cluster_map.select(F.col("Cluster").alias("_cl"), F.col("Segment").alias("_seg"),
                           F.col("SegmentEmoji").alias("_emo"), F.col("SegmentColor").alias("_col"))
    out = df.join(small_side(m), F.col(cluster_col) == F.col("_cl"), "left")
    return (out.withColumn("Segment", F.coalesce("_seg", F.concat(F.lit(dims.UNKNOWN_SEGMENT_PREFIX),
                                                                   F.col(cluster_col).cast("string"))))
            .withColumn("SegmentEmoji", F.coalesce("_emo", F.lit(dims.UNKNOWN_SEGMENT_EMOJI)))
            .withColumn("SegmentColor", F.coalesce("_col", F.lit(dims.UNKNOWN_SEGMENT_COLOR)))
            .drop("_cl", "_seg", "_emo", "_col"))


def interpret_clusters(clusters: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """J2 as a table: every cluster id with its record, defaults filled."""
    ids = clusters.select(F.col("Cluster").cast("int").alias("Cluster")).distinct()
    m = cluster_map.select("Cluster", "Segment", "SegmentEmoji", "SegmentColor", "Description", "Action")
    out = ids.join(small_side(m), "Cluster", "left")
    return out.select(
        "Cluster",
        F.coalesce("Segment", F.concat(F.lit(dims.UNKNOWN_SEGMENT_PREFIX), F.col("Cluster").cast("string"))).alias("Segment"),
        F.coalesce("SegmentEmoji", F.lit(dims.UNKNOWN_SEGMENT_EMOJI)).alias("SegmentEmoji"),
        F.coalesce("SegmentColor", F.lit(dims.UNKNOWN_SEGMENT_COLOR)).alias("SegmentColor"),
        F.coalesce("Description", F.lit(dims.UNKNOWN_SEGMENT_TEXT[0])).alias("Description"),
        F.coalesce("Action", F.lit(dims.UNKNOWN_SEGMENT_TEXT[1])).alias("Action"))


def action_cards(scored: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """One card per mapped segment that is present in the data, with its
    description, action and total revenue, ordered by revenue (desc)."""
    rev = scored.groupBy("Segment").agg(F.sum("Monetary").alias("Total_Rev"))
    cards = (cluster_map.select("Segment", "SegmentEmoji", "SegmentColor", "Description", "Action")
             .join(rev, "Segment", "inner"))
    return cards.orderBy(F.desc("Total_Rev"), "Segment")


def quick_wins(scored: DataFrame) -> DataFrame:
    """The four fixed quick-win alerts with the number of customers now in
    each segment (0 when absent)."""
    counts = scored.groupBy("Segment").agg(F.count(F.lit(1)).alias("Customers"))
    alerts = dims.quick_wins_df(scored.sparkSession)
    return (alerts.join(counts, "Segment", "left")
            .withColumn("Customers", F.coalesce("Customers", F.lit(0)).cast("long")))


def with_currency(df: DataFrame, code: str | None, value_col: str = "Monetary",
                  out_col: str = "Monetary_text") -> DataFrame:
    """J5 + H1: resolve a currency code (unknown -> USD) and format a column."""
    c, symbol, _ = dims.currency_record(code)
    return df.withColumn(out_col, format_currency(value_col, symbol)).withColumn("currency_code", F.lit(c))


def convert_currency(df: DataFrame, rates: DataFrame, base: str, target: str,
                     value_col: str = "Monetary") -> DataFrame:
    """H2/H3: multiply money by the base->target rate from a rates table
    (broadcast: one matching row at most). A missing rate leaves values as they
    are and ``rate`` NULL; identity when base == target."""
    if base.upper() == target.upper():
        return df.withColumn("rate", F.lit(1.0))
    rate = (rates.where((F.upper("base") == base.upper()) & (F.upper("target") == target.upper()))
            .agg(F.max("rate")).scalar())
    return (df.withColumn("rate", rate)
            .withColumn(value_col, F.when(F.col("rate").isNotNull(), F.col(value_col) * F.col("rate"))
                        .otherwise(F.col(value_col))))
