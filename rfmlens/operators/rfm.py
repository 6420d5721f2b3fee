"""RFM aggregation and descriptive statistics."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Observation, functions as F

from rfmlens.functions import bround, days_between, ntz_literal, sample_skewness
from rfmlens.session import checkpoint_dir

FEATURES = ["Recency", "Frequency", "Monetary"]
# money is added as decimals: a sum does not depend on the order of additions
MONEY = "decimal(38,6)"


def _snapshot_literal(snapshot) -> Column:
    if isinstance(snapshot, Column):
        return snapshot
    if isinstance(snapshot, str):
        return F.lit(snapshot).cast("timestamp_ntz")
    if isinstance(snapshot, (_dt.datetime, _dt.date)):
        return ntz_literal(snapshot)
    raise TypeError(f"unsupported snapshot {snapshot!r}")


def snapshot_date(df: DataFrame, date_col: str = "invoice_date") -> DataFrame:
    """A1: one-row table with the snapshot = last purchase + 1 day."""
    return df.agg((F.max(date_col) + F.expr("INTERVAL 1 DAY")).alias("snapshot_date"))


def compute_rfm(df: DataFrame, snapshot=None, keep_last: bool = False,
                materialize: bool = True, return_snapshot: bool = False):
    """One row per customer with Recency, Frequency, Monetary.

    A single ``groupBy(customer_id)``: the distinct invoice count is planned
    with a first exchange on (customer, invoice), so a customer holding a third
    of all lines is still spread over many tasks before its final merge.

    The default snapshot (last purchase + 1 day) needs the global maximum
    of the per-customer maxima. With ``materialize`` the per-customer table
    is checkpointed to the shared checkpoint folder (it is far smaller than
    the line items), the maximum is read from it and the lineage back to the
    line items is cut; otherwise the snapshot is a scalar subquery, which
    costs a second pass over the line items. ``return_snapshot`` returns
    (rfm, snapshot) with the snapshot as a Python value when it is known.
    """
    per_customer = (df.groupBy("customer_id")
                    .agg(F.max("invoice_date").alias("last_purchase"),
                         F.countDistinct("invoice_id").alias("Frequency"),
                         F.sum(F.col("line_total").try_cast(MONEY)).cast("double").alias("Monetary")))
    snap_value = snapshot
    if snapshot is not None:
        snap = _snapshot_literal(snapshot)
    elif materialize:
        checkpoint_dir(df.sparkSession)
        # the maximum is observed while the checkpoint is written: no extra scan
        obs = Observation()
        per_customer = per_customer.observe(obs, F.max("last_purchase").alias("m")).checkpoint(eager=True)
        seen = obs.get or {}
        last = seen["m"] if "m" in seen else per_customer.agg(F.max("last_purchase")).first()[0]
        snap = ntz_literal(last) + F.expr("INTERVAL 1 DAY")
        snap_value = None if last is None else last + _dt.timedelta(days=1)
    else:
        snap = per_customer.agg(F.max("last_purchase") + F.expr("INTERVAL 1 DAY")).scalar()
    rfm = per_customer.select(
        "customer_id",
        F.greatest(days_between("last_purchase", snap), F.lit(0)).cast("long").alias("Recency"),
        F.col("Frequency").cast("long").alias("Frequency"),
        F.col("Monetary").cast("double").alias("Monetary"),
        *(["last_purchase"] if keep_last else []))
    rfm = rfm.where((F.col("Recency") >= 0) & (F.col("Frequency") > 0) & (F.col("Monetary") > 0))
    return (rfm, snap_value) if return_snapshot else rfm


def describe_features(rfm: DataFrame, features=FEATURES) -> DataFrame:
    """Mean, sample std, min, max and bias-corrected skewness per
    feature, long form (one row per feature), from a single aggregate pass."""
    aggs = []
    for f in features:
        aggs += [F.mean(f).alias(f"{f}__mean"), F.stddev_samp(f).alias(f"{f}__std"),
                 F.min(f).cast("double").alias(f"{f}__min"), F.max(f).cast("double").alias(f"{f}__max"),
                 sample_skewness(f).alias(f"{f}__skew")]
    wide = rfm.agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}__mean`, `{f}__std`, `{f}__min`, `{f}__max`, `{f}__skew`"
                      for f in features)
    return wide.selectExpr(f"stack({len(features)}, {stack}) AS (feature, mean, std, min, max, skewness)")


def correlation_matrix(rfm: DataFrame, features=FEATURES, digits: int = 2) -> DataFrame:
    """Pearson correlations of every feature pair in one pass, long form,
    rounded half-even."""
    aggs = [F.corr(a, b).alias(f"{a}__{b}") for a in features for b in features]
    wide = rfm.agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a in features for b in features)
    return (wide.selectExpr(f"stack({len(features) ** 2}, {stack}) AS (row_feature, col_feature, corr)")
            .withColumn("corr", bround("corr", digits)))


def global_kpis(scored: DataFrame, buckets: int | None = None, ranks=None) -> DataFrame:
    """A10: headline numbers over the scored customers. Medians are exact
    order statistics from distributed ranks (one ranked pass for both
    columns); the rest is one aggregate pass."""
    from rfmlens.operators.ranks import feature_ranks, grouped_quantiles
    r = ranks if ranks is not None else feature_ranks(scored, ["Monetary", "Recency"], buckets)
    med = grouped_quantiles(r, [0.5])
    return scored.agg(
        F.count(F.lit(1)).alias("customers"),
        F.countDistinct("Segment").alias("segments"),
        F.sum("Monetary").alias("total_revenue"),
        F.mean("Monetary").alias("avg_revenue"),
        F.lit(med.get("Monetary", [None])[0]).cast("double").alias("median_revenue"),
        F.mean("Recency").alias("avg_recency"),
        F.lit(med.get("Recency", [None])[0]).cast("double").alias("median_recency"),
    )


def score_means(scored: DataFrame) -> DataFrame:
    """Mean R/F/M score."""
    return scored.agg(F.mean("R_Score").alias("avg_r_score"),
                      F.mean("F_Score").alias("avg_f_score"),
                      F.mean("M_Score").alias("avg_m_score"))
