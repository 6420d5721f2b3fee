"""Registered queries: one per operator group of the survey, each reading the
supplied tables (or tables Spark derives from them), with a DuckDB oracle
where the operator is expressible in SQL.

Money and means are rounded at the output (half-up, 2-8 places) in both the
Spark query and the oracle, because the two engines add doubles in different
orders; the rounding places are chosen where exact halves cannot occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rfmlens import dims
from rfmlens.operators import insights as G
from rfmlens.operators import lookup as L
from rfmlens.operators import quality as Q
from rfmlens.operators import silhouette as SL
from rfmlens.operators.clean import clean_transactions
from rfmlens.operators.labels import action_cards, convert_currency, interpret_clusters, quick_wins
from rfmlens.operators.neighbors import nearest_neighbors
from rfmlens.operators.rfm import compute_rfm, correlation_matrix, describe_features, global_kpis, score_means, snapshot_date
from rfmlens.operators.scoring import tier_summary
from rfmlens.operators.transform import cap_report
from rfmlens.plans import base as B
from rfmlens.plans import sql as S
from rfmlens.sources.readers import preview, read_table, source_profile, txn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r(c, d):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def _money_sql(x: str, sym: str = "$") -> str:
    return (f"'{sym}' || CASE WHEN {x} IS NULL THEN '0' WHEN isnan({x}) THEN 'nan' "
            f"WHEN abs({x}) >= 1000000 THEN format('{{:,.2f}}', {x} / 1000000) || 'M' "
            f"WHEN abs({x}) >= 1000 THEN format('{{:,.1f}}', {x} / 1000) || 'K' "
            f"ELSE format('{{:,.0f}}', {x}) END")


# --------------------------------------------------------------- flagship
@query("rfm_tier_summary", S.with_ctes(*S.BASE, body="""
SELECT RFM_Tier, count(*) AS customers,
       CAST(sum(CAST(round(Monetary, 2) AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS revenue,
       round(avg(RFM_Total), 4) AS avg_rfm_total
FROM scores GROUP BY RFM_Tier"""))
def q_tier_summary(spark, sf):
    return tier_summary(B.scores(spark, sf))


# --------------------------------------------------------------- sources (S)
@query("source_profile", S.with_ctes(S.TXN, body="""
SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, count(DISTINCT customer_id) AS n_customers FROM txn"""))
def q_source_profile(spark, sf):
    return source_profile(txn(spark, sf))


@query("preview_lines", S.with_ctes(S.TXN, body="""
SELECT customer_id, invoice_id, invoice_date, quantity, round(unit_price, 6) AS unit_price FROM txn
ORDER BY invoice_id, customer_id, quantity, unit_price LIMIT 8"""))
def q_preview(spark, sf):
    return preview(txn(spark, sf), 8, ["invoice_id", "customer_id", "quantity", "unit_price"]) \
        .withColumn("unit_price", r("unit_price", 6))


# --------------------------------------------------------------- cleaning (P, C)
def _clean_events(spark, sf):
    return clean_transactions(read_table(spark, sf, "events"))


@query("clean_events_lines", """
SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(user_id AS VARCHAR) || '_20230601' AS invoice_id,
       TIMESTAMP '2023-06-01 00:00:00' AS invoice_date, 1.0::DOUBLE AS quantity,
       CAST(value AS DOUBLE) AS unit_price, 1.0::DOUBLE * value AS line_total,
       event_id, ts, event_type, props
FROM events WHERE value > 0""")
def q_clean_events(spark, sf):
    return _clean_events(spark, sf)[0]


@query("clean_report_events", """
SELECT * FROM (
  SELECT 'rows' AS section, 'original_rows' AS key, count(*) AS value, NULL::VARCHAR AS detail FROM events
  UNION ALL SELECT 'rows', 'clean_rows', count_if(value > 0), NULL FROM events
  UNION ALL SELECT 'imputed', 'customer_id', count_if(user_id IS NULL), NULL FROM events HAVING count_if(user_id IS NULL) > 0
  UNION ALL SELECT 'imputed', 'invoice_id', count(*), NULL FROM events
  UNION ALL SELECT 'imputed', 'invoice_date', count(*), NULL FROM events
  UNION ALL SELECT 'imputed', 'quantity', count(*), NULL FROM events
  UNION ALL SELECT 'imputed', 'unit_price', count_if(value IS NULL OR isnan(value)), NULL FROM events
            HAVING count_if(value IS NULL OR isnan(value)) > 0
  UNION ALL SELECT 'dropped', 'zero_price', count_if(value <= 0), NULL FROM events HAVING count_if(value <= 0) > 0
  UNION ALL SELECT 'inferred', 'customer_id', NULL, 'user_id'
  UNION ALL SELECT 'inferred', 'unit_price', NULL, 'value')""")
def q_clean_report_events(spark, sf):
    return _clean_events(spark, sf)[1]


@query("clean_report_lineitem", """
SELECT * FROM (
  SELECT 'rows' AS section, 'original_rows' AS key, count(*) AS value, NULL::VARCHAR AS detail FROM lineitem
  UNION ALL SELECT 'rows', 'clean_rows', count_if(l_quantity > 0 AND l_extendedprice > 0), NULL FROM lineitem
  UNION ALL SELECT 'imputed', 'customer_id', count(*), NULL FROM lineitem
  UNION ALL SELECT 'dropped', 'negative_quantity', count_if(l_quantity <= 0), NULL FROM lineitem HAVING count_if(l_quantity <= 0) > 0
  UNION ALL SELECT 'dropped', 'zero_price', count_if(l_quantity > 0 AND l_extendedprice <= 0), NULL FROM lineitem
            HAVING count_if(l_quantity > 0 AND l_extendedprice <= 0) > 0
  UNION ALL SELECT 'inferred', 'invoice_id', NULL, 'l_orderkey'
  UNION ALL SELECT 'inferred', 'invoice_date', NULL, 'l_shipdate'
  UNION ALL SELECT 'inferred', 'quantity', NULL, 'l_quantity'
  UNION ALL SELECT 'inferred', 'unit_price', NULL, 'l_extendedprice')""")
def q_clean_report_lineitem(spark, sf):
    return clean_transactions(read_table(spark, sf, "lineitem"))[1]


@query("clean_report_orders", """
SELECT * FROM (
  SELECT 'rows' AS section, 'original_rows' AS key, count(*) AS value, NULL::VARCHAR AS detail FROM orders
  UNION ALL SELECT 'rows', 'clean_rows', count_if(o_totalprice > 0), NULL FROM orders
  UNION ALL SELECT 'imputed', 'customer_id', count(*), NULL FROM orders
  UNION ALL SELECT 'imputed', 'quantity', count(*), NULL FROM orders
  UNION ALL SELECT 'dropped', 'zero_price', count_if(o_totalprice <= 0), NULL FROM orders HAVING count_if(o_totalprice <= 0) > 0
  UNION ALL SELECT 'inferred', 'invoice_id', NULL, 'o_orderkey'
  UNION ALL SELECT 'inferred', 'invoice_date', NULL, 'o_orderdate'
  UNION ALL SELECT 'inferred', 'unit_price', NULL, 'o_totalprice')""")
def q_clean_report_orders(spark, sf):
    return clean_transactions(read_table(spark, sf, "orders"))[1]


@query("clean_text_rfm", S.with_ctes(S.TXN, S.RFM, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary FROM rfm"""))
def q_clean_text_rfm(spark, sf):
    # the line items as a CSV reader would hand them over: every column text
    text = txn(spark, sf).select([F.col(c).cast("string").alias(c) for c in
                                  ("customer_id", "invoice_id", "invoice_date", "quantity", "unit_price")])
    lines, _ = clean_transactions(text)
    return compute_rfm(lines).withColumn("Monetary", r("Monetary", 2))


# --------------------------------------------------------------- RFM (A)
@query("rfm_txn", S.with_ctes(S.TXN, S.RFM, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary FROM rfm"""))
def q_rfm(spark, sf):
    return B.rfm(spark, sf).withColumn("Monetary", r("Monetary", 2))


@query("rfm_events", S.with_ctes(S.TXN_EVENTS, S.RFM, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 4) AS Monetary FROM rfm"""))
def q_rfm_events(spark, sf):
    return B.rfm_events(spark, sf).withColumn("Monetary", r("Monetary", 4))


@query("snapshot_date", S.with_ctes(S.TXN, body="""
SELECT max(invoice_date) + INTERVAL 1 DAY AS snapshot_date FROM txn"""))
def q_snapshot(spark, sf):
    return snapshot_date(B.lines(spark, sf))


@query("describe_rfm", S.with_ctes(S.TXN, S.RFM, body="""
SELECT * FROM (
  SELECT 'Recency' AS feature, round(avg(Recency), 6) AS mean, round(stddev_samp(Recency), 6) AS std,
         CAST(min(Recency) AS DOUBLE) AS min, CAST(max(Recency) AS DOUBLE) AS max, round(skewness(Recency), 6) AS skewness FROM rfm
  UNION ALL SELECT 'Frequency', round(avg(Frequency), 6), round(stddev_samp(Frequency), 6),
         CAST(min(Frequency) AS DOUBLE), CAST(max(Frequency) AS DOUBLE), round(skewness(Frequency), 6) FROM rfm
  UNION ALL SELECT 'Monetary', round(avg(Monetary), 4), round(stddev_samp(Monetary), 4),
         round(min(Monetary), 4), round(max(Monetary), 4), round(skewness(Monetary), 6) FROM rfm)"""))
def q_describe(spark, sf):
    d = describe_features(B.rfm(spark, sf))
    money = F.col("feature") == "Monetary"
    out = d
    for c in ("mean", "std", "min", "max"):
        out = out.withColumn(c, F.when(money, r(c, 4)).otherwise(r(c, 6)))
    return out.withColumn("skewness", r("skewness", 6))


@query("correlation", S.with_ctes(S.TXN, S.RFM, body="""
SELECT a.f AS row_feature, b.f AS col_feature,
  CAST(round_even(CASE a.f || b.f
    WHEN 'RecencyRecency' THEN corr(Recency, Recency) WHEN 'RecencyFrequency' THEN corr(Recency, Frequency)
    WHEN 'RecencyMonetary' THEN corr(Recency, Monetary) WHEN 'FrequencyRecency' THEN corr(Frequency, Recency)
    WHEN 'FrequencyFrequency' THEN corr(Frequency, Frequency) WHEN 'FrequencyMonetary' THEN corr(Frequency, Monetary)
    WHEN 'MonetaryRecency' THEN corr(Monetary, Recency) WHEN 'MonetaryFrequency' THEN corr(Monetary, Frequency)
    ELSE corr(Monetary, Monetary) END, 2) AS DOUBLE) AS corr
FROM rfm, (VALUES ('Recency'), ('Frequency'), ('Monetary')) a(f), (VALUES ('Recency'), ('Frequency'), ('Monetary')) b(f)
GROUP BY a.f, b.f"""))
def q_corr(spark, sf):
    return correlation_matrix(B.rfm(spark, sf))


# --------------------------------------------------------------- scores & labels (W)
@query("rfm_scores", S.with_ctes(S.TXN, S.RFM, S.SCORES, body="""
SELECT customer_id, R_Score, F_Score, M_Score, RFM_Total, RFM_Tier FROM scores"""))
def q_scores(spark, sf):
    return B.scores(spark, sf).select("customer_id", "R_Score", "F_Score", "M_Score", "RFM_Total", "RFM_Tier")


@query("quintile_edges", S.with_ctes(S.TXN, S.RFM, S.SCORES, body="""
SELECT feature, round(e[1], 4) AS e0, round(e[2], 4) AS e20, round(e[3], 4) AS e40, round(e[4], 4) AS e60,
       round(e[5], 4) AS e80, round(e[6], 4) AS e100, len(list_distinct(e)) = 6 AS scored
FROM (SELECT 'Recency' AS feature, er AS e FROM edges UNION ALL SELECT 'Frequency', ef FROM edges
      UNION ALL SELECT 'Monetary', em FROM edges)"""))
def q_quintile_edges(spark, sf):
    from rfmlens.operators.scoring import quintile_report
    rep = quintile_report(B.rfm(spark, sf))
    return rep.select("feature", *[r(c, 4).alias(c) for c in ("e0", "e20", "e40", "e60", "e80", "e100")], "scored")


@query("score_means", S.with_ctes(S.TXN, S.RFM, S.SCORES, body="""
SELECT round(avg(R_Score), 6) AS avg_r_score, round(avg(F_Score), 6) AS avg_f_score,
       round(avg(M_Score), 6) AS avg_m_score FROM scores"""))
def q_score_means(spark, sf):
    return score_means(B.scores(spark, sf)).select(*[r(c, 6).alias(c) for c in ("avg_r_score", "avg_f_score", "avg_m_score")])


@query("segment_map", S.with_ctes(*S.BASE, body="""
SELECT Cluster, Score, order_pos, Segment, SegmentEmoji, SegmentColor FROM cmap"""))
def q_segment_map(spark, sf):
    return B.cluster_map(spark, sf).select("Cluster", "Score", F.col("order_pos").cast("bigint").alias("order_pos"),
                                          "Segment", "SegmentEmoji", "SegmentColor")


@query("scored_customers", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary, Cluster, R_Score, F_Score, M_Score,
       RFM_Total, RFM_Tier, Segment, SegmentEmoji, SegmentColor FROM scored"""))
def q_scored(spark, sf):
    return B.scored(spark, sf).withColumn("Monetary", r("Monetary", 2)) \
        .select("customer_id", "Recency", "Frequency", "Monetary", "Cluster", "R_Score", "F_Score", "M_Score",
                "RFM_Total", "RFM_Tier", "Segment", "SegmentEmoji", "SegmentColor")


@query("interpret_clusters", S.with_ctes(*S.BASE, body="""
SELECT Cluster, Segment, SegmentEmoji, SegmentColor FROM cmap"""))
def q_interpret(spark, sf):
    return interpret_clusters(B.scored(spark, sf), B.cluster_map(spark, sf)) \
        .select("Cluster", "Segment", "SegmentEmoji", "SegmentColor")


@query("global_kpis", S.with_ctes(*S.BASE, body="""
SELECT count(*) AS customers, count(DISTINCT Segment) AS segments, round(sum(Monetary), 2) AS total_revenue,
       round(avg(Monetary), 4) AS avg_revenue, round(median(Monetary), 4) AS median_revenue,
       round(avg(Recency), 4) AS avg_recency, round(median(Recency), 4) AS median_recency FROM scored"""))
def q_kpis(spark, sf):
    k = global_kpis(B.scored(spark, sf), ranks=B.ranks(spark, sf))
    return k.select("customers", "segments", r("total_revenue", 2).alias("total_revenue"),
                    r("avg_revenue", 4).alias("avg_revenue"), r("median_revenue", 4).alias("median_revenue"),
                    r("avg_recency", 4).alias("avg_recency"), r("median_recency", 4).alias("median_recency"))


# --------------------------------------------------------------- segment analytics (G)
CENTS_SQL = "cents AS (SELECT * REPLACE (round(Monetary, 2) AS Monetary) FROM scored)"

@query("overview_stats", S.with_ctes(*S.BASE, body="""
SELECT Segment, SegmentColor, count(*) AS Customers, round(sum(Monetary), 2) AS Revenue,
       round(avg(Recency), 6) AS Avg_R, round(avg(Frequency), 6) AS Avg_F, round(avg(Monetary), 4) AS Avg_M
FROM scored GROUP BY Segment, SegmentColor"""))
def q_overview(spark, sf):
    g = G.overview_stats(B.scored(spark, sf))
    return g.select("Segment", "SegmentColor", "Customers", r("Revenue", 2).alias("Revenue"),
                    r("Avg_R", 6).alias("Avg_R"), r("Avg_F", 6).alias("Avg_F"), r("Avg_M", 4).alias("Avg_M"))


@query("champions_share", S.with_ctes(*S.BASE, body="""
SELECT round(coalesce(sum(CASE WHEN Segment = 'Champions' THEN Monetary ELSE 0 END) * 100 / nullif(sum(Monetary), 0), 0), 6)
       AS champions_share_pct, count_if(Segment = 'Champions') AS champions FROM scored"""))
def q_champions(spark, sf):
    g = G.champions_share(B.scored(spark, sf))
    return g.select(r("champions_share_pct", 6).alias("champions_share_pct"), "champions")


@query("overview_kpi_text", S.with_ctes(*S.BASE, body=f"""
SELECT format('{{:,}}', count(*)) AS customers_text, count(DISTINCT Segment) AS segments,
       {_money_sql('sum(Monetary)')} AS total_revenue_text, {_money_sql('avg(Monetary)')} AS avg_revenue_text,
       format('{{:.1f}}', round_even(100 * sum(CASE WHEN Segment = 'Champions' THEN Monetary ELSE 0 END)
                                     / sum(Monetary), 1)) || '%' AS champions_share_text
FROM scored"""))
def q_overview_kpi_text(spark, sf):
    """The overview's headline numbers as display text."""
    from rfmlens.functions import format_currency, percent_text
    sc = B.scored(spark, sf)
    k = sc.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Segment").alias("segments"),
               F.sum("Monetary").alias("tot"), F.avg("Monetary").alias("avg"),
               (F.sum(F.when(F.col("Segment") == "Champions", F.col("Monetary")).otherwise(0.0)) * 100
                / F.sum("Monetary")).alias("share"))
    return k.select(F.format_number("n", 0).alias("customers_text"), "segments",
                    format_currency("tot", "$").alias("total_revenue_text"),
                    format_currency("avg", "$").alias("avg_revenue_text"),
                    percent_text("share").alias("champions_share_text"))


@query("headcount", S.with_ctes(*S.BASE, body="""
SELECT Segment, SegmentColor, count(*) AS Count FROM scored GROUP BY Segment, SegmentColor"""))
def q_headcount(spark, sf):
    return G.headcount(B.scored(spark, sf))


SEG_STATS_SQL = """seg AS (
  SELECT Segment, SegmentColor, count(*) AS Customers, sum(Monetary) AS Total_Rev, avg(Monetary) AS Avg_Rev,
         avg(Recency) AS Avg_Rec, avg(Frequency) AS Avg_Frq, median(Monetary) AS Med_Rev
  FROM scored GROUP BY Segment, SegmentColor),
segx AS (SELECT *, CAST(round_even(Total_Rev / sum(Total_Rev) OVER () * 100, 1) AS DOUBLE) AS Rev_Share,
                CAST(round_even(Avg_Rev * Avg_Frq / (Avg_Rec + 1), 1) AS DOUBLE) AS CLV_Score FROM seg)"""


@query("segment_stats", S.with_ctes(*S.BASE, SEG_STATS_SQL, body="""
SELECT Segment, SegmentColor, Customers, round(Total_Rev, 2) AS Total_Rev, round(Avg_Rev, 4) AS Avg_Rev,
       round(Avg_Rec, 6) AS Avg_Rec, round(Avg_Frq, 6) AS Avg_Frq, round(Med_Rev, 4) AS Med_Rev,
       Rev_Share, CLV_Score FROM segx"""))
def q_segment_stats(spark, sf):
    g = G.segment_stats(B.scored(spark, sf))
    return g.select("Segment", "SegmentColor", "Customers", r("Total_Rev", 2).alias("Total_Rev"),
                    r("Avg_Rev", 4).alias("Avg_Rev"), r("Avg_Rec", 6).alias("Avg_Rec"),
                    r("Avg_Frq", 6).alias("Avg_Frq"), r("Med_Rev", 4).alias("Med_Rev"), "Rev_Share", "CLV_Score")


@query("segment_stats_converted", S.with_ctes(*S.BASE, SEG_STATS_SQL.replace("FROM scored GROUP BY",
                                                                          "FROM conv GROUP BY"),
                                              body="""
SELECT Segment, Customers, round(Total_Rev, 2) AS Total_Rev, round(Avg_Rev, 4) AS Avg_Rev,
       round(Med_Rev, 4) AS Med_Rev, Rev_Share, CLV_Score FROM segx""").replace(
    "seg AS (", "conv AS (SELECT * REPLACE (Monetary * 83.0 AS Monetary) FROM scored),\nseg AS (", 1))
def q_segment_stats_converted(spark, sf):
    """H2 then G4-G6: money converted with the USD->INR rate before any
    aggregate, as the dashboard does for a display currency."""
    rates = spark.createDataFrame(RATES, "base STRING, target STRING, rate DOUBLE")
    conv = convert_currency(B.scored(spark, sf), rates, "USD", "INR")
    g = G.segment_stats(conv)
    return g.select("Segment", "Customers", r("Total_Rev", 2).alias("Total_Rev"), r("Avg_Rev", 4).alias("Avg_Rev"),
                    r("Med_Rev", 4).alias("Med_Rev"), "Rev_Share", "CLV_Score")


@query("pareto", S.with_ctes(*S.BASE, body="""
SELECT Segment, round(Total_Rev, 2) AS Total_Rev,
       CAST(round_even(Total_Rev / sum(Total_Rev) OVER () * 100, 1) AS DOUBLE) AS Rev_Share,
       CAST(round_even(sum(Total_Rev) OVER (ORDER BY Total_Rev DESC, Segment ROWS UNBOUNDED PRECEDING)
                       / sum(Total_Rev) OVER () * 100, 1) AS DOUBLE) AS Cum_Share,
       row_number() OVER (ORDER BY Total_Rev DESC, Segment) AS position
FROM (SELECT Segment, sum(Monetary) AS Total_Rev FROM scored GROUP BY Segment)"""))
def q_pareto(spark, sf):
    g = G.pareto(B.scored(spark, sf))
    return g.select("Segment", r("Total_Rev", 2).alias("Total_Rev"), "Rev_Share", "Cum_Share",
                    F.col("position").cast("bigint").alias("position"))


@query("centroid_heatmap", S.with_ctes(*S.BASE, body="""
SELECT Segment,
  CAST(round_even(1 - (mR - min(mR) OVER ()) / (max(mR) OVER () - min(mR) OVER () + 1e-9), 2) AS DOUBLE) AS Recency,
  CAST(round_even((mF - min(mF) OVER ()) / (max(mF) OVER () - min(mF) OVER () + 1e-9), 2) AS DOUBLE) AS Frequency,
  CAST(round_even((mM - min(mM) OVER ()) / (max(mM) OVER () - min(mM) OVER () + 1e-9), 2) AS DOUBLE) AS Monetary
FROM (SELECT Segment, avg(Recency) AS mR, avg(Frequency) AS mF, avg(Monetary) AS mM FROM scored GROUP BY Segment)"""))
def q_heatmap(spark, sf):
    return G.centroid_heatmap(B.scored(spark, sf))


@query("radar_profile", S.with_ctes(*S.BASE, body="""
SELECT Segment,
  round(avg(1 - (Recency - lR) / CASE WHEN hR <> lR THEN hR - lR ELSE 1 END), 8) AS Recency_Score,
  round(avg((Frequency - lF) / CASE WHEN hF <> lF THEN hF - lF ELSE 1 END), 8) AS Frequency_Score,
  round(avg((Monetary - lM) / CASE WHEN hM <> lM THEN hM - lM ELSE 1 END), 8) AS Revenue_Score
FROM scored, (SELECT min(Recency) lR, max(Recency) hR, min(Frequency) lF, max(Frequency) hF,
                     min(Monetary) lM, max(Monetary) hM FROM scored)
GROUP BY Segment"""))
def q_radar(spark, sf):
    g = G.radar_profile(B.scored(spark, sf))
    return g.select("Segment", *[r(c, 8).alias(c) for c in ("Recency_Score", "Frequency_Score", "Revenue_Score")])


def _quality_spark(spark, sf):
    df, _ = B.scaled(spark, sf)
    rows = Q.silhouette_rows(df, ["Recency_s", "Frequency_s", "Monetary_s"])
    return G.cluster_quality(rows)


CQ_SQL = """cq AS (
  SELECT s.Cluster, Segment, count(*) AS N, avg(Recency) AS Avg_R, avg(Frequency) AS Avg_F,
         (sum(CAST(round(Monetary * 100) AS BIGINT)) // count(*)
          + CASE WHEN 2 * (sum(CAST(round(Monetary * 100) AS BIGINT)) % count(*)) > count(*) THEN 1
                 WHEN 2 * (sum(CAST(round(Monetary * 100) AS BIGINT)) % count(*)) = count(*)
                      AND (sum(CAST(round(Monetary * 100) AS BIGINT)) // count(*)) % 2 = 1 THEN 1 ELSE 0 END
         ) / 100.0 AS Avg_M,
         avg(RFM_Total) AS Avg_RFM, avg(silhouette_sq_euclidean) AS Sil_Score
  FROM scaled s JOIN sil USING (customer_id) GROUP BY s.Cluster, Segment),
cq2 AS (SELECT Cluster, Segment, N, CAST(round_even(N * 100.0 / sum(N) OVER (), 2) AS DOUBLE) AS Pct,
               CAST(round_even(Avg_R, 2) AS DOUBLE) AS Avg_R, CAST(round_even(Avg_F, 2) AS DOUBLE) AS Avg_F,
               CAST(round_even(Avg_M, 2) AS DOUBLE) AS Avg_M, CAST(round_even(Avg_RFM, 2) AS DOUBLE) AS Avg_RFM,
               CAST(round_even(Sil_Score, 2) AS DOUBLE) AS Sil_Score FROM cq)"""


@query("cluster_quality", S.with_ctes(*S.BASE, S.SCALED, S.SIL, CQ_SQL, body="SELECT * FROM cq2"))
def q_cluster_quality(spark, sf):
    return _quality_spark(spark, sf)


@query("cluster_warnings", S.with_ctes(*S.BASE, S.SCALED, S.SIL, CQ_SQL, body=f"""
SELECT Cluster, Segment, 'small_cluster' AS warning, Pct AS value
FROM (SELECT *, 100.0 * N / (SELECT count(*) FROM scored) AS share FROM cq2) WHERE share < {dims.SMALL_CLUSTER_PCT}
UNION ALL
SELECT Cluster, Segment, 'low_silhouette', Sil_Score FROM cq2 WHERE Sil_Score < 0.19"""))
def q_cluster_warnings(spark, sf):
    return G.cluster_warnings(_quality_spark(spark, sf))


def _density_sql(feature: str) -> str:
    return f"""
m AS (SELECT Segment, min(CAST({feature} AS DOUBLE)) AS lo, max(CAST({feature} AS DOUBLE)) AS hi, count(*) AS n,
             1.06 * stddev_samp(CAST({feature} AS DOUBLE)) * pow(count(*), -0.2) AS h FROM scored GROUP BY Segment),
c AS (SELECT Segment, least(floor((CAST({feature} AS DOUBLE) - lo) / (hi - lo) * 64), 63) AS j, count(*) AS c
      FROM scored JOIN m USING (Segment) GROUP BY ALL)
SELECT Segment, '{feature}' AS feature, CAST(bin AS INTEGER) AS bin,
       round(sum(c * exp(-0.5 * pow((bin - j) * (hi - lo) / 64 / h, 2))) / any_value(n) / any_value(h) / sqrt(2 * pi()) * any_value(hi - lo), 6) AS density
FROM m JOIN c USING (Segment), range(64) t(bin) GROUP BY Segment, bin"""


def _density(spark, sf, feature):
    d = G.density_curve(B.scored(spark, sf), feature)
    return d.select("Segment", "feature", "bin", r(F.col("density") * F.col("width"), 6).alias("density"))


@query("density_curves", S.with_ctes(*S.BASE, body=" UNION ALL ".join(
    f"SELECT * FROM (WITH {_density_sql(f).strip()})" for f in ("Recency", "Frequency", "Monetary"))))
def q_density(spark, sf):
    """Kernel densities of the three features, times the width of their range."""
    return _density(spark, sf, "Recency").unionAll(_density(spark, sf, "Frequency")).unionAll(_density(spark, sf, "Monetary"))


@query("all_peers", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Segment, CAST(rank AS INTEGER) AS rank, peer, round(distance, 9) AS distance FROM (
  SELECT a.customer_id, a.Segment, b.customer_id AS peer, sqrt(dR * dR + dF * dF + dM * dM) AS distance,
         row_number() OVER (PARTITION BY a.customer_id ORDER BY sqrt(dR * dR + dF * dF + dM * dM), b.customer_id) AS rank
  FROM scored a JOIN scored b ON a.Segment = b.Segment AND a.customer_id <> b.customer_id,
       (SELECT CAST(max(Recency) AS DOUBLE) - min(Recency) + 1e-9 AS wR, CAST(max(Frequency) AS DOUBLE) - min(Frequency) + 1e-9 AS wF,
               max(Monetary) - min(Monetary) + 1e-9 AS wM FROM scored),
       LATERAL (SELECT (a.Recency - b.Recency) / wR AS dR, (a.Frequency - b.Frequency) / wF AS dF, (a.Monetary - b.Monetary) / wM AS dM))
WHERE rank <= 10"""))
def q_all_peers(spark, sf):
    """T3 for every customer: the ten nearest of the segment."""
    out = nearest_neighbors(B.scored(spark, sf), "customer_id", ["Recency", "Frequency", "Monetary"], "Segment")
    return out.select("customer_id", "Segment", "rank", "peer", r("distance", 9).alias("distance"))


#: Mean distances from the pairs of all customers.
EUCLID_SQL = """pd AS (SELECT f.customer_id, f.Cluster AS own, g.Cluster AS other, count(*) AS N,
              sum(sqrt((f.x1 - g.x1) ** 2 + (f.x2 - g.x2) ** 2 + (f.x3 - g.x3) ** 2)) AS d
       FROM feat f, feat g GROUP BY f.customer_id, f.Cluster, g.Cluster),
pab AS (SELECT customer_id, own, max(CASE WHEN other = own THEN N END) AS own_n,
              max(CASE WHEN other = own AND N > 1 THEN d / (N - 1) END) AS a, min(CASE WHEN other <> own THEN d / N END) AS b
       FROM pd GROUP BY customer_id, own),
euclid AS (SELECT customer_id, own AS Cluster,
               CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END AS silhouette_euclidean FROM pab)"""
EUCLID = (*S.BASE, S.SCALED, S.SIL, EUCLID_SQL)
SCALED_COLS = ["Recency_s", "Frequency_s", "Monetary_s"]


def _euclid(spark, sf):
    return B._memo(spark, sf, "euclid", lambda: SL.euclidean_points(B.scaled(spark, sf)[0], SCALED_COLS))


def _euclid_quality(spark, sf):
    rows = SL.euclidean_rows(B.scaled(spark, sf)[0], SCALED_COLS, points=_euclid(spark, sf))
    return G.cluster_quality(rows, SL.EUCLIDEAN)


CQ_EUCLID = CQ_SQL.replace("avg(silhouette_sq_euclidean)", "avg(silhouette_euclidean)").replace("JOIN sil USING", "JOIN euclid USING")


@query("silhouette_euclidean", S.with_ctes(*EUCLID, body="""
SELECT customer_id, Cluster, round(silhouette_euclidean, 8) AS silhouette_euclidean FROM euclid"""))
def q_euclid_rows(spark, sf):
    """Euclidean silhouette of every customer."""
    rows = SL.euclidean_rows(B.scaled(spark, sf)[0], SCALED_COLS, points=_euclid(spark, sf))
    return rows.select("customer_id", "Cluster", r(SL.EUCLIDEAN, 8).alias(SL.EUCLIDEAN))


@query("fit_verdict", S.with_ctes(*EUCLID, body=f"""
SELECT round(avg(silhouette_euclidean), 6) AS silhouette_euclidean, count_if(silhouette_euclidean < 0) AS n_negative,
       CASE WHEN avg(silhouette_euclidean) < {dims.SIL_WARN} THEN 'warning' WHEN avg(silhouette_euclidean) >= {dims.SIL_GOOD} THEN 'good'
            ELSE 'ok' END AS verdict, TRUE AS certified
FROM euclid"""))
def q_fit_verdict(spark, sf):
    """Mean Euclidean silhouette, its certified error at most 1e-6, and the verdict on it."""
    m = SL.euclidean_summary(_euclid(spark, sf))
    return spark.createDataFrame([(round(m[SL.EUCLIDEAN], 6), m["n_negative_euclidean"], Q.fit_verdict(m[SL.EUCLIDEAN], dims.SIL_WARN, dims.SIL_GOOD), m["euclidean_error"] <= 1e-6)],
                                 "silhouette_euclidean DOUBLE, n_negative BIGINT, verdict STRING, certified BOOLEAN")


@query("cluster_quality_euclidean", S.with_ctes(*EUCLID, CQ_EUCLID, body="SELECT * FROM cq2"))
def q_euclid_quality(spark, sf):
    """G10, G11 with the Euclidean silhouette."""
    return _euclid_quality(spark, sf)


@query("cluster_warnings_euclidean", S.with_ctes(*EUCLID, CQ_EUCLID, body=f"""
SELECT Cluster, Segment, 'small_cluster' AS warning, Pct AS value
FROM (SELECT *, 100.0 * N / (SELECT count(*) FROM scored) AS share FROM cq2) WHERE share < {dims.SMALL_CLUSTER_PCT}
UNION ALL
SELECT Cluster, Segment, 'low_silhouette', Sil_Score FROM cq2 WHERE Sil_Score < {dims.LOW_SIL}"""))
def q_euclid_warnings(spark, sf):
    """G12 with the Euclidean limit."""
    return G.cluster_warnings(_euclid_quality(spark, sf), dims.LOW_SIL)


@query("box_stats_monetary", S.with_ctes(*S.BASE, CENTS_SQL, body="""
SELECT Segment, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
       round(q1 - 1.5 * (q3 - q1), 4) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 4) AS upper_fence,
       round(mn, 4) AS min, round(mx, 4) AS max, outliers, 'Monetary' AS feature
FROM (SELECT s.Segment, any_value(q.q1) AS q1, any_value(q.med) AS med, any_value(q.q3) AS q3,
             min(Monetary) AS mn, max(Monetary) AS mx,
             count_if(Monetary < q.q1 - 1.5 * (q.q3 - q.q1) OR Monetary > q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers
      FROM cents s JOIN (SELECT Segment, quantile_cont(Monetary, 0.25) AS q1, quantile_cont(Monetary, 0.5) AS med,
                                quantile_cont(Monetary, 0.75) AS q3 FROM cents GROUP BY Segment) q USING (Segment)
      GROUP BY s.Segment)"""))
def q_box(spark, sf):
    # money in cents: quartiles interpolate between customers, and the two
    # engines' per-customer sums differ in the last bit
    b = G.box_stats(B.scored(spark, sf).withColumn("Monetary", r("Monetary", 2)), "Monetary")
    return b.select("Segment", *[r(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_fence", "upper_fence",
                                                           "min", "max")], "outliers", "feature")


@query("color_map", S.with_ctes(*S.BASE, body="SELECT DISTINCT Segment, SegmentColor FROM scored"))
def q_color_map(spark, sf):
    return G.color_map(B.scored(spark, sf))


@query("summary_text", S.with_ctes(*S.BASE, SEG_STATS_SQL, body=f"""
SELECT Segment, Customers, {_money_sql('Total_Rev')} AS Total, {_money_sql('Avg_Rev')} AS Avg_Rev,
       {_money_sql('Med_Rev')} AS Median, format('{{:.0f}}', round_even(Avg_Rec, 0)) || 'd' AS Avg_Recency,
       CAST(round_even(Avg_Frq, 2) AS DOUBLE) AS Avg_Freq, format('{{:.1f}}', Rev_Share) || '%' AS Rev_Pct,
       format('{{:.1f}}', CLV_Score) AS CLV FROM segx"""))
def q_summary_text(spark, sf):
    return G.summary_text(G.segment_stats(B.scored(spark, sf)))


@query("composition", S.with_ctes(*S.BASE, body="""
SELECT Segment, SegmentColor, Customers, round(Revenue, 2) AS Revenue,
       round(Customers * 100.0 / sum(Customers) OVER (), 6) AS Customer_Share,
       round(Revenue * 100.0 / sum(Revenue) OVER (), 6) AS Revenue_Share
FROM (SELECT Segment, SegmentColor, count(*) AS Customers, sum(Monetary) AS Revenue FROM scored
      GROUP BY Segment, SegmentColor)"""))
def q_composition(spark, sf):
    g = G.composition(B.scored(spark, sf))
    return g.select("Segment", "SegmentColor", "Customers", r("Revenue", 2).alias("Revenue"),
                    r("Customer_Share", 6).alias("Customer_Share"), r("Revenue_Share", 6).alias("Revenue_Share"))


@query("segment_strip", S.with_ctes(*S.BASE, body=f"""
SELECT Segment, SegmentColor, any_value(SegmentEmoji) AS SegmentEmoji,
       format('{{:.0f}}', round_even(avg(Recency), 0)) || 'd' AS R_text,
       format('{{:.1f}}', round_even(avg(Frequency), 1)) AS F_text,
       {_money_sql('avg(Monetary)')} AS M_text, round(sum(Monetary), 2) AS Revenue
FROM scored GROUP BY Segment, SegmentColor"""))
def q_strip(spark, sf):
    return G.segment_strip(B.scored(spark, sf)).withColumn("Revenue", r("Revenue", 2))


# --------------------------------------------------------------- lookups (W6-W10, T, J)
@query("percentile_standing", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Segment, Recency, Frequency, round(Monetary, 2) AS Monetary,
       round(100 - cume_dist() OVER (ORDER BY Recency) * 100, 8) AS Recency_Pct,
       round(cume_dist() OVER (ORDER BY Frequency) * 100, 8) AS Frequency_Pct,
       round(cume_dist() OVER (ORDER BY Monetary) * 100, 8) AS Monetary_Pct,
       rank() OVER (ORDER BY Monetary) AS revenue_rank_asc,
       rank() OVER (ORDER BY Monetary DESC) AS revenue_rank
FROM scored"""))
def q_standing(spark, sf):
    p = L.percentile_standing(B.scored(spark, sf), ranks=B.ranks(spark, sf))
    return p.select("customer_id", "Segment", "Recency", "Frequency", r("Monetary", 2).alias("Monetary"),
                    *[r(c, 8).alias(c) for c in ("Recency_Pct", "Frequency_Pct", "Monetary_Pct")],
                    "revenue_rank_asc", "revenue_rank")


@query("percentile_bands", S.with_ctes(*S.BASE, body=f"""
SELECT customer_id,
  CASE WHEN p >= {dims.BAND_GREEN} THEN '#22c55e' WHEN p >= {dims.BAND_AMBER} THEN '#f59e0b' ELSE '#ef4444' END AS Monetary_Band
FROM (SELECT customer_id, cume_dist() OVER (ORDER BY Monetary) * 100 AS p FROM scored)"""))
def q_bands(spark, sf):
    return L.percentile_standing(B.scored(spark, sf), ranks=B.ranks(spark, sf)).select("customer_id", "Monetary_Band")


@query("segment_context", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Segment, round(Monetary, 2) AS Monetary,
       round(avg(Monetary) OVER (PARTITION BY Segment), 4) AS Segment_Avg_M,
       count(*) OVER (PARTITION BY Segment) AS Segment_Size,
       round(Monetary - avg(Monetary) OVER (PARTITION BY Segment), 4) AS Diff_To_Segment
FROM scored"""))
def q_seg_context(spark, sf):
    c = L.segment_context(B.scored(spark, sf))
    return c.select("customer_id", "Segment", r("Monetary", 2).alias("Monetary"),
                    r("Segment_Avg_M", 4).alias("Segment_Avg_M"), "Segment_Size",
                    r("Diff_To_Segment", 4).alias("Diff_To_Segment"))


@query("minmax_scores", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Segment,
  round(1 - (Recency - lR) / (hR - lR + 1e-9), 8) AS Recency_Score,
  round(1 - (avg(Recency) OVER w - lR) / (hR - lR + 1e-9), 8) AS Segment_Recency_Score,
  round((Frequency - lF) / (hF - lF + 1e-9), 8) AS Frequency_Score,
  round((avg(Frequency) OVER w - lF) / (hF - lF + 1e-9), 8) AS Segment_Frequency_Score,
  round((Monetary - lM) / (hM - lM + 1e-9), 8) AS Monetary_Score,
  round((avg(Monetary) OVER w - lM) / (hM - lM + 1e-9), 8) AS Segment_Monetary_Score
FROM scored, (SELECT min(Recency) lR, max(Recency) hR, min(Frequency) lF, max(Frequency) hF,
                     min(Monetary) lM, max(Monetary) hM FROM scored)
WINDOW w AS (PARTITION BY Segment)"""))
def q_minmax(spark, sf):
    m = L.minmax_scores(B.scored(spark, sf))
    return m.select("customer_id", "Segment", *[r(c, 8).alias(c) for c in m.columns[2:]])


@query("by_monetary", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary, Segment FROM scored
ORDER BY Monetary DESC, customer_id"""))
def q_by_monetary(spark, sf):
    return L.by_monetary(B.scored(spark, sf)).withColumn("Monetary", r("Monetary", 2))


@query("segmentation_table", S.with_ctes(*S.BASE, body=f"""
SELECT customer_id AS "Customer ID", Recency AS "Recency (days)", Frequency,
       {_money_sql('Monetary')} AS "Revenue (USD)", Segment FROM scored"""))
def q_segmentation_table(spark, sf):
    from rfmlens.operators.schema import segmentation_table
    return segmentation_table(B.scored(spark, sf))


@query("customer_ids", S.with_ctes(*S.BASE, body="SELECT DISTINCT customer_id FROM scored ORDER BY customer_id"))
def q_ids(spark, sf):
    return L.customer_ids(B.scored(spark, sf))


TOP_SQL = "top AS (SELECT customer_id FROM scored ORDER BY Monetary DESC, customer_id LIMIT 1)"


@query("nearest_peers", S.with_ctes(*S.BASE, TOP_SQL, body="""
SELECT s.customer_id, s.Recency, s.Frequency, round(s.Monetary, 2) AS Monetary,
       round(sqrt(pow((s.Recency - m.Recency) / (hR - lR + 1e-9), 2) + pow((s.Frequency - m.Frequency) / (hF - lF + 1e-9), 2)
            + pow((s.Monetary - m.Monetary) / (hM - lM + 1e-9), 2)), 8) AS distance
FROM scored s, (SELECT * FROM scored WHERE customer_id = (SELECT customer_id FROM top)) m,
     (SELECT min(Recency) lR, max(Recency) hR, min(Frequency) lF, max(Frequency) hF,
             min(Monetary) lM, max(Monetary) hM FROM scored) g
WHERE s.Segment = m.Segment AND s.customer_id <> m.customer_id
ORDER BY sqrt(pow((s.Recency - m.Recency) / (hR - lR + 1e-9), 2) + pow((s.Frequency - m.Frequency) / (hF - lF + 1e-9), 2)
            + pow((s.Monetary - m.Monetary) / (hM - lM + 1e-9), 2)), s.customer_id
LIMIT 10"""))
def q_peers(spark, sf):
    p = L.nearest_peers(B.scored(spark, sf), B.top_customer(spark, sf))
    return p.withColumn("Monetary", r("Monetary", 2)).withColumn("distance", r("distance", 8))


@query("customer_profile", S.with_ctes(*S.BASE, TOP_SQL, body="""
SELECT m.customer_id, m.Cluster, m.Segment, m.SegmentEmoji, m.SegmentColor, m.Recency, m.Frequency,
       round(m.Monetary, 2) AS Monetary,
       round(100 - 100.0 * (SELECT count_if(Recency <= m.Recency) FROM scored) / (SELECT count(*) FROM scored), 8) AS Recency_Pct,
       round(100.0 * (SELECT count_if(Frequency <= m.Frequency) FROM scored) / (SELECT count(*) FROM scored), 8) AS Frequency_Pct,
       round(100.0 * (SELECT count_if(Monetary <= m.Monetary) FROM scored) / (SELECT count(*) FROM scored), 8) AS Monetary_Pct,
       (SELECT count_if(Monetary < m.Monetary) FROM scored) + 1 AS revenue_rank_asc,
       (SELECT count(*) FROM scored) AS customers,
       (SELECT count(*) FROM scored WHERE Segment = m.Segment) AS Segment_Size,
       round((SELECT avg(Monetary) FROM scored WHERE Segment = m.Segment), 4) AS Segment_Avg_M
FROM scored m WHERE m.customer_id = (SELECT customer_id FROM top)"""))
def q_profile(spark, sf):
    p = L.customer_profile(B.scored(spark, sf), B.cluster_map(spark, sf), B.top_customer(spark, sf))
    return p.select("customer_id", "Cluster", "Segment", "SegmentEmoji", "SegmentColor", "Recency", "Frequency",
                    r("Monetary", 2).alias("Monetary"),
                    *[r(c, 8).alias(c) for c in ("Recency_Pct", "Frequency_Pct", "Monetary_Pct")],
                    "revenue_rank_asc", "customers", "Segment_Size", r("Segment_Avg_M", 4).alias("Segment_Avg_M"))


@query("histogram", S.with_ctes(*S.BASE, body="""
SELECT Segment, bin, count(*) AS count, round(any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / 25, 4) AS bin_start,
       round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 25, 4) AS bin_end
FROM (SELECT s.Segment, lo, hi,
             CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((Monetary - lo) / (hi - lo) * 25) AS INTEGER) + 1, 25) END AS bin
      FROM scored s JOIN (SELECT Segment, min(Monetary) lo, max(Monetary) hi FROM scored GROUP BY Segment) USING (Segment))
GROUP BY Segment, bin"""))
def q_hist(spark, sf):
    h = L.segment_histogram(B.scored(spark, sf))
    return h.withColumn("bin_start", r("bin_start", 4)).withColumn("bin_end", r("bin_end", 4))


@query("action_cards", S.with_ctes(*S.BASE, body="""
SELECT m.Segment, m.SegmentEmoji, m.SegmentColor, round(sum(s.Monetary), 2) AS Total_Rev
FROM cmap m JOIN scored s USING (Segment) GROUP BY m.Segment, m.SegmentEmoji, m.SegmentColor"""))
def q_actions(spark, sf):
    a = action_cards(B.scored(spark, sf), B.cluster_map(spark, sf))
    return a.select("Segment", "SegmentEmoji", "SegmentColor", r("Total_Rev", 2).alias("Total_Rev"))


def _quick_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', '{e}', '{c}')" for i, (n, e, c) in enumerate(dims.QUICK_WIN_SEGMENTS))
    return f"qw(pos, Segment, SegmentEmoji, SegmentColor) AS (VALUES {rows})"


@query("quick_wins", S.with_ctes(*S.BASE, _quick_sql(), body="""
SELECT q.pos, q.Segment, q.SegmentEmoji, q.SegmentColor, CAST(coalesce(c.n, 0) AS BIGINT) AS Customers
FROM qw q LEFT JOIN (SELECT Segment, count(*) AS n FROM scored GROUP BY Segment) c USING (Segment)"""))
def q_quick(spark, sf):
    return quick_wins(B.scored(spark, sf)).select("pos", "Segment", "SegmentEmoji", "SegmentColor", "Customers")


@query("currency_text", S.with_ctes(*S.BASE, body=f"""
SELECT customer_id, {_money_sql('Monetary', '₹')} AS Monetary_text, 'INR' AS currency_code FROM scored"""))
def q_currency_text(spark, sf):
    from rfmlens.operators.labels import with_currency
    return with_currency(B.scored(spark, sf), "inr").select("customer_id", "Monetary_text", "currency_code")


RATES = [("USD", "EUR", 0.5), ("USD", "INR", 83.0), ("EUR", "USD", 2.0)]


@query("currency_conversion", S.with_ctes(*S.BASE, body="""
SELECT customer_id, round(Monetary * 83.0, 2) AS Monetary, 83.0::DOUBLE AS rate FROM scored"""))
def q_conversion(spark, sf):
    rates = spark.createDataFrame(RATES, "base STRING, target STRING, rate DOUBLE")
    c = convert_currency(B.scored(spark, sf), rates, "USD", "INR")
    return c.select("customer_id", r("Monetary", 2).alias("Monetary"), "rate")


# --------------------------------------------------------------- transform & metrics (M)
@query("caps", S.with_ctes(*S.BASE, body="""
SELECT * FROM (
  SELECT 'Recency' AS feature, round(c, 6) AS cap, (SELECT count_if(Recency > c) FROM scored) AS n_capped
  FROM (SELECT quantile_cont(Recency, 0.99) AS c FROM scored)
  UNION ALL SELECT 'Frequency', round(c, 6), (SELECT count_if(Frequency > c) FROM scored)
  FROM (SELECT quantile_cont(Frequency, 0.99) AS c FROM scored)
  UNION ALL SELECT 'Monetary', round(c, 6), (SELECT count_if(Monetary > c) FROM scored)
  FROM (SELECT quantile_cont(Monetary, 0.99) AS c FROM scored))"""))
def q_caps(spark, sf):
    _, model = B.scaled(spark, sf)
    c = cap_report(B.scored(spark, sf), model.caps)
    return c.withColumn("cap", r("cap", 6))


@query("quantile_transform", S.with_ctes(*S.BASE, S.SCALED, body="""
SELECT customer_id, round(Recency_s, 10) AS Recency_s, round(Frequency_s, 10) AS Frequency_s,
       round(Monetary_s, 10) AS Monetary_s FROM scaled"""))
def q_qt(spark, sf):
    df, _ = B.scaled(spark, sf)
    return df.select("customer_id", *[r(c, 10).alias(c) for c in ("Recency_s", "Frequency_s", "Monetary_s")])


EV_SQL = """net AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS invoice_id,
         CAST(l_shipdate AS TIMESTAMP) AS invoice_date,
         l_quantity * (l_extendedprice * (1 - l_discount) / l_quantity) AS line_total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
net_c AS (SELECT customer_id, max(invoice_date) AS last_purchase, count(DISTINCT invoice_id) AS Frequency,
                 CAST(sum(CAST(line_total AS DECIMAL(38, 6))) AS DOUBLE) AS Monetary FROM net GROUP BY customer_id),
ev AS (SELECT customer_id,
              CAST(greatest(date_sub('day', last_purchase, (SELECT max(last_purchase) FROM net_c) + INTERVAL 1 DAY), 0)
                   AS BIGINT) AS Recency, Frequency, Monetary FROM net_c)"""
def _transform_sql(f: str) -> str:
    """M5 for one feature from the definition: a knot's middle, else a line
    between the nearest knots, else 0 or 1."""
    x, knots = f"x{f[0]}", f"knots_{f}"
    return f"""{knots} AS (SELECT DISTINCT {x} AS v, nl_{f} / (n_{f} - 1) AS lo, (nq_{f} - 1) / (n_{f} - 1) AS hi FROM scaled),
ev_{f} AS (SELECT customer_id, least(CAST({f} AS DOUBLE), (SELECT c{f[0]} FROM caps)) AS x FROM ev),
tr_{f} AS (SELECT customer_id, CASE
    WHEN x <= (SELECT min(v) FROM {knots}) THEN 0.0
    WHEN x >= (SELECT max(v) FROM {knots}) THEN 1.0
    WHEN x = k0.v THEN (k0.lo + k0.hi) / 2
    ELSE k0.hi + (x - k0.v) / (k1.v - k0.v) * (k1.lo - k0.hi) END AS {f}_t
  FROM ev_{f} ASOF LEFT JOIN {knots} k0 ON x >= k0.v ASOF LEFT JOIN {knots} k1 ON x <= k1.v)"""


TRANSFORM_SQL = ",\n".join(_transform_sql(f) for f in ("Recency", "Frequency", "Monetary"))


@query("transform_unseen", S.with_ctes(*S.BASE, S.SCALED, EV_SQL, TRANSFORM_SQL, body="""
SELECT customer_id, round(Recency_t, 10) AS Recency_s, round(Frequency_t, 10) AS Frequency_s,
       round(Monetary_t, 10) AS Monetary_s
FROM tr_Recency JOIN tr_Frequency USING (customer_id) JOIN tr_Monetary USING (customer_id)"""))
def q_transform_unseen(spark, sf):
    """M5: the transform fitted on the customers' order-date, list-price RFM,
    applied to a file it has not seen: the same orders by ship date with net
    prices (values between, on and beyond the saved knots)."""
    from rfmlens.operators.transform import transform
    _, model = B.scaled(spark, sf)
    out = transform(compute_rfm(net_lines(spark, sf)), model)
    return out.select("customer_id", *[r(c, 10).alias(c) for c in ("Recency_s", "Frequency_s", "Monetary_s")])


def net_lines(spark, sf):
    """The orders' lines by ship date with net prices."""
    li = read_table(spark, sf, "lineitem")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .select(F.col("o_custkey").cast("string").alias("customer_id"),
                   F.col("o_orderkey").cast("string").alias("invoice_id"),
                   F.col("l_shipdate").cast("timestamp_ntz").alias("invoice_date"),
                   (F.col("l_quantity") * (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")))
                   .alias("line_total")))


@query("silhouette_rows", S.with_ctes(*S.BASE, S.SCALED, S.SIL, body="""
SELECT customer_id, Cluster, round(silhouette_sq_euclidean, 8) AS silhouette_sq_euclidean FROM sil"""))
def q_sil_rows(spark, sf):
    df, _ = B.scaled(spark, sf)
    s = Q.silhouette_rows(df, ["Recency_s", "Frequency_s", "Monetary_s"])
    return s.select("customer_id", "Cluster", r("silhouette_sq_euclidean", 8).alias("silhouette_sq_euclidean"))


CENTERS_SQL = """cen AS (SELECT Cluster, avg(Recency_s) AS c1, avg(Frequency_s) AS c2, avg(Monetary_s) AS c3
                         FROM scaled GROUP BY Cluster)"""


@query("kmeans_assign", S.with_ctes(*S.BASE, S.SCALED, CENTERS_SQL, body="""
SELECT customer_id, CAST(arg_min(c.Cluster, pow(Recency_s - c1, 2) + pow(Frequency_s - c2, 2) + pow(Monetary_s - c3, 2)) AS INTEGER)
       AS Assigned
FROM scaled s, cen c GROUP BY customer_id"""))
def q_assign(spark, sf):
    df, _ = B.scaled(spark, sf)
    cols = ["Recency_s", "Frequency_s", "Monetary_s"]
    sums = Q.cluster_sums(df, cols)
    centers = [sums[k]["mean"] for k in sorted(sums)]
    return Q.assign_clusters(df, cols, centers, "Assigned").select("customer_id", "Assigned")


METRICS_SQL = """cen2 AS (SELECT Cluster, count(*) AS N, avg(Recency_s) AS c1, avg(Frequency_s) AS c2, avg(Monetary_s) AS c3
                  FROM scaled GROUP BY Cluster),
dist AS (SELECT s.Cluster, pow(Recency_s - c1, 2) + pow(Frequency_s - c2, 2) + pow(Monetary_s - c3, 2) AS d2
         FROM scaled s JOIN cen2 USING (Cluster)),
spread AS (SELECT Cluster, avg(sqrt(d2)) AS sp FROM dist GROUP BY Cluster),
gm AS (SELECT avg(Recency_s) g1, avg(Frequency_s) g2, avg(Monetary_s) g3, count(*) AS n FROM scaled),
db AS (SELECT avg(worst) AS davies_bouldin FROM (
         SELECT a.Cluster, max((sa.sp + sb.sp) / sqrt(pow(a.c1 - b.c1, 2) + pow(a.c2 - b.c2, 2) + pow(a.c3 - b.c3, 2))) AS worst
         FROM cen2 a JOIN cen2 b ON a.Cluster <> b.Cluster JOIN spread sa ON sa.Cluster = a.Cluster
              JOIN spread sb ON sb.Cluster = b.Cluster GROUP BY a.Cluster)),
w AS (SELECT sum(d2) AS within FROM dist),
bt AS (SELECT sum(cen2.N * (pow(c1 - g1, 2) + pow(c2 - g2, 2) + pow(c3 - g3, 2))) AS between, count(*) AS k,
              any_value(gm.n) AS n
       FROM cen2, gm)"""


@query("clustering_metrics", S.with_ctes(*S.BASE, S.SCALED, S.SIL, METRICS_SQL, body=f"""
SELECT CAST(k AS BIGINT) AS k, round(within, 6) AS inertia, round((SELECT avg(silhouette_sq_euclidean) FROM sil), 6) AS silhouette_sq_euclidean,
       (SELECT count_if(silhouette_sq_euclidean < 0) FROM sil) AS n_negative,
       round(between * (n - k) / (within * (k - 1)), 4) AS calinski_harabasz,
       round(davies_bouldin, 6) AS davies_bouldin,
       CASE WHEN (SELECT avg(silhouette_sq_euclidean) FROM sil) < 0.51 THEN 'warning'
            WHEN (SELECT avg(silhouette_sq_euclidean) FROM sil) >= 0.64 THEN 'good' ELSE 'ok' END AS verdict
FROM w, bt, db"""))
def q_metrics(spark, sf):
    df, _ = B.scaled(spark, sf)
    m = Q.quality_metrics(df, ["Recency_s", "Frequency_s", "Monetary_s"])
    row = [(m["k"], round(m["inertia"], 6), round(m["silhouette_sq_euclidean"], 6), m["n_negative"],
            round(m["calinski_harabasz"], 4), round(m["davies_bouldin"], 6), Q.fit_verdict(m["silhouette_sq_euclidean"], Q.squared_limit(dims.SIL_WARN), Q.squared_limit(dims.SIL_GOOD)))]
    return spark.createDataFrame(row, "k BIGINT, inertia DOUBLE, silhouette_sq_euclidean DOUBLE, n_negative BIGINT, "
                                      "calinski_harabasz DOUBLE, davies_bouldin DOUBLE, verdict STRING")


def _norm_sql(c: str, lower_better: bool) -> str:
    rng = f"CASE WHEN max({c}) OVER () - min({c}) OVER () > 0 THEN max({c}) OVER () - min({c}) OVER () ELSE 1 END"
    v = f"({c} - min({c}) OVER ()) / {rng}"
    return f"(1 - {v})" if lower_better else v


K_SQL = """kv AS (SELECT * FROM (VALUES (3), (4), (5), (6), (7), (8)) t(k)),
kf AS (SELECT k, customer_id, Recency_s AS x1, Frequency_s AS x2, Monetary_s AS x3,
              CAST(least(floor(Monetary_s * k), k - 1) AS INTEGER) AS Cluster FROM scaled, kv),
kcs AS (SELECT k, Cluster, count(*) AS N, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3,
               sum(x1 * x1 + x2 * x2 + x3 * x3) AS psi, avg(x1) AS c1, avg(x2) AS c2, avg(x3) AS c3
        FROM kf GROUP BY k, Cluster),
kmd AS (SELECT f.k, f.customer_id, f.Cluster AS own, c.Cluster AS other, c.N,
               (x1 * x1 + x2 * x2 + x3 * x3) + c.psi / c.N - 2 * (x1 * c.s1 + x2 * c.s2 + x3 * c.s3) / c.N AS d
        FROM kf f JOIN kcs c ON f.k = c.k),
kab AS (SELECT k, customer_id, max(CASE WHEN other = own THEN N END) AS own_n,
               max(CASE WHEN other = own AND N > 1 THEN d * N / (N - 1) END) AS a,
               min(CASE WHEN other <> own THEN d END) AS b
        FROM kmd GROUP BY k, customer_id, own),
ksil AS (SELECT k, avg(CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END)
                AS silhouette_sq_euclidean FROM kab GROUP BY k),
kd AS (SELECT f.k, f.Cluster, pow(x1 - c1, 2) + pow(x2 - c2, 2) + pow(x3 - c3, 2) AS d2
       FROM kf f JOIN kcs c ON f.k = c.k AND f.Cluster = c.Cluster),
kin AS (SELECT k, sum(d2) AS inertia FROM kd GROUP BY k),
ksp AS (SELECT k, Cluster, avg(sqrt(d2)) AS sp FROM kd GROUP BY k, Cluster),
kdb AS (SELECT k, avg(worst) AS davies_bouldin FROM (
          SELECT a.k, a.Cluster,
                 max((sa.sp + sb.sp) / sqrt(pow(a.c1 - b.c1, 2) + pow(a.c2 - b.c2, 2) + pow(a.c3 - b.c3, 2))) AS worst
          FROM kcs a JOIN kcs b ON a.k = b.k AND a.Cluster <> b.Cluster
               JOIN ksp sa ON sa.k = a.k AND sa.Cluster = a.Cluster
               JOIN ksp sb ON sb.k = b.k AND sb.Cluster = b.Cluster
          GROUP BY a.k, a.Cluster) GROUP BY k),
kgm AS (SELECT avg(Recency_s) AS g1, avg(Frequency_s) AS g2, avg(Monetary_s) AS g3, count(*) AS n_all FROM scaled),
kch AS (SELECT k, sum(kcs.N * (pow(c1 - g1, 2) + pow(c2 - g2, 2) + pow(c3 - g3, 2))) AS between,
               count(*) AS kk, any_value(n_all) AS n_all FROM kcs, kgm GROUP BY k),
km AS (SELECT k, inertia, silhouette_sq_euclidean, between * (n_all - kk) / (inertia * (kk - 1)) AS calinski_harabasz, davies_bouldin
       FROM kin JOIN ksil USING (k) JOIN kch USING (k) JOIN kdb USING (k)),
kcons AS (SELECT *, (""" + " + ".join([_norm_sql("inertia", True), _norm_sql("silhouette_sq_euclidean", False),
                                       _norm_sql("calinski_harabasz", False), _norm_sql("davies_bouldin", True)]) + \
    """) / 4.0 AS consensus FROM km)"""


@query("k_consensus", S.with_ctes(*S.BASE, S.SCALED, K_SQL, body="""
SELECT k, round(inertia, 6) AS inertia, round(silhouette_sq_euclidean, 6) AS silhouette_sq_euclidean, round(calinski_harabasz, 4) AS calinski_harabasz,
       round(davies_bouldin, 6) AS davies_bouldin, round(consensus, 6) AS consensus,
       row_number() OVER (ORDER BY consensus DESC, k) = 1 AS best
FROM kcons"""))
def q_k_consensus(spark, sf):
    """M8-M13 over k = 3..8 for deterministic surrogate clusterings (equal-width
    bands of the scaled Monetary), then the four-metric consensus."""
    from concurrent.futures import ThreadPoolExecutor
    from rfmlens.operators.cluster import select_k
    df, _ = B.scaled(spark, sf)
    cols = ["Recency_s", "Frequency_s", "Monetary_s"]

    def one(k):
        d = df.withColumn("Cluster", F.least(F.floor(F.col("Monetary_s") * k), F.lit(k - 1)).cast("int"))
        m = Q.quality_metrics(d, cols)
        return (k, m["inertia"], m["silhouette_sq_euclidean"], m["calinski_harabasz"], m["davies_bouldin"])

    with ThreadPoolExecutor(max_workers=6) as pool:
        rows = list(pool.map(one, range(dims.K_MIN, dims.K_MAX + 1)))
    metrics = spark.createDataFrame(rows, "k INT, inertia DOUBLE, silhouette_sq_euclidean DOUBLE, "
                                          "calinski_harabasz DOUBLE, davies_bouldin DOUBLE")
    t = select_k(metrics)
    return t.select("k", r("inertia", 6).alias("inertia"), r("silhouette_sq_euclidean", 6).alias("silhouette_sq_euclidean"),
                    r("calinski_harabasz", 4).alias("calinski_harabasz"), r("davies_bouldin", 6).alias("davies_bouldin"),
                    r("consensus", 6).alias("consensus"), "best")


@query("random_customer", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Segment FROM scored ORDER BY md5(customer_id || '42'), customer_id LIMIT 1"""))
def q_random(spark, sf):
    """T4: one customer picked by a seeded hash (a distributed top-1)."""
    return L.random_customer(B.scored(spark, sf)).select("customer_id", "Segment")


@query("scored_roundtrip", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary, Cluster, RFM_Total, RFM_Tier, Segment
FROM scored"""))
def q_roundtrip(spark, sf):
    """S5 + S3: write the scored table to the shared checkpoint folder as CSV
    and read it back with its fixed schema."""
    from rfmlens.session import scratch_path
    from rfmlens.sources.readers import read_scored
    from rfmlens.sources.writers import write_scored
    path = scratch_path(spark, "scored")
    out = B.scored(spark, sf).withColumn("PCA1", F.lit(None).cast("double")).withColumn("PCA2", F.lit(None).cast("double"))
    write_scored(out.select([f.name for f in dims.SCORED_SCHEMA.fields]), path, fmt="csv")
    back = read_scored(spark, path, fmt="csv")
    return back.select("customer_id", "Recency", "Frequency", r("Monetary", 2).alias("Monetary"), "Cluster",
                       "RFM_Total", "RFM_Tier", "Segment")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rfmlens.plans import input_queries, ml_queries, report_queries  # noqa: F401  (they register theirs)
    return dict(QUERIES)


def _bigint_counts(sql: str) -> str:
    """``count_if(c)`` is HUGEINT in DuckDB but BIGINT in Spark; the same count
    written ``count(*) FILTER (WHERE c)`` is BIGINT in both."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "count(*) FILTER (WHERE " + _bigint_counts(sql[j + len(key):k - 1]) + ")")
        i = k


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: _bigint_counts(v) for k, v in ORACLES.items()}
