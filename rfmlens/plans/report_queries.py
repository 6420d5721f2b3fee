"""Registered queries on defaults, texts and further features of the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rfmlens import dims
from rfmlens.functions import day_text, format_currency
from rfmlens.operators import insights as G
from rfmlens.operators import lookup as L
from rfmlens.operators.labels import action_cards, assign_segment_labels, convert_currency, interpret_clusters, quick_wins, with_currency
from rfmlens.operators.rfm import global_kpis
from rfmlens.plans import base as B
from rfmlens.plans import sql as S
from rfmlens.plans.catalog import RATES, TOP_SQL, _money_sql, query, r


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _box_sql(f: str) -> str:
    return S.with_ctes(*S.BASE, body=f"""
SELECT Segment, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower_fence,
       round(q3 + 1.5 * (q3 - q1), 4) AS upper_fence, min, max, outliers, '{f}' AS feature
FROM (SELECT Segment, any_value(q1) AS q1, any_value(med) AS med, any_value(q3) AS q3, CAST(min({f}) AS DOUBLE) AS min,
             CAST(max({f}) AS DOUBLE) AS max,
             count(*) FILTER ({f} < q1 - 1.5 * (q3 - q1) OR {f} > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM scored JOIN (SELECT Segment, quantile_cont({f}, 0.25) AS q1, quantile_cont({f}, 0.5) AS med,
                               quantile_cont({f}, 0.75) AS q3 FROM scored GROUP BY Segment) USING (Segment) GROUP BY Segment)""")


def _box(f: str):
    @query(f"box_stats_{f.lower()}", _box_sql(f))
    def run(spark, sf):
        b = G.box_stats(B.scored(spark, sf), f)
        return b.select("Segment", *[r(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_fence", "upper_fence")],
                        "min", "max", "outliers", "feature")
    run.__doc__ = f"G13 for {f}."


_box("Recency")
_box("Frequency")


@query("kpi_texts", S.with_ctes(*S.BASE, body=f"""
SELECT format('{{:,}}', count(*)) AS customers, {_money_sql('avg(Monetary)')} AS avg_revenue,
       {_money_sql('median(round(Monetary, 2))')} AS median_revenue, format('{{:.0f}}', round_even(avg(Recency), 0)) || 'd' AS avg_recency,
       format('{{:.0f}}', round_even(median(Recency), 0)) || 'd' AS median_recency
FROM scored"""))
def q_kpi_texts(spark, sf):
    """A10 as text, medians included (H1, H5)."""
    k = global_kpis(B.scored(spark, sf), ranks=B.ranks(spark, sf))
    return k.select(F.format_number("customers", 0).alias("customers"), format_currency("avg_revenue", "$").alias("avg_revenue"),
                    format_currency("median_revenue", "$").alias("median_revenue"), day_text("avg_recency").alias("avg_recency"),
                    day_text("median_recency").alias("median_recency"))


# the map without its first cluster: that one falls back to the defaults
@query("interpret_defaults", S.with_ctes(*S.BASE, f"""texts(Segment, Description, Action) AS (
  VALUES {_values((n, *t) for n, t in dims.SEGMENT_TEXT.items())})""", body=f"""
SELECT Cluster, CASE WHEN Cluster = 0 THEN 'Segment 0' ELSE Segment END AS Segment,
       CASE WHEN Cluster = 0 THEN '📦' ELSE SegmentEmoji END AS SegmentEmoji,
       CASE WHEN Cluster = 0 THEN '#94a3b8' ELSE SegmentColor END AS SegmentColor,
       CASE WHEN Cluster = 0 THEN '{dims.UNKNOWN_SEGMENT_TEXT[0]}' ELSE Description END AS Description,
       CASE WHEN Cluster = 0 THEN '{dims.UNKNOWN_SEGMENT_TEXT[1]}' ELSE Action END AS Action
FROM cmap JOIN texts USING (Segment)"""))
def q_interpret_defaults(spark, sf):
    """J2 with descriptions and actions, one cluster without a mapping."""
    return interpret_clusters(B.scored(spark, sf), B.cluster_map(spark, sf).where("Cluster <> 0"))


@query("profile_defaults", S.with_ctes(*S.BASE, TOP_SQL, body=f"""
SELECT customer_id, Cluster, 'Unknown' AS Segment, '📦' AS SegmentEmoji, '#64748b' AS SegmentColor, '' AS Description, '' AS Action,
       CAST(Recency AS VARCHAR) || 'd' AS Recency_text, CAST(Frequency AS VARCHAR) AS Frequency_text,
       {_money_sql('Monetary')} AS Monetary_text
FROM scored WHERE customer_id = (SELECT customer_id FROM top)"""))
def q_profile_defaults(spark, sf):
    """J7 for a cluster without a mapping."""
    none = B.cluster_map(spark, sf).where("Cluster < 0")
    p = L.customer_profile(B.scored(spark, sf), none, B.top_customer(spark, sf))
    return p.select("customer_id", "Cluster", "Segment", "SegmentEmoji", "SegmentColor", "Description", "Action",
                    "Recency_text", "Frequency_text", "Monetary_text")


@query("unknown_currency", S.with_ctes(*S.BASE, body=f"""
SELECT customer_id, {_money_sql('Monetary')} AS Monetary_text, 'USD' AS currency_code, round(Monetary, 2) AS Monetary,
       CAST(NULL AS DOUBLE) AS rate
FROM scored"""))
def q_unknown_currency(spark, sf):
    """J5 with an unknown code (USD) and H3 without a rate (money stays as it is)."""
    rates = spark.createDataFrame(RATES, "base STRING, target STRING, rate DOUBLE")
    text = with_currency(B.scored(spark, sf), "xyz")
    return convert_currency(text, rates, "USD", "XYZ").select("customer_id", "Monetary_text", "currency_code",
                                                              r("Monetary", 2).alias("Monetary"), "rate")


@query("segment_map_8", S.with_ctes(*S.BASE, f"""s8 AS (SELECT *, CAST(least(R_Score, 4) - 1 + CASE WHEN M_Score > 3 THEN 4 ELSE 0 END AS INTEGER) AS c8 FROM scores),
m8 AS (SELECT c8, avg(Recency) AS mR, avg(Frequency) AS mF, avg(Monetary) AS mM FROM s8 GROUP BY c8),
o8 AS (SELECT c8, -{S._avg_rank('mR')} + {S._avg_rank('mF')} + {S._avg_rank('mM')} AS Score FROM m8),
p8 AS (SELECT *, row_number() OVER (ORDER BY Score DESC, c8) - 1 AS pos FROM o8),
t8(rank_pos, Segment, Description, Action) AS (VALUES {_values((i, n, *dims.SEGMENT_TEXT[n]) for i, (n, *_) in enumerate(dims.SEGMENTS))})""", body="""
SELECT c8 AS Cluster, Score, CAST(pos AS BIGINT) AS order_pos, Segment, Description, Action FROM p8 JOIN t8 ON rank_pos = pos % 6"""))
def q_segment_map_8(spark, sf):
    """W1-W3 with up to 8 clusters for 6 templates: the templates go round."""
    df = B.scores(spark, sf).withColumn("Cluster", (F.least("R_Score", F.lit(4)) - 1 + F.when(F.col("M_Score") > 3, 4).otherwise(0)).cast("int"))
    return assign_segment_labels(df, 8).select("Cluster", "Score", F.col("order_pos").cast("long").alias("order_pos"),
                                               "Segment", "Description", "Action")


@query("action_texts", S.with_ctes(*S.BASE, f"""texts(Segment, Description, Action) AS (
  VALUES {_values((n, *t) for n, t in dims.SEGMENT_TEXT.items())}),
quick(Segment, Why, Todo) AS (VALUES {_values((n, *t) for n, t in dims.QUICK_WIN_TEXT.items())})""", body="""
SELECT 'card' AS kind, Segment, Description, Action FROM cmap JOIN texts USING (Segment)
UNION ALL SELECT 'quick win', Segment, Why, Todo FROM quick"""))
def q_action_texts(spark, sf):
    """Descriptions and actions of the cards and quick wins."""
    cards = action_cards(B.scored(spark, sf), B.cluster_map(spark, sf)).select(F.lit("card").alias("kind"), "Segment", "Description", "Action")
    return cards.unionAll(quick_wins(B.scored(spark, sf)).select(F.lit("quick win").alias("kind"), "Segment", "Description", "Action"))


@query("peer_table", S.with_ctes(*S.BASE, TOP_SQL, f"""rng AS (
  SELECT max(Recency) - min(Recency) + 1e-9 AS r, max(Frequency) - min(Frequency) + 1e-9 AS f, max(Monetary) - min(Monetary) + 1e-9 AS m FROM scored)""", body=f"""
SELECT p.customer_id AS "Customer ID", p.Recency AS "Recency (days)", p.Frequency, {_money_sql('p.Monetary')} AS "Revenue (USD)"
FROM scored p, scored me, rng
WHERE me.customer_id = (SELECT customer_id FROM top) AND p.Segment = me.Segment AND p.customer_id <> me.customer_id
QUALIFY row_number() OVER (ORDER BY pow((p.Recency - me.Recency) / r, 2) + pow((p.Frequency - me.Frequency) / f, 2)
                                    + pow((p.Monetary - me.Monetary) / m, 2), p.customer_id) <= 10"""))
def q_peer_table(spark, sf):
    """P7 on T3: the ten nearest peers as displayed."""
    return L.peer_table(L.nearest_peers(B.scored(spark, sf), B.top_customer(spark, sf)))
