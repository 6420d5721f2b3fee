"""DuckDB oracle SQL: common table expressions mirroring ``plans.base``.

Written independently from the Spark code, from the survey's definitions,
so that the driver's side-by-side run checks one against the other.
"""

from __future__ import annotations

from rfmlens import dims

TXN = """txn AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(o_orderkey AS VARCHAR) AS invoice_id,
         CAST(o_orderdate AS TIMESTAMP) AS invoice_date,
         CAST(l_quantity AS DOUBLE) AS quantity,
         l_extendedprice / l_quantity AS unit_price,
         l_quantity * (l_extendedprice / l_quantity) AS line_total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

TXN_EVENTS = """txn AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id AS VARCHAR) AS invoice_id,
         CAST(ts AS TIMESTAMP) AS invoice_date, 1.0::DOUBLE AS quantity,
         CAST(value AS DOUBLE) AS unit_price, 1.0::DOUBLE * CAST(value AS DOUBLE) AS line_total
  FROM events)"""

RFM = """per_c AS (
  SELECT customer_id, max(invoice_date) AS last_purchase,
         count(DISTINCT invoice_id) AS Frequency,
         CAST(sum(CAST(line_total AS DECIMAL(38, 6))) AS DOUBLE) AS Monetary
  FROM txn GROUP BY customer_id),
rfm0 AS (
  SELECT customer_id,
         CAST(greatest(date_sub('day', last_purchase,
              (SELECT max(last_purchase) FROM per_c) + INTERVAL 1 DAY), 0) AS BIGINT) AS Recency,
         CAST(Frequency AS BIGINT) AS Frequency, CAST(Monetary AS DOUBLE) AS Monetary
  FROM per_c),
rfm AS (SELECT * FROM rfm0 WHERE Recency >= 0 AND Frequency > 0 AND Monetary > 0)"""


def _score(col: str, edges: str, asc: bool) -> str:
    above = " + ".join(f"CAST({col} > {edges}[{i}] AS INTEGER)" for i in range(2, 6))
    s = f"(1 + {above})"
    s = s if asc else f"(6 - {s})"
    return f"CASE WHEN len(list_distinct({edges})) = 6 THEN CAST({s} AS INTEGER) END"


SCORES = f"""edges AS (
  SELECT quantile_cont(Recency, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS er,
         quantile_cont(Frequency, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS ef,
         quantile_cont(Monetary, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS em FROM rfm),
sc0 AS (
  SELECT rfm.*, {_score('Recency', 'er', False)} AS R_Score,
         {_score('Frequency', 'ef', True)} AS F_Score,
         {_score('Monetary', 'em', True)} AS M_Score
  FROM rfm, edges),
scores AS (
  SELECT *, CAST(R_Score + F_Score + M_Score AS INTEGER) AS RFM_Total,
         CASE WHEN R_Score + F_Score + M_Score IS NULL THEN NULL
              WHEN R_Score + F_Score + M_Score >= {dims.TIER_HIGH} THEN 'High Value'
              WHEN R_Score + F_Score + M_Score >= {dims.TIER_MID} THEN 'Mid Value'
              ELSE 'Low Value' END AS RFM_Tier
  FROM sc0)"""


def _templates(n: int) -> str:
    rows = ", ".join(f"({i}, '{name}', '{emo}', '{col}')"
                     for i, (name, emo, col) in enumerate(dims.SEGMENTS[:n]))
    return f"tpl(rank_pos, Segment, SegmentEmoji, SegmentColor) AS (VALUES {rows})"


def _avg_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


N = 5
LABELS = f"""surr AS (SELECT *, CAST(M_Score - 1 AS INTEGER) AS Cluster FROM scores),
cmeans AS (SELECT Cluster, avg(Recency) AS mR, avg(Frequency) AS mF, avg(Monetary) AS mM
           FROM surr GROUP BY Cluster),
cscore AS (SELECT Cluster, -{_avg_rank('mR')} + {_avg_rank('mF')} + {_avg_rank('mM')} AS Score FROM cmeans),
corder AS (SELECT Cluster, Score, row_number() OVER (ORDER BY Score DESC, Cluster) - 1 AS order_pos FROM cscore),
{_templates(N)},
cmap AS (SELECT c.Cluster, c.Score, c.order_pos, t.Segment, t.SegmentEmoji, t.SegmentColor
         FROM corder c JOIN tpl t ON t.rank_pos = c.order_pos % {min(N, len(dims.SEGMENTS))}),
scored AS (SELECT s.*, m.Segment, m.SegmentEmoji, m.SegmentColor FROM surr s JOIN cmap m USING (Cluster))"""


def _scaled_col(f: str) -> str:
    return f"""CASE WHEN n_{f} <= 1 THEN 0.0 WHEN nl_{f} = 0 THEN 0.0 WHEN nq_{f} = n_{f} THEN 1.0
              ELSE (nl_{f} + nq_{f} - 1) / 2.0 / (n_{f} - 1) END AS {f}_s"""


SCALED = """caps AS (SELECT quantile_cont(Recency, 0.99) AS cR, quantile_cont(Frequency, 0.99) AS cF,
                      quantile_cont(Monetary, 0.99) AS cM FROM scored),
capped AS (SELECT s.*, least(CAST(Recency AS DOUBLE), cR) AS xR, least(CAST(Frequency AS DOUBLE), cF) AS xF,
                  least(Monetary, cM) AS xM FROM scored s, caps),
ranked AS (SELECT *,
   rank() OVER (ORDER BY xR) - 1 AS nl_Recency, count(*) OVER (ORDER BY xR) AS nq_Recency, count(*) OVER () AS n_Recency,
   rank() OVER (ORDER BY xF) - 1 AS nl_Frequency, count(*) OVER (ORDER BY xF) AS nq_Frequency, count(*) OVER () AS n_Frequency,
   rank() OVER (ORDER BY xM) - 1 AS nl_Monetary, count(*) OVER (ORDER BY xM) AS nq_Monetary, count(*) OVER () AS n_Monetary
   FROM capped),
scaled AS (SELECT *, """ + ",\n ".join(_scaled_col(f) for f in ("Recency", "Frequency", "Monetary")) + """
   FROM ranked)"""

SIL = """feat AS (SELECT customer_id, Cluster, Recency_s AS x1, Frequency_s AS x2, Monetary_s AS x3 FROM scaled),
cs AS (SELECT Cluster, count(*) AS N, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3,
              sum(x1 * x1 + x2 * x2 + x3 * x3) AS psi FROM feat GROUP BY Cluster),
md AS (SELECT f.customer_id, f.Cluster AS own, c.Cluster AS other, c.N,
              (f.x1 * f.x1 + f.x2 * f.x2 + f.x3 * f.x3) + c.psi / c.N
              - 2 * (f.x1 * c.s1 + f.x2 * c.s2 + f.x3 * c.s3) / c.N AS d
       FROM feat f, cs c),
ab AS (SELECT customer_id, own, max(CASE WHEN other = own THEN N END) AS own_n,
              max(CASE WHEN other = own AND N > 1 THEN d * N / (N - 1) END) AS a,
              min(CASE WHEN other <> own THEN d END) AS b
       FROM md GROUP BY customer_id, own),
sil AS (SELECT customer_id, own AS Cluster,
               CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END
               AS silhouette_sq_euclidean FROM ab)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


BASE = (TXN, RFM, SCORES, LABELS)
