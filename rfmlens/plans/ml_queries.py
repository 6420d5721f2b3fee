"""Registered queries that fit or apply models.

What a fit finds differs between engines, what it must satisfy does not: the oracles of the
fits state those conditions for every customer. Scoring and PCA have full oracles,
on given centres and on the scaled features.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rfmlens import dims
from rfmlens.operators.cluster import (SCALED, Centers, assemble, explained_variance, fit_pca, model_rows, search_k)
from rfmlens.operators.quality import assign_clusters
from rfmlens.operators.transform import fit_transform, transform
from rfmlens.plans import base as B
from rfmlens.plans import sql as S
from rfmlens.plans.catalog import EV_SQL, TRANSFORM_SQL, net_lines, query, r
from rfmlens.plans.score import score
from rfmlens.plans.train import SegmentModel, train
from rfmlens.session import scratch_path
from rfmlens.sources.readers import read_table, txn

K_FIXED = 5
#: Given centres for the scoring queries, on the main diagonal of the scaled features.
POINTS = [[0.1, 0.1, 0.1], [0.3, 0.3, 0.3], [0.5, 0.5, 0.5], [0.7, 0.7, 0.7], [0.9, 0.9, 0.9]]


def _trained(spark, sf):
    return B._memo(spark, sf, "trained", lambda: train(txn(spark, sf), k=K_FIXED))


@query("train_scored", S.with_ctes(*S.BASE, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary, R_Score, F_Score, M_Score, RFM_Total, RFM_Tier,
       TRUE AS nearest, TRUE AS labelled
FROM scores"""))
def q_train_scored(spark, sf):
    """M6/M14/M16/M18 with k forced to 5, cleaned first, all restarts: each customer with
    its scores, whether its cluster is that of the nearest centre and whether its
    segment is the cluster's."""
    res = _trained(spark, sf)
    centers = [list(map(float, c)) for c in res.model.kmeans.clusterCenters()]
    again = assign_clusters(transform(res.scored, res.model.transform), SCALED, centers, "again")
    names = res.model.cluster_map_df(spark).select(F.col("Cluster").alias("c2"), F.col("Segment").alias("s2"))
    return (again.join(names, F.col("Cluster") == F.col("c2"), "left")
            .select("customer_id", "Recency", "Frequency", r("Monetary", 2).alias("Monetary"), "R_Score", "F_Score", "M_Score",
                    "RFM_Total", "RFM_Tier", (F.col("Cluster") == F.col("again")).alias("nearest"),
                    F.coalesce(F.col("Segment") == F.col("s2"), F.lit(False)).alias("labelled")))


@query("k_search", "SELECT CAST(k AS INTEGER) AS k, TRUE AS finite, TRUE AS in_unit, TRUE AS one_best FROM range(3, 9) t(k)")
def q_k_search(spark, sf):
    """Four-metric consensus over k = 3..8 with all restarts: metrics finite, consensus
    between 0 and 1, one k chosen."""
    feats = model_rows(fit_transform(B.rfm(spark, sf))[0])
    best, table = search_k(feats)
    feats.unpersist()
    metrics = ("inertia", "silhouette_euclidean", "calinski_harabasz", "davies_bouldin")
    finite = F.lit(True)
    for m in metrics:
        finite = finite & F.col(m).isNotNull() & ~F.isnan(m)
    return table.select("k", finite.alias("finite"), F.col("consensus").between(0, 1).alias("in_unit"),
                        (F.col("best") == (F.col("k") == best)).alias("one_best"))


def _given_model(spark, sf) -> SegmentModel:
    """Given centres, the customers' transform, segments in template order."""
    _, fitted = B.scaled(spark, sf)
    rows = [(i, float(i), i, name, emoji, color, *dims.SEGMENT_TEXT[name])
            for i, (name, emoji, color) in enumerate(dims.SEGMENTS[:len(POINTS)])]
    return SegmentModel(Centers(POINTS), fitted, rows)


def _nearest_sql() -> str:
    def d(p):
        return " + ".join(f"pow({c}_t - {v}, 2)" for c, v in zip(("Recency", "Frequency", "Monetary"), p))
    dist = ", ".join(f"{d(p)}" for p in POINTS)
    return f"""placed AS (
  SELECT ev.customer_id, ev.Recency, ev.Frequency, ev.Monetary, list_position(ds, list_min(ds)) - 1 AS Cluster
  FROM (SELECT customer_id, [{dist}] AS ds
        FROM tr_Recency JOIN tr_Frequency USING (customer_id) JOIN tr_Monetary USING (customer_id)) t
  JOIN ev ON ev.customer_id = t.customer_id)"""


SCORE_SQL = S.with_ctes(*S.BASE, S.SCALED, EV_SQL, TRANSFORM_SQL, _nearest_sql(), body=f"""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary, CAST(Cluster AS INTEGER) AS Cluster,
       [{", ".join(f"'{n}'" for n, *_ in dims.SEGMENTS)}][Cluster + 1] AS Segment
FROM placed""")


def _score_net(spark, sf, model):
    scored, _ = score(net_lines(spark, sf), model, clean=False)
    return scored.select("customer_id", "Recency", "Frequency", r("Monetary", 2).alias("Monetary"), "Cluster", "Segment")


@query("score_lines", SCORE_SQL)
def q_score_lines(spark, sf):
    """M17 + M5 + M7 on lines the model hasn't seen, every customer."""
    return _score_net(spark, sf, _given_model(spark, sf))


@query("model_roundtrip", SCORE_SQL)
def q_model_roundtrip(spark, sf):
    """The same from the model saved and loaded again."""
    from rfmlens.sources.model_store import load_model, save_model
    path = scratch_path(spark, "model")
    save_model(spark, _given_model(spark, sf), path)
    return _score_net(spark, sf, load_model(spark, path))


@query("score_events", """
SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(1 AS BIGINT) AS Recency, CAST(1 AS BIGINT) AS Frequency,
       round(CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE), 2) AS Monetary, TRUE AS valid
FROM events WHERE user_id IS NOT NULL AND value > 0 GROUP BY user_id""")
def q_score_events(spark, sf):
    """Raw events (header detected, roles generated) scored with the model trained
    on the orders; the cluster must exist and carry its segment."""
    model = _trained(spark, sf).model
    scored, _ = score(read_table(spark, sf, "events"), model)
    names = {row[0]: row[3] for row in model.cluster_map}
    valid = F.lit(False)
    for cluster, name in names.items():
        valid = valid | ((F.col("Cluster") == cluster) & (F.col("Segment") == name))
    return scored.select("customer_id", "Recency", "Frequency", r("Monetary", 2).alias("Monetary"), valid.alias("valid"))


# eigenvalues of the 3x3 covariance in closed form
PCA_SQL = """m AS (SELECT covar_samp(Recency_s, Recency_s) AS a, covar_samp(Frequency_s, Frequency_s) AS b,
  covar_samp(Monetary_s, Monetary_s) AS c, covar_samp(Recency_s, Frequency_s) AS d, covar_samp(Recency_s, Monetary_s) AS e,
  covar_samp(Frequency_s, Monetary_s) AS f FROM scaled),
q AS (SELECT *, (a + b + c) / 3 AS q FROM m),
p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - e * f)
                 + e * (d * f - e * (b - q))) / (2 * p * p * p)))) / 3 AS t FROM p),
ev3 AS (SELECT q + 2 * p * cos(t) AS e1, q + 2 * p * cos(t + 2 * pi() / 3) AS e3, 3 * q AS total FROM t)"""


@query("pca_variance", S.with_ctes(*S.BASE, S.SCALED, PCA_SQL, body="""
SELECT CAST(1 AS INTEGER) AS component, round(e1 / total, 8) AS explained_variance_ratio FROM ev3
UNION ALL SELECT 2, round((total - e1 - e3) / total, 8) FROM ev3"""))
def q_pca_variance(spark, sf):
    """Explained variance ratio of the two display components."""
    df, _ = B.scaled(spark, sf)
    _, pca, _ = fit_pca(assemble(df))
    return spark.createDataFrame([(i + 1, round(float(v), 8)) for i, v in enumerate(explained_variance(pca))],
                                 "component INT, explained_variance_ratio DOUBLE")
