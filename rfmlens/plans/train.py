"""Training plan (M18): clean -> RFM -> caps + quantile transform -> choose k
-> final KMeans -> scores, labels, PCA -> metrics and metadata.

The RFM table is the result of the one big shuffle over the line items; it
is checkpointed to the shared ``spark.checkpoint.dir`` so that the many
KMeans jobs after it never recompute the scan and the join, even when
executors are lost.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rfmlens import dims
from rfmlens.operators.clean import clean_transactions
from rfmlens.operators.cluster import (FINAL_WORK, SCALED, SEARCH_WORK, Centers, assemble, explained_variance, fit_pca, model_rows,
                                       pca_coordinates, predict, search_k)
from rfmlens.operators.insights import cluster_quality, cluster_warnings
from rfmlens.operators.labels import apply_labels, assign_segment_labels
from rfmlens.operators.lloyd import best_fits
from rfmlens.operators.quality import SILHOUETTE, fit_verdict, quality_metrics
from rfmlens.operators.ranks import feature_ranks
from rfmlens.operators.rfm import compute_rfm, describe_features
from rfmlens.operators.scoring import add_rfm_scores
from rfmlens.operators.silhouette import EUCLIDEAN, euclidean_points, euclidean_rows, euclidean_summary
from rfmlens.operators.transform import QuantileModel, cap_report, fit_transform
from rfmlens.session import checkpoint_dir


@dataclass
class SegmentModel:
    """Everything scoring needs (S7): KMeans centres (a fitted model or
    ``Centers``), the quantile transform, the cluster -> segment map and metadata."""
    kmeans: object
    transform: QuantileModel
    cluster_map: list[tuple]
    meta: dict = field(default_factory=dict)
    pca: tuple | None = None

    def cluster_map_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.cluster_map, "Cluster INT, Score DOUBLE, order_pos INT, Segment STRING, "
                                                       "SegmentEmoji STRING, SegmentColor STRING, "
                                                       "Description STRING, Action STRING")


def _collected(cmap: DataFrame):
    """The <= k-row cluster map read once: rows for the model, and a local
    DataFrame of them for the broadcast join."""
    rows = [tuple(r) for r in cmap.collect()]
    return rows, cmap.sparkSession.createDataFrame(rows, cmap.schema)


@dataclass
class TrainResult:
    scored: DataFrame
    model: SegmentModel
    metrics: dict
    k_table: DataFrame | None
    #: What a training run reports: cleaning (if it cleaned), describe, caps, quality, warnings.
    report: dict[str, DataFrame] = field(default_factory=dict)
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Drop the cached tables behind this result; its frames then recompute."""
        for df in self.cached:
            df.unpersist()


def train(df: DataFrame, k: int | None = None, currency: str = "USD", clean: bool = True,
          search_restarts: int = SEARCH_WORK[0], final_restarts: int = FINAL_WORK[0],
          search_max_iter: int = SEARCH_WORK[1], final_max_iter: int = FINAL_WORK[1],
          search_tol: float = SEARCH_WORK[2], final_tol: float = FINAL_WORK[2],
          seed: int = 42, k_min: int = dims.K_MIN, k_max: int = dims.K_MAX,
          row_id_col: str | None = None, snapshot=None, save_path: str | None = None) -> TrainResult:
    """M18. ``df`` is raw transactions (any header) when ``clean`` is true,
    else canonical line items with ``line_total``. With ``save_path`` the scored
    customers (S5), the model (S7), the metadata (S6) and the report's tables are written under
    that folder. The verdict, the negative silhouettes and the quality report are those of the Euclidean silhouette."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    lines, cleaning = clean_transactions(df, row_id_col=row_id_col) if clean else (df, None)
    rfm, rfm_snapshot = compute_rfm(lines, snapshot, return_snapshot=True)
    ranks = feature_ranks(rfm, ["Recency", "Frequency", "Monetary"])
    ranks.df = ranks.df.cache()                # shared by the transform and the scores
    scaled, qmodel = fit_transform(rfm, ranks=ranks)
    feats = model_rows(scaled)

    best_k, k_table = search_k(feats, k_min, k_max, search_restarts, search_max_iter, search_tol,
                               seed, force_k=k)
    fit = best_fits(feats, SCALED, [best_k], final_restarts, final_max_iter, final_tol, seed)[best_k]
    centers = Centers(fit.points.tolist())
    pred = predict(centers, feats)
    scored = add_rfm_scores(predict(centers, assemble(scaled)), ranks=ranks).cache()
    scored_cache = scored
    # independent pieces: submitted together so their jobs overlap
    with ThreadPoolExecutor(max_workers=4) as pool:
        f_sil = pool.submit(euclidean_points, pred, SCALED)
        f_cmap = pool.submit(lambda: _collected(assign_segment_labels(scored, best_k)))
        f_pca = pool.submit(fit_pca, feats)
        f_q = pool.submit(quality_metrics, pred, SCALED)
        cmap_rows, cmap = f_cmap.result()
        scaler, pca, signs = f_pca.result()
        metrics = f_q.result()
        points = f_sil.result()
    metrics |= euclidean_summary(points)
    scored = pca_coordinates(scored, scaler, pca, signs)
    scored = apply_labels(scored, cmap)
    code, symbol, name = dims.currency_record(currency)
    meta = {
        "currency_code": code, "currency_symbol": symbol, "currency_name": name,
        "n_clusters": best_k, "trained_on": str(_dt.date.today()),
        "rfm_snapshot": str(rfm_snapshot),
        "scaler_type": "quantile_uniform_midrank", "cap_values": qmodel.caps,
        EUCLIDEAN: metrics[EUCLIDEAN], "silhouette_error": metrics["euclidean_error"], "n_negative": metrics["n_negative_euclidean"],
        SILHOUETTE: metrics[SILHOUETTE], "davies_bouldin": metrics["davies_bouldin"],
        "calinski_harabasz": metrics["calinski_harabasz"], "inertia": fit.cost,
        "pca_variance": explained_variance(pca), "n_customers": qmodel.n, "n_iter": fit.iterations,
        "fit_verdict": fit_verdict(metrics[EUCLIDEAN], dims.SIL_WARN, dims.SIL_GOOD),
    }
    model = SegmentModel(centers, qmodel, cmap_rows, meta, (scaler, pca, signs))
    quality = cluster_quality(euclidean_rows(scored, SCALED, points=points), EUCLIDEAN)
    report = {"describe": describe_features(rfm), "caps": cap_report(rfm, qmodel.caps),
              "quality": quality, "warnings": cluster_warnings(quality, dims.LOW_SIL)}
    if cleaning is not None:
        report["cleaning"] = cleaning
    out = scored.select("customer_id", "Recency", "Frequency", "Monetary", "Cluster", "R_Score", "F_Score",
                        "M_Score", "RFM_Total", "RFM_Tier", "PCA1", "PCA2", "Segment", "SegmentEmoji",
                        "SegmentColor")
    if save_path:
        from rfmlens.sources.model_store import save_model
        from rfmlens.sources.writers import write_meta, write_scored
        root = save_path.rstrip("/")
        write_scored(out, f"{root}/scored")
        save_model(spark, model, f"{root}/model")
        write_meta(spark, meta, f"{root}/meta")
        for name, table in report.items():
            write_scored(table, f"{root}/report/{name}")
    return TrainResult(out, model, metrics, k_table, report, [feats, scored_cache, ranks.df])
