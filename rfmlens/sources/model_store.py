"""Model persistence (S7, S8): Spark ML writers for the KMeans and PCA stages,
parquet for the quantile knots and the cluster map, JSON for the rest."""

from __future__ import annotations

import json

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import PCAModel, StandardScalerModel
from pyspark.sql import SparkSession

from rfmlens.operators.cluster import Centers
from rfmlens.operators.transform import KNOTS, QuantileModel
from rfmlens.plans.train import SegmentModel


def save_model(spark: SparkSession, model: SegmentModel, path: str) -> None:
    path = path.rstrip("/")
    centers = [[float(x) for x in c] for c in model.kmeans.points] if isinstance(model.kmeans, Centers) else None
    if centers is None:
        model.kmeans.write().overwrite().save(f"{path}/kmeans")
    if model.pca is not None:
        scaler, pca, signs = model.pca
        scaler.write().overwrite().save(f"{path}/pca_center")
        pca.write().overwrite().save(f"{path}/pca")
    else:
        signs = None
    model.cluster_map_df(spark).write.mode("overwrite").parquet(f"{path}/cluster_map")
    model.transform.knots.write.mode("overwrite").parquet(f"{path}/knots")
    side = {"caps": model.transform.caps, "n": model.transform.n, "meta": model.meta, "pca_signs": signs, "centers": centers}
    spark.createDataFrame([(json.dumps(side, default=str),)], "value STRING") \
        .coalesce(1).write.mode("overwrite").text(f"{path}/side")


def load_model(spark: SparkSession, path: str) -> SegmentModel:
    path = path.rstrip("/")
    side = json.loads(spark.read.text(f"{path}/side").first()[0])
    km = Centers(side["centers"]) if side["centers"] else KMeansModel.load(f"{path}/kmeans")
    pca = None
    if side.get("pca_signs") is not None:
        pca = (StandardScalerModel.load(f"{path}/pca_center"), PCAModel.load(f"{path}/pca"), side["pca_signs"])
    cmap = [tuple(r) for r in spark.read.parquet(f"{path}/cluster_map")
            .select("Cluster", "Score", "order_pos", "Segment", "SegmentEmoji", "SegmentColor",
                    "Description", "Action").collect()]
    return SegmentModel(km, QuantileModel(side["caps"], spark.read.schema(KNOTS).parquet(f"{path}/knots"), side["n"]), cmap, side["meta"], pca)
