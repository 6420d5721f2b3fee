"""KMeans with restarts, k selection and PCA coordinates.

The search and the final fit take all restarts of all k together (``operators.lloyd``); ``fit_kmeans``
is one k with Spark ML, whose restarts are independent jobs (``initMode`` k-means||).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from rfmlens import dims
from rfmlens.operators.lloyd import best_fits
from rfmlens.operators.quality import SILHOUETTE, assign_clusters, quality_metrics
from rfmlens.operators.silhouette import EUCLIDEAN, clustering_points

SCALED = ["Recency_s", "Frequency_s", "Monetary_s"]


def assemble(df: DataFrame, cols=SCALED, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


@dataclass
class Fit:
    model: KMeansModel
    cost: float
    seed: int
    iterations: int


#: Work of the search and of the final fit: restarts, iterations, tolerance.
SEARCH_WORK, FINAL_WORK = (30, 1000, 1e-6), (50, 2000, 1e-7)
ROWS_PER_PARTITION = 250_000


def model_rows(df: DataFrame, key: str = "customer_id", cols=SCALED) -> DataFrame:
    """What the fits read, cached: key, features and the vector, in as few
    partitions as the number of rows needs (a fit is many short passes)."""
    narrow = assemble(df.select(key, *cols), cols)
    n = narrow.count()
    return narrow.coalesce(max(1, -(-n // ROWS_PER_PARTITION))).cache()


def fit_kmeans(feats: DataFrame, k: int, restarts: int = FINAL_WORK[0], max_iter: int = FINAL_WORK[1], tol: float = FINAL_WORK[2],
               seed: int = 42, features_col: str = "features", parallelism: int = 8) -> Fit:
    """M6: best of ``restarts`` fits (lowest training cost; ties -> lower
    seed). Independent fits are submitted from a small driver thread pool,
    as Spark ML's ``CrossValidator(parallelism=...)`` does, so their jobs
    share the cluster instead of queueing."""
    def one(r: int) -> Fit:
        km = KMeans(k=k, initMode="k-means||", maxIter=max_iter, tol=tol, seed=seed + r,
                    featuresCol=features_col, predictionCol="Cluster")
        m = km.fit(feats)
        return Fit(m, float(m.summary.trainingCost), seed + r, int(m.summary.numIter))

    n = max(1, restarts)
    if parallelism > 1 and n > 1:
        with ThreadPoolExecutor(max_workers=min(parallelism, n)) as pool:
            fits = list(pool.map(one, range(n)))
    else:
        fits = [one(r) for r in range(n)]
    return min(fits, key=lambda f: (f.cost, f.seed))


@dataclass
class Centers:
    """Cluster centres from elsewhere, in the place of a fitted model."""
    points: list[list[float]]

    def clusterCenters(self):  # noqa: N802 - as KMeansModel names it
        return self.points


def predict(model: KMeansModel | Centers, feats: DataFrame, cols=SCALED) -> DataFrame:
    """M7 with a fitted model or given centres."""
    if isinstance(model, Centers):
        return assign_clusters(feats, list(cols), model.points)
    return model.transform(feats).withColumn("Cluster", F.col("Cluster").cast("int"))


def select_k(metrics: DataFrame, silhouette: str = SILHOUETTE) -> DataFrame:
    """M13 on a metrics table (k, inertia, ``silhouette``, calinski_harabasz,
    davies_bouldin): each metric min-max scaled over the k values (inertia
    and DB inverted, flat range -> denominator 1), averaged; rows in k order
    with ``consensus`` and ``best`` (first maximum). <= 6 rows."""
    w = Window.partitionBy()

    def scaled(c, lower_better):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        rng = F.when(hi - lo > 0, hi - lo).otherwise(F.lit(1.0))
        v = (F.col(c) - lo) / rng
        return 1 - v if lower_better else v

    # an undefined metric (NaN) is no score at all: NULL, so it neither wins
    # the comparison (Spark sorts NaN above every number) nor shifts min/max
    clean = metrics.select("k", *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
                                  for c in ("inertia", silhouette, "calinski_harabasz", "davies_bouldin")])
    out = clean.withColumn("consensus", (scaled("inertia", True) + scaled(silhouette, False) +
                                         scaled("calinski_harabasz", False) +
                                         scaled("davies_bouldin", True)) / 4.0)
    first_max = F.row_number().over(Window.orderBy(F.desc_nulls_last("consensus"), "k"))
    return out.withColumn("best", first_max == 1).orderBy("k")


def search_k(feats: DataFrame, k_min: int = dims.K_MIN, k_max: int = dims.K_MAX,
             restarts: int = SEARCH_WORK[0], max_iter: int = SEARCH_WORK[1], tol: float = SEARCH_WORK[2], seed: int = 42, force_k: int | None = None,
             cols=SCALED) -> tuple[int, DataFrame | None]:
    """Choose k by the four-metric consensus, or take ``force_k``. All fits share their passes, all
    silhouettes (Euclidean) their distances."""
    if force_k:
        return int(force_k), None
    ks = list(range(k_min, k_max + 1))
    fits = best_fits(feats, list(cols), ks, restarts, max_iter, tol, seed)
    marked = feats.select(*cols)
    for k in ks:
        marked = assign_clusters(marked, list(cols), fits[k].points.tolist(), f"k{k}")

    def one(k: int):
        q = quality_metrics(marked.select(*cols, F.col(f"k{k}").alias("Cluster")), list(cols))
        return q["calinski_harabasz"], q["davies_bouldin"]
    with ThreadPoolExecutor(max_workers=len(ks) + 1) as pool:
        points = pool.submit(clustering_points, marked, list(cols), [f"k{k}" for k in ks])
        scores = list(pool.map(one, ks))
        points = points.result()
    means = points.agg(F.sum("n").alias("n"), *[F.sum(F.get("silhouettes", F.lit(i)) * F.col("n")).alias(f"k{k}") for i, k in enumerate(ks)]).first()
    rows = [(k, fits[k].cost, means[f"k{k}"] / means["n"], *s) for k, s in zip(ks, scores)]
    metrics = feats.sparkSession.createDataFrame(
        rows, f"k INT, inertia DOUBLE, {EUCLIDEAN} DOUBLE, calinski_harabasz DOUBLE, davies_bouldin DOUBLE")
    table = select_k(metrics, EUCLIDEAN)
    best = table.where("best").select("k").first()["k"]
    return int(best), table


def fit_pca(feats: DataFrame, features_col: str = "features"):
    """Centre (no scaling), then PCA to 2 components. Spark's PCA does not
    centre the projection, so the StandardScaler stage does. Returns
    (scaler model, pca model, sign flips) with each component's largest
    absolute loading made positive."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol=features_col,
                            outputCol="_centered").fit(feats)
    pca = PCA(k=2, inputCol="_centered", outputCol="_pca").fit(scaler.transform(feats))
    pc = pca.pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        signs.append(-1.0 if col[abs(col).argmax()] < 0 else 1.0)
    return scaler, pca, signs


def pca_coordinates(feats: DataFrame, scaler, pca, signs, features_col: str = "features") -> DataFrame:
    """PCA1 / PCA2 columns (display only)."""
    out = pca.transform(scaler.transform(feats))
    arr = vector_to_array("_pca")
    return (out.withColumn("PCA1", arr[0] * signs[0]).withColumn("PCA2", arr[1] * signs[1])
            .drop("_centered", "_pca"))


def explained_variance(pca) -> list[float]:
    return [float(x) for x in pca.explainedVariance.toArray()]
