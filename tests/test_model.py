import pytest
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from rfmlens.operators.cluster import SCALED, assemble, fit_kmeans
from rfmlens.operators.quality import quality_metrics, silhouette_rows
from rfmlens.operators.transform import fit_transform, transform
from rfmlens.plans import base as B


def test_transform_unseen_equals_training(spark):
    rfm = B.rfm(spark, SF001)
    fitted, model = fit_transform(rfm)
    again = transform(rfm, model, suffix="_t")
    j = fitted.join(again.select("customer_id", *[f"{f}_t" for f in ("Recency", "Frequency", "Monetary")]),
                    "customer_id")
    worst = j.select(*[F.max(F.abs(F.col(f"{f}_s") - F.col(f"{f}_t"))).alias(f)
                       for f in ("Recency", "Frequency", "Monetary")]).first()
    assert max(worst) < 1e-12
    rng = fitted.select(*[F.min(c) for c in SCALED], *[F.max(c) for c in SCALED]).first()
    assert min(rng) >= 0.0 and max(rng) <= 1.0


def test_kmeans_invariants_and_silhouette(spark):
    fitted, _ = fit_transform(B.rfm(spark, SF001))
    feats = assemble(fitted).cache()
    a = fit_kmeans(feats, 4, restarts=1, seed=7)
    b = fit_kmeans(feats, 4, restarts=1, seed=7)
    assert abs(a.cost - b.cost) < 1e-9                      # fixed seed repeats
    more = fit_kmeans(feats, 4, restarts=3, seed=7)
    assert more.cost <= a.cost + 1e-9                      # more restarts never worse
    pred = a.model.transform(feats).withColumn("Cluster", F.col("Cluster").cast("int"))
    labels = {r[0] for r in pred.select("Cluster").distinct().collect()}
    assert labels <= set(range(4))
    q = quality_metrics(pred, SCALED)
    assert abs(q["inertia"] - a.cost) < 1e-6 * max(1.0, a.cost)
    # the squared-Euclidean silhouette equals Spark's evaluator
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="Cluster",
                             distanceMeasure="squaredEuclidean").evaluate(pred)
    assert abs(ev - q["silhouette_sq_euclidean"]) < 1e-9
    # and a brute-force per-row check on a few rows
    rows = [(r["Cluster"], [r[c] for c in SCALED]) for r in pred.collect()]
    sil = {r["customer_id"]: r["silhouette_sq_euclidean"] for r in silhouette_rows(pred, SCALED).collect()}
    cids = [r["customer_id"] for r in pred.collect()]
    for idx in range(0, len(rows), max(1, len(rows) // 10)):
        c, x = rows[idx]
        d = {}
        for j, (cj, y) in enumerate(rows):
            if j != idx:
                d.setdefault(cj, []).append(sum((u - v) ** 2 for u, v in zip(x, y)))
        if c not in d:
            continue
        a_ = sum(d[c]) / len(d[c])
        b_ = min(sum(v) / len(v) for k, v in d.items() if k != c)
        ref = (b_ - a_) / max(a_, b_)
        assert abs(ref - sil[cids[idx]]) < 1e-9


def test_train_score_save_load(spark):
    from rfmlens.plans.score import score
    from rfmlens.plans.train import train
    from rfmlens.sources.model_store import load_model, save_model
    saved = os.path.join(tempfile.mkdtemp(prefix="rfmlens-train-"), "run")
    res = train(B.lines(spark, SF001), k=3, clean=False, final_restarts=1, save_path=saved)
    assert res.scored.count() == B.rfm(spark, SF001).count()
    from rfmlens.sources.readers import load_meta, read_scored
    assert read_scored(spark, saved + "/scored").count() == res.scored.count()
    assert load_meta(spark, saved + "/meta").first()["n_clusters"] == 3
    var = res.model.meta["pca_variance"]
    assert var[0] >= var[1] and sum(var) <= 1 + 1e-9
    path = os.path.join(tempfile.mkdtemp(prefix="rfmlens-model-"), "m")
    save_model(spark, res.model, path)
    loaded = load_model(spark, path)
    s1, _ = score(B.lines(spark, SF001), res.model, clean=False, refit_pca=False)
    s2, _ = score(B.lines(spark, SF001), loaded, clean=False, refit_pca=False)
    cols = ["customer_id", "Cluster", "Segment", "PCA1", "PCA2"]
    a = sorted(tuple(r) for r in s1.select(cols).collect())
    b = sorted(tuple(r) for r in s2.select(cols).collect())
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(abs(x[3] - y[3]) < 1e-9 and abs(x[4] - y[4]) < 1e-9 for x, y in zip(a, b))
    # scoring the training lines reproduces the training clusters
    train_c = {r["customer_id"]: r["Cluster"] for r in res.scored.select("customer_id", "Cluster").collect()}
    assert all(train_c[r[0]] == r[1] for r in a)


@pytest.mark.parametrize("buckets", [None, 5])
def test_transform_of_training_rows_is_exact(spark, buckets):
    """M5 on the training rows equals M4 for every row, over one bucket or many."""
    rfm = B.rfm(spark, SF001)
    exact, model = fit_transform(rfm)
    cols = ["Recency", "Frequency", "Monetary"]
    out = transform(rfm, model, suffix="_t", buckets=buckets).join(exact.select("customer_id", *[c + "_s" for c in cols]), "customer_id")
    rows = out.collect()
    assert len(rows) == rfm.count()
    assert all(r[c + "_t"] == pytest.approx(r[c + "_s"], abs=1e-12) for r in rows for c in cols)


@pytest.mark.parametrize("buckets", [None, 4])
def test_transform_between_and_beyond_knots(spark, buckets):
    """Values of one feature between, on and beyond the knots, by hand."""
    from rfmlens.operators.transform import KNOTS, QuantileModel
    knots = [("x", float(v), i / 9, i / 9) for i, v in enumerate([1, 2, 4, 8, 16, 32, 64, 128, 256, 512])]
    model = QuantileModel({}, spark.createDataFrame(knots, KNOTS), 10)
    values = [-5.0, 1.0, 1.5, 3.0, 100.0, 300.0, 512.0, 1000.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x DOUBLE")
    got = [r["x_s"] for r in transform(df, model, ["x"], buckets=buckets).orderBy("i").collect()]
    want = [0.0, 0.0, 0.5 / 9, 1.5 / 9, (6 + 36 / 64) / 9, (8 + 44 / 256) / 9, 1.0, 1.0, None]
    assert got == [w if w is None else pytest.approx(w) for w in want]
