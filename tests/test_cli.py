import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from rfmlens.__main__ import main
from rfmlens.plans import base as B


def test_train_then_score(spark):
    root = tempfile.mkdtemp(prefix="rfmlens-cli-")
    text = B.lines(spark, SF001).select("customer_id", "invoice_id",
                                        F.col("invoice_date").cast("string").alias("invoice_date"),
                                        "quantity", "unit_price")
    text.coalesce(1).write.option("header", True).csv(os.path.join(root, "sales"))
    main(["train", "--data", os.path.join(root, "sales"), "--out", os.path.join(root, "run"),
          "--clusters", "3", "--final-restarts", "1"])
    main(["score", "--data", os.path.join(root, "sales"), "--model", os.path.join(root, "run", "model"),
          "--out", os.path.join(root, "new")])
    scored = spark.read.parquet(os.path.join(root, "new", "scored"))
    trained = spark.read.parquet(os.path.join(root, "run", "scored"))
    assert scored.count() == trained.count() == 150
    j = scored.select("customer_id", "Cluster").join(trained.select("customer_id", F.col("Cluster").alias("c")),
                                                     "customer_id")
    assert j.where("Cluster <> c").count() == 0


def test_score_upload_messages(spark):
    from rfmlens.plans.score import score_upload
    from rfmlens.plans.train import train
    res = train(B.lines(spark, SF001), k=3, clean=False, final_restarts=1)
    root = tempfile.mkdtemp(prefix="rfmlens-upload-")
    scored, report, msg = score_upload(spark, os.path.join(root, "missing.csv"), res.model)
    assert scored is None and "not found" in msg
    ev = os.path.join(root, "ev")
    spark.read.parquet(f"{SF001}/events.parquet").coalesce(1).write.option("header", True).csv(ev)
    scored, report, msg = score_upload(spark, ev, res.model)
    assert scored.count() > 0 and "no column for invoice_id" in msg and "no column for quantity" in msg
    bad = os.path.join(root, "bad")
    spark.createDataFrame([("x", "-1")], "customer STRING, price STRING").coalesce(1) \
        .write.option("header", True).csv(bad)
    scored, report, msg = score_upload(spark, bad, res.model)
    assert scored is None and msg.startswith("No valid customer records")
