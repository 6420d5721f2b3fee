import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from rfmlens.plans import base as B
from rfmlens.plans.train import train
from rfmlens.streaming import score_arriving_files


def test_files_scored_per_batch(spark):
    lines = B.lines(spark, SF001)
    res = train(lines, k=3, clean=False, final_restarts=1)
    root = tempfile.mkdtemp(prefix="rfmlens-stream-")
    src = os.path.join(root, "in")
    # two "uploads" derived from the supplied tables, as CSV text
    text = lines.select("customer_id", "invoice_id", F.col("invoice_date").cast("string").alias("invoice_date"),
                        "quantity", "unit_price")
    # two periods, as two monthly uploads would be
    days = sorted(r[0] for r in text.select("invoice_date").distinct().collect())   # small fixture
    cut = days[len(days) // 2]
    a = text.where(F.col("invoice_date") < cut)
    b = text.where(F.col("invoice_date") >= cut)
    a.coalesce(1).write.option("header", True).csv(os.path.join(src, "a"))
    b.coalesce(1).write.option("header", True).csv(os.path.join(src, "b"))
    out = os.path.join(root, "out")
    q = score_arriving_files(spark, os.path.join(src, "*"), res.model, out, os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    per_batch = {r["batch_id"]: r["n"] for r in got.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert len(per_batch) == 2
    want = (a.select("customer_id").distinct().count() + b.select("customer_id").distinct().count())
    assert sum(per_batch.values()) == want
    assert got.where(F.col("Segment").isNull()).count() == 0
