"""Inputs as they come: CSV dialect, cleaning of spoiled columns, zones, shares."""

import datetime as dt
import os
import random
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rfmlens.operators.clean import clean_transactions
from rfmlens.operators.insights import cluster_warnings
from rfmlens.operators.quality import fit_verdict, squared_limit
from rfmlens.operators.ranks import value_ranks
from rfmlens.sources.readers import load_meta, read_transactions


def _csv(text):
    path = os.path.join(tempfile.mkdtemp(prefix="rfmlens-csv-"), "t.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_quotes_and_line_breaks(spark):
    path = _csv('id,note,qty\n1,"He said ""hi"", ok",2\n2,"two\nlines",3\n3,NA,4\n')
    rows = [tuple(r) for r in read_transactions(spark, path).orderBy("id").collect()]
    assert rows == [("1", 'He said "hi", ok', "2"), ("2", "two\nlines", "3"), ("3", None, "4")]
    assert read_transactions(spark, _csv("a,b\n1,2\n3,4\n"), multi_line=False).count() == 2


def test_csv_corrupt_column(spark):
    df = read_transactions(spark, _csv("a,b\n1,2\n3\n4,5,6\n"), corrupt_column="bad")
    rows = {r["a"]: r["bad"] for r in df.cache().collect()}
    assert rows["1"] is None and rows["3"] == "3" and rows["4"] == "4,5,6"


def test_existence_by_the_default_file_system(spark):
    path = _csv("a\n1\n")
    assert read_transactions(spark, os.path.dirname(path) + "/*.csv").count() == 1
    with pytest.raises(FileNotFoundError):
        read_transactions(spark, "/nonexistent-folder/x.csv")
    assert load_meta(spark, "/nonexistent-folder/meta").first()["n_clusters"] == 5


def test_cleaner_keeps_every_column(spark):
    df = spark.createDataFrame([("c", "i", "2024-01-01", "1", None, "n", 7, 1, 2)],
                               "customer_id STRING, invoice_id STRING, invoice_date STRING, quantity STRING, unit_price STRING, "
                               "_note STRING, _c0 INT, _rid INT, `_rfm_q` INT")
    clean, report = clean_transactions(df)
    row = clean.first().asDict()
    assert (row["_note"], row["_c0"], row["_rid"], row["_rfm_q"]) == ("n", 7, 1, 2) and row["unit_price"] == 1.0
    assert report.count() > 2


def test_cleaner_reads_its_input_once(spark):
    src = spark.read.parquet(f"{SF001}/lineitem.parquet").selectExpr(
        "CAST(l_suppkey AS STRING) AS customer_id", "CAST(l_orderkey AS STRING) AS order_id", "CAST(l_shipdate AS STRING) AS date",
        "IF(l_linenumber = 1, 'x', CAST(l_quantity AS STRING)) AS quantity", "IF(l_linenumber = 2, NULL, CAST(l_tax + 1 AS STRING)) AS price")
    clean, report = clean_transactions(src)
    for df in (clean, report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem.parquet" not in plan and plan.count("Relation [") == 0


def test_hot_customer_with_missing_values(spark):
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 50}", rnd.choice([None, "x", "1", "2", "3", "8"]), rnd.choice([None, "4", "6", "9.5", "0"]))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id INT, customer_id STRING, quantity STRING, unit_price STRING")
    got = {r["row_id"]: (r["quantity"], r["unit_price"]) for r in clean_transactions(df, row_id_col="row_id")[0].collect()}
    num = lambda t: float(t) if t not in (None, "x") else None
    q, p = {}, {}
    for _, c, a, _ in rows:
        if num(a) is not None:
            q.setdefault(c, []).append(num(a))
    full = {i: num(a) if num(a) is not None else statistics.median(q[c]) for i, c, a, _ in rows}
    for i, c, _, b in rows:
        if full[i] > 0 and num(b) is not None:
            p.setdefault(c, []).append(num(b))
    price = {i: num(b) if num(b) is not None else statistics.median(p[c]) for i, c, _, b in rows}
    assert got == {i: (full[i], price[i]) for i, *_ in rows if full[i] > 0 and price[i] > 0}


def test_ranks_of_times_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = [dt.datetime(2024, 3, 10, 0, 0) + dt.timedelta(minutes=10 * i) for i in range(40)]    # over the spring change
    df = spark.createDataFrame([(t,) for t in times], "t TIMESTAMP_NTZ")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ranks = value_ranks(df, "t", buckets=7)
        rows = sorted(tuple(r) for r in ranks.df.select("value", "n_less", "n_leq").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert rows == [(t, i, i + 1) for i, t in enumerate(times)]


def test_small_cluster_by_the_unrounded_share(spark):
    q = spark.createDataFrame([(0, "a", 29_960, 3.0, 0.5), (1, "b", 30_000, 3.0, 0.5), (2, "c", 940_040, 94.0, 0.1)],
                              "Cluster INT, Segment STRING, N LONG, Pct DOUBLE, Sil_Score DOUBLE")
    assert {(r["Cluster"], r["warning"]) for r in cluster_warnings(q).collect()} == {(0, "small_cluster"), (2, "low_silhouette")}
    assert {r["Cluster"] for r in cluster_warnings(q, low=0.05).collect()} == {0}


def test_verdict_needs_limits():
    assert fit_verdict(0.9) is None
    assert [fit_verdict(x, squared_limit(0.3), squared_limit(0.4)) for x in (0.5, 0.55, 0.64)] == ["warning", "ok", "good"]


def test_training_report(spark):
    from rfmlens.plans import base as B
    from rfmlens.plans.train import train
    from rfmlens.sources.readers import txn
    root = tempfile.mkdtemp(prefix="rfmlens-train-")
    res = train(txn(spark, SF001), k=3, final_restarts=2, save_path=root)
    assert set(res.report) == {"describe", "caps", "quality", "warnings", "cleaning"}
    for name in res.report:
        assert spark.read.parquet(f"{root}/report/{name}").columns == res.report[name].columns
    assert spark.read.parquet(f"{root}/report/quality").agg(F.sum("N")).first()[0] == B.rfm(spark, SF001).count()
    meta = res.model.meta
    assert meta["fit_verdict"] == fit_verdict(meta["silhouette_euclidean"], 0.3, 0.4) and meta["silhouette_error"] <= 1e-6
    assert meta["silhouette_euclidean"] != meta["silhouette_sq_euclidean"]
    res.release()


def test_numbered_csv_is_written_in_many_sorted_files(spark, monkeypatch):
    from rfmlens.plans import input_queries as I
    seen = []
    monkeypatch.setattr(I, "write_scored", lambda df, path, fmt: (seen.append(df.rdd.getNumPartitions()), write_scored(df, path, fmt)))
    from rfmlens.sources.writers import write_scored
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert I.q_csv_ids(spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0] > 1
