"""A customer holding a third of all orders: results must stay exact."""

import duckdb
from pyspark.sql import functions as F

from conftest import SF01
from rfmlens.operators.lookup import percentile_standing
from rfmlens.operators.rfm import compute_rfm
from rfmlens.operators.scoring import add_rfm_scores
from rfmlens.sources.readers import read_table


def test_hot_customer_rfm_and_ranks(spark):
    li = read_table(spark, SF01, "lineitem")
    o = read_table(spark, SF01, "orders")
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit("HOT")).otherwise(F.col("o_custkey").cast("string"))
    lines = (li.join(o, li.l_orderkey == o.o_orderkey)
             .select(hot.alias("customer_id"), F.col("o_orderkey").cast("string").alias("invoice_id"),
                     F.col("o_orderdate").alias("invoice_date"),
                     (F.col("l_quantity") * (F.col("l_extendedprice") / F.col("l_quantity"))).alias("line_total")))
    rfm = compute_rfm(lines)
    got = {r["customer_id"]: (r["Recency"], r["Frequency"], round(r["Monetary"], 2)) for r in rfm.collect()}
    con = duckdb.connect()
    ref = con.execute(f"""
      WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'HOT' ELSE CAST(o_custkey AS VARCHAR) END AS c,
                        o_orderkey, o_orderdate, l_quantity * (l_extendedprice / l_quantity) AS lt
                 FROM '{SF01}/lineitem.parquet' JOIN '{SF01}/orders.parquet' ON l_orderkey = o_orderkey),
           p AS (SELECT c, max(o_orderdate) AS last, count(DISTINCT o_orderkey) AS f, sum(lt) AS m FROM t GROUP BY c)
      SELECT c, date_sub('day', last, (SELECT max(last) FROM p) + INTERVAL 1 DAY), f, round(m, 2) FROM p""").fetchall()
    assert got == {c: (r, f, m) for c, r, f, m in ref}
    assert got["HOT"][1] > 4000                       # the hot customer really holds a third
    scored = add_rfm_scores(rfm).withColumn("Segment", F.lit("all"))
    st = {r["customer_id"]: (r["Frequency_Pct"], r["revenue_rank_asc"]) for r in percentile_standing(scored).collect()}
    n = len(got)
    freqs = sorted(v[1] for v in got.values())
    assert abs(st["HOT"][0] - 100.0 * sum(1 for f in freqs if f <= got["HOT"][1]) / n) < 1e-9
    assert st["HOT"][1] == n                         # highest spender is last in ascending rank


def test_unseen_values_are_placed_in_linear_time(spark):
    """Ten times the knots and values: a frame read anew per row would take a hundred times as long."""
    import time

    from rfmlens.operators.transform import place_values

    def seconds(n: int) -> float:
        i = F.col("id")
        knots = spark.range(n).select(F.lit("x").alias("feature"), (i * 2.0).alias("value"), (i / n).alias("lo"), (i / n).alias("hi")).cache()
        values = spark.range(n).select(F.lit("x").alias("feature"), (i * 2.0 + 1).alias("value")).cache()
        knots.count(), values.count()
        start = time.time()
        got = place_values(values, knots, 1).agg(F.sum("s")).first()[0]
        spent = time.time() - start
        # (i + 0.5) / n between knots, 1 above the last one
        assert abs(got - (sum((k + 0.5) / n for k in range(n - 1)) + 1)) < 1e-6 * n
        knots.unpersist(), values.unpersist()
        return spent

    seconds(1_000)
    assert seconds(50_000) < 10 * seconds(5_000) + 5
