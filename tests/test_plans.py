"""Plan shape: no customer-level data goes through a single-partition
exchange, filters and column pruning reach the parquet scans."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF01

HEAVY = ["percentile_standing", "segment_stats", "quantile_transform", "cluster_quality",
         "global_kpis", "box_stats_monetary", "minmax_scores", "segment_context", "rfm_scores"]


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("name", HEAVY)
def test_single_partition_only_after_aggregation(spark, name):
    lines = _plan(E.queries()[name](spark, SF01))
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i + 1:i + 4])
            assert re.search(r"HashAggregate|ObjectHashAggregate|LocalTableScan|Scan ExistingRDD", below), \
                f"{name}: single-partition exchange over non-aggregated rows:\n" + "\n".join(lines[i:i + 4])


def test_scans_are_pruned(spark):
    from rfmlens.operators.rfm import compute_rfm
    from rfmlens.sources.readers import txn_invoices
    lines = "\n".join(_plan(compute_rfm(txn_invoices(spark, SF01), materialize=False)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in lines
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in lines
    # lines are summed per order before the join's exchange (map-side partial aggregate)
    assert re.search(r"HashAggregate\(keys=\[l_orderkey", lines)


def test_lookup_pushes_filter(spark):
    from rfmlens.operators.lookup import lookup
    df = spark.read.parquet(f"{SF01}/customer.parquet").withColumnRenamed("c_custkey", "customer_id")
    plan = "\n".join(_plan(lookup(df, "7")))
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in plan
    assert lookup(df, "7").count() == 1 and lookup(df, "x7").count() == 0
    s = df.withColumn("customer_id", df.customer_id.cast("string"))
    assert lookup(s, "7").count() == 1
