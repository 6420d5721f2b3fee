"""Sinks: scored customers (S5) and training metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_scored(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table (parquet by default; CSV with a header, quotes doubled
    inside quoted fields, as ``csv_options`` reads it)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    else:
        w.parquet(path)


def write_meta(spark: SparkSession, meta: dict, path: str) -> DataFrame:
    """One-row metadata table as JSON lines (nested values kept as structs)."""
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(meta, default=str)], 1))
    df.coalesce(1).write.mode("overwrite").json(path)
    return df
