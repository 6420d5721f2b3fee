"""Helpers shared by the text operators: kept tables, name-safe columns, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rfmlens.session import checkpoint_dir

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()`` (every executor sees the files, so a
    lost executor costs nothing already written), but columnar and compressed.
    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath.getParent())
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that a Python worker and the JVM hold at once (the default of
#: 10,000 would be tens of megabytes on either side).
ROWS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of ``ROWS_AT_ONCE`` rows at most."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= ROWS_AT_ONCE:
        conf.set(_BATCH, ROWS_AT_ONCE)
    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, with underscores added until no column has that name (Spark
    ignores case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
