"""Readers: transactions (S1/S2), scored customers (S3), preview (S4),
metadata (S9), source profile (S10) and the fixture views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rfmlens import dims
from rfmlens.sources.csv_records import read_csv

# Cell texts that a CSV reader in the reference's stack treats as
# missing (pandas default ``na_values``); they become NULL at the scan.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def csv_options(reader, multi_line: bool = True):
    """The CSV dialect of batch and stream: a header, quotes doubled inside
    quoted fields and, with ``multi_line``, line breaks in them.

    Spark's reader can't split a file whose records may span lines, so ``multi_line`` makes one
    task of each file there; ``csv_records.read_csv`` reads such files in parallel.
    """
    return (reader.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line))


def missing_to_null(df: DataFrame, *keep: str | None) -> DataFrame:
    """Texts that mean a missing value become NULL in all columns but ``keep``."""
    return df.select([F.col(f"`{c}`") if c in keep else
                      F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv", corrupt_column: str | None = None,
                      multi_line: bool = True, row_id: str | None = None) -> DataFrame:
    """Read a transactions file with whatever header it has.

    CSV is read with every column as STRING (no schema inference: inference
    scans the data twice and turns integer ids with gaps into ``3.0``); the
    cleaner types the columns. Missing-value tokens become NULL here.
    Records may span lines (``csv_records`` reads them in parallel); with ``multi_line`` false Spark's own
    reader takes each line as a record. ``corrupt_column`` names a further column that holds the text of records with too few
    or too many fields, NULL for the others (S2), ``row_id`` one with the record's number in the input, the same for any
    partitioning: the cleaner's ``row_id_col``.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if not _exists(spark, path):
        raise FileNotFoundError(f"transactions file not found: {path}")
    if multi_line or row_id:
        return missing_to_null(read_csv(spark, path, row_id, corrupt_column), corrupt_column, row_id)
    reader = csv_options(spark.read, False)
    if corrupt_column:
        # Spark fills the column only if the schema names it
        header = reader.csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, corrupt_column]])
        reader = (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_column))
    return missing_to_null(reader.csv(path), corrupt_column)


def try_read_transactions(spark: SparkSession, path: str, fmt: str = "csv", row_id: str | None = None
                          ) -> tuple[DataFrame | None, str | None]:
    """Like ``read_transactions`` but a file that cannot be read gives
    (None, message) instead of an exception, as an upload form needs."""
    try:
        df = read_transactions(spark, path, fmt, row_id=row_id)
        df.schema  # resolve now: a bad path or format fails here
        return df, None
    except Exception as e:  # noqa: BLE001 - the message is the result
        return None, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything in its own file system (the
    default one if the path names none)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_scored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: a scored-customers table with its fixed schema."""
    if fmt == "csv":
        return spark.read.schema(dims.SCORED_SCHEMA).option("header", True).csv(path)
    return spark.read.parquet(path)


def preview(df: DataFrame, n: int = 8, order_by: list[str] | None = None) -> DataFrame:
    """First rows; deterministic only with an ordering, which then runs as a
    top-k (TakeOrderedAndProject), not a full sort."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def source_profile(df: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """Rows, columns and distinct customers of a source in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.countDistinct(customer_col).alias("n_customers"),
    )


def load_meta(spark: SparkSession, path: str | None) -> DataFrame:
    """Training metadata, or the defaults (USD, $, 5 clusters) when absent."""
    if path and _exists(spark, path):
        return spark.read.json(path)
    code, symbol, name = dims.currency_record(dims.DEFAULT_CURRENCY)
    return spark.createDataFrame(
        [(code, symbol, name, dims.DEFAULT_CLUSTERS)],
        "currency_code STRING, currency_symbol STRING, currency_name STRING, n_clusters INT")


# ---------------------------------------------------------------------------
# Fixture views over the supplied test tables (FIXTURES.md section 2).
# ---------------------------------------------------------------------------

def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in canonical form: orders joined to their lines.

    At scale this is the one large join (lineitem x orders on the order key);
    both sides are read with only the columns used, and Catalyst plans a
    shuffled join that AQE may turn into a broadcast if orders is small.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .select(F.col("o_custkey").cast("string").alias("customer_id"),
                    F.col("o_orderkey").cast("string").alias("invoice_id"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"),
                    F.col("l_quantity").cast("double").alias("quantity"),
                    (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")))


def txn_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` summed per invoice *before* the join: what RFM needs.

    Recency, Frequency and Monetary only use per-invoice facts (date, the
    invoice id, the sum of line totals), so the lines are aggregated by order
    key first. The partial aggregate runs map-side (line files are clustered
    by order), so the join's shuffle carries about one row per order instead
    of one per line.
    """
    lines = (read_table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.sum((F.col("l_quantity") * (F.col("l_extendedprice") / F.col("l_quantity"))).try_cast("decimal(38,6)"))
                  .alias("line_total")))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .select(F.col("o_custkey").cast("string").alias("customer_id"),
                    F.col("o_orderkey").cast("string").alias("invoice_id"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"),
                    "line_total"))


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as line items (timestamps with time of day)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("customer_id"),
                     F.col("event_id").cast("string").alias("invoice_id"),
                     F.col("ts").cast("timestamp_ntz").alias("invoice_date"),
                     F.lit(1.0).alias("quantity"),
                     F.col("value").cast("double").alias("unit_price"))


def with_line_total(df: DataFrame) -> DataFrame:
    """line_total = quantity * unit_price."""
    return df.withColumn("line_total", F.col("quantity") * F.col("unit_price"))


