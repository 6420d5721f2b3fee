"""Registered queries on inputs as they really come: text columns with missing and
bad values under any header, and CSV files with quotes and line breaks.

The spoiled line items cover all of orders x lineitem. Which cell is spoiled how follows
from the hex digits of the row key's MD5, a rule that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rfmlens.operators.clean import clean_transactions, nonzero_report, require_rows
from rfmlens.operators.dates import date_format_table
from rfmlens.operators.rfm import compute_rfm
from rfmlens.operators.schema import detect_columns, schema_messages
from rfmlens.plans import base as B
from rfmlens.plans import sql as S
from rfmlens.plans.catalog import query, r
from rfmlens.session import scratch_path
from rfmlens.sources.readers import load_meta, read_table, read_transactions, txn, try_read_transactions
from rfmlens.sources.writers import write_meta, write_scored

#: Per column, in the order of the key's hex digits: value by digit, as SQL text.
SPOILED = [
    ("Cust-ID", "CAST(o_custkey AS STRING)",
     {"0": "'nan'", "1": "'  '", "2": "NULL", "3": "concat('  ', CAST(o_custkey AS STRING), ' ')", "4": "'NaN'"}),
    ("Order No", "CAST(o_orderkey AS STRING)", {"0": "''", "1": "'null'", "2": "NULL"}),
    ("Order Date", "CAST(CAST(o_orderdate AS DATE) AS STRING)",
     {"0": "'garbage'", "1": "NULL", "2": "concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 13:45:00')"}),
    ("QTY", "CAST(CAST(l_quantity AS INT) AS STRING)", {"0": "'abc'", "1": "NULL", "2": "'-1'", "3": "'0'", "4": "' 2 '"}),
    ("Selling-Price", "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)",
     {"0": "'n/a'", "1": "NULL", "2": "'0'", "3": "'-5'", "4": "'12.5'"}),
]


def _spoiled_columns(quote: str) -> list[str]:
    parts = []
    for i, (name, value, bad) in enumerate(SPOILED, 1):
        cases = " ".join(f"WHEN '{d}' THEN {v}" for d, v in bad.items())
        parts.append(f"CASE substr(u, {i}, 1) {cases} ELSE {value} END AS {quote}{name}{quote}")
    return parts


def dirty_lines(spark, sf) -> DataFrame:
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("u", F.md5(key.cast("binary")))
            .withColumn("row_key", key)
            .selectExpr(*_spoiled_columns("`"), "row_key", "u AS _note"))


# the cleaner's rules, from their definition, over the spoiled text
DIRTY_SQL = f"""raw AS (
  SELECT {", ".join(_spoiled_columns('"'))}, row_key, u AS _note
  FROM (SELECT *, md5(row_key) AS u FROM (
    SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS row_key
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey))),
typed AS (
  SELECT row_key, _note,
         CASE WHEN trim("Cust-ID") NOT IN ('nan', 'none', 'na', '', 'null', 'NaN') THEN trim("Cust-ID") END AS c,
         CASE WHEN trim("Order No") NOT IN ('nan', 'none', 'na', '', 'null') THEN trim("Order No") END AS i,
         TRY_CAST("Order Date" AS TIMESTAMP) AS d, TRY_CAST(trim(QTY) AS DOUBLE) AS q,
         TRY_CAST(trim("Selling-Price") AS DOUBLE) AS p
  FROM raw),
ids AS (
  SELECT *, coalesce(c, 'CUST_' || row_key) AS customer_id, coalesce(i, 'INV_' || row_key) AS invoice_id,
         coalesce(d, (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n
                                     FROM typed WHERE d IS NOT NULL) WHERE k = n // 2 + 1)) AS invoice_date
  FROM typed),
filled_q AS (
  SELECT *, coalesce(q, median(q) OVER (PARTITION BY customer_id), (SELECT median(q) FROM typed)) AS quantity FROM ids),
filled_p AS (
  SELECT *, coalesce(p, median(p) OVER (PARTITION BY customer_id), median(p) OVER ()) AS unit_price
  FROM filled_q WHERE quantity > 0),
txn AS (
  SELECT customer_id, invoice_id, invoice_date, quantity, unit_price, quantity * unit_price AS line_total, row_key, _note
  FROM filled_p WHERE unit_price > 0)"""


@query("clean_dirty_lines", S.with_ctes(DIRTY_SQL, body="SELECT * FROM txn"))
def q_dirty_lines(spark, sf):
    """Every cleaned line, with the input's other columns."""
    return clean_transactions(dirty_lines(spark, sf), row_id_col="row_key")[0]


REPORT_ROWS = """
  SELECT 'rows' AS section, 'original_rows' AS key, count(*) AS value, CAST(NULL AS VARCHAR) AS detail FROM typed
  UNION ALL SELECT 'rows', 'clean_rows', count(*), NULL FROM txn
  UNION ALL SELECT 'dropped', 'negative_quantity', count(*) FILTER (quantity <= 0), NULL FROM filled_q
  UNION ALL SELECT 'dropped', 'zero_price', count(*) FILTER (unit_price <= 0), NULL FROM filled_p
  UNION ALL SELECT 'imputed', 'customer_id', count(*) - count(c), NULL FROM typed
  UNION ALL SELECT 'imputed', 'invoice_id', count(*) - count(i), NULL FROM typed
  UNION ALL SELECT 'imputed', 'invoice_date', count(*) - count(d), NULL FROM typed
  UNION ALL SELECT 'imputed', 'quantity', count(*) - count(q), NULL FROM typed
  UNION ALL SELECT 'imputed', 'unit_price', count(*) - count(p), NULL FROM filled_p"""


@query("clean_dirty_report", S.with_ctes(DIRTY_SQL, body=f"""
SELECT * FROM ({REPORT_ROWS}) WHERE section = 'rows' OR value > 0
UNION ALL VALUES ('inferred', 'customer_id', NULL, 'Cust-ID'), ('inferred', 'invoice_id', NULL, 'Order No'),
  ('inferred', 'invoice_date', NULL, 'Order Date'), ('inferred', 'quantity', NULL, 'QTY'),
  ('inferred', 'unit_price', NULL, 'Selling-Price')"""))
def q_dirty_report(spark, sf):
    """C11: counts and the inferred columns."""
    return clean_transactions(dirty_lines(spark, sf), row_id_col="row_key")[1]


@query("clean_dirty_shown", S.with_ctes(DIRTY_SQL, body=f"SELECT * FROM ({REPORT_ROWS}) WHERE section <> 'rows' AND value > 0"))
def q_dirty_shown(spark, sf):
    """The entries worth showing."""
    return nonzero_report(clean_transactions(dirty_lines(spark, sf), row_id_col="row_key")[1])


@query("clean_dirty_rfm", S.with_ctes(DIRTY_SQL, S.RFM, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary FROM rfm"""))
def q_dirty_rfm(spark, sf):
    lines, _ = clean_transactions(dirty_lines(spark, sf), row_id_col="row_key")
    return compute_rfm(lines).withColumn("Monetary", r("Monetary", 2))


@query("upload_messages", """
SELECT 'events' AS input, 'no column for invoice_id: its values are generated; no column for invoice_date: its values are generated; no column for quantity: its values are generated' AS note,
       CASE WHEN count(*) FILTER (value > 0) = 0 THEN 'No valid customer records found in this file.' END AS empty FROM events
UNION ALL SELECT 'refunds', '', CASE WHEN count(*) FILTER (l_quantity < 0) = 0 THEN 'No valid customer records found in this file.' END FROM lineitem""")
def q_upload_messages(spark, sf):
    """Messages for an input with roles missing and for one without a usable row."""
    events = read_table(spark, sf, "events")
    refunds = txn(spark, sf).withColumn("quantity", -F.col("quantity"))
    rows = [(name, schema_messages(df.columns), require_rows(clean_transactions(df)[0]))
            for name, df in (("events", events), ("refunds", refunds))]
    return spark.createDataFrame(rows, "input STRING, note STRING, empty STRING")


@query("detected_columns", """
SELECT * FROM (VALUES ('dirty', 'Cust-ID', 'Order No', 'Order Date', 'QTY', 'Selling-Price'),
  ('lineitem', NULL, 'l_orderkey', 'l_shipdate', 'l_quantity', 'l_extendedprice'),
  ('orders', NULL, 'o_orderkey', 'o_orderdate', NULL, 'o_totalprice'))
  t(input, customer_id, invoice_id, invoice_date, quantity, unit_price)""")
def q_detected(spark, sf):
    """P1 on real headers, the slug tier (H6) included."""
    rows = [(name, *detect_columns(df.columns).values()) for name, df in (
        ("dirty", dirty_lines(spark, sf)), ("lineitem", read_table(spark, sf, "lineitem")), ("orders", read_table(spark, sf, "orders")))]
    return spark.createDataFrame(rows, "input STRING, customer_id STRING, invoice_id STRING, invoice_date STRING, "
                                       "quantity STRING, unit_price STRING")


# --------------------------------------------------------------- dates
def dated_orders(spark, sf) -> DataFrame:
    """Lines with dates as people write them: days first, some of them dates in one order only."""
    day = F.col("o_orderdate").cast("date")
    return (read_table(spark, sf, "lineitem").join(read_table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").cast("string").alias("Customer ID"), F.col("o_orderkey").cast("string").alias("Invoice"),
                    F.date_format(day, "dd/MM/yyyy").alias("Invoice Date"), F.col("l_quantity").cast("int").alias("Quantity"),
                    F.lit("2").alias("Price"), F.date_format(day, "M-d-yyyy H:mm").alias("shipped"), day.cast("string").alias("iso"),
                    F.concat(F.lit("0"), F.dayofmonth(day) % 9 + 1, F.lit("/0"), F.month(day) % 9 + 1, F.lit("/2011")).alias("either"),
                    F.date_format(day, "d MMM yyyy").alias("named"), F.lit("30/02/2011").alias("no_date")))


@query("clean_day_first", """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS invoice_id,
       CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS invoice_date, count(*) AS n, CAST(sum(2 * l_quantity) AS DOUBLE) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def q_day_first(spark, sf):
    """A column of days first, every line, by invoice."""
    lines, _ = clean_transactions(dated_orders(spark, sf).select("Customer ID", "Invoice", "Invoice Date", "Quantity", "Price"))
    return lines.groupBy("customer_id", "invoice_id", "invoice_date").agg(F.count(F.lit(1)).alias("n"), F.sum("line_total").alias("total"))


@query("date_formats", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT count(*) AS n, count(*) FILTER (day(d) <= 12) AS low FROM d)
SELECT 'Invoice Date' AS "column", 'day_first' AS date_order, 0::BIGINT AS plain, low AS both, 0::BIGINT AS month_first_only,
       n - low AS day_first_only, 0::BIGINT AS unread FROM n
UNION ALL SELECT 'shipped', 'month_first', 0, low, n - low, 0, 0 FROM n
UNION ALL SELECT 'iso', NULL, n, 0, 0, 0, 0 FROM n
UNION ALL SELECT 'either', 'month_first', 0, n, 0, 0, 0 FROM n
UNION ALL SELECT 'named', NULL, n, 0, 0, 0, 0 FROM n
UNION ALL SELECT 'no_date', NULL, 0, 0, 0, 0, n FROM n""")
def q_date_formats(spark, sf):
    """The order of day and month in each date column, from all rows."""
    return date_format_table(dated_orders(spark, sf), ["Invoice Date", "shipped", "iso", "either", "named", "no_date"])


# --------------------------------------------------------------- files (S)
@query("csv_documents", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n, lang, source FROM documents""")
def q_csv_documents(spark, sf):
    """Texts with quotes, commas and line breaks through a CSV file."""
    path = scratch_path(spark, "documents")
    write_scored(read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path, "csv")
    back = read_transactions(spark, path)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                       F.length("text").cast("long").alias("n"), "lang", "source")


# the spoiled lines in an order of their own, numbered from 0
FILE_ORDER = ["row_key", "Cust-ID", "Order No", "Order Date", "QTY", "Selling-Price"]
NUMBERED_SQL = DIRTY_SQL.replace("raw AS (", "unnumbered AS (", 1).replace("typed AS (", f"""raw AS (
  SELECT * REPLACE (CAST(row_number() OVER (ORDER BY {", ".join(f'"{c}" NULLS FIRST' for c in FILE_ORDER)}) - 1 AS VARCHAR) AS row_key)
  FROM unnumbered),
typed AS (""", 1)


@query("clean_csv_ids", S.with_ctes(NUMBERED_SQL, body="SELECT customer_id, invoice_id, CAST(row_key AS BIGINT) AS place FROM txn"))
def q_csv_ids(spark, sf):
    """Ids generated from a record's place in the input, every cleaned line. Sorted ranges are files in the order
    of their paths, which is that of the records."""
    path = scratch_path(spark, "places")
    write_scored(dirty_lines(spark, sf).orderBy(*[f"`{c}`" for c in FILE_ORDER]), path, "csv")
    lines, _ = clean_transactions(read_transactions(spark, path, row_id="place"), row_id_col="place")
    return lines.select("customer_id", "invoice_id", "place")


@query("csv_upload_rfm", S.with_ctes(DIRTY_SQL, S.RFM, body="""
SELECT customer_id, Recency, Frequency, round(Monetary, 2) AS Monetary FROM rfm"""))
def q_csv_upload(spark, sf):
    """The spoiled lines as an uploaded CSV file, read, cleaned and grouped."""
    path = scratch_path(spark, "upload")
    write_scored(dirty_lines(spark, sf), path, "csv")
    df, message = try_read_transactions(spark, path)
    if message:
        raise ValueError(message)
    return compute_rfm(clean_transactions(df, row_id_col="row_key")[0]).withColumn("Monetary", r("Monetary", 2))


@query("meta_roundtrip", S.with_ctes(*S.BASE, body="""
SELECT 'saved' AS kind, 'INR' AS currency_code, count(*) AS n_customers FROM rfm
UNION ALL SELECT 'absent', 'USD', NULL"""))
def q_meta(spark, sf):
    """Metadata written and read back by a path without a scheme, and the defaults."""
    path = scratch_path(spark, "meta")
    write_meta(spark, {"currency_code": "INR", "n_customers": B.rfm(spark, sf).count()}, path)
    saved = load_meta(spark, path.removeprefix("file://")).select(F.lit("saved").alias("kind"), "currency_code",
                                                                   F.col("n_customers").cast("long").alias("n_customers"))
    absent = load_meta(spark, path + "-absent").select(F.lit("absent").alias("kind"), "currency_code",
                                                       F.lit(None).cast("long").alias("n_customers"))
    return saved.unionAll(absent)
