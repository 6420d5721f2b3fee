"""Transaction cleaning (C0-C13): typed, imputed, filtered line items plus a
report, for an input with any header.

The raw input is read once: its columns are parsed into a typed frame that is
checkpointed (so generated row ids are pinned), and the counts that decide on fallbacks
are observed while it is written. Medians come from (customer, value) counts,
summed before they are narrowed to the customers in need; one join per column fills
them in, and the cleaned rows and the report read the same frame. The driver sees
scalars only. Helper columns evade the input's names and are the only ones dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from rfmlens import dims
from rfmlens.functions import ntz_literal, strip_ws
from rfmlens.operators import dates
from rfmlens.operators.ranks import counted_quantile, exact_quantiles, order_statistics, value_ranks
from rfmlens.operators.schema import detect_columns, rename_to_canonical
from rfmlens.session import checkpoint_dir

# medians of at most so many customers are broadcast to the rows (size counted first)
BROADCAST_MEDIANS = 500_000

# Formats that ``parse_date`` tries, in order, after ISO text (Q3). Month-first for slashes.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d.M.yyyy",
]
# Spark's text -> double cast also accepts Java float suffixes (``1d``, ``2f``)
# that a CSV reader would reject; text ending in one of them is refused.
_JAVA_SUFFIX_RE = r"[dDfF]\s*$"

REPORT_SCHEMA = "section STRING, key STRING, value BIGINT, detail STRING"


def parse_date(c: Column, dtype: T.DataType, formats=DATE_FORMATS) -> Column:
    """To TIMESTAMP_NTZ; text that no format parses becomes NULL."""
    if isinstance(dtype, (T.TimestampNTZType,)):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    s = strip_ws(c.cast("string"))
    tries = [s.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def parse_number(c: Column, dtype: T.DataType) -> Column:
    """To DOUBLE; bad text and NaN become NULL (Spark alone would also
    accept ``1d``/``1f``, hence the pattern guard)."""
    if isinstance(dtype, T.NumericType):
        d = c.cast("double")
    else:
        s = c.cast("string")
        d = F.when(~s.rlike(_JAVA_SUFFIX_RE), s.try_cast("double"))
    return F.when(~F.isnan(d), d)


def clean_id(c: Column, tokens: list[str]) -> Column:
    """Text, trimmed; tokens meaning "missing" -> NULL (case-sensitive)."""
    s = strip_ws(c.cast("string"))
    return F.when(s.isNull() | s.isin(tokens), F.lit(None).cast("string")).otherwise(s)


def _customer_medians(df: DataFrame, value: Column, todo: Column, pool: Column) -> DataFrame:
    """(_who, _med): median of ``value`` over the ``pool`` rows of each customer
    with a ``todo`` row. Values are counted per customer before anything is joined, so a
    customer with a third of all rows is a row per distinct value by then."""
    pairs = (df.where(pool).select(F.col("customer_id").alias("_who"), value.alias("_x"))
             .groupBy("_who", "_x").agg(F.count(F.lit(1)).alias("_n")))
    need = df.where(todo).select(F.col("customer_id").alias("_who")).distinct()
    med = counted_quantile(pairs.join(need, "_who", "left_semi"), "_who", "_x", "_n", 0.5)
    med = med.withColumnRenamed("quantile", "_med").checkpoint(eager=True)
    return F.broadcast(med) if med.count() <= BROADCAST_MEDIANS else med


def _global_median(df: DataFrame, value: Column) -> float:
    (m,), n = exact_quantiles(df.select(value.alias("_x")), "_x", [0.5])
    return float(m) if n and m is not None else 1.0


def _free_prefix(columns: list[str]) -> str:
    prefix = "_rfm_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def clean_transactions(df: DataFrame, row_id_col: str | None = None, strict: bool = False,
                       date_formats: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (line items, report).

    Line items: customer_id, invoice_id, invoice_date (TIMESTAMP_NTZ),
    quantity, unit_price, line_total (DOUBLE) and any other input columns.
    Report: long form (section, key, value, detail), see ``REPORT_SCHEMA``.

    ``row_id_col`` names a unique key used to build ids for rows without one
    (``CUST_<id>``, ``INV_<id>``); without it a generated id is used (Q2).
    Dates as text are read by ``operators.dates``: whether day or month comes first is settled by the whole
    column and reported (section ``date_format``); ``date_formats`` are tried in their order instead.
    """
    checkpoint_dir(df.sparkSession)
    at = df.columns.index(row_id_col) if row_id_col else None
    detected = detect_columns(df.columns, strict)
    df, inferred = rename_to_canonical(df, detected)
    others = [c for c in df.columns if c not in dims.ROLE_ORDER and c != "line_total"]
    types = {f.name: f.dataType for f in df.schema.fields}
    present = {r: r in df.columns for r in dims.ROLE_ORDER}
    h = _free_prefix(df.columns)
    rid = F.col(f"`{df.columns[at]}`").cast("string") if at is not None else F.monotonically_increasing_id().cast("string")

    # Everything that needs no other row
    def id_of(role: str, tokens: list[str]) -> Column:
        return clean_id(F.col(role), tokens) if present[role] else F.lit(None).cast("string")
    none = F.lit(None).cast("timestamp_ntz")
    if not present["invoice_date"]:
        ways = (none, none, none)
    elif date_formats is not None:
        ways = (parse_date(F.col("invoice_date"), types["invoice_date"], date_formats), none, none)
    else:
        ways = dates.readings(F.col("invoice_date"), types["invoice_date"])
    number = {r: parse_number(F.col(r), types[r]) if present[r] else F.lit(default)
              for r, default in (("quantity", dims.DEFAULT_QUANTITY), ("unit_price", dims.DEFAULT_PRICE))}
    typed = df.select(rid.alias(h + "rid"), id_of("customer_id", dims.CUSTOMER_NULL_TOKENS).alias(h + "cust"),
                      id_of("invoice_id", dims.INVOICE_NULL_TOKENS).alias(h + "inv"), *[w.alias(h + n) for w, n in zip(ways, ("date", "month1", "day1"))],
                      number["quantity"].alias(h + "q"), number["unit_price"].alias(h + "p"),
                      *[F.col(f"`{c}`") for c in others])
    rid, cust, inv, date, q, p = (F.col(h + c) for c in ("rid", "cust", "inv", "date", "q", "p"))
    ways = tuple(F.col(h + n) for n in ("date", "month1", "day1"))
    seen = Observation()
    typed = typed.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(*ways).isNull()).alias("date"),
                          F.count_if(q.isNull()).alias("q"), F.count_if(p.isNull()).alias("p"),
                          *[v.alias(k) for k, v in dates.counts(*ways).items()]).checkpoint(eager=True)
    missing = dict(seen.get or {})
    order = dates.settled(missing)
    typed = typed.withColumn(h + "date", dates.dates(*ways, order)).drop(h + "month1", h + "day1")

    # customer_id, invoice_date (C4), invoice_id
    fallback = None
    if present["invoice_date"] and missing.get("date"):
        ranks = value_ranks(typed, date)
        if ranks.n() > 0:
            mid = ranks.n() // 2
            fallback = order_statistics(ranks, [mid])[mid]
        ranks.release()
    day = ntz_literal(fallback) if fallback is not None else F.lit(dims.DEFAULT_DATE).cast("timestamp_ntz")
    flagged = typed.withColumn("customer_id", F.coalesce(cust, F.concat(F.lit(dims.CUSTOMER_PREFIX), rid)))
    flagged = flagged.withColumn("invoice_date", F.coalesce(date, day))
    flagged = flagged.withColumn("invoice_id", F.coalesce(inv, F.concat(F.lit(dims.INVOICE_PREFIX), rid)) if present["invoice_id"]
                                 else F.concat_ws("_", F.col("customer_id"), F.date_format("invoice_date", "yyyyMMdd")))

    # quantity (C8, C9), then unit_price over the rows whose quantity stays
    def fill(frame: DataFrame, value: Column, role: str, todo: Column, pool: Column) -> DataFrame:
        if not missing.get(value_name[role]):
            return frame.withColumn(role, value)
        med = _customer_medians(frame, value, todo, pool)
        fallback = _global_median(frame.where(pool), value)
        # only the rows in need move to their customer's median, once; the others stay where they are
        filled = (frame.where(todo).join(med, F.col("customer_id") == F.col("_who"), "left")
                  .withColumn(role, F.coalesce("_med", F.lit(fallback))).drop("_who", "_med").checkpoint(eager=True))
        return frame.where(~F.coalesce(todo, F.lit(False))).withColumn(role, value).unionByName(filled)
    value_name = {"quantity": "q", "unit_price": "p"}
    flagged = fill(flagged, q, "quantity", q.isNull(), q.isNotNull())
    stays = F.col("quantity") > 0
    flagged = fill(flagged, p, "unit_price", stays & p.isNull(), stays & p.isNotNull())

    keep = F.coalesce(stays & (F.col("unit_price") > 0), F.lit(False))
    flags = {"customer_id": cust.isNull(), "invoice_id": inv.isNull(), "invoice_date": date.isNull(),
             "quantity": q.isNull(), "unit_price": stays & p.isNull()}
    for role in dims.ROLE_ORDER:
        if not present[role]:
            flags[role] = stays if role == "unit_price" else F.lit(True)
    cleaned = (flagged.where(keep).withColumn("line_total", F.col("quantity") * F.col("unit_price"))
               .select("customer_id", "invoice_id", "invoice_date", "quantity", "unit_price", "line_total",
                       *[F.col(f"`{c}`") for c in others]))
    found = [("date_format", order, sum(missing[k] for k in ("both", dates.MONTH_FIRST, dates.DAY_FIRST)), dates.PATTERNS[order])] if order else []
    return cleaned, cleaning_report(flagged, inferred, present, stays, keep, flags, found)


def cleaning_report(flagged: DataFrame, inferred: dict[str, str], present: dict[str, bool],
                    stays: Column, keep: Column, flags: dict[str, Column], found: list[tuple] = []) -> DataFrame:
    """C11: original/clean row counts, inferred mapping, imputed counts per
    role (listed when a role was absent or had missing values) and dropped
    counts (listed when > 0) -- one aggregate pass over the flagged rows:
    ``stays`` says whether a row's quantity is kept, ``keep`` whether the row is,
    ``flags`` which values were imputed, ``found`` further rows (the order of day and month)."""
    spark = flagged.sparkSession
    aggs = [F.count(F.lit(1)).alias("original_rows"), F.count_if(keep).alias("clean_rows"),
            F.count_if(~stays).alias("negative_quantity"),
            F.count_if(stays & ~keep).alias("zero_price")]
    aggs += [F.count_if(flags[r]).alias(f"imp_{r}") for r in dims.ROLE_ORDER]
    wide = flagged.agg(*aggs)
    rows = [f"'rows', 'original_rows', original_rows, 0", f"'rows', 'clean_rows', clean_rows, 0",
            "'dropped', 'negative_quantity', negative_quantity, 1", "'dropped', 'zero_price', zero_price, 1"]
    rows += [f"'imputed', '{r}', imp_{r}, {0 if not present[r] else 1}" for r in dims.ROLE_ORDER]
    long = wide.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (section, key, value, only_if_positive)")
    long = (long.where((F.col("only_if_positive") == 0) | (F.col("value") > 0))
            .select("section", "key", F.col("value").cast("long").alias("value"),
                    F.lit(None).cast("string").alias("detail")))
    inf_rows = [("inferred", role, None, actual) for role, actual in inferred.items()] + found
    if inf_rows:
        long = long.unionByName(spark.createDataFrame(inf_rows, REPORT_SCHEMA))
    return long


def nonzero_report(report: DataFrame) -> DataFrame:
    """Report entries worth showing (imputed / dropped counts > 0)."""
    return report.where(F.col("section").isin("imputed", "dropped") & (F.col("value") > 0))


def require_rows(df: DataFrame) -> str | None:
    """Message when nothing usable is left, else None."""
    return None if not df.isEmpty() else "No valid customer records found in this file."
