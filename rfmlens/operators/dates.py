"""Dates as text (C3): every reading of a value at once, the ambiguous ones settled by the whole column.

``03/02/2011`` is the third of February where days come first and the second of March where months do. A value
tells which only if one of the two is no date, so both readings are kept until the column has been counted: days come
first if more of its values can only be read that way than only the other. A tie, as of a column without such a value,
is month first. The other order still reads the values that the column's own can't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rfmlens.functions import strip_ws

_N, _TIME = r"[+-]?\d+", r"\d\d:\d\d"
#: Formats with one reading, tried in order after ISO text, and the shape that each text of a format has: a text that a format
#: can't read costs an exception, so only those of its shape are tried.
PLAIN = {"yyyy/MM/dd HH:mm:ss": rf"{_N}/\d\d/\d\d {_TIME}:\d\d", "yyyy/MM/dd HH:mm": rf"{_N}/\d\d/\d\d {_TIME}", "yyyy/MM/dd": rf"{_N}/\d\d/\d\d",
         "d.M.yyyy": rf"{_N}\.{_N}\.{_N}", "d.M.yyyy H:mm": rf"{_N}\.{_N}\.{_N} {_N}:\d\d", "d.M.yyyy H:mm:ss": rf"{_N}\.{_N}\.{_N} {_N}:\d\d:\d\d",
         "d MMM yyyy": rf"{_N} \D+ {_N}", "d-MMM-yyyy": rf"{_N}-\D+-{_N}", "MMM d, yyyy": rf"\D+ {_N}, {_N}"}
#: Two numbers of one or two digits, a year of four and maybe a time.
_TWO_WAYS = r"^\d{1,2}([/-])\d{1,2}\1\d{4}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$"
MONTH_FIRST, DAY_FIRST = "month_first", "day_first"
PATTERNS = {MONTH_FIRST: "M/d/yyyy", DAY_FIRST: "d/M/yyyy"}


def readings(c: Column, dtype: T.DataType) -> tuple[Column, Column, Column]:
    """(plain, month first, day first) readings of a column as TIMESTAMP_NTZ; each NULL where a value can't be read so."""
    none = F.lit(None).cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampNTZType):
        return c, none, none
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz"), none, none
    s = strip_ws(c.cast("string"))
    two_ways = F.coalesce(s.rlike(_TWO_WAYS), F.lit(False))
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))

    def part(i: int) -> Column:
        return F.coalesce(F.get(numbers, F.lit(i)), F.lit(0))

    def read(month: int, day: int) -> Column:
        y, m, d = part(2), part(month), part(day)
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        real = m.between(1, 12) & d.between(1, days) & part(3).between(0, 23) & part(4).between(0, 59) & part(5).between(0, 60)
        return F.when(two_ways & real, F.try_make_timestamp_ntz(y, m, d, part(3), part(4), part(5).cast("decimal(8, 6)")))
    tries = [F.when(s.rlike(f"^{shape}$"), F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz")) for f, shape in PLAIN.items()]
    plain = F.when(~two_ways, F.coalesce(s.try_cast("timestamp_ntz"), *tries))
    return plain, read(0, 1), read(1, 0)


def counts(plain: Column, month_first: Column, day_first: Column) -> dict[str, Column]:
    """Aggregates that settle the order: rows read plainly, either way, and in one order only."""
    m, d = month_first.isNotNull(), day_first.isNotNull()
    return {"plain": F.count(plain), "both": F.count_if(m & d), MONTH_FIRST: F.count_if(m & ~d), DAY_FIRST: F.count_if(d & ~m)}


def settled(counted: dict) -> str | None:
    """The column's order, None if no value has two numbers that could be day and month."""
    if not any(counted.get(k) for k in ("both", MONTH_FIRST, DAY_FIRST)):
        return None
    return DAY_FIRST if counted[DAY_FIRST] > counted[MONTH_FIRST] else MONTH_FIRST


def dates(plain: Column, month_first: Column, day_first: Column, order: str | None) -> Column:
    first, second = (day_first, month_first) if order == DAY_FIRST else (month_first, day_first)
    return F.coalesce(plain, first, second)


def date_format_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: its order (NULL without ambiguous values), rows read plainly, either way, in one order only, and not at all.
    Texts are read value by value, each reading once, in one pass over the rows; columns of dates are counted in another."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    dated = [c for c in columns if isinstance(kinds[c], (T.TimestampNTZType, T.TimestampType, T.DateType))]
    texts = [c for c in dict.fromkeys(columns) if c not in dated]
    found: dict[str, dict] = {c: dict.fromkeys(("plain", "both", MONTH_FIRST, DAY_FIRST, "unread"), 0) for c in columns}
    if dated:
        row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(dated)]).first()
        for i, c in enumerate(dated):
            found[c]["plain"] = row[f"n{i}"]
    if texts:
        values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("s")) for i, c in enumerate(texts)])
        long = df.select(F.inline(values))
        read = long.select("i", "s", *[v.alias(k) for k, v in zip("pmd", readings(F.col("s"), T.StringType()))])
        ways = [F.col(k) for k in "pmd"]
        unread = F.count_if(F.col("s").isNotNull() & F.coalesce(*ways).isNull()).alias("unread")
        for r in read.groupBy("i").agg(*[v.alias(k) for k, v in counts(*ways).items()], unread).collect():
            found[texts[r["i"]]] = r.asDict()
    out = []
    for c in columns:
        n = found[c]
        out.append((c, settled(n), n["plain"], n["both"], n[MONTH_FIRST], n[DAY_FIRST], n["unread"]))
    return df.sparkSession.createDataFrame(out, "column STRING, date_order STRING, plain LONG, both LONG, month_first_only LONG, "
                                                "day_first_only LONG, unread LONG")
