"""Built-in-only column expressions: they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rfmlens import dims


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Remove leading/trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def slug(c) -> Column:
    """H6: lower case, whitespace/underscores/hyphens removed."""
    return F.regexp_replace(F.lower(strip_ws(c)), r"[\s_\-]+", "")


def bround(c, scale: int) -> Column:
    """H7: half-even rounding, the rule pandas/numpy apply."""
    return F.bround(_c(c), scale)


def safe_ratio(num, den) -> Column:
    """Q16: a ratio that is NULL instead of an error when the denominator is 0."""
    return F.try_divide(_c(num), _c(den))


def format_currency(c, symbol) -> Column:
    """H1: |v| >= 1e6 -> 2 decimals + M; >= 1e3 -> 1 decimal + K; else 0
    decimals; thousands separators; NULL -> symbol + '0'.

    ``symbol`` is a Python string or a Column (e.g. from a currency join).
    """
    v = _c(c).cast("double")
    sym = F.lit(symbol) if isinstance(symbol, str) else symbol
    a = F.abs(v)
    body = (F.when(F.isnan(v), F.lit("nan"))
            .when(a >= 1_000_000, F.concat(F.format_number(v / 1_000_000, 2), F.lit("M")))
            .when(a >= 1_000, F.concat(F.format_number(v / 1_000, 1), F.lit("K")))
            .otherwise(F.format_number(v, 0)))
    return F.concat(sym, F.coalesce(body, F.lit("0")))


def day_text(c) -> Column:
    """H5: whole days, e.g. ``45d``."""
    return F.concat(F.format_string("%.0f", bround(c, 0)), F.lit("d"))


def percent_text(c) -> Column:
    """H5: one decimal and a percent sign, e.g. ``12.3%``."""
    return F.concat(F.format_string("%.1f", bround(c, 1)), F.lit("%"))


def band_color(c) -> Column:
    """H4: percentile band colour: >= 66 green, >= 33 amber, else red."""
    p = _c(c)
    return (F.when(p >= dims.BAND_GREEN, F.lit("#22c55e"))
            .when(p >= dims.BAND_AMBER, F.lit("#f59e0b"))
            .otherwise(F.lit("#ef4444")))


def _time_of_day_micros(c: Column) -> Column:
    return ((F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
            + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long"))


def days_between(start, end) -> Column:
    """A2: whole days elapsed from ``start`` to ``end`` rounded down, like a
    timedelta's ``.days`` (23:00 -> 22:00 two dates later is 1 day, where
    ``datediff`` says 2). Wall-clock arithmetic on TIMESTAMP_NTZ: calendar
    days minus one when the end's time of day is earlier; no time zone is
    involved, so DST cannot shift a result."""
    s, e = _c(start), _c(end)
    days = F.datediff(F.to_date(e), F.to_date(s)).cast("long")
    return days - F.when(_time_of_day_micros(e) < _time_of_day_micros(s), 1).otherwise(0)


def sample_skewness(c) -> Column:
    """Bias-corrected sample skewness (Spark's ``skewness`` is the
    population form): g1 * sqrt(n(n-1)) / (n-2)."""
    n = F.count(_c(c)).cast("double")
    return F.when(n > 2, F.skewness(_c(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def cents_mean(c) -> Column:
    """Aggregate: mean of a money column rounded half-even to whole cents,
    computed from integer cents (sum, integer division, remainder), so the
    result does not depend on the order in which rows are added up."""
    cents = F.round(_c(c) * 100).cast("long")
    s, n = F.sum(cents), F.count(cents)
    q = F.floor(s / n).cast("long")
    rem = s - q * n
    up = F.when(2 * rem > n, 1).when((2 * rem == n) & (F.pmod(q, F.lit(2)) == 1), 1).otherwise(0)
    return (q + up) / 100.0


def ntz_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal from a Python datetime/date via ISO text, so the
    Python process's local zone can never shift the wall-clock value."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    text = value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")
