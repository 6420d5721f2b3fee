"""Column expressions (section H of the survey) used by the operators."""

from rfmlens.functions.expressions import (
    band_color, bround, cents_mean, day_text, days_between, format_currency, ntz_literal, percent_text,
    safe_ratio, sample_skewness, slug, strip_ws,
)

__all__ = [
    "band_color", "bround", "cents_mean", "day_text", "days_between", "format_currency", "ntz_literal",
    "percent_text", "safe_ratio", "sample_skewness", "slug", "strip_ws",
]
