"""Column-role detection and schema mapping.

Detection looks at column *names* only (metadata on the driver, no scan);
everything after it is a lazy plan over a fixed schema.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from rfmlens import dims


def _plain(name: str) -> str:
    """Case and outer blanks don't count; a blank is an underscore."""
    return name.strip().lower().replace(" ", "_")


def _compact(name: str) -> str:
    """H6: blanks, underscores and hyphens don't count either."""
    return re.sub(r"[\s_\-]", "", name.lower())


def column_ranks(columns: list[str], strict: bool = False) -> dict[tuple[str, int], tuple[int, int]]:
    """How well each column suits each role: (role, column number) -> (tier, place),
    less is better; pairs that don't suit are absent.

    Tier 0 and 1 compare spellings (plain, compact) with the role's aliases, the
    place is the alias's; of columns spelled alike only the last counts. Tier 2 looks
    for a role's keyword in the name, the place is the column's (not if ``strict``,
    as it takes e.g. ``order_date`` for an invoice id, Q4).
    """
    ranks: dict[tuple[str, int], tuple[int, int]] = {}
    for role in dims.ROLE_ORDER:
        for k, column in enumerate(columns):
            fits = []
            for tier, spell in enumerate((_plain, _compact)):
                aliases = [spell(a) for a in dims.ROLE_ALIASES[role]]
                name = spell(column)
                if name in aliases and all(spell(later) != name for later in columns[k + 1:]):
                    fits.append((tier, aliases.index(name)))
            if not strict and any(word in column.lower() for word in dims.ROLE_KEYWORDS[role]):
                fits.append((2, k))
            if fits:
                ranks[role, k] = min(fits)
    return ranks


def detect_columns(columns: list[str], strict: bool = False) -> dict[str, str | None]:
    """Canonical role -> actual column name (or None).

    Roles choose in the order customer, invoice, date, quantity, price, each the
    best ranked column that is still free (``column_ranks``).
    """
    ranks = column_ranks(columns, strict)
    chosen: dict[str, int] = {}
    for role in dims.ROLE_ORDER:
        free = [(rank, k) for (r, k), rank in ranks.items() if r == role and k not in chosen.values()]
        if free:
            chosen[role] = min(free)[1]
    return {role: columns[chosen[role]] if role in chosen else None for role in dims.ROLE_ORDER}


def schema_messages(columns: list[str]) -> str:
    """Names the roles without a column, whose values the cleaner makes up
    ('' if there is none)."""
    return "; ".join(f"no column for {role}: its values are generated"
                     for role, column in detect_columns(columns).items() if column is None)


def rename_to_canonical(df: DataFrame, detected: dict[str, str | None] | None = None
                        ) -> tuple[DataFrame, dict[str, str]]:
    """Rename detected columns to the canonical names, by position.

    Returns (frame, inferred) where ``inferred`` maps role -> original name for
    the columns that were renamed. Raises if two columns would have the same name in
    Spark, which ignores case (Q6).
    """
    detected = detected if detected is not None else detect_columns(df.columns)
    inferred = {role: actual for role, actual in detected.items() if actual and actual != role}
    role_of = {actual: role for role, actual in inferred.items()}
    final = [role_of.get(c, c) for c in df.columns]
    seen = [c.lower() for c in final]
    twice = sorted({c for c in seen if seen.count(c) > 1})
    if twice:
        raise ValueError(f"renaming detected columns would give more than one column {twice}")
    return (df.toDF(*final) if inferred else df), inferred


def segmentation_table(scored: DataFrame, symbol: str = "$", code: str = "USD") -> DataFrame:
    """All customers by Monetary (desc) with display names; the money
    text uses H1."""
    from rfmlens.functions import format_currency
    return (scored.select(F.col("customer_id").alias("Customer ID"),
                          F.col("Recency").alias("Recency (days)"),
                          "Frequency",
                          format_currency("Monetary", symbol).alias(f"Revenue ({code})"),
                          "Segment", F.col("Monetary").alias("_m"))
            .orderBy(F.desc("_m"), "Customer ID").drop("_m"))
