"""A few order statistics without ranking all values: brackets around each, narrowed by counting.

Ranking shuffles every distinct value. Where only some positions are wanted, each has a bracket of values that is known to hold it,
and the number of rows below the bracket. A bounded sample of the rows in the brackets proposes narrower ones, one aggregate counts
the rows below and up to their ends, and the position says which part holds it. After two or three such passes few rows are
left in a bracket; their counts by value end it. What is shuffled is one row of counts a task and a bounded number of values at the
end, however many values there are. Samples only propose: the result is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 20_000            # rows of each group's brackets that a pass looks at, about
LEFT = 20_000              # rows of a bracket that are counted by value at the end


class _Bracket:
    def __init__(self, group, position: int, n: int, lo: float, hi: float):
        self.group, self.position, self.lo, self.hi = group, position, lo, hi
        self.below, self.inside, self.stuck = 0, n, False

    def proposal(self, sample: list[float]) -> tuple[float, float]:
        """Ends of a narrower bracket that very likely holds the position."""
        mine = [v for v in sample if self.lo <= v <= self.hi]
        m = len(mine)
        if not m:
            return self.lo, self.hi
        share = (self.position - self.below + 0.5) / self.inside
        wide = 4 * math.sqrt(m * max(share * (1 - share), 0)) + 3
        a, b = math.floor(share * m - wide), math.ceil(share * m + wide)
        return mine[a] if a >= 0 else self.lo, mine[b] if b < m else self.hi


def select(df: DataFrame, value: str | Column, positions, group: str | None = None, sample: int = SAMPLE, left: int = LEFT
           ) -> tuple[dict, dict]:
    """({group: {position: value}}, {group: rows}) for the 0-based sorted positions that ``positions`` (rows -> list) asks for in
    each group; without ``group`` its key is None. Null and NaN values count for nothing; groups must be few."""
    g = F.col(group) if group else F.lit(None).cast("string")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(g.alias("g"), v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes, brackets = {}, []
    for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        sizes[r["g"]] = r["n"]
        brackets += [_Bracket(r["g"], p, r["n"], r["lo"], r["hi"]) for p in sorted(set(positions(r["n"])))]

    def within(some: list[_Bracket]) -> Column:
        hit = F.lit(False)
        for b in some:
            hit = hit | (F.col("g").eqNullSafe(F.lit(b.group)) & F.col("v").between(b.lo, b.hi))
        return hit

    turn = 0
    while wide := [b for b in brackets if b.lo < b.hi and b.inside > left and not b.stuck]:
        turn += 1
        most = {}
        for b in wide:
            most[b.group] = most.get(b.group, 0) + b.inside
        chance = F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(k)), F.lit(min(1.0, sample * sum(b.group == k for b in wide) / n)))
                              for k, n in most.items()])
        seen: dict = {}
        for r in rows.where(within(wide)).where(F.rand(turn) < chance).collect():
            seen.setdefault(r["g"], []).append(r["v"])
        ends = [b.proposal(sorted(seen.get(b.group, []))) for b in wide]
        counts = {r["g"]: r for r in rows.groupBy("g").agg(*[x for i, (lo, hi) in enumerate(ends) for x in (
            F.count_if(F.col("v") < lo).alias(f"lt{i}"), F.count_if(F.col("v") <= hi).alias(f"le{i}"))]).collect()}
        for i, (b, (lo, hi)) in enumerate(zip(wide, ends)):
            under, upto = counts[b.group][f"lt{i}"], counts[b.group][f"le{i}"]
            before = b.lo, b.hi
            if b.position < under:                     # the sample missed it: rare, and only the one end is moved
                b.hi = lo
            elif b.position < upto:
                b.lo, b.hi, b.below, b.inside = lo, hi, under, upto - under
            else:
                b.lo = hi
                b.below = rows.where(F.col("g").eqNullSafe(F.lit(b.group)) & (F.col("v") < hi)).count()
            b.stuck = (b.lo, b.hi) == before
    out: dict = {k: {} for k in sizes}
    for b in brackets:
        if b.lo >= b.hi:
            out[b.group][b.position] = b.lo
    some = [b for b in brackets if b.lo < b.hi]
    if some:
        values: dict = {}
        for r in rows.where(within(some)).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).collect():
            values.setdefault(r["g"], []).append((r["v"], r["n"]))
        for b in some:
            at = b.below
            for x, n in sorted(values[b.group]):
                if b.lo <= x <= b.hi:
                    at += n
                    if at > b.position:
                        out[b.group][b.position] = x
                        break
    return out, sizes

