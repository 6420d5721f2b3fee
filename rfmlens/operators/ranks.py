"""Exact global (or per-group) ranks and order statistics without a
one-partition window and without one aggregator holding every value.

``percent_rank()``/``cume_dist()`` over a whole table move every row into one
task; an exact ``percentile`` keeps every distinct value in one aggregator.
Here:

1. collapse to distinct (group, value) pairs with counts (map-side combine, so
   a value holding a third of all rows is one row after this step);
2. cut values into contiguous buckets of about ``VALUES_PER_BUCKET`` distinct
   values, at split points from a bounded sample of them (the values with the least
   hashes, so the same for every run; at most ``MAX_BUCKETS`` * ``PER_SPLIT``
   numbers reach the driver). The number of buckets follows the number of values, not
   the session's shuffle partitions;
3. per (group, bucket) totals -> prefix offsets, as DataFrames;
4. running sum inside each (group, bucket) -- a window whose partitions are
   bounded by the bucket size -- plus the offset.

The result is exact: ``n_less`` / ``n_leq`` count rows strictly below / at or
below each distinct value within its group. Only the split points are
sampled, and they only decide how evenly the work is spread.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from rfmlens.operators.selection import select

VALUES_PER_BUCKET = 50_000
MAX_BUCKETS = 4096
PER_SPLIT = 50
#: Rank tables with at most so many values are broadcast to the rows.
BROADCAST_VALUES = 100_000


class RankTable:
    """A ``value_ranks`` result: the distributed table plus the row totals
    (per group, or under key None) that the driver already knows."""

    def __init__(self, df: DataFrame, totals: dict, group: str | None, distinct: dict | None = None):
        self.df, self.totals, self.group = df, totals, group
        self.distinct = distinct or {}

    def n_distinct(self, g=None) -> int:
        return int(self.distinct.get(g, 0))

    def release(self) -> None:
        """Drop the persisted distinct-value counts behind this table."""
        for d in getattr(self, "_persisted", []):
            d.unpersist()
        self._persisted = []

    def n(self, g=None) -> int:
        return int(self.totals.get(g, 0))


def _sort_key(dtype: str) -> Column:
    """A number that never falls as the value grows. Times without a zone are
    read field by field, so no session zone shifts them."""
    v = F.col("value")
    if dtype in ("timestamp_ntz", "date"):
        days = F.datediff(v.cast("date"), F.lit("1970-01-01").cast("date"))
        if dtype == "date":
            return days.cast("double")
        return (days * 86400.0 + F.hour(v) * 3600 + F.minute(v) * 60 + F.second(v)).cast("double")
    if dtype == "timestamp":
        return F.unix_micros(v).cast("double")
    return v.cast("double")


def split_points(values: DataFrame, key: str, n: int, buckets: int | None = None) -> list[float]:
    """Ascending inner split points that cut ``n`` rows of ``values`` into
    buckets of about equal size, from a bounded sample of ``key``."""
    p = int(buckets) if buckets else min(MAX_BUCKETS, -(-n // VALUES_PER_BUCKET))
    if p <= 1 or n <= 1:
        return []
    step = max(1, n // (p * PER_SPLIT))
    rows = values.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0).select(key).collect()
    sample = sorted(x for x in (float(r[0]) for r in rows if r[0] is not None) if math.isfinite(x))
    return sorted({sample[i * len(sample) // p] for i in range(1, p)}) if sample else []


def bucket_of(df: DataFrame, key: str, inner: list[float], out: str) -> DataFrame:
    """``df`` with the number of the bucket that ``key`` falls into."""
    if not inner:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *inner, math.inf]
    return (Bucketizer(splits=splits, inputCol=key, outputCol=out, handleInvalid="keep").transform(df)
            .withColumn(out, F.col(out).cast("int")))


def value_ranks(df: DataFrame, col: str | Column, buckets: int | None = None,
                group: str | None = None) -> RankTable:
    """Distinct non-null values of ``col`` (per ``group`` if given) with
    ``cnt``, ``n_less``, ``n_leq`` and the group's total ``n`` (longs).

    Output: [group,] value, cnt, n_less, n_leq, n. Groups must be few (segments,
    features: the driver gets one row each); ``grouped_quantile`` takes any number.
    """
    c = F.col(col) if isinstance(col, str) else col
    gcols = [F.col(group)] if group else []
    vals = df.select(*gcols, c.alias("value")).where(F.col("value").isNotNull())
    dtype = vals.schema["value"].dataType.simpleString()
    if dtype in ("double", "float"):
        vals = vals.where(~F.isnan("value"))
    keys = [group] if group else []
    # distinct (group, value) counts: read by the split, totals and window jobs,
    # so computed once (their size is the number of distinct values, not rows)
    counts = (vals.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
              .withColumn("_key", _sort_key(dtype))).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = counts.groupBy(*keys).agg(F.sum("cnt").alias("t"), F.count(F.lit(1)).alias("d")).collect()
    totals = {(r[group] if group else None): int(r["t"] or 0) for r in sizes}
    distinct = {(r[group] if group else None): int(r["d"]) for r in sizes}
    inner = split_points(counts, "_key", sum(distinct.values()), buckets)
    bucketed = bucket_of(counts, "_key", inner, "_b")

    per = bucketed.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(k).alias("_g") for k in keys], F.col("_b").alias("_ob"),
                         F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
                         F.sum("_t").over(Window.partitionBy(*keys)).alias("n"))
    same = bucketed["_b"] == F.col("_ob")
    if group:
        same = same & bucketed[group].eqNullSafe(F.col("_g"))
    w = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    out = (bucketed.join(offsets, same)
           .withColumn("n_leq", F.col("_off") + F.sum("cnt").over(w))
           .withColumn("n_less", F.col("n_leq") - F.col("cnt"))
           .select(*keys, "value", "cnt", "n_less", "n_leq", "n"))
    table = RankTable(out, totals, group, distinct)
    table._persisted = [counts]
    return table


def feature_ranks(df: DataFrame, features: list[str], buckets: int | None = None) -> RankTable:
    """Ranks of several numeric columns in one pass: the columns are stacked
    into (feature, value) pairs and ranked per feature, so the split points
    and the totals of all of them cost one small job each."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.selectExpr(f"stack({len(features)}, {pairs}) AS (feature, x)")
    return value_ranks(long, "x", buckets, group="feature")


def feature_table(ranks: RankTable, feature: str) -> RankTable:
    """One feature's slice of a ``feature_ranks`` table, as a global table."""
    df = ranks.df.where(F.col(ranks.group) == feature).drop(ranks.group)
    return RankTable(df, {None: ranks.n(feature)}, None, {None: ranks.n_distinct(feature)})


def order_statistics(ranks, positions: list[int], group: str | None = None,
                     group_positions: dict | None = None) -> dict:
    """Values at 0-based sorted positions from a ``value_ranks`` table.

    Global: ``positions`` -> {pos: value}. Grouped: ``group_positions`` maps
    group -> positions and the result is {group: {pos: value}}. Collects one
    row per requested position at most.
    """
    if isinstance(ranks, RankTable):
        ranks = ranks.df
    if group is None:
        wanted = sorted({int(p) for p in positions})
        if not wanted:
            return {}
        cond = None
        for p in wanted:
            term = (F.col("n_less") <= p) & (F.col("n_leq") > p)
            cond = term if cond is None else (cond | term)
        rows = ranks.where(cond).select("value", "n_less", "n_leq").collect()
        return {p: r["value"] for p in wanted for r in rows if r["n_less"] <= p < r["n_leq"]}
    cond = None
    for g, ps in group_positions.items():
        for p in sorted(set(ps)):
            term = F.col(group).eqNullSafe(F.lit(g)) & (F.col("n_less") <= p) & (F.col("n_leq") > p)
            cond = term if cond is None else (cond | term)
    if cond is None:
        return {}
    rows = ranks.where(cond).select(group, "value", "n_less", "n_leq").collect()
    out: dict = {}
    for g, ps in group_positions.items():
        for p in ps:
            for r in rows:
                if r[group] == g and r["n_less"] <= p < r["n_leq"]:
                    out.setdefault(g, {})[p] = r["value"]
                    break
    return out


def _interp(stats: dict, n: int, q: float):
    h = (n - 1) * float(q)
    lo = int(math.floor(h))
    hi = min(lo + 1, n - 1)
    a, b = float(stats[lo]), float(stats[hi])
    t = h - lo
    return a if t == 0 or a == b else a + (b - a) * t


def _positions(n: int, qs) -> list[int]:
    pos = []
    for q in qs:
        lo = int(math.floor((n - 1) * float(q)))
        pos += [lo, min(lo + 1, n - 1)]
    return pos


def exact_quantiles(df: DataFrame, col: str | Column, qs: list[float],
                    buckets: int | None = None, ranks: RankTable | None = None
                    ) -> tuple[list[float | None], int]:
    """Linear-interpolated quantiles (numpy/pandas default, DuckDB
    ``quantile_cont``), exact and distributed. Returns (values, n). From ``ranks`` if they are there already (or
    ``buckets`` asks for a ranking), else selected without ranking all values."""
    if ranks is None and buckets is None:
        found, sizes = select(df, col, lambda n: _positions(n, qs))
        n = sizes.get(None, 0)
        return [_interp(found[None], n, q) if n else None for q in qs], n
    r = ranks if ranks is not None else value_ranks(df, col, buckets)
    n = r.n()
    if n == 0:
        out = [None] * len(qs)
    else:
        stats = order_statistics(r, _positions(n, qs))
        out = [_interp(stats, n, q) for q in qs]
    if ranks is None:
        r.release()
    return out, n


def grouped_quantiles(r: RankTable, qs: list[float]) -> dict:
    """{group: [quantiles]} from a grouped ``RankTable`` (one small job)."""
    sizes = {g: n for g, n in r.totals.items() if n > 0}
    stats = order_statistics(r, [], group=r.group,
                             group_positions={g: _positions(n, qs) for g, n in sizes.items()})
    return {g: [_interp(stats[g], n, q) for q in qs] for g, n in sizes.items()}


def exact_quantiles_by(df: DataFrame, col: str, group: str, qs: list[float],
                       buckets: int | None = None) -> dict:
    """Per-group linear-interpolated quantiles: {group: [values]} (few groups), selected without ranking all values unless
    ``buckets`` asks for a ranking."""
    if buckets is None:
        found, sizes = select(df, col, lambda n: _positions(n, qs), group)
        return {g: [_interp(found[g], n, q) for q in qs] for g, n in sizes.items()}
    r = value_ranks(df, col, buckets, group=group)
    out = grouped_quantiles(r, qs)
    r.release()
    return out


def attach_ranks(df: DataFrame, col: str, prefix: str, buckets: int | None = None,
                 ranks: RankTable | None = None) -> DataFrame:
    """Join ``{prefix}n_less``, ``{prefix}n_leq``, ``{prefix}n`` onto every row
    by value. A table of at most ``BROADCAST_VALUES`` values (its size is known) is
    broadcast, so a hot value's rows stay where they are; a larger one is
    joined by shuffle, where AQE splits a hot value."""
    r = ranks if ranks is not None else value_ranks(df, col, buckets)
    key_type = df.schema[col].dataType.simpleString()
    t = r.df.select(F.col("value").cast(key_type).alias(col),
                    F.col("n_less").alias(prefix + "n_less"),
                    F.col("n_leq").alias(prefix + "n_leq"),
                    F.col("n").alias(prefix + "n"))
    if 0 < r.n_distinct() <= BROADCAST_VALUES:
        t = F.broadcast(t)
    return df.join(t, on=col, how="left")


def grouped_quantile(df: DataFrame, group: str, col: str, q: float = 0.5,
                     partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated ``q`` quantile of ``col`` per ``group`` for
    any number of groups: (group, quantile)."""
    pairs = df.where(F.col(col).isNotNull()).groupBy(group, col).agg(F.count(F.lit(1)).alias("_cnt"))
    return counted_quantile(pairs, group, col, "_cnt", q, partitions)


def counted_quantile(pairs: DataFrame, group: str, col: str, cnt: str, q: float = 0.5,
                     partitions: int | None = None) -> DataFrame:
    """``grouped_quantile`` of distinct (group, value) rows with counts, without any
    group in one task or one aggregator.

    The pairs are range-partitioned on (group, value), so a group
    holding a third of all rows spans many partitions; the partition id is
    pinned by a checkpoint (the range bounds come from a sample); per
    (partition, group) totals -- at most groups + partitions rows -- give
    each group's offsets; a window per (partition, group) adds the running
    count; the two order statistics around the quantile position are picked
    per group with one more aggregate. Returns (group, quantile).
    """
    from rfmlens.session import checkpoint_dir
    spark = pairs.sparkSession
    checkpoint_dir(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    pairs = pairs.select(group, col, F.col(cnt).alias("_cnt"))
    ranged = (pairs.repartitionByRange(p, group, col).withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    tot = ranged.groupBy("_pid", group).agg(F.sum("_cnt").alias("_t"))
    wg = Window.partitionBy(group).orderBy("_pid")
    offs = (tot.withColumn("_off", F.coalesce(F.sum("_t").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_n", F.sum("_t").over(Window.partitionBy(group))).drop("_t"))
    w = Window.partitionBy("_pid", group).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (ranged.join(offs, ["_pid", group])
              .withColumn("_leq", F.col("_off") + F.sum("_cnt").over(w))
              .withColumn("_less", F.col("_leq") - F.col("_cnt")))
    h = (F.col("_n") - 1) * F.lit(float(q))
    lo = F.floor(h).cast("long")
    hi = F.least(lo + 1, F.col("_n") - 1)
    x = F.col(col).cast("double")
    picked = ranked.select(
        group, "_n", h.alias("_h"),
        F.when((F.col("_less") <= lo) & (lo < F.col("_leq")), x).alias("_vlo"),
        F.when((F.col("_less") <= hi) & (hi < F.col("_leq")), x).alias("_vhi"))
    agg = picked.where(F.col("_vlo").isNotNull() | F.col("_vhi").isNotNull()).groupBy(group).agg(
        F.max("_vlo").alias("_a"), F.max("_vhi").alias("_b"), F.first("_h").alias("_h"))
    t = F.col("_h") - F.floor("_h")
    return agg.select(group, F.when((t == 0) | (F.col("_a") == F.col("_b")), F.col("_a"))
                      .otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * t).alias("quantile"))


def capped_ranks(ranks: RankTable, caps: dict) -> RankTable:
    """Ranks of ``least(value, cap)`` per feature, derived from the ranks of
    the raw values without another ranking pass: values at or above the cap
    merge into one value whose ranks are the smallest ``n_less`` and the
    largest ``n_leq`` of the merged (contiguous) run. ``caps`` maps a group
    (feature) name to its cap; the distinct counts stay upper bounds."""
    g = ranks.group
    cap_expr = F.coalesce(*[F.when(F.col(g) == F.lit(n), F.lit(float(c))) for n, c in caps.items()])
    df = (ranks.df.withColumn("value", F.least(F.col("value"), cap_expr))
          .groupBy(g, "value")
          .agg(F.sum("cnt").alias("cnt"), F.min("n_less").alias("n_less"), F.max("n_leq").alias("n_leq"),
               F.first("n").alias("n")))
    return RankTable(df, dict(ranks.totals), g, dict(ranks.distinct))
