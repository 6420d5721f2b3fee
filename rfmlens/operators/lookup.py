"""Customer standing and lookup.

Whole-table forms: every customer gets its standing from distributed exact
ranks (no single-partition window), and segment figures come from a per-
segment aggregate of <= 8 rows that is broadcast back, instead of a window
partitioned by segment (a segment may hold a third of all customers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rfmlens import dims
from rfmlens.functions import band_color, format_currency
from rfmlens.operators.ranks import attach_ranks, feature_ranks, feature_table
from rfmlens.session import small_side

FEATURES = ("Recency", "Frequency", "Monetary")


def percentile_standing(scored: DataFrame, buckets: int | None = None, ranks=None) -> DataFrame:
    """W6/W7/H4 for every customer: percentile = 100 * share of customers with
    a value <= own (Recency: 100 minus that), band colour, and the revenue
    rank both ascending (#1 = lowest spender, as the reference shows it) and
    descending. ``ranks`` may be a ``feature_ranks`` table of the same
    customers' R/F/M computed earlier."""
    out = scored
    ranks = ranks if ranks is not None else feature_ranks(scored, list(FEATURES), buckets)
    for f, p in (("Recency", "r_"), ("Frequency", "f_"), ("Monetary", "m_")):
        out = attach_ranks(out, f, p, ranks=feature_table(ranks, f))
    pct = {f: F.col(f"{p}n_leq") * 100.0 / F.col(f"{p}n")
           for f, p in (("Recency", "r_"), ("Frequency", "f_"), ("Monetary", "m_"))}
    return out.select(
        "customer_id", "Segment", "Recency", "Frequency", "Monetary",
        (100 - pct["Recency"]).alias("Recency_Pct"),
        pct["Frequency"].alias("Frequency_Pct"),
        pct["Monetary"].alias("Monetary_Pct"),
        band_color(100 - pct["Recency"]).alias("Recency_Band"),
        band_color(pct["Frequency"]).alias("Frequency_Band"),
        band_color(pct["Monetary"]).alias("Monetary_Band"),
        (F.col("m_n_less") + 1).alias("revenue_rank_asc"),
        (F.col("m_n") - F.col("m_n_leq") + 1).alias("revenue_rank"))


def segment_context(scored: DataFrame) -> DataFrame:
    """Difference of Monetary to the segment mean (signed) and the
    segment size, via a broadcast per-segment aggregate."""
    seg = scored.groupBy("Segment").agg(F.avg("Monetary").alias("Segment_Avg_M"),
                                        F.count(F.lit(1)).alias("Segment_Size"))
    return (scored.join(small_side(seg), "Segment")
            .select("customer_id", "Segment", "Monetary", "Segment_Avg_M", "Segment_Size",
                    (F.col("Monetary") - F.col("Segment_Avg_M")).alias("Diff_To_Segment")))


def _global_range(scored: DataFrame) -> dict[str, tuple[Column, Column]]:
    # one scalar subquery returning a struct: a single aggregate pass
    mm = scored.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in FEATURES],
                                          *[F.max(c).alias(f"hi_{c}") for c in FEATURES]).alias("s"))
    s = mm.scalar()
    return {c: (s[f"lo_{c}"], s[f"hi_{c}"]) for c in FEATURES}


def _minmax(x: Column, lo: Column, hi: Column, invert: bool) -> Column:
    v = (x - lo) / (hi - lo + dims.NORM_EPS)
    return 1 - v if invert else v


def minmax_scores(scored: DataFrame) -> DataFrame:
    """Every customer's and its segment mean's R/F/M scaled to the global
    range (+1e-9), Recency inverted."""
    rng = _global_range(scored)
    seg = scored.groupBy("Segment").agg(*[F.avg(c).alias(f"seg_{c}") for c in FEATURES])
    j = scored.join(small_side(seg), "Segment")
    cols = []
    for c in FEATURES:
        lo, hi = rng[c]
        cols.append(_minmax(F.col(c), lo, hi, c == "Recency").alias(f"{c}_Score"))
        cols.append(_minmax(F.col(f"seg_{c}"), lo, hi, c == "Recency").alias(f"Segment_{c}_Score"))
    return j.select("customer_id", "Segment", *cols)


def by_monetary(scored: DataFrame) -> DataFrame:
    """All customers by Monetary, highest first (a range-partitioned sort)."""
    return scored.select("customer_id", "Recency", "Frequency", "Monetary", "Segment") \
        .orderBy(F.desc("Monetary"), "customer_id")


def customer_ids(scored: DataFrame) -> DataFrame:
    """Sorted distinct customer ids as text."""
    return scored.select(F.col("customer_id").cast("string").alias("customer_id")).distinct() \
        .orderBy("customer_id")


def random_customer(scored: DataFrame, seed: int = 42) -> DataFrame:
    """T4: one pseudo-random customer; a distributed top-1 by the MD5 of id and seed."""
    order = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(str(seed))).cast("binary"))
    return scored.orderBy(order, "customer_id").limit(1)


def lookup(scored: DataFrame, customer_id: str) -> DataFrame:
    """Point lookup by id text. The comparison is made in the column's own
    type so that parquet can skip row groups (a cast on the column would stop
    the pushdown): numeric ids compare numerically when the text is a whole
    number, and never match otherwise."""
    key = str(customer_id)
    dtype = scored.schema["customer_id"].dataType.simpleString()
    if dtype in ("bigint", "int", "smallint", "tinyint"):
        try:
            return scored.where(F.col("customer_id") == F.lit(int(key)))
        except ValueError:
            return scored.where(F.lit(False))
    if dtype == "string":
        return scored.where(F.col("customer_id") == F.lit(key))
    return scored.where(F.col("customer_id").cast("string") == F.lit(key))


def _me(scored: DataFrame, customer_id: str):
    """The customer's row (a pushed-down point lookup) and its own values as
    literals: one row reaches the driver, and every later expression uses
    constants instead of re-planning a subquery per reference."""
    me = lookup(scored, customer_id)
    row = me.select(*FEATURES, "Segment").limit(1).collect()
    if not row:
        return me, None
    return me, {k: F.lit(v) for k, v in row[0].asDict().items()}


def nearest_peers(scored: DataFrame, customer_id: str, k: int = 10) -> DataFrame:
    """The ``k`` customers of the same segment closest to one customer in
    range-normalised R/F/M (Euclidean, +1e-9), the customer excluded.
    One pass for the global range, one filtered scan and a top-k."""
    _, mine = _me(scored, customer_id)
    if mine is None:
        return scored.select("customer_id", "Recency", "Frequency", "Monetary",
                             F.lit(None).cast("double").alias("distance")).limit(0)
    rng = _global_range(scored)
    terms = []
    for c in FEATURES:
        lo, hi = rng[c]
        terms.append(F.pow((F.col(c) - mine[c]) / (hi - lo + dims.NORM_EPS), 2))
    dist = F.sqrt(terms[0] + terms[1] + terms[2])
    peers = scored.where((F.col("Segment") == mine["Segment"]) &
                         (F.col("customer_id").cast("string") != F.lit(str(customer_id))))
    return (peers.select("customer_id", "Recency", "Frequency", "Monetary", dist.alias("distance"))
            .orderBy("distance", "customer_id").limit(k))


def peer_table(peers: DataFrame, symbol: str = "$", code: str = "USD") -> DataFrame:
    """The peer list as displayed: renamed columns, money as text."""
    return peers.orderBy("distance", "customer_id").select(
        F.col("customer_id").alias("Customer ID"), F.col("Recency").alias("Recency (days)"), "Frequency",
        format_currency("Monetary", symbol).alias(f"Revenue ({code})"))


def segment_histogram(scored: DataFrame, bins: int = 25, feature: str = "Monetary",
                      segment: str | None = None) -> DataFrame:
    """Equal-width histogram of ``feature`` per segment (or for one), with
    ``bins`` bins between the segment's min and max; the max falls in the last
    bin and a flat segment has one bin."""
    df = scored if segment is None else scored.where(F.col("Segment") == segment)
    rng = df.groupBy("Segment").agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    x = F.col(feature).cast("double")
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int") + 1, F.lit(bins)))
    width = (F.col("hi") - F.col("lo")) / bins
    return (df.join(small_side(rng), "Segment").withColumn("bin", b)
            .groupBy("Segment", "bin").agg(F.count(F.lit(1)).alias("count"),
                                           F.first("lo").alias("lo"), F.first("hi").alias("hi"))
            .select("Segment", "bin", "count",
                    (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_end")))


def customer_profile(scored: DataFrame, cluster_map: DataFrame, customer_id: str,
                     symbol: str = "$") -> DataFrame:
    """J7 (+W6-W10 for one customer): the customer's row, its segment record,
    percentiles against all customers, revenue rank, segment size/mean and
    the signed difference. Zero rows when the id is unknown; a cluster without a
    mapping shows the default record (``dims.PROFILE_DEFAULT``, empty texts)."""
    me, mine = _me(scored, customer_id)
    if mine is None:
        mine = {c: F.lit(None) for c in (*FEATURES, "Segment")}
    agg = [F.avg(F.when(F.col(c) <= mine[c], 1.0).otherwise(0.0)).alias(f"p_{c}") for c in FEATURES]
    agg += [F.count_if(F.col("Monetary") < mine["Monetary"]).alias("below"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("Segment") == mine["Segment"]).alias("Segment_Size"),
            F.avg(F.when(F.col("Segment") == mine["Segment"], F.col("Monetary"))).alias("Segment_Avg_M")]
    st = scored.agg(F.struct(*agg).alias("s")).scalar()
    rec = cluster_map.select(F.col("Cluster").alias("_c"), F.col("Segment").alias("_s"), F.col("SegmentEmoji").alias("_e"),
                             F.col("SegmentColor").alias("_col"), "Description", "Action")
    name, emoji, color = (F.lit(x) for x in dims.PROFILE_DEFAULT)
    out = (me.select("*", *[st[f].alias(f) for f in ("p_Recency", "p_Frequency", "p_Monetary",
                                                        "below", "n", "Segment_Size", "Segment_Avg_M")])
           .join(rec, F.col("Cluster") == F.col("_c"), "left"))
    return out.select(
        "customer_id", "Cluster", F.coalesce("_s", name).alias("Segment"), F.coalesce("_e", emoji).alias("SegmentEmoji"),
        F.coalesce("_col", color).alias("SegmentColor"), F.coalesce("Description", F.lit("")).alias("Description"),
        F.coalesce("Action", F.lit("")).alias("Action"),
        "Recency", "Frequency", "Monetary", F.concat(F.col("Recency").cast("string"), F.lit("d")).alias("Recency_text"),
        F.col("Frequency").cast("string").alias("Frequency_text"), format_currency("Monetary", symbol).alias("Monetary_text"),
        (100 - F.col("p_Recency") * 100).alias("Recency_Pct"),
        (F.col("p_Frequency") * 100).alias("Frequency_Pct"),
        (F.col("p_Monetary") * 100).alias("Monetary_Pct"),
        (F.col("below") + 1).alias("revenue_rank_asc"), F.col("n").alias("customers"),
        "Segment_Size", "Segment_Avg_M",
        (F.col("Monetary") - F.col("Segment_Avg_M")).alias("Diff_To_Segment"),
        format_currency(F.abs(F.col("Monetary") - F.col("Segment_Avg_M")), symbol).alias("Diff_text"))
