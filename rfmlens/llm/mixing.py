"""Mixing sources to target weights by pivotal dependent rounding (native).

Targets: sources sorted by code point (null last) weigh 5, 2, 1, repeating, and
share the whole size of the corpus; a target stops at ``MAX_COPIES`` times its
source's size and the excess goes to the others by weight until none is above.
That limit is one level ``t``: target = min(cap, t * weight), and ``t`` follows from
the sources sorted by cap / weight.

Copies: a source with rate r = target / size takes each document floor(r) times
and one more time with probability r - floor(r). The pivotal method rounds
these probabilities together: two open documents trade words, so that one
gains what the other loses and at least one of them ends at 0 or 1; which
one gains is drawn so that each keeps its expectation. The pair's open
remainder meets the next document. The words taken thus change by nothing but
rounding, and a source ends with one open document, which goes to the nearer end:
a source misses its target by half of its largest document at most.

The trades run as a reduction tree: documents are dealt by a hash to blocks of
about ``BLOCK`` of their source, each block folds its documents in a fixed order
and hands up at most one open document, and the remainders are dealt to blocks
again until a source has one. A hot source only has more blocks. Draws come from hashes of the ids, so reruns agree. Rows equal
in id, source and size are one unit with a count (so none can crowd a block); its
whole copies are shared out among them.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source
is a source of its own, the last; rows with null ids count like any others; a
source of size 0 has target 0; an empty table gives an empty result; further columns, whatever their names, are
ignored by the query's figures and kept by ``take_mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rfmlens.llm.common import keep, let, n_words, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK = 256      # documents that meet in one fold, on average
SEED = 20240607
EPS = 1e-12      # probabilities this near to 0 or 1 are integral


def targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target for a table of (source, size) rows.

    Only per-source sums meet in the global windows below: one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(rank) - 1) % n)
    per = (per.withColumn("w", w).withColumn("cap", max_copies * F.col("source_size").cast("double"))
           .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double")))
    # sources fill up in order of cap / weight; a level t leaves (total - caps before) to the weights from here on
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    # a frame that ends with the last row would be added up anew for each row; weights are whole numbers, so this is exact
    rest = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    level = (F.col("total") - before) / rest
    per = per.withColumn("level", level)
    # the first level that does not lift its own source above the cap holds for it and all after it
    full = F.col("level") >= F.col("cap") / F.col("w")
    t = F.min(F.when(~full, F.col("level"))).over(Window.partitionBy())
    first = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(
        by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (per.withColumn("t", F.coalesce(first, t))
            .select("source", "source_size",
                    F.when(full | F.col("t").isNull(), F.col("cap"))
                    .otherwise(F.least("cap", F.col("t") * F.col("w"))).alias("target")))


def _hash01(*cols) -> Column:
    """A uniform number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(2 ** 53)


def _fold(units: Column, unit_type: str, level: int) -> Column:
    """Pivotal rounding of one block's sorted units: struct(done: units whose
    p is integral, open: the remaining one or null)."""
    zero = F.struct(F.lit(None).cast(unit_type).alias("open"), F.array().cast(f"array<{unit_type}>").alias("done"))

    def put(u: Column, p: Column) -> Column:
        return u.withField("p", p)

    def integral(p: Column) -> Column:
        return (p <= EPS) | (p >= 1 - EPS)

    def trade(acc: Column, x: Column) -> Column:
        def settle(m: Column) -> Column:
            # m.gain: words the open one wins if it wins, m.loss: words it loses otherwise
            up = _hash01(F.lit(SEED + level), acc["open"]["id"], x["id"], acc["open"]["n"], x["n"]) * (
                m["gain"] + m["loss"]) < m["loss"]
            words = F.when(up, m["gain"]).otherwise(-m["loss"])
            pair = F.array(put(acc["open"], acc["open"]["p"] + words / acc["open"]["size"]),
                           put(x, x["p"] - words / x["size"]))
            return let(pair, lambda q: F.struct(
                F.get(F.filter(q, lambda u: ~integral(u["p"])), F.lit(0)).alias("open"),
                F.concat(acc["done"], F.transform(F.filter(q, lambda u: integral(u["p"])),
                                                  lambda u: put(u, F.round(u["p"])))).alias("done")))
        a, b = acc["open"], x
        moves = F.struct(F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]).alias("gain"),
                         F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"]).alias("loss"))
        return F.when(a.isNull(), F.struct(x.alias("open"), acc["done"].alias("done"))).otherwise(let(moves, settle))
    return F.aggregate(units, zero, trade)


def round_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` holds id, source, size, target, source_size; the result has one
    row per row of it, with copies (long) besides."""
    units = (docs.groupBy("id", "source", "size", "source_size", "target")
             .agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("want", F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size"))
                         .otherwise(0.0))
             .withColumn("whole", F.floor("want").cast("long"))
             .withColumn("p", F.col("want") - F.col("whole"))
             .withColumn("n", F.xxhash64(F.lit(SEED), "id", "size")))
    units = keep(units.select(F.struct("id", "source", F.col("size").cast("double").alias("size"), "p", "n",
                                       "whole", "rows", "source_size", "target").alias("u")), "units")
    is_open = (F.col("u.p") > EPS) & (F.col("u.p") < 1 - EPS)
    unit_type = units.schema["u"].dataType.simpleString()
    settled = [units.where(~is_open).select(F.col("u").withField("p", F.round("u.p")).alias("u"))]
    open_units, level = units.where(is_open), 0
    most = open_units.groupBy("u.source").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    while most > 1:
        # each source's units, dealt by a hash to as many blocks as keep them near the block size
        count = open_units.groupBy(F.col("u.source").alias("s")).agg(F.count(F.lit(1)).alias("c")).select(
            "s", F.ceil(F.col("c") / block).alias("blocks"))
        dealt = open_units.join(F.broadcast(count) if _few(count) else count,
                                F.col("u.source").eqNullSafe(F.col("s")))
        at = F.pmod(F.xxhash64(F.lit(SEED + 101 + level), F.col("u.n"), F.col("u.id")), F.col("blocks"))
        # sorted by the hash n, then the id
        item = F.struct(F.col("u.n").alias("n"), F.col("u.id").alias("id"), F.col("u").alias("u"))
        folded = (dealt.groupBy(F.col("s"), at.alias("b")).agg(F.sort_array(F.collect_list(item)).alias("a"))
                  .select(_fold(F.transform("a", lambda x: x["u"]), unit_type, level).alias("f")))
        folded = keep(folded, f"level{level}")
        settled.append(folded.select(F.explode("f.done").alias("u")))
        open_units = folded.where(F.col("f.open").isNotNull()).select(F.col("f.open").alias("u"))
        most, level = math.ceil(most / block) if most > block else 1, level + 1
    settled.append(open_units.select(F.col("u").withField("p", F.round("u.p")).alias("u")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionAll(s)
    total = F.col("u.whole") + F.col("u.p").cast("long")
    share = F.floor(total / F.col("u.rows")).cast("long")
    return (out.select("u", F.explode(F.sequence(F.lit(1).cast("long"), F.col("u.rows"))).alias("k"))
            .select(F.col("u.id").alias("id"), F.col("u.source").alias("source"), F.col("u.size").cast("long").alias("size"),
                    F.col("u.source_size").alias("source_size"), F.col("u.target").alias("target"),
                    F.col("k"), (share + (F.col("k") <= total - share * F.col("u.rows")).cast("long")).alias("copies")))


def _few(sources: DataFrame, limit: int = 10_000) -> bool:
    """Whether the per-source table is small enough to broadcast."""
    return len(sources.select(F.lit(1)).limit(limit + 1).collect()) <= limit


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, size, source_size, target, k, copies for each row of ``docs``
    (k numbers the rows that are equal in id, source and size)."""
    slim = keep(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"),
                            n_words(docs[text_col]).alias("size")), "sizes")
    t = targets(slim, weights, max_copies).select(F.col("source").alias("s"), "source_size", "target")
    joined = slim.join(F.broadcast(t) if _few(t) else t, slim["source"].eqNullSafe(F.col("s"))).drop("s")
    return round_copies(joined)


def take_mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, id_col: str = "doc_id",
             source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, all columns
    as they were."""
    chosen = mix(docs, weights, max_copies, id_col, source_col, text_col).where("copies > 0").select(
        F.col("id").alias("i2"), F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("k").alias("k2"), "copies")
    cols = docs.columns
    row = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"),
                      docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))
    # rows equal in id, source and size are numbered as in mix()
    number = F.row_number().over(Window.partitionBy("id", "source", "size").orderBy(F.xxhash64("row")))
    both = row.withColumn("k", number).join(chosen, F.col("id").eqNullSafe(F.col("i2")) & F.col("source").eqNullSafe(F.col("s2"))
                                            & (F.col("size") == F.col("z2")) & (F.col("k") == F.col("k2")))
    return (both.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)]))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                            (F.col("copies") * F.col("size")).alias("taken"))
