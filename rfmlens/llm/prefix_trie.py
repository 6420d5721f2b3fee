"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

* **Nodes.** A conversation's turns are numbered without bringing it to one task: rows are sorted by range
  of (conversation, turn, role, text), so a conversation of any length spans many partitions, and a place is the
  one in its partition plus the conversation's rows in earlier ones. A prefix is named by its depth and two
  xors of 64-bit hashes of (depth, turn's contents) over its turns: running values in a partition, and one value for each
  earlier partition. One aggregate over (depth, name) gives the nodes, so a hot first turn is added up before the shuffle.
* **Contraction** (``subtree_sums``). Rounds of joins shrink the tree to its root. *Rake*: every leaf goes, what it
  holds is added to its parent (an aggregate by parent, so a parent of a third of all nodes is added up in parts first). *Compress*: a node
  with one child left is taken out where a hash of the round says so and doesn't say so for the child (no two neighbours
  go at once); the child gets its parent and keeps what lay between on its edge. Each round takes a constant
  share of chains and all leaves, so the rounds grow with the logarithm of the tree, also of one long chain.
* **Expansion.** Backwards through the rounds, each node taken out gets its child's total, its own and its edge's. Join
  keys are node ids, each at most once on either side.

A round's table is written below ``spark.checkpoint.dir``, so a lost executor costs one round at most.

Defined results: rows sort by (turn, role, text), null turns first, so ties and repeated rows have one order and each
stays a turn; null roles and texts are empty; rows without a conv_id belong to no conversation and are left out; further columns are
ignored, whatever their names; an empty table has no conversation, so no node and not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rfmlens.llm.common import keep, n_words, shuffle_partitions, table

START = 32                 # characters of roles and texts that range borders are made of
LISTED = 4096              # conversation ids in a piece of a node's list


# -- subtree sums ---------------------------------------------------------------------------------
def subtree_sums(tree: DataFrame, columns: list[str]) -> DataFrame:
    """node and the sums of ``columns`` (longs) over its subtree, itself included, for each row of ``tree``: node
    (unique, any type that sorts), parent (null for a root; must be a node), columns."""
    def coin(node: Column, t: int) -> Column:
        return F.xxhash64(F.lit(t), node) % 2 == 0

    own, edge = [f"a{i}" for i in range(len(columns))], [f"e{i}" for i in range(len(columns))]
    state = tree.select("node", "parent", *[F.col(c).cast("long").alias(a) for c, a in zip(columns, own)],
                        *[F.lit(0).cast("long").alias(e) for e in edge])
    n = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    state = state.join(n, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rounds: list[tuple[DataFrame, int]] = []
    while True:
        t = len(rounds)
        leaf = F.col("n") == 0
        below = (state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("up"))
                 .agg(F.count_if(~leaf).alias("m"), F.min(F.when(~leaf, F.col("node"))).alias("child"),
                      *[F.sum(F.when(leaf, F.col(a) + F.col(e)).otherwise(F.lit(0))).alias(f"r{a}") for a, e in zip(own, edge)],
                      *[F.min(F.when(~leaf, F.col(e))).alias(f"c{e}") for e in edge]))
        joined = state.join(below, state["node"] == below["up"], "left")
        out = ((F.col("m") == 1) & F.col("parent").isNotNull() & coin(F.col("node"), t) & ~coin(F.col("child"), t))
        kind = F.when(leaf, F.lit("leaf")).when(F.coalesce(out, F.lit(False)), F.lit("spliced")).otherwise(F.lit("stays"))
        now = keep(joined.select("node", "parent", *[(F.col(a) + F.coalesce(F.col(f"r{a}"), F.lit(0))).alias(a) for a in own], *edge,
                                 F.coalesce("m", F.lit(0)).alias("n"), "child", *[f"c{e}" for e in edge], kind.alias("kind")), f"round{t}")
        sizes = {r["kind"]: r["count"] for r in now.groupBy("kind").count().collect()}
        rounds.append((now, sizes.get("spliced", 0)))
        if not sizes.get("stays"):
            break
        gone = now.where("kind = 'spliced'").select(
            F.col("child").alias("node"), F.col("parent").alias("above"), *[(F.col(a) + F.col(e)).alias(f"x{e}") for a, e in zip(own, edge)])
        state = now.where("kind = 'stays'").drop("child", "kind", *[f"c{e}" for e in edge])
        if sizes.get("spliced"):
            state = state.join(gone, "node", "left")
            state = state.select("node", F.coalesce("above", "parent").alias("parent"), *own,
                                 *[(F.col(e) + F.coalesce(F.col(f"x{e}"), F.lit(0))).alias(e) for e in edge], "n")
    known = None
    for t, (now, spliced) in reversed(list(enumerate(rounds))):
        totals = now.where("kind = 'leaf'").select("node", *own)
        if known is not None:
            totals = totals.unionAll(known)
        if spliced:
            low = known.select(F.col("node").alias("child"), *[F.col(a).alias(f"t{a}") for a in own])
            back = now.where("kind = 'spliced'").join(low, "child").select(
                "node", *[(F.col(a) + F.col(f"c{e}") + F.col(f"t{a}")).alias(a) for a, e in zip(own, edge)])
            totals = keep(totals.unionAll(back), f"totals{t}")
        known = totals
    return known.toDF("node", *columns)


# -- nodes ----------------------------------------------------------------------------------------
def numbered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, parts): turns are conv_id, part, place, t1, t2 (hashes of role and text), n_words; parts are conv_id,
    part, first (the place of the conversation's first turn in the part), n, before (its turns in earlier
    parts). A turn's number is before + place - first + 1."""
    spark = rows.sparkSession
    empty = F.lit("")
    rows = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"),
                        F.coalesce("text", empty).alias("text")).where("conv_id IS NOT NULL"))
    long = F.length("role") > START
    ranged = (rows.repartitionByRange(shuffle_partitions(spark), "conv_id", "turn", F.substring("role", 1, START), long,
                                      F.when(~long, F.substring("text", 1, START)))
              .sortWithinPartitions("conv_id", "turn", "role", "text"))
    turns = keep(ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("t1"),
                               F.xxhash64(F.lit(1), "text", "role").alias("t2"), n_words(F.col("text")).alias("n_words"))
                 .select("conv_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"),
                         "t1", "t2", "n_words"), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
             .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    return turns, keep(parts, "parts")


def _names(depth: Column, t1: Column, t2: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, t1, t2), F.xxhash64(F.lit(1), depth, t2, t1)


def prefix_rows(rows: DataFrame, family: int = 1, borrowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(convs, prefixes). convs: conv_id, n (turns). prefixes, one row for each conversation and depth from 1 on: conv_id, depth, x1, x2
    (the prefix's name), p1, p2 (its parent's), n_words (of its last turn), last (the conversation ends there).

    With ``borrowed`` (of conv_id, 3 at most) a conversation's first turns are replaced: it starts with the
    first ``borrowed`` turns of conversation ``conv_id - conv_id % family`` and goes on with its own after as many."""
    turns, parts = numbered_turns(rows)
    h = borrowed.cast("long") if borrowed is not None else F.lit(0).cast("long")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    head = (turns.where(F.col("conv_id") % family == 0).join(parts, ["conv_id", "part"])
            .select("conv_id", (F.col("before") + F.col("place") - F.col("first") + 1).alias("r"), "t1", "t2", "n_words").where("r <= 3")
            .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("r", "t1", "t2", "n_words"))).alias("head")))
    convs = (convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(head, "base", "left")
             .withColumn("head", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array().cast("array<struct<r:bigint,t1:bigint,t2:bigint,n_words:bigint>>")))
             .withColumn("b", F.size("head").cast("long")))

    def running(which: int) -> Column:
        parts_ = F.transform("head", lambda x: _names(x["r"], x["t1"], x["t2"])[which])
        return F.transform("head", lambda x, i: F.aggregate(F.slice(parts_, 1, i + 1), F.lit(0).cast("long"), lambda a, y: a.bitwiseXOR(y)))

    convs = keep(convs.select("conv_id", "h", "b", (F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"), "head",
                              running(0).alias("x1s"), running(1).alias("x2s")), "convs")
    zero = F.lit(0).cast("long")
    first = (convs.select("conv_id", "n", F.posexplode(F.arrays_zip("head", "x1s", "x2s")).alias("i", "x"), "x1s", "x2s")
             .select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("x.x1s").alias("x1"), F.col("x.x2s").alias("x2"),
                     F.when(F.col("i") > 0, F.get("x1s", F.col("i") - 1)).otherwise(zero).alias("p1"),
                     F.when(F.col("i") > 0, F.get("x2s", F.col("i") - 1)).otherwise(zero).alias("p2"),
                     F.col("x.head.n_words").alias("n_words"), (F.col("i") + 1 == F.col("n")).alias("last")))
    # what a part's turns need to know: one row for each (conversation, part)
    known = parts.join(convs.select("conv_id", "h", "b", F.col("n").alias("all"), F.coalesce(F.get("x1s", F.col("b").cast("int") - 1), zero).alias("y1"),
                                    F.coalesce(F.get("x2s", F.col("b").cast("int") - 1), zero).alias("y2")), "conv_id")
    r = F.col("before") + F.col("place") - F.col("first") + 1
    own = turns.join(known, ["conv_id", "part"]).where(r > F.col("h")).withColumn("depth", F.col("b") + r - F.col("h"))
    e1, e2 = _names(F.col("depth"), F.col("t1"), F.col("t2"))
    own = own.withColumn("e1", e1).withColumn("e2", e2)
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (own.groupBy("conv_id", "part").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
               .select("conv_id", "part", F.coalesce(F.bit_xor("s1").over(earlier), zero).alias("z1"),
                       F.coalesce(F.bit_xor("s2").over(earlier), zero).alias("z2")))
    own = (own.withColumn("w1", F.bit_xor("e1").over(so_far)).withColumn("w2", F.bit_xor("e2").over(so_far))
           .join(carried, ["conv_id", "part"])
           .withColumn("x1", F.col("w1").bitwiseXOR(F.col("z1")).bitwiseXOR(F.col("y1")))
           .withColumn("x2", F.col("w2").bitwiseXOR(F.col("z2")).bitwiseXOR(F.col("y2")))
           .select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"),
                   F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"), "n_words", (F.col("depth") == F.col("all")).alias("last")))
    return convs.select("conv_id", "n"), keep(first.unionAll(own), "prefixes")


def conversation_trie(rows: DataFrame, family: int = 1, borrowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations in ``rows`` (conv_id, turn, role, text), as ``prefix_rows`` builds them.

    nodes: depth, x1, x2 (the prefix's name; zeros at the root), conv_id (least member; with depth it names the node, too), parent_conv_id
    (the parent's conv_id; null at the root), n_convs, n_children, n_leaves, saved_tokens. ends: depth, x1, x2, first, ids: the
    conversations that end at a node, ascending decimal ids joined by commas, in pieces of ``LISTED`` at most that sort by
    ``first``, so that no node's list has to fit in one row."""
    spark = rows.sparkSession
    convs, prefixes = prefix_rows(rows, family, borrowed)
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    root = spark.createDataFrame([(0, 0, 0, top["conv_id"], top["n_convs"], 0, None, None)] if top["n_convs"] else [],
                                 "depth long, x1 long, x2 long, conv_id long, n_convs long, n_words long, p1 long, p2 long")
    nodes = keep(prefixes.groupBy("depth", "x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2")).unionByName(root), "nodes")
    # the root is the parent of all nodes of depth 1: no join for them
    parents = nodes.select((F.col("depth") + 1).alias("d"), F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("conv_id").alias("up")).where("d > 1")
    found = (nodes.where("depth > 1").join(parents, (F.col("depth") == F.col("d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")))
             .drop("d", "q1", "q2").unionByName(nodes.where("depth <= 1").withColumn("up", F.when(F.col("depth") == 1, F.lit(top["conv_id"]).cast("long")))))
    node = F.struct("conv_id", "depth")
    found = keep(found.withColumn("node", node).withColumn("parent", F.when(F.col("depth") > 0, F.struct(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")))),
                 "tree")
    children = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    found = keep(found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    sums = subtree_sums(found.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                                     ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    nodes = found.join(sums, "node").select("depth", "x1", "x2", "conv_id", F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
                                            "n_leaves", "saved_tokens")
    ended = (prefixes.where("last").select("depth", "x1", "x2", "conv_id")
             .unionAll(convs.where("n = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id")))
    return nodes, _listed(ended)


def _listed(ended: DataFrame) -> DataFrame:
    """depth, x1, x2, first, ids: a node's conversations in pieces, sorted by range so that a node's spread over partitions."""
    key = ["depth", "x1", "x2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        out: list[dict] = []

        def close() -> None:
            if ids:
                out.append({**dict(zip(key, now)), "first": ids[0], "ids": ",".join(map(str, ids))})
                ids.clear()
        for batch in batches:
            for *k, c in zip(*(col.to_pylist() for col in batch.columns)):
                if k != now or len(ids) == LISTED:
                    close()
                    now = k
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    schema = pa.schema([*((k, pa.int64()) for k in key), ("first", pa.int64()), ("ids", pa.string())])
    sorted_ = ended.repartitionByRange(shuffle_partitions(ended.sparkSession), *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    return sorted_.mapInArrow(run, "depth long, x1 long, x2 long, first long, ids string")


def list_digests(ends: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256: digest of each node's whole list. The pieces of a list pass through one task in order, one
    batch of them in memory at a time."""
    key = ["depth", "x1", "x2"]
    schema = pa.schema([*((k, pa.int64()) for k in key), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if k == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append({**dict(zip(key, now)), "ends_sha256": digest.hexdigest()})
                now, digest = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{**dict(zip(key, now)), "ends_sha256": digest.hexdigest()}], schema)
    return (ends.repartition(shuffle_partitions(ends.sparkSession), *key).sortWithinPartitions(*key, "first")
            .mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string"))


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family: crc32 of its decimal id, modulo 4."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    nodes, ends = conversation_trie(rows, 20, borrowed_turns(F.col("conv_id")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(list_digests(ends), ["depth", "x1", "x2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", nothing).alias("ends_sha256")))


ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, count(*) AS own, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda u, i: xor(u >> 1, 3988292384 * (u & 1))))) % 4 AS h
  FROM t GROUP BY c
), head AS (
  SELECT k.c, t.r AS d, t.role, t.text FROM k JOIN t ON t.c = k.c - k.c % 20 AND t.r <= k.h
), b AS (
  SELECT k.c, k.h, count(head.d) AS b FROM k LEFT JOIN head USING (c) GROUP BY k.c, k.h
), turns AS (
  SELECT * FROM head UNION ALL SELECT t.c, b.b + t.r - b.h, t.role, t.text FROM t JOIN b USING (c) WHERE t.r > b.h
), p AS (
  SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS path, text,
         d = max(d) OVER (PARTITION BY c) AS ends FROM turns
  UNION ALL SELECT c, 0, [], '', c NOT IN (SELECT c FROM turns) FROM k
), node AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, path
), place AS (
  SELECT p.c, p.d, node.conv_id FROM p JOIN node USING (d, path)
), child AS (
  SELECT n.*, up.conv_id AS parent_conv_id FROM node n LEFT JOIN place up ON up.c = n.conv_id AND up.d = n.d - 1
), kids AS (
  SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM child WHERE d > 0 GROUP BY ALL
), full_ AS (
  SELECT child.*, coalesce(n_children, 0) AS n_children FROM child LEFT JOIN kids USING (conv_id, d)
), sums AS (
  SELECT a.conv_id, a.d, sum((x.n_children = 0)::INT) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM full_ x JOIN place a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.conv_id, a.d
)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_ JOIN sums USING (conv_id, d)
"""
