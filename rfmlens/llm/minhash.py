"""MinHash near-duplicates by tensored banding, links confirmed on full sets.

A document's set holds its distinct shingles of ``width`` words. Documents with
equal sets are one node. Each node gets two small collections of ``t`` half keys,
every half key made of ``half`` minhashes; the tables' keys are all t * t pairs of
one half key from either collection. So 2 * t * half minhashes serve t * t tables of
2 * half minhashes each, where plain banding would need t * t * 2 * half. t follows from the
threshold: a pair just at it stays unfound with probability ``miss`` at most.

A pair can only meet in a table if it agrees in a half key of both collections,
so half keys that occur once are dropped first (one count over 2t rows a node),
and only nodes with repeated ones on both sides form table keys. Buckets do not emit
their pairs. Every bucket has a hub, the member that meets most others in all its buckets
(copies' original, as a rule), and every member proposes one link to it. Proposed links are
confirmed on full sets, and confirmed ones joined into components. Any pair of a bucket has a
hub in common; so where the nodes that proposed links to one hub are still in several
components, pairs between different components are compared on full sets, block by
block of ``BLOCK`` nodes or ``SHINGLES`` shingles, and a task emits only links that join
components of its block. Nodes outside the hub's largest component meet all its blocks; those
inside meet only blocks of nodes outside. So every pair of a bucket is either joined already or
compared; n nodes, s of them outside, make about n + 2 * n * s / BLOCK rows, not one per pair.

Full sets are formed again from the texts of documents that have a proposed link,
and are not kept for the others.

Defined results: null texts and texts without words have an empty set, link with
nothing and are kept; repeated rows and ids share a node; null ids stay null unless they link
to others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rfmlens.llm import shingles as S
from rfmlens.llm.common import free_name, keep, map_batches, table
from rfmlens.llm.graph import components

HALF = 4                   # minhashes in a half key
MISS = 5e-6                # chance that a pair at the threshold meets in no table
SEED = 20240611
BROADCAST_IDS = 500_000    # ids that a broadcast may hold; beyond, a shuffled join
SALTS = 64                 # copies of a hub's row in a shuffled join
BLOCK = 512                # nodes of one hub that a task compares with as many others, on average
SHINGLES = 1_000_000       # shingles of these, on average; a longer set is a block's only one at best


def collection_size(threshold: float, half: int = HALF, miss: float = MISS) -> int:
    """t: both collections must agree somewhere, each fails with (1 - s^half)^t."""
    return math.ceil(math.log(miss / 2) / math.log(1 - threshold ** half))


def _multipliers(n: int) -> np.ndarray:
    odd = np.random.default_rng(SEED).integers(0, 2 ** 63, n, dtype=np.uint64)
    return (odd << np.uint64(1)) | np.uint64(1)


def half_keys(sets: list[np.ndarray], t: int, half: int) -> np.ndarray:
    """(documents, 2t) half keys of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    mult = _multipliers(2 * t * half)
    out = np.empty((2 * t, len(sets)), np.uint64)
    y = np.empty_like(x)
    for k in range(2 * t):
        acc = np.full(len(sets), k + 1, np.uint64)
        for j in range(half):
            np.multiply(x, mult[k * half + j], out=y)
            acc = S.mix(acc * S._K1 + np.minimum.reduceat(y, starts))
        out[k] = acc
    return out.T


def node_of(s: np.ndarray) -> bytes | None:
    """Digest of a set; null for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch(docs: DataFrame, width: int, t: int, half: int) -> DataFrame:
    """id, n_shingles, node, keys (2t half keys) of rows (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for first, end, sets in S.document_sets(batch, "text", width):
                full = [s for s in sets if len(s)]
                keys = iter(half_keys(full, t, half).view(np.int64)) if full else iter(())
                yield pa.record_batch([
                    ids.slice(first, end - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], ["id", "n_shingles", "node", "keys"])
    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.select("id", "text"), run, f"id {kind}, n_shingles long, node binary, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, s (sorted shingle hashes) of rows (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in S.document_sets(batch, "text", width):
                yield pa.record_batch([pa.array([node_of(s) for s in sets], pa.binary()),
                                       pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"])
    return map_batches(docs.select("text"), run, "node binary, s array<long>")


def _alike(inter: Column, a: Column, b: Column, pct: int) -> Column:
    return 100 * inter >= pct * (a + b - inter)


def confirm(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) with sizes (na, nb) whose full sets (nid, s) are alike. Pairs whose
    sizes alone rule that out are dropped before any set is fetched."""
    na, nb = F.col("na"), F.col("nb")
    pairs = pairs.where(_alike(F.least(na, nb), na, nb, pct)).select("a", "b")
    left = sets.select(F.col("nid").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("nid").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(_alike(inter, F.size("sa"), F.size("sb"), pct)).select("a", "b")


def table_keys(nodes: DataFrame, t: int) -> DataFrame:
    """(key, nid) of the tables in which a node can meet another."""
    halves = nodes.select("nid", F.posexplode("keys").alias("pos", "key"))
    again = keep(halves.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "halves")
    alive = halves.join(again, "key").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("k"))
    one = F.filter("k", lambda x: x["pos"] < t)
    two = F.filter("k", lambda x: x["pos"] >= t)
    return (alive.select("nid", F.explode(one).alias("u"), two.alias("v"))
            .select("nid", "u", F.explode("v").alias("v"))
            .select(F.xxhash64("u.key", "v.key").alias("key"), "nid"))


def stars(buckets: DataFrame) -> DataFrame:
    """(a, b): each node and the hubs of its buckets."""
    counts = keep(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    met = keep(buckets.join(counts, "key"), "met")
    weight = keep(met.groupBy("nid").agg(F.sum("c").alias("w")), "weight")
    hubs = keep(met.join(weight, "nid").groupBy("key").agg(F.max(F.struct("w", "nid")).alias("hub"))
                .select("key", F.col("hub.nid").alias("b")), "hubs")
    return keep(met.select("key", F.col("nid").alias("a")).join(hubs, "key").where("a <> b").select("a", "b").distinct(), "stars")


def compare(pct: int):
    """Links between nodes of two blocks that are in different components; of
    these only such as join components of the two blocks."""
    def counts(x: np.ndarray, order: np.ndarray, starts: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Size of the intersection of x with each of the other block's sets."""
        at = np.searchsorted(values, x)
        x, at = x[at < len(values)], at[at < len(values)]
        at = at[values[at] == x]
        size = starts[at + 1] - starts[at]
        total = int(size.sum())
        if not total:
            return np.zeros(n, np.int64)
        idx = np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(total)
        return np.bincount(owner[order[idx]], minlength=n)

    def run(t: pa.Table) -> pa.Table:
        nid, root, own = (t[c].to_numpy() for c in ("nid", "root", "own"))
        lo, hi = t["p"][0].as_py(), t["q"][0].as_py()
        s = [x.values.to_numpy() for x in t["s"]]
        size = np.array([len(x) for x in s])
        parent = {r: r for r in root.tolist()}

        def find(r):
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r
        out: list[tuple[int, int]] = []
        names, many = np.unique(root, return_counts=True)
        main = names[many.argmax()]
        for mine, other in {(lo, hi), (hi, lo)}:
            y = np.flatnonzero(own == other)
            owner = np.repeat(np.arange(len(y)), size[y])
            flat = np.concatenate([s[i] for i in y]) if len(y) else np.zeros(0, np.int64)
            order = np.argsort(flat, kind="stable")
            values, starts = np.unique(flat[order], return_index=True)
            starts = np.append(starts, len(flat))
            # pairs within the largest component need no look
            for i in np.flatnonzero((own == mine) & (root != main)):
                inter = counts(s[i], order, starts, values, owner, len(y))
                for j in y[(100 * inter >= pct * (size[i] + size[y] - inter)) & (root[y] != root[i])]:
                    a, b = find(root[i]), find(root[j])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((int(nid[i]), int(nid[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
    return run


def across(proposed: DataFrame, roots: DataFrame, sets: DataFrame, pct: int, block: int = BLOCK,
           sizes: DataFrame | None = None) -> DataFrame:
    """Links between nodes of one hub that are in different components. ``sizes``
    (nid, n) spares a look at the sets for their sizes."""
    label = roots.select(F.col("node").alias("n2"), "root")
    mine = proposed.select(F.col("b").alias("hub"), F.col("a").alias("nid")).unionAll(
        proposed.select(F.col("b").alias("hub"), F.col("b").alias("nid")).distinct())
    tagged = mine.join(label, F.col("nid") == F.col("n2"), "left").select("hub", "nid", F.coalesce("root", "nid").alias("root"))
    tagged = keep(tagged, "tagged")
    sizes = sets.select("nid", F.size("s").alias("n")) if sizes is None else sizes
    # added up by (hub, root) before anything goes by hub: a hub of a third of all nodes is a few rows by then
    parts = keep(tagged.join(sizes, "nid").groupBy("hub", "root").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("w")), "parts")

    def blocks(c: Column, w: Column) -> Column:
        return F.ceil(F.greatest(c / block, w / SHINGLES)).cast("long")
    # the largest component's blocks come first
    top = F.max(F.struct("c", "w", "root"))
    mixed = keep(parts.groupBy("hub").agg(top.alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots"))
                 .where("roots > 1").select("hub", F.col("top.root").alias("main"), blocks(F.col("top.c"), F.col("top.w")).alias("inner"),
                         blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("outer")), "mixed")
    inside, number = F.col("root") == F.col("main"), F.xxhash64("nid")
    if mixed.count() <= BROADCAST_IDS:
        marked = tagged.join(F.broadcast(mixed), "hub")
    else:                          # a hub's nodes go to as many tasks as it has copies
        marked = (tagged.withColumn("salt", F.pmod(number, F.lit(SALTS)))
                  .join(mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["hub", "salt"]).drop("salt"))
    dealt = (marked.join(sets, "nid")
             .withColumn("own", F.when(inside, F.pmod(number, "inner")).otherwise(F.col("inner") + F.pmod(number, "outer")))
             .withColumn("other", F.explode(F.sequence(F.when(inside, F.col("inner")).otherwise(F.lit(0).cast("long")),
                                                       F.col("inner") + F.col("outer") - 1)))
             .select("hub", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "nid", "root", "own", "s"))
    return dealt.groupBy("hub", "p", "q").applyInArrow(compare(pct), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    half: int = HALF, miss: float = MISS) -> DataFrame:
    """id, n_shingles, node, component_id, kept for each row of ``docs``: documents
    with 100 * shared >= pct * united shingles are linked."""
    t = collection_size(pct / 100, half, miss)
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = keep(sketch(docs, width, t, half), "sketches")
    nodes = (rows.where("node IS NOT NULL").groupBy("node")
             .agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")))
    # numbered once and written, so the numbers stay
    nodes = keep(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    proposed = stars(keep(table_keys(nodes, t), "buckets"))

    met = keep(proposed.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
               .join(nodes.select("nid", "node", "first", "n"), "nid"), "proposers")
    some = met.select(F.col("first").alias("f")).where("f IS NOT NULL").distinct()
    wanted = docs.join(F.broadcast(some) if met.count() <= BROADCAST_IDS else some, docs["id"] == F.col("f"), "left_semi")
    # nodes of null ids only are rare; their texts are found by the null id
    wanted = wanted.unionAll(docs.where("id IS NULL"))
    sets = keep(full_sets(wanted, width).where("node IS NOT NULL").join(met.select("node", "nid"), "node")
                .groupBy("nid").agg(F.first("s").alias("s")), "sets")
    size = met.select("nid", "n")
    sized = (proposed.join(size.select(F.col("nid").alias("a"), F.col("n").alias("na")), "a")
             .join(size.select(F.col("nid").alias("b"), F.col("n").alias("nb")), "b"))
    links = keep(confirm(sized, sets, pct), "links")
    roots = components(links)
    more = keep(across(proposed, roots, sets, pct, sizes=size), "across")
    if more.limit(1).count():
        roots = components(links.unionAll(more))

    # the least id of each component, then of each node
    placed = nodes.join(roots.select(F.col("node").alias("n2"), "root"), F.col("nid") == F.col("n2"), "left").select(
        "node", "first", F.coalesce("root", "nid").alias("root"))
    placed = keep(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(placed.join(least, "root").select(F.col("node").alias("n2"), "component_id"), "named")
    comp = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (rows.select("id", "n_shingles", "node").join(named, F.col("node") == F.col("n2"), "left")
            .select("id", "n_shingles", "node", comp.alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))


def with_node(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """``docs``, columns c0, c1, ..., with the node of each text besides."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(s) for _, _, sets in S.document_sets(batch, f"c{at}", width) for s in sets]
            yield pa.record_batch([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, "node"])
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return map_batches(plain, run, f"{schema}, node binary")


def drop_near_duplicates(docs: DataFrame, width: int = 5, pct: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is its component's least; documents
    without words stay, and of rows that repeat an id and set one stays."""
    judged = keep(near_duplicates(docs, width, pct, id_col, text_col).select("id", "node", "kept"), "judged")
    name = free_name(docs.columns, "_id")

    def ids(df: DataFrame, what: str) -> tuple[DataFrame, int]:
        df = keep(df.select(F.col("id").alias(name)).distinct(), what)
        n = df.count()
        return (F.broadcast(df) if n <= BROADCAST_IDS else df), n
    repeated, n = ids(judged.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated")
    gone, _ = ids(judged.where("NOT kept").join(repeated, F.col("id").eqNullSafe(F.col(name)), "left_anti"), "gone")
    same = docs[id_col].eqNullSafe(F.col(name))
    out = docs.join(gone, same, "left_anti")
    if n == 0:
        return out
    # rows that share an id are told apart by their sets
    several = with_node(docs.join(repeated, same, "left_semi"), width, text_col)
    key = f"c{docs.columns.index(id_col)}"
    best = judged.where("kept").select(F.col("id").alias("_id"), F.col("node").alias("_node")).distinct()
    several = several.join(best, several[key].eqNullSafe(F.col("_id")) & several["node"].eqNullSafe(F.col("_node")))
    number = F.row_number().over(Window.partitionBy(key, "node").orderBy(F.xxhash64(*[f"c{i}" for i in range(len(docs.columns))])))
    several = several.withColumn("k", F.when(F.col("node").isNull(), 1).otherwise(number)).where("k = 1")
    several = several.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return out.join(repeated, same, "left_anti").unionAll(several)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, width=3, pct=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * i >= 85 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
