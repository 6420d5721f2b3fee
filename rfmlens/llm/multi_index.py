"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook of its own, and the pairs of
one word from either codebook form a grid of cells. Every vector is indexed in the
cell of its nearest words. As a query it visits cells in the multi-sequence's order: by growing
``g1^2 + g2^2``, where g is the distance from the half to the border between its
nearest word's region and the cell's, at least the distance to anything indexed
there. It stops at a radius ``r``. With r = sqrt(2 - 2 * threshold) no link could be
missed; the radius taken is the least that meets ``RECALL`` of the links in a sample:
of vectors at the threshold in random directions, and of pairs found by brute force. (For
a query the cells within r are a stretch of the sorted second half for each word of
the first, so they are listed, not searched.) Found pairs are verified in double precision.

Equal vectors of a label are one node with a count. A cell's vectors and visitors
are dealt by a hash to blocks of about ``BLOCK``, and a task compares one block with
one block as a matrix product. It emits sums of links per node and the links of a
spanning forest, never pairs, so a dense group of n vectors makes n rows a block and
not n * n, and a hot cell or label is spread over its blocks.

The codebooks are fitted on ``SAMPLE`` vectors (those with the least hashes of
id), their size grows with the square root of the number of vectors; both are
sent to the executors. Every vector is indexed and every vector queries.

Defined results: null, empty and zero vectors, those with null or non-finite components and
those without a label have no links and are their own component; vectors of another length
than most are compared within their length, in one cell; repeated rows and ids count as
separate vectors; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rfmlens.llm.common import keep, table
from rfmlens.llm.graph import components

THRESHOLD = 0.98
RECALL = 0.9999
SAMPLE = 20_000          # vectors that the codebooks are fitted on
TRIALS = 4_000           # vectors of the sample that the radius is fitted on
PER_CELL = 64            # vectors of one label in a cell, on average
BLOCK = 1024             # vectors and visitors that a task compares at once
SEED = 20240613


def unit(v) -> np.ndarray | None:
    """A vector scaled to length 1 in double precision, null if it has none."""
    if v is None or len(v) == 0 or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def prepare(rows: DataFrame) -> DataFrame:
    """id, node (digest of label and vector, null if it can't link), label, unit of (id, label, vec)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, labels, units = [], [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("vec").to_pylist()):
                u = unit(v) if label is not None else None
                raw = None if u is None else (np.asarray(v, np.float64) + 0.0).tobytes()
                labels.append(None if u is None else str(label))
                nodes.append(None if u is None else hashlib.blake2b(
                    raw, key=hashlib.blake2b(str(label).encode()).digest(), digest_size=16).digest())
                units.append(u)
            yield pa.record_batch([batch.column("id"), pa.array(nodes, pa.binary()), pa.array(labels, pa.string()),
                                   pa.array(units, pa.list_(pa.float64()))], ["id", "node", "label", "unit"])
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "label", "vec").mapInArrow(run, f"id {kind}, node binary, label string, unit array<double>")


def matrix(column) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Codebook:
    """Words of one half, by k-means with fixed seeds."""

    def __init__(self, x: np.ndarray, k: int, seed: int, rounds: int = 8):
        rng = np.random.default_rng(seed)
        self.words = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
        for _ in range(rounds):
            near = self.distances(x).argmin(1)
            n = np.bincount(near, minlength=len(self.words))
            total = np.zeros_like(self.words)
            np.add.at(total, near, x)
            self.words[n > 0] = total[n > 0] / n[n > 0, None]
        gaps = ((self.words[:, None] - self.words[None]) ** 2).sum(-1) if len(self.words) <= 256 else np.array(
            [((self.words - w) ** 2).sum(-1) for w in self.words])
        self.gaps = np.sqrt(gaps)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x ** 2).sum(1)[:, None] + (self.words ** 2).sum(1) - 2 * x @ self.words.T)

    def borders(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest word of each row, and squared distances to the border of each
        word's region against the nearest word's (0 for the nearest itself)."""
        d = self.distances(x)
        near = d.argmin(1)
        gap = self.gaps[near]
        gap[gap == 0] = 1
        return near, ((d - d[np.arange(len(x)), near][:, None]) / (2 * gap)) ** 2


class Grid:
    def __init__(self, sample: np.ndarray, labels: np.ndarray, k: int, threshold: float, recall: float):
        self.size, self.half = sample.shape[1], sample.shape[1] // 2
        self.books = [Codebook(sample[:, :self.half], k, SEED), Codebook(sample[:, self.half:], k, SEED + 1)]
        self.radius2 = self._radius2(sample[:TRIALS], labels[:TRIALS], threshold, recall)

    def _radius2(self, x: np.ndarray, labels: np.ndarray, threshold: float, recall: float) -> float:
        """Squared radius within which the sample's links are found."""
        rng = np.random.default_rng(SEED + 2)
        n = rng.standard_normal(x.shape)
        n -= (n * x).sum(1)[:, None] * x
        n /= np.maximum(np.sqrt((n ** 2).sum(1)), 1e-12)[:, None]
        needed = [self.needed(x, threshold * x + np.sqrt(1 - threshold ** 2) * n)]
        for at in range(0, len(x), 1000):
            i, j = np.nonzero((x[at:at + 1000] @ x.T >= threshold) & (labels[at:at + 1000, None] == labels[None]))
            i = i + at
            if (i < j).any():
                needed.append(self.needed(x[i[i < j]], x[j[i < j]]))
        return min(2 - 2 * threshold, max(float(np.quantile(a, recall)) for a in needed))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared radius at which x visits y's cell."""
        out = 0.0
        for book, a, b in zip(self.books, self.halves(x), self.halves(y)):
            out = out + book.borders(a)[1][np.arange(len(x)), book.distances(b).argmin(1)]
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (book.distances(h).argmin(1) for book, h in zip(self.books, self.halves(x)))
        return a * len(self.books[1].words) + b

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """Cells that each row visits, nearest first."""
        one, two = (book.borders(h)[1] for book, h in zip(self.books, self.halves(x)))
        out, width = [], len(self.books[1].words)
        for g1, g2 in zip(one, two):
            i = np.flatnonzero(g1 <= self.radius2)
            order = np.argsort(g2, kind="stable")
            ends = np.searchsorted(g2[order], self.radius2 - g1[i], "right")
            cells = [i[n] * width + order[:e] for n, e in enumerate(ends)]
            far = [g1[i[n]] + g2[order[:e]] for n, e in enumerate(ends)]
            out.append(np.concatenate(cells)[np.argsort(np.concatenate(far), kind="stable")])
        return out


def place(nodes: DataFrame, grid: Grid | None) -> DataFrame:
    """A row per indexed vector (query false) and per visit (query true), with its cell."""
    shared = nodes.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n = batch.num_rows
                sizes = np.array([len(x) for x in batch.column("unit")])
                home, tour = np.zeros(n, np.int64), [np.zeros(1, np.int64)] * n
                rows = np.flatnonzero(sizes == g.size) if g else []
                if len(rows):
                    x = matrix(batch.column("unit").take(pa.array(rows)))
                    home[rows] = g.cells(x)
                    for r, cells in zip(rows, g.visits(x)):
                        tour[r] = cells
                take = np.concatenate([np.arange(n), np.repeat(np.arange(n), [len(t) for t in tour])])
                cell = np.concatenate([home, *tour])
                query = np.arange(len(take)) >= n
                rest = batch.take(pa.array(take))
                yield pa.record_batch([*rest.columns, pa.array(cell.astype(np.int64)), pa.array(query)],
                                      [*batch.schema.names, "cell", "query"])
    return nodes.select("node", "label", "unit", "c").mapInArrow(
        run, "node binary, label string, unit array<double>, c long, cell long, query boolean")


def compare(threshold: float):
    """Links between the visitors and the vectors of one block pair: for each
    node its number of links, and a link to its group's first node."""
    def run(t: pa.Table) -> pa.Table:
        query = t["query"].to_numpy()
        nodes, count = np.array(t["node"].to_pylist(), object), t["c"].to_numpy()
        x = matrix(t["unit"])
        q, y = np.flatnonzero(query), np.flatnonzero(~query)
        out: dict[str, list] = {"a": [], "b": [], "n": []}
        if len(q) and len(y):
            # a pair is counted where its lesser node visits the other
            same = {v: i for i, v in enumerate(sorted(set(nodes)))}
            rank = np.array([same[v] for v in nodes])
            link = (x[q] @ x[y].T >= threshold) & (rank[q][:, None] < rank[y][None])
            if link.any():
                total = np.zeros(len(same), np.int64)
                np.add.at(total, rank[q], link @ count[y])
                np.add.at(total, rank[y], count[q] @ link)
                # least rank of each group of linked nodes
                root = np.arange(len(same))
                while True:
                    old = root.copy()
                    lq, ly = root[rank[q]], root[rank[y]]
                    np.minimum.at(root, rank[y], np.where(link, lq[:, None], len(same)).min(0))
                    np.minimum.at(root, rank[q], np.where(link, ly[None], len(same)).min(1))
                    root = root[root]
                    if (root == old).all():
                        break
                names = sorted(same)
                for i in np.flatnonzero(total):
                    out["a"].append(names[i])
                    out["b"].append(names[root[i]])
                    out["n"].append(int(total[i]))
        return pa.table({"a": pa.array(out["a"], pa.binary()), "b": pa.array(out["b"], pa.binary()),
                         "n": pa.array(out["n"], pa.int64())})
    return run


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label", per_cell: int = PER_CELL,
                    block: int = BLOCK) -> DataFrame:
    """id, n_links, component_id, kept for each row; vectors of one label with
    a cosine of ``threshold`` or more are linked."""
    kept = keep(prepare(rows.select(rows[id_col].alias("id"), rows[label_col].alias("label"), rows[vec_col].alias("vec"))), "vectors")
    nodes = keep(kept.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("unit").alias("unit"), F.min("id").alias("first"),
        F.count(F.lit(1)).alias("c")), "nodes")
    sizes = nodes.groupBy(F.size("unit").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("l"))
    most = sizes.orderBy(F.desc("n"), "s").limit(1).collect()
    grid = None
    if most and most[0]["s"] > 1:
        of_size = nodes.where(F.size("unit") == most[0]["s"])
        got = of_size.select("label", "unit", F.xxhash64("node").alias("h"), "node").orderBy("h", "node").limit(SAMPLE).toArrow()
        k = int(min(SAMPLE // 16, max(1, round((most[0]["n"] / max(1, most[0]["l"]) / per_cell) ** 0.5))))
        grid = Grid(matrix(got["unit"]), np.array(got["label"].to_pylist(), object), k, threshold, recall)
    placed = keep(place(nodes, grid).withColumn("s", F.size("unit")), "placed")
    where = ["label", "s", "cell"]
    blocks = keep(placed.groupBy(*where).agg(
        F.ceil(F.count_if(~F.col("query")) / block).alias("vs"), F.ceil(F.count_if("query") / block).alias("qs"))
        .where("vs > 0 AND qs > 0"), "blocks")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("query"), F.col("qs")).otherwise(F.col("vs")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("vs")).otherwise(F.col("qs")) - 1)
    dealt = (placed.join(blocks, where).withColumn("mine", mine).withColumn("other", F.explode(others))
             .withColumn("vb", F.when(F.col("query"), F.col("other")).otherwise(F.col("mine")))
             .withColumn("qb", F.when(F.col("query"), F.col("mine")).otherwise(F.col("other"))))
    found = keep(dealt.select(*where, "vb", "qb", "node", "unit", "c", "query").groupBy(*where, "vb", "qb")
                 .applyInArrow(compare(threshold), "a binary, b binary, n long"), "found")
    roots = components(found.where("a <> b").select("a", "b"))
    label = roots.select(F.col("node").alias("n2"), "root")
    named = nodes.join(label, F.col("node") == F.col("n2"), "left").select(
        "node", "first", "c", F.coalesce("root", "node").alias("root"))
    named = keep(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    degree = found.groupBy(F.col("a").alias("n3")).agg(F.sum("n").alias("n"))
    facts = keep(named.join(least, "root").join(degree, F.col("node") == F.col("n3"), "left").select(
        F.col("node").alias("n2"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("links")), "facts")
    comp = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (kept.select("id", "node").join(facts, F.col("node") == F.col("n2"), "left")
            .select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = near_duplicates(rows)
    return out.select(F.col("id").cast("long").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(embedding, 'count') = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT r.a AS vec_id, (SELECT count(*) FROM link WHERE link.a = r.a) AS n_links, min(r.b) AS component_id,
       r.a = min(r.b) AS kept
FROM reach r GROUP BY r.a
"""
