"""Suffix-array dedup: removes every byte inside a ``LENGTH``-byte string that also
starts elsewhere, in another document or in the same one.

Candidates. Positions are anchored by content: of the hashes of the ``GRAM``-byte strings
that start in any stretch of LENGTH - GRAM + 1 positions the least is an anchor, so
each LENGTH-byte string holds an anchor, at the same place wherever it occurs. Only
anchors whose hash occurs twice matter. What lies around one (its *context*: all
LENGTH-byte strings that hold it) is compared whole first: equal contexts are one row with a
count, and all strings of a context with a count of two or more are repeated.

Decision. Contexts that differ but share an anchor are dealt out by the longer strings that
some of their windows share (``PARTS`` stretches of window starts each), and the rows
of one such string are suffix-sorted (``lyndon``): the shared string as a single
symbol of its own with the bytes that may precede and follow it. Two windows are equal
if they have a common prefix of a window's length in the sorted order. Spans found
are joined per text and cut out.

A text is known by its MD5, so copies share their spans, and no id is relied on. Scans:
one to count anchors' hashes, one to list the repeated ones, one to fetch contexts,
one to cut. A bitmap of fixed size holds back most anchors whose hash occurs once.
Shuffled are hashes (summed first), the other anchors, contexts, and the texts, once for
contexts and once for the cut (unless Spark finds the other side small). A string shared by more than
``DENSE`` different contexts isn't gathered in a task: its windows are counted by a
grouped sum instead.

Defined results: null and empty texts have no bytes and stay as they are; texts under
LENGTH bytes are untouched; repeated rows are copies and lose everything that is
LENGTH bytes or more; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rfmlens.llm import shingles as S
from rfmlens.llm.common import keep, map_batches, shuffle_partitions, table
from rfmlens.llm.lyndon import common_prefixes, suffix_array

LENGTH = 200
GRAM = 150
PARTS = 4
CHUNK = 1 << 18            # bytes of texts that are hashed at once
PIECE = 1 << 18            # windows of one longer text that are
SORTED_AT_ONCE = 100_000   # symbols suffix-sorted at once, about
MAX_BITS = 27              # of the bitmap of repeated hashes (16 MB)
DENSE = 20_000             # contexts of one shared string that a task gathers
_U = np.uint64
_R = int(S._RADIX)
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """r^0 ... r^(n-1) modulo 2^64, of the radix or its inverse."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        r = _U(pow(_R, -1, 1 << 64) if inverse else _R)
        have = _POWERS[inverse] = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(max(n, 1 << 16), r, _U)]))
    return have[:n]


BYTE = S.mix((np.arange(256, dtype=np.uint64) + _U(1)) * S._K3)


class Hashes:
    """Hashes of any substrings of a byte array."""

    def __init__(self, x: np.ndarray):
        self.sums = np.concatenate([[_U(0)], np.cumsum(BYTE[x] * _powers(len(x), False))])
        self.back = _powers(len(x) + 1, True)

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of all strings of ``size`` bytes, by their start."""
        h = self.sums[size:] - self.sums[:-size]
        h *= self.back[:len(h)]
        h += _U(size * int(S._K1) % (1 << 64))
        return S.mix(h)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return S.mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(_U) * S._K1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    r = w - size
    return np.minimum(x[:len(x) - r], x[r:]) if r else x


def anchors(x: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and context hashes of one text's anchors, piece by piece."""
    n, w = len(x), length - gram + 1
    parts = []
    # stretches of window starts; each sees the bytes around it that its contexts need
    for first in range(0, max(0, n - length + 1), PIECE):
        last = min(first + PIECE, n - length + 1)
        lo, hi = max(0, first - length), min(n, last + 2 * length)
        at, h, ctx, _ = _chunk_anchors(x[lo:hi], np.array([0, hi - lo]), length, gram, first - lo, last - lo, lo > 0, hi < n)
        parts.append((at + lo, h, ctx))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    at, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
    return at, np.concatenate([p[1] for p in parts])[first], np.concatenate([p[2] for p in parts])[first]


def _chunk_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, first: int = 0, last: int | None = None,
                   open_left: bool = False, open_right: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes, context hashes and texts of the anchors of several texts
    (``offsets``), or of the windows ``first`` to ``last`` of a piece of one."""
    n, w = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
    made = Hashes(data)
    h = made.rolling(gram)
    least = _sliding_min(h, w)
    # windows across two texts, or outside of the piece, choose nothing
    for end in offsets[1:-1]:
        least[max(0, end - length + 1):end] = 0
    least[:first] = 0
    if last is not None:
        least[last:] = 0
    # a start is an anchor if it is the least of any window that holds it
    pad = np.zeros(w - 1, _U)
    over = ~_sliding_min(~np.concatenate([pad, least, pad]), w)
    at = np.flatnonzero(over == h)
    text = np.searchsorted(offsets, at, "right") - 1
    a, b = np.maximum(offsets[text], at - (w - 1)), np.minimum(offsets[text + 1], at + length)
    if open_left or open_right:        # every context of a chosen anchor lies within the piece
        assert (not open_left or (at - (w - 1) >= 0).all()) and (not open_right or (at + length <= n).all())
    ctx = S.mix(made.of(a, b) * S._K2 + (at - a).astype(_U) * S._K1)
    return at - offsets[text], h[at], ctx, text


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for first, end, data, offsets in S.chunks(batch, "text"):
        for i in range(end - first):
            yield first + i, data[offsets[i]:offsets[i + 1]]


def _md5(x: np.ndarray) -> bytes:
    return hashlib.md5(x, usedforsecurity=False).digest()


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """Bits for the leading bits of the keys' hashes: sixteen a key, 2^MAX_BITS at
    most. A hash whose bit is 0 is not among the keys; a larger corpus only fills the bits."""
    k = min(MAX_BITS, max(6, (16 * keys.count()).bit_length()))
    words = (keys.select(F.shiftrightunsigned("h", 64 - k).alias("slot"))
             .selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, CAST(slot % 64 AS INT)) AS m").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow())
    out = np.zeros(1 << (k - 6), np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out.view(_U)


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> _U(64 - (6 + len(bits).bit_length() - 1))
    return (bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) > 0


def anchor_rows(texts: DataFrame, length: int, gram: int, keys: np.ndarray | None = None) -> DataFrame:
    """h of all anchors, or h, ctx, doc (MD5 of the text), pos of those that may be
    among the ``keys`` (a bitmap)."""
    only_hash = keys is None
    bitmap = None if only_hash else texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in S.chunks(batch, "text", CHUNK):
                if end - first == 1 and len(data) > CHUNK:
                    at, h, ctx = anchors(data, length, gram)
                    text = np.zeros(len(at), np.int64)
                else:
                    at, h, ctx, text = _chunk_anchors(data, offsets, length, gram)
                if not only_hash:
                    pick = _maybe(bitmap.value, h)
                    at, h, ctx, text = at[pick], h[pick], ctx[pick], text[pick]
                if not len(at):
                    continue
                hashes = pa.array(h.view(np.int64))
                if only_hash:
                    yield pa.record_batch([hashes], ["h"])
                    continue
                docs = pa.array([_md5(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.record_batch([hashes, pa.array(ctx.view(np.int64)), docs.take(pa.array(text)), pa.array(at)],
                                      ["h", "ctx", "doc", "pos"])
    return map_batches(texts.select("text"), run, "h long" if only_hash else "h long, ctx long, doc binary, pos long")


def stretches(length: int, gram: int, parts: int) -> list[tuple[int, int]]:
    """The numbers 0 to length - gram of bytes that a window may hold before the
    anchor, in stretches (first, last)."""
    edges = np.linspace(0, length - gram + 1, parts + 1).astype(int)
    return [(int(a), int(b) - 1) for a, b in zip(edges, edges[1:]) if b > a]


def shared_rows(texts: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """For rows (text, wanted: positions of anchors with h and ctx) a row per context and
    stretch: key of the string that the stretch's windows share, the bytes that may
    precede it (``pre``) and follow it (``post``)."""
    ranges = stretches(length, gram, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            wanted = batch.column("wanted")
            for i, x in _texts(batch):
                data, n = x.tobytes(), len(x)
                for w in wanted[i].as_py():
                    a = w["pos"]
                    for part, (least, most) in enumerate(ranges):
                        lo, hi = a - least, a - most + length
                        if lo >= 0 and hi <= n:
                            key = hashlib.blake2b(data[lo:hi], digest_size=15).digest() + bytes([part])
                            rows.append((key, w["h"], w["ctx"], part, data[max(0, a - most):lo], data[hi:min(n, a - least + length)]))
                if len(rows) > 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                               ["key", "h", "ctx", "part", "pre", "post"])
    return map_batches(texts.select("text", "wanted"), run, "key binary, h long, ctx long, part int, pre binary, post binary")


def repeated_windows(groups: list[list[tuple[bytes, bytes]]], widths: list[int]) -> list[list[tuple[int, int] | None]]:
    """For each group of different (pre, post) around one shared string: the least and
    greatest number of bytes of ``pre`` in a window that another of the group has too,
    a window being the shared string with ``width`` of the bytes around it. One
    suffix array over all groups, each with a symbol for its shared string."""
    text: list[int] = []
    row_at: list[int] = []                      # row that a position belongs to
    rows: list[tuple[int, int, int, int, int]] = []      # group, place in it, start, bytes of pre, of post
    for g, members in enumerate(groups):
        # a window holds half of its width before or after the shared string: rows that
        # share neither half with another row need no sorting
        half = (widths[g] + 1) // 2
        before = Counter(pre[-half:] for pre, _ in members if len(pre) >= half)
        after = Counter(post[:half] for _, post in members if len(post) >= half)
        for r, (pre, post) in enumerate(members):
            if before[pre[-half:]] < 2 and after[post[:half]] < 2:
                continue
            row_at += [len(rows)] * (len(pre) + len(post) + 2)
            rows.append((g, r, len(text), len(pre), len(post)))
            text += pre
            text.append(257 + g)
            text += post
            text.append(256)
    order = suffix_array(text)
    common = common_prefixes(text, order)
    found: list[list[tuple[int, int] | None]] = [[None] * len(members) for members in groups]
    least = min(widths, default=0) + 1
    for i in range(1, len(order)):
        c = common[i]
        if c < least:
            continue
        for s in (order[i - 1], order[i]):
            g, r, start, pre, post = rows[row_at[s]]
            width, used = widths[g], pre - (s - start)       # bytes of pre in the window from here
            if c > width and 0 <= used <= width and width - used <= post:
                old = found[g][r]
                found[g][r] = (min(old[0], used), max(old[1], used)) if old else (used, used)
    return found


def decide(rows: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """h, ctx, lo, hi (bytes before the anchor in the first and the last repeated
    window) from rows of ``shared_rows`` that arrive sorted by key."""
    ranges = stretches(length, gram, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple[bytes, bytes]]] = []
        members: list[list[set[tuple[int, int]]]] = []      # (h, ctx) of each row of each group
        part_of: list[int] = []
        size = 0
        now: dict[tuple[bytes, bytes], set[tuple[int, int]]] = {}
        key, part = None, 0

        def close() -> int:
            if len(now) < 2 and sum(map(len, now.values())) < 2:
                return 0
            groups.append(list(now))
            members.append(list(now.values()))
            part_of.append(part)
            return sum(len(a) + len(b) + 2 for a, b in now)

        def flush() -> pa.RecordBatch:
            widths = [ranges[p][1] - ranges[p][0] for p in part_of]
            several = [i for i, g in enumerate(groups) if len(g) > 1]
            found = dict(zip(several, repeated_windows([groups[i] for i in several], [widths[i] for i in several])))
            out = []
            for i, (rows, who) in enumerate(zip(groups, members)):
                base, width = ranges[part_of[i]][0], widths[i]
                for r, ((pre, post), ids) in enumerate(zip(rows, who)):
                    span = found[i][r] if i in found else None
                    if len(ids) > 1:             # another context has the same bytes here: all its windows
                        own = (max(0, width - len(post)), min(width, len(pre)))
                        span = own if own[0] <= own[1] else span
                    if span:
                        out += [(h, c, base + span[0], base + span[1]) for h, c in ids]
            groups.clear(), members.clear(), part_of.clear()
            return pa.record_batch([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], ["h", "ctx", "lo", "hi"])

        for batch in batches:
            for k, h, c, p, pre, post in zip(*(batch.column(x).to_pylist() for x in ("key", "h", "ctx", "part", "pre", "post"))):
                if k != key:
                    size += close()
                    now, key, part = {}, k, p
                    if size > SORTED_AT_ONCE:
                        yield flush()
                        size = 0
                now.setdefault((pre, post), set()).add((h, c))
        close()
        if groups:
            yield flush()
    return rows.select("key", "h", "ctx", "part", "pre", "post").mapInArrow(run, "h long, ctx long, lo long, hi long")


def dense_windows(rows: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """The same as ``decide`` by a grouped sum over all windows, for strings that too
    many contexts share."""
    ranges = stretches(length, gram, parts)
    width = F.element_at(F.array(*[F.lit(b - a) for a, b in ranges]), F.col("part") + 1)
    base = F.element_at(F.array(*[F.lit(a) for a, _ in ranges]), F.col("part") + 1)
    pre, post = F.length("pre"), F.length("post")
    used = F.filter(F.sequence(F.lit(0), width), lambda u: (u <= pre) & (width - u <= post))
    rows = rows.dropDuplicates(["key", "h", "ctx"])     # copies of a text give the same contexts
    windows = (rows.select("key", "h", "ctx", "pre", "post", base.alias("base"), width.alias("width"), F.explode(used).alias("u"))
               .withColumn("window", F.concat(F.substr("pre", F.length("pre") - F.col("u") + 1, F.col("u")),
                                              F.substr("post", F.lit(1), F.col("width") - F.col("u")))))
    by = ["key", "u", "window"]
    twice = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    return (windows.join(twice, by).groupBy("h", "ctx")
            .agg(F.min(F.col("base") + F.col("u")).cast("long").alias("lo"), F.max(F.col("base") + F.col("u")).cast("long").alias("hi")))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, parts: int = PARTS) -> DataFrame:
    """doc (MD5 of a text), spans (merged start and end of its repeated bytes)."""
    spark = texts.sparkSession
    long_texts = texts.where(F.octet_length("text") >= length).select("text")
    keys = keep(anchor_rows(long_texts, length, gram).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("h"), "keys")
    found = keep(anchor_rows(long_texts, length, gram, key_bitmap(keys)).join(keys, "h"), "anchors")
    contexts = keep(found.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("at")), "contexts")
    # an anchor whose contexts all occur twice needs no further look
    several = keep(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
                   .where("k > 1 AND n = 1").select("h"), "several")
    wanted = keep(contexts.join(several, "h").groupBy("at.doc").agg(
        F.collect_list(F.struct("at.pos", "h", "ctx")).alias("wanted")), "wanted")
    with_doc = long_texts.withColumn("doc", F.unhex(F.md5(F.col("text").cast("binary"))))
    fetched = with_doc.join(wanted, "doc")
    shared = keep(shared_rows(fetched, length, gram, parts), "shared")
    counts = keep(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    n = shuffle_partitions(spark)
    rest = shared.join(counts.where(F.col("n") <= DENSE).select("key"), "key", "left_semi")
    decided = decide(rest.repartition(n, "key").sortWithinPartitions("key"), length, gram, parts)
    dense = counts.where(F.col("n") > DENSE).select("key")
    if dense.limit(1).count():
        decided = decided.unionAll(dense_windows(shared.join(dense, "key", "left_semi"), length, gram, parts))
    most = length - gram
    whole = contexts.where("n > 1").select("h", "ctx", F.lit(0).cast("long").alias("lo"), F.lit(most).cast("long").alias("hi"))
    cover = keep(decided.unionAll(whole).groupBy("h", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "cover")
    # windows from pos - hi to pos - lo, as far as the text goes
    spans = (found.join(cover, ["h", "ctx"])
             .groupBy("doc").agg(F.sort_array(F.collect_set(F.struct((F.col("pos") - F.col("hi")).alias("a"),
                                                                     (F.col("pos") - F.col("lo") + length).alias("b")))).alias("s")))
    return keep(spans, "spans")


def _merged(spans: list[dict], n: int, length: int) -> list[tuple[int, int]]:
    """Spans of whole windows inside a text of n bytes, joined where they touch."""
    out: list[tuple[int, int]] = []
    for s in spans:
        a, b = max(0, s["a"]), min(n, s["b"])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif b > a:
            out.append((a, b))
    return out


def cut(docs: DataFrame, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (bytes) of rows (id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for s, (_, x) in zip(batch.column("s"), _texts(batch)):
                data = x.tobytes()
                cuts = _merged(s.as_py(), len(data), length) if s.is_valid else []
                edges = [0, *(e for c in cuts for e in c), len(data)]
                n.append(len(data))
                gone.append(sum(b - a for a, b in cuts))
                runs.append(len(cuts))
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]) if cuts else data)
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                   pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                  ["id", "n_bytes", "n_removed", "n_spans", "kept"])
    kind = docs.schema["id"].dataType.simpleString()
    doc = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = (docs.select("id", "text", doc.alias("doc")).join(spans, "doc", "left")
            .select("id", "text", "s"))
    return map_batches(rows, run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, parts: int = PARTS) -> DataFrame:
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return cut(docs, repeated_spans(docs, length, gram, parts), length)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
