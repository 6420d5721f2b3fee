"""Runs of repeated words: recompression to a run-length grammar, exact extensions by LCE queries.

A run is a stretch of consecutive words with least period q (words q apart are equal), at least
``max(SHORTEST, TIMES * q)`` long, that neither neighbour extends. Texts' words become numbers and the texts of a batch
one string, a border of its own between any two:

* **Recompression.** Rounds alternate: block compression replaces each maximal block of one symbol by a
  symbol for (symbol, length), pair compression splits the alphabet into left and right symbols by a hash and
  replaces each left symbol followed by a right one by a symbol for the two. Equal symbols have equal
  expansions (they are numbered from the sorted pairs themselves, not hashes), borders are never paired, and a round
  shrinks the string by a constant factor, so a text is one symbol after O(log n) rounds.
* **Extensions.** How far the words from i and from j agree is asked of the grammar: both places climb to the level
  where both begin a symbol, equal symbols (or what two blocks of one symbol share) are passed whole, and where they
  differ the walk goes down into them; O(log n) steps. Extensions to the left mirror it.
* **Candidates.** A run with period q has (TIMES - 1) * q places in a row whose word equals the one q on, so of the places
  0, 3q, 6q, ... one lies among them: n / 3q places for each q, n log n / 3 in all. Where the two words are equal, the extensions
  to both sides give the maximal stretch of period q; it is a run if it is long enough, and of equal stretches the
  least period is the run's.

All of it is numpy over a batch of texts (about ``WORDS`` words, or one longer text) in a task; queries are
answered ``QUERIES`` at once. No shuffle.

Defined results: a null text has no words, and so no runs and an empty text left; rows are judged one by one, so repeated rows and
ids get equal results; further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rfmlens.llm.common import let, map_batches, table, words
from rfmlens.llm.shingles import mix

SHORTEST, TIMES = 6, 4
WORDS = 1 << 17            # words of the texts that are compressed together
QUERIES = 1 << 19          # candidates looked at together
_U = np.uint64


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the pairs (a, b), equal only for equal pairs, and how many there are."""
    if len(a) == 0:
        return np.zeros(0, np.int64), 0
    known, number = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
    return number.astype(np.int64), len(known)


class Grammar:
    """The levels of a recompressed string, one node for each symbol of each level. Nodes are numbered level
    by level, left to right."""

    def __init__(self, string: np.ndarray, border: np.ndarray):
        """``string``: numbers from 0; ``border``: where its borders are, which must be its first and last places and of
        a number each."""
        symbols, size = string.astype(np.int64), np.ones(len(string), np.int64)
        fixed = border.copy()
        total, base = int(symbols.max()) + 1, 0
        sym, length, up, child, block = [], [], [], [], []
        idle, seed = 0, 0
        while True:
            n = len(symbols)
            sym.append(symbols)
            length.append(size)
            if idle == 2:                      # neither a block nor a pair is left
                break
            if seed % 2 == 0:
                head = np.ones(n, bool)
                head[1:] = symbols[1:] != symbols[:-1]
            else:
                head = ~self._second(symbols, fixed, seed)
            first = np.flatnonzero(head)
            count = np.diff(np.append(first, n))
            idle = idle + 1 if len(first) == n else 0
            more = count > 1
            other = count if seed % 2 == 0 else symbols[np.minimum(first + 1, n - 1)]
            new = symbols[first].copy()
            numbers, kinds = _numbered(new[more], other[more])
            new[more] = total + numbers
            total += kinds
            up.append(base + n + np.cumsum(head) - 1)
            child.append(base + first)
            # the end of the block around each node, where blocks are compressed next
            block.append(base + (np.repeat(first + count, count) if seed % 2 == 0 else np.arange(1, n + 1)))
            symbols, size, fixed = new, np.add.reduceat(size, first), fixed[first]
            base += n
            seed += 1
        n = len(symbols)
        self.symbol, self.length = np.concatenate(sym), np.concatenate(length)
        self.up = np.concatenate([*up, np.full(n, -1)])
        self.block_end = np.concatenate([*block, base + np.arange(1, n + 1)])
        # children of a node: [child[i], child_end[i]); the lowest level has none
        low = len(string)
        self.child = np.concatenate([np.full(low, -1), *child])
        self.child_end = np.full(len(self.symbol), -1)
        self.child_end[low:-1] = self.child[low + 1:]
        if len(self.symbol) > low:
            bounds = low + np.cumsum([len(c) for c in child])
            begins = np.cumsum([len(s) for s in sym])
            self.child_end[bounds - 1] = begins[:-1]
        # the begin of the block around each node
        self.block_begin = np.arange(len(self.symbol))
        starts = np.ones(len(self.symbol), bool)
        starts[1:] = self.block_end[1:] != self.block_end[:-1]
        self.block_begin = np.maximum.accumulate(np.where(starts, self.block_begin, 0))
        self.top = len(self.symbol) - n

    @staticmethod
    def _second(symbols: np.ndarray, fixed: np.ndarray, seed: int) -> np.ndarray:
        """Which places are the second of a pair: right symbols after left ones. The sides come from a hash; of a few the
        one with most pairs, so that some pair is found whenever neighbours differ."""
        best = np.zeros(len(symbols), bool)
        free = ~fixed
        most = int((free[1:] & free[:-1]).sum())
        for turn in range(8):
            left = (mix(symbols.astype(_U) * _U(2 * seed + 1) + _U(turn)) & _U(1)).astype(bool)
            for side in (left, ~left):
                second = np.zeros(len(symbols), bool)
                second[1:] = side[:-1] & ~side[1:] & free[1:] & free[:-1]
                if second.sum() > best.sum():
                    best = second
            if 5 * int(best.sum()) >= most:
                break
        return best

    def reach(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from the places ``x`` and ``y`` (x < y) on are equal."""
        return self._walk(x, y, True)

    def reach_back(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from the places ``x`` and ``y`` backwards are equal."""
        return self._walk(x, y, False)

    def _walk(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        who = np.arange(len(x))
        x, y = x.copy(), y.copy()
        climbing = np.ones(len(x), bool)
        sym, up = self.symbol, self.up

        def outer(v: np.ndarray) -> np.ndarray:
            """Whether a node is the outermost child, on the walk's near side."""
            p = np.maximum(up[v], 0)
            return self.child[p] == v if forward else self.child_end[p] - 1 == v

        while len(who):
            # climb where both places begin (or end) a symbol of the next level
            rise = climbing & (up[x] >= 0)
            at = np.flatnonzero(rise)
            at = at[outer(x[at]) & outer(y[at])]
            same_up = at[sym[up[x[at]]] == sym[up[y[at]]]]
            x[same_up], y[same_up] = up[x[same_up]], up[y[same_up]]
            risen = np.zeros(len(x), bool)
            risen[same_up] = True
            # pass equal symbols, a block at a time
            same = ~risen & (sym[x] == sym[y])
            at = np.flatnonzero(same)
            if forward:
                step = np.minimum(self.block_end[x[at]] - x[at], self.block_end[y[at]] - y[at])
            else:
                step = np.minimum(x[at] - self.block_begin[x[at]], y[at] - self.block_begin[y[at]]) + 1
            out[who[at]] += step * self.length[x[at]]
            move = step if forward else -step
            x[at] += move
            y[at] += move
            # go down where they differ
            differ = np.flatnonzero(~risen & ~same)
            climbing[differ] = False
            down = differ[self.child[x[differ]] >= 0]
            if forward:
                x[down], y[down] = self.child[x[down]], self.child[y[down]]
            else:
                x[down], y[down] = self.child_end[x[down]] - 1, self.child_end[y[down]] - 1
            live = np.ones(len(x), bool)
            live[differ] = False
            live[down] = True
            who, x, y, climbing = who[live], x[live], y[live], climbing[live]
        return out


def _grid(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of all candidates of texts of ``n`` words, about ``QUERIES`` at once."""
    gap = TIMES - 1
    # texts by length, so those that a period fits are a tail
    order = np.argsort(n, kind="stable")
    lengths = n[order]
    most = int(lengths[-1]) // TIMES if len(n) else 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for q in range(1, most + 1):
        fit = np.searchsorted(lengths, max(SHORTEST, TIMES * q))
        which, room = order[fit:], lengths[fit:] - q
        for at in range(0, len(which), QUERIES):
            some, count = which[at:at + QUERIES], -(-room[at:at + QUERIES] // (gap * q))
            whose = np.repeat(np.arange(len(some)), count)
            place = (np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)) * (gap * q)
            held.append((some[whose], place, np.full(len(place), q)))
            size += len(place)
            if size >= QUERIES:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of the texts (numbers of words), by text, start and period."""
    n = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(n + 1) - n              # a border before each text
    total = int(n.sum()) + len(n) + 1
    string = np.zeros(total, np.int64)
    border = np.zeros(total, bool)
    border[np.append(offset - 1, total - 1)] = True
    body = np.concatenate([np.zeros(0, np.int64), *texts])
    string[~border] = body
    string[border] = (int(body.max()) + 1 if len(body) else 0) + np.arange(len(n) + 1)
    grammar, found = None, [np.zeros((4, 0), np.int64)]
    for text, place, q in _grid(n):
        i = offset[text] + place
        hit = string[i] == string[i + q]
        text, i, q = text[hit], i[hit], q[hit]
        if len(i) == 0:
            continue
        grammar = grammar or Grammar(string, border)
        right = grammar.reach(i, i + q)
        # what a text can't hold to the left needn't be asked
        need = np.maximum(SHORTEST, TIMES * q) - q - right
        ask = need <= i - offset[text]
        text, i, q, right = text[ask], i[ask], q[ask], right[ask]
        left = grammar.reach_back(i - 1, i + q - 1)
        length = left + right + q
        run = length >= np.maximum(SHORTEST, TIMES * q)
        found.append(np.stack([text, i - left - offset[text], length, q])[:, run])
    runs = np.concatenate(found, axis=1)
    # of equal stretches the least period, once
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(axis=0)
    runs = runs[:, new]
    runs = runs[:, np.lexsort((runs[3], runs[1], runs[0]))]
    return runs[0], runs[1], runs[2], runs[3]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def _scan(docs: DataFrame, id_col: str, text_col: str, columns: str, finish) -> DataFrame:
    """id_col and ``columns`` of each row, from ``finish``(words, start, length, period, kept)."""
    kinds = {"long": pa.int64(), "string": pa.string(),
             "array<struct<start:bigint,length:bigint,period:bigint>>":
                 pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
    schema = pa.schema([(c, kinds[t]) for c, t in (c.split() for c in columns.split(", "))])

    def rows_of(texts: list[list[bytes]]) -> Iterator[dict]:
        number: dict[bytes, int] = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
        which, start, length, period = find_runs(coded)
        cut = np.searchsorted(which, np.arange(len(texts) + 1))
        for t, a, b in zip(texts, cut[:-1], cut[1:]):
            part = start[a:b], length[a:b], period[a:b]
            yield finish(t, *part, _kept(len(t), *part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column(1):
                # the words of a text are what bytes.split() finds: it cuts at blanks and U+0009 to U+000D only
                held.append((text.as_py() or "").encode().split())
                size += len(held[-1])
                if size >= WORDS:
                    out += rows_of(held)
                    held, size = [], 0
            out += rows_of(held) if held else []
            done = pa.Table.from_pylist(out, schema).combine_chunks()
            yield pa.record_batch([batch.column(0), *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in done.columns]],
                                  ["id", *schema.names])
    rest = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_batches(rest, run, f"id {rest.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, runs (array of struct<start, length, period>, word numbers, by start and period), collapsed (the
    words that no run holds after its first period, joined by blanks)."""
    def finish(t, start, length, period, kept) -> dict:
        runs = [{"start": s, "length": e, "period": p} for s, e, p in zip(start.tolist(), length.tolist(), period.tolist())]
        return {"n_words": len(t), "runs": runs, "collapsed": b" ".join([t[i] for i in np.flatnonzero(kept).tolist()]).decode()}
    return _scan(docs, id_col, text_col,
                 "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", finish)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_runs, the greatest run (start, length, period, exponent_milli; nulls without one), runs_sha256 and
    collapsed_sha256 of the same results, without sending them back to the JVM."""
    def finish(t, start, length, period, kept) -> dict:
        listed = zip(start.tolist(), length.tolist(), period.tolist())
        top = {}
        if len(start):
            s, e, p = min(zip(start.tolist(), length.tolist(), period.tolist()), key=lambda r: (-r[1], r[0], r[2]))
            top = {"start": s, "length": e, "period": p, "exponent_milli": 1000 * e // p}
        left = b" ".join(t if kept.all() else [t[i] for i in np.flatnonzero(kept).tolist()])
        return {"n_runs": len(start), "start": None, "length": None, "period": None, "exponent_milli": None, **top,
                "runs_sha256": hashlib.sha256("".join(f"{s},{e},{p}\n" for s, e, p in listed).encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(left).hexdigest()}
    return _scan(docs, id_col, text_col, "n_runs long, start long, length long, period long, exponent_milli long, "
                                         "runs_sha256 string, collapsed_sha256 string", finish)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for a document with h = crc32(doc_id) divisible by 10 its words with those from a on replaced by the p
    from a on, repeated: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10)."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        cut = let(F.struct(w.alias("w"), a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(
            v["w"], lambda x, i: F.when(i < v["a"], x).otherwise(v["w"][(v["a"] + (i - v["a"]) % v["p"]).cast("int")])), " "))
        return F.when(n > 0, cut).otherwise(F.lit(""))
    return F.when(h % 10 == 0, let(words(text), repeat)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return run_digests(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
