"""Secret scans: base patterns, and formats inferred as probabilistic automata.

Base spans are the matches of three patterns (``assign``: a credential's name, a sign
and a value of 12 characters or more; ``access``: ``AKIA`` and more, 18 or more;
``hex``: 16 or more lower-case hex digits), leftmost and non-overlapping per kind; a span is
the whole match, in code points, end exclusive.

The method learns what such values look like. The strings found by the base
patterns are labelled credentials (an assignment's value, else the match). A candidate
is another run of ``MIN_RUN`` or more credential characters with ``MIN_VALUE`` or more in a row, a letter among them, that
no dash, dot or underscore parts: dates, versions, phone numbers, host names and rules of dashes are none. Labelled
ordinary are shorter runs, of ``MIN_WORD`` or more, other runs of ``MIN_RUN`` or more, and candidates found in ``MANY`` or more documents, so what
is judged doesn't define it. For each
label a prefix tree of at most ``SAMPLE`` distinct strings (those with the least hashes among all
documents') is folded into an automaton: two states merge if their frequencies of
ending and of each next character class agree within Hoeffding's bound, all the way down.
Every candidate is then scored by the mean log-likelihood ratio of a credential's automaton
against the ordinary one, its end included. Each state's probabilities are mixed with a share ``PRIOR`` of one distribution that all automata
have in common, so what neither automaton knows counts 0. Bars come from scores by automata of the half of the sample that a
string is not in: a format accepts scores above the middle between its own lowest percentile
and the ordinary strings' highest percentile; where these overlap, scores above all
ordinary strings'. No bar is below ``MARGIN``, and a run must not be shorter than half of a format's shortest string or longer than twice its longest. The candidates that this rejects (of ``SAMPLE``) join the ordinary
strings, and automata and bars are made once more, so that long ordinary runs are known too.
Accepted candidates are added as ``inferred``, and so are accepted runs that meet a base
span but aren't covered by it (they are judged whole, and not learned from).

Two scans of the texts; the first sends up to 5 * SAMPLE strings a task, the
driver gets 5 * SAMPLE strings at most, and the executors get the automata.

Defined results: a null text is empty and has no spans; rows are judged one by one,
so repeated rows and ids get equal results; an empty table gives an empty result and
no automata; further columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rfmlens.llm.common import map_batches, table

KINDS = ("assign", "access", "hex", "inferred")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 12          # characters of an assigned value
MIN_RUN = 16            # characters of a candidate
MIN_WORD = 4            # characters of a shorter run that is learned from
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
WORD = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_WORD)
#: Enough characters in a row, not parted by a dash, dot or underscore, with a letter among them.
DENSE = re.compile(r"(?<![A-Za-z0-9+/=])(?=[0-9+/=]*+[A-Za-z])[A-Za-z0-9+/=]{%d}" % MIN_VALUE)
LABELS = (*KINDS[:3], "ordinary", "candidate")
SAMPLE = 500            # distinct labelled strings for each automaton at most
LONGEST = 256           # longer strings aren't learned from (they are scored)
MANY = 3                # documents that make a run ordinary
ALPHA = 0.01            # 1 - confidence of Hoeffding's bound
MARGIN = 0.05           # least mean log-likelihood ratio of a character
PRIOR = 0.05            # share of the distribution that all states have in common


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the base patterns."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _apart(runs: Iterator[re.Match], base: list) -> Iterator[re.Match]:
    """Runs that meet no base span; both are in order of their starts."""
    i, reach = 0, -1                # spans that start before the run's end reach up to here
    for m in runs:
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start():
            yield m


def open_runs(text: str, base: list) -> list[tuple[int, int]]:
    """Candidates that no base span covers whole."""
    out, i, reach = [], 0, -1       # spans that start no later than the run reach up to here
    for m in RUN.finditer(text):
        while i < len(base) and base[i][0] <= m.start():
            reach = max(reach, base[i][2])
            i += 1
        if reach < m.end() and DENSE.search(m[0]):
            out.append((m.start(), m.end()))
    return out


def labelled_runs(text: str, base: list) -> tuple[set[str], set[str]]:
    """(candidates, ordinary runs) that meet no base span."""
    candidates, ordinary = set(), set()
    for m in _apart(WORD.finditer(text), base):
        (candidates if len(m[0]) >= MIN_RUN and DENSE.search(m[0]) else ordinary).add(m[0])
    return candidates, ordinary


def symbols(s: str) -> str:
    """Character classes: d digit, h a-f, l g-z, H A-F, L G-Z; others as they are."""
    return s.translate(_CLASS)


_CLASS = {ord(c): "d" if c.isdigit() else ("h" if c in "abcdef" else "l") if c.islower() else ("H" if c in "ABCDEF" else "L")
          for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
CLASSES = 5 + len("+/_.=-")


class Automaton:
    """Deterministic and probabilistic; state 0 is the start."""

    def __init__(self, strings: list[str]):
        self.n: list[int] = [0]
        self.ends: list[int] = [0]
        self.to: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        for s in strings:
            self._add(symbols(s))
        self._fold()
        self.longest, self.shortest = (max(map(len, strings)), min(map(len, strings))) if strings else (0, 0)

        def cost(times: int, q: int) -> float:
            return -math.log((1 - PRIOR) * times / (self.n[q] + 1) + PRIOR / (CLASSES + 1))
        self.cost = [{c: cost(self.taken[q][c], q) for c in self.to[q]} for q in range(len(self.n))]
        self.end = [cost(self.ends[q], q) for q in range(len(self.n))]
        self.unseen = -math.log(PRIOR / (CLASSES + 1))

    def _add(self, s: str) -> None:
        q = 0
        for c in s:
            self.n[q] += 1
            if c not in self.to[q]:
                self.to[q][c] = len(self.n)
                self.n.append(0)
                self.ends.append(0)
                self.to.append({})
                self.taken.append({})
            self.taken[q][c] = self.taken[q].get(c, 0) + 1
            q = self.to[q][c]
        self.n[q] += 1
        self.ends[q] += 1

    def _agree(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not self.n[a] or not self.n[b]:
                continue
            bound = (self.n[a] ** -0.5 + self.n[b] ** -0.5) * math.sqrt(0.5 * math.log(2 / ALPHA))
            if abs(self.ends[a] / self.n[a] - self.ends[b] / self.n[b]) > bound:
                return False
            for c in sorted(self.to[a].keys() | self.to[b].keys()):
                if abs(self.taken[a].get(c, 0) / self.n[a] - self.taken[b].get(c, 0) / self.n[b]) > bound:
                    return False
                if c in self.to[a] and c in self.to[b] and self.to[a][c] != self.to[b][c]:
                    todo.append((self.to[a][c], self.to[b][c]))
        return True

    def _join(self, a: int, b: int) -> None:
        """Folds the tree below b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, q in sorted(self.to[b].items()):
                if c in self.to[a]:
                    todo.append((self.to[a][c], q))
                else:
                    self.to[a][c] = q
                self.taken[a][c] = self.taken[a].get(c, 0) + self.taken[b][c]

    def _fold(self) -> None:
        red = [0]
        while True:
            edge = min(((self.to[r][c], r, c) for r in red for c in self.to[r] if self.to[r][c] not in red), default=None)
            if edge is None:
                return
            blue, r, c = edge
            for a in red:
                if self._agree(a, blue):
                    self.to[r][c] = a
                    self._join(a, blue)
                    break
            else:
                red.append(blue)

    def mean_cost(self, s: str) -> float:
        """Mean negative log-likelihood of a string's character classes and its end. A class
        unseen in a state leads to the start, and so says nothing about the end."""
        q, total, end = 0, 0.0, self.end[0]
        for c in s:
            step = self.cost[q].get(c)
            if step is None:
                total, q, end = total + self.unseen, 0, self.unseen
            else:
                total, q = total + step, self.to[q][c]
                end = self.end[q]
        return (total + end) / (len(s) + 1)


class Formats:
    """The credentials' automata with their bars, and the ordinary one."""

    def __init__(self, labelled: dict[str, list[str]]):
        ordinary = labelled.get("ordinary", [])
        self._fit(labelled, ordinary)
        if self.kinds and (rejected := [s for s in labelled.get("candidate", []) if not self.accepts(s)]):
            self._fit(labelled, ordinary + rejected)

    def _fit(self, labelled: dict[str, list[str]], ordinary: list[str]) -> None:
        self.kinds: list[tuple[Automaton, float]] = []
        self.ordinary = Automaton(ordinary)  # of no strings: all classes alike
        halves = _halves(ordinary, self.ordinary)
        for kind in KINDS[:3]:
            strings = labelled.get(kind, [])
            if not strings:
                continue
            made = Automaton(strings)
            own = sorted(_ratio(self.ordinary, half, symbols(s)) for half, held in _halves(strings, made) for s in held)
            other = sorted(_ratio(half, made, symbols(s)) for half, held in halves for s in held) or [0.0]
            low, high = own[len(own) // 100], other[-1 - len(other) // 100]
            self.kinds.append((made, max(MARGIN, (low + high) / 2 if low > high else other[-1])))

    def accepts(self, run: str) -> bool:
        s = symbols(run)
        return any(made.shortest <= 2 * len(s) and len(s) <= 2 * made.longest and _ratio(self.ordinary, made, s) > bar
                   for made, bar in self.kinds)


def _ratio(ordinary: Automaton, made: Automaton, s: str) -> float:
    return ordinary.mean_cost(s) - made.mean_cost(s)


def _halves(strings: list[str], whole: Automaton) -> list[tuple[Automaton, list[str]]]:
    """(automaton of one half, strings of the other), both ways; one string has no other half."""
    if len(strings) < 2:
        return [(whole, strings)]
    return [(Automaton(strings[1 - k::2]), strings[k::2]) for k in (0, 1)]


def all_spans(text: str, formats: Formats) -> tuple[list, list]:
    """(base spans, all spans), each (start, kind's number, end)."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b in open_runs(text, base) if formats.accepts(text[a:b])] if formats.kinds else []
    base = [x[:3] for x in base]
    return base, sorted(base + more)


def _order(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=7).digest(), "big")


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Formats:
    """Automata from the labelled strings of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the documents of each string kept; one that gives way to others never comes back, so the counts are whole
        least: dict[str, dict[tuple[int, str], int]] = {k: {} for k in LABELS}
        for batch in batches:
            found: dict[str, dict[str, int]] = {k: {} for k in LABELS}
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    candidates, ordinary = labelled_runs(text, base)
                    for k, strings in (("candidate", candidates), ("ordinary", ordinary), *((KINDS[k], (value,)) for _, k, _, value in base)):
                        of = found[k]
                        for s in strings:
                            of[s] = of.get(s, 0) + 1
            for k, strings in found.items():
                new = least[k]
                for s, n in strings.items():
                    if len(s) <= LONGEST:
                        at = _order(s), s
                        new[at] = new.get(at, 0) + n
                least[k] = {at: new[at] for at in sorted(new)[:sample]}
        rows = [(k, h, s, n) for k, strings in least.items() for (h, s), n in strings.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in
                               enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["kind", "h", "value", "n"])
    strings = (map_batches(docs.select(docs[text_col].alias("text")), run, "kind string, h long, value string, n long")
               .groupBy("kind", "h", "value").agg(F.sum("n").alias("n")))

    def first(v: str) -> Column:
        return F.slice(F.sort_array(F.collect_list(v)), 1, sample)
    # the least of each part, then of all
    parts = (strings.select("kind", F.pmod("h", F.lit(64)).alias("part"), F.struct("h", "value", "n").alias("v"))
             .groupBy("kind", "part").agg(first("v").alias("v")).select("kind", F.explode("v").alias("v")))
    kept = {r["kind"]: r["v"] for r in parts.groupBy("kind").agg(first("v").alias("v")).collect()}
    labelled = {k: [x["value"] for x in kept.get(k, [])] for k in KINDS[:3]}
    often = [x["value"] for x in kept.get("candidate", []) if x["n"] >= MANY]
    return Formats({**labelled, "ordinary": [x["value"] for x in kept.get("ordinary", [])] + often,
                    "candidate": [x["value"] for x in kept.get("candidate", []) if x["n"] < MANY]})


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base (text of the base spans), spans of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [all_spans(t or "", formats) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in base) for base, _ in both], pa.int64()) for k in range(3)]
            yield pa.record_batch([batch.column("id"), *counts, pa.array([_joined(b) for b, _ in both]),
                                   pa.array([_joined(s) for _, s in both])],
                                  ["id", "n_assign", "n_access", "n_hex", "base", "spans"])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, formats: Formats, text_col: str = "text", mark: str = "[SECRET]",
           length_col: str | None = None) -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; where
    ``length_col`` is given, it becomes the length of a changed text."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col else None

    def clean(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text, formats)[1]):
            return text
        out, done = [], 0
        for a, _, b in spans:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                columns[size] = pa.array([n if a is b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new)],
                                         columns[size].type)
            yield pa.record_batch(columns, batch.schema.names)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return map_batches(plain, run, plain.schema).toDF(*docs.columns)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, learn(docs)).select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
