"""Quality rules as a short-circuit cascade (native).

Every rule is a Spark expression over measures of a text that says whether it rejects it. The
cascade estimates each rule's cost and rejection rate on a bounded random sample of
all rows, orders the rules by rejection per cost, and evaluates them as one ``CASE``
chain: a text is rejected by the first rule that fires and no later rule runs on
it. Where the measures are wanted themselves (``measure``), the chain reads them instead of making them again. The order changes only the work and the reported rule, never which texts
are kept. No shuffle, no Python on the executors; one scan for the sample, one for the texts.

Defined results: a null or empty text has no words and fails ``too_short``;
rows are judged one by one, so repeated rows and ids get the same verdict; an
empty table gives an empty result (the rules then keep their given order);
further columns pass through, and the verdict column evades clashing names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rfmlens.llm.common import GAP, free_name, keep, let, table, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50        # words inside repeated 3-word windows, % of words
MAX_SYMBOLS_PER_10 = 1     # symbols per ten words
MAX_DUP_LINE_PCT = 50      # repeated lines, % of lines that hold a word
MEAN_WORD = (2, 15)        # code points a word
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 1000         # rows that cost and selectivity are estimated on, about


@dataclass(frozen=True)
class Measures:
    """Expressions for a text's measures; ``lines`` is a struct<n, dup>."""
    n_words: Column
    word_chars: Column
    n_symbols: Column
    lines: Column
    n_repeat_words: Column


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, GAP, "")) != "")


def lines(text: Column) -> Column:
    """struct<n, dup>: lines with a word, and those of them that equal an earlier one."""
    return let(_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def n_repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    64-bit hashes of the windows settle texts without a repeat; the others
    sort the windows themselves, so a hash collision cannot change the count.
    """
    def windows(f):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), f)

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["t"] == x["t"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["t"] == x["t"], F.lit(False)))
        spread = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spread)).cast("long")

    hashes = windows(lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    texts = windows(lambda i: F.struct(
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))
    distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return (F.when(F.size(w) < 4, F.lit(0).cast("long")).when(distinct, F.lit(0).cast("long"))
            .otherwise(let(F.sort_array(texts), covered)))


#: The two base rules first, then the method's own.
RULES = (
    Rule("too_short", lambda m: m.n_words < MIN_WORDS),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PCT * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > MAX_SYMBOLS_PER_10 * m.n_words),
    Rule("repeated_lines", lambda m: let(m.lines, lambda x: 100 * x["dup"] > MAX_DUP_LINE_PCT * x["n"])),
    Rule("word_length", lambda m: let(m.word_chars, lambda c: (c < MEAN_WORD[0] * m.n_words) | (c > MEAN_WORD[1] * m.n_words))),
)


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, measured on about ``sample_rows`` random rows.

    Each rule runs alone over the sample; only its flags reach the driver. The
    time of a trivial expression over the same rows (the scan) is taken off.
    A rule's rate counts + 1 of + 2 so that no rate is nought.
    """
    total = docs.count()
    if total == 0:
        return list(rules)
    few = docs.select(docs[text].alias("text"))
    few = keep(few if total <= sample_rows else few.where(F.rand(10) < sample_rows / total), "sample")

    def measure(flag: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        got = few.agg(F.count_if(flag).alias("r"), F.count(F.lit(1)).alias("n")).first()
        return time.perf_counter() - began, got["r"], got["n"]

    t = F.coalesce(F.col("text"), F.lit(""))
    measure(t == "")                       # opens the files, compiles the scan
    scan, _, _ = measure(t == "")
    scored = []
    for rule in rules:
        flag = rejected_by(F.col("text"), [rule]).isNotNull()
        measure(flag)
        seconds, hits, n = measure(flag)
        scored.append(((hits + 1) / (n + 2) / max(seconds - scan, 1e-4), rule))
    return [rule for _, rule in sorted(scored, key=lambda x: -x[0])]


def _measures(t: Column, w: Column) -> Measures:
    return Measures(F.size(w).cast("long"), word_chars(w), n_symbols(t), lines(t), n_repeat_words(w))


def _chain(m: Measures, rules) -> Column:
    out = None
    for rule in rules:
        out = F.when(rule.rejects(m), rule.name) if out is None else out.when(rule.rejects(m), rule.name)
    return out


def rejected_by(text: Column, rules) -> Column:
    """Name of the first rule that rejects the text, null if none does."""
    t = F.coalesce(text, F.lit(""))
    return let(words(t), lambda w: _chain(_measures(t, w), rules))


def measure(text: Column, rules) -> Column:
    """struct of a text's measures and the name of the first rule that rejects it; each measure is made once."""
    t = F.coalesce(text, F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")

    def all_of(w: Column) -> Column:
        m = _measures(t, w)
        return F.struct(*[getattr(m, n).alias(n) for n in names])

    def judged(m: Column) -> Column:
        return F.struct(*[m[n].alias(n) for n in names], _chain(Measures(*[m[n] for n in names]), rules).alias("rejected_by"))
    return let(let(words(t), all_of), judged)


def judge(docs: DataFrame, rules=RULES, text: str = "text", out: str = "rejected_by") -> DataFrame:
    """``docs`` with the name of the rejecting rule (null: kept)."""
    ordered = order_rules(docs, rules, text)
    return docs.withColumn(free_name(docs.columns, out), rejected_by(docs[text], ordered))


def filter_quality(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, all columns as they were."""
    return docs.where(rejected_by(docs[text], order_rules(docs, rules, text)).isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = measure(F.col("text"), order_rules(docs))
    failed = (F.col("m.n_words") < MIN_WORDS) | (
        100 * F.col("m.n_repeat_words") > MAX_REPEAT_PCT * F.col("m.n_words"))
    return (docs.select("doc_id", m.alias("m"))
            .select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.dup").alias("n_dup_lines"), "m.n_repeat_words",
                    failed.alias("base_failed"), (~failed & F.col("m.rejected_by").isNull()).alias("kept")))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n
  FROM (SELECT r, i, list_aggregate(w[i:i+2], 'string_agg', ' ') AS t
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY r
), ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM w)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
