"""Language ID by error-correcting output codes over character n-grams.

Every learned language has a codeword of bits. Each bit is predicted by a binary
classifier: the languages whose bit is 1 against those whose bit is 0, with the
log-odds of hashed character n-grams (1 to 3 characters, lower-cased, with a mark
for every run of non-letters) estimated from smoothed counts. A text's margin for a
bit is the mean log-odds over its n-grams. Loss-weighted decoding picks the
codeword with the least sum over bits of weight * loss(sign * margin), the weight being the
share of training text's bits that the classifier gets right above chance, the loss logistic.
The score is the runner-up's share of the two least losses; a text whose two nearest
codewords are nearly equal is flagged as ambiguous.

Learning counts n-grams over all rows with a label (no sample): one scan, summed by
language and n-gram before the shuffle. The driver gets one row per n-gram bucket
and language, a fixed number of buckets, and sends the weights to the executors.
Prediction is one scan without a shuffle.

Codes: with up to ``EXHAUSTIVE`` languages all 2^(k-1) - 1 ways to part them, beyond
that random codewords of 10 * log2(k) bits, the best of several draws by least distance.

Defined results: a null text or one without a letter is ``und`` with score 0; without
any labelled text all are ``und``; rows are judged one by one, so repeated rows and ids get
equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rfmlens.llm.common import map_batches, table
from rfmlens.llm.shingles import mix

BUCKETS = 1 << 16          # hashed n-grams
EXHAUSTIVE = 5             # languages with all partitions as bits
SMOOTH = 0.5
PIECE = 1 << 18            # characters scored at once
AMBIGUOUS = 0.55           # scores below are flagged
_U = np.uint64


def _letter_table() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all other characters."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of a text's letters, lower-cased, each run of anything else
    one 0, with a 0 at both ends; empty if there is no letter."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    c = _LETTERS[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = c > 0
    if not keep.any():
        return np.zeros(0, np.uint32)
    keep[1:] |= keep[:-1] & (c[1:] == 0)      # the first of a run of others
    c = c[keep]
    return np.concatenate([[0] if c[0] else [], c, [0] if c[-1] else []]).astype(np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams of a letter sequence (none of blanks alone)."""
    x = c.astype(_U)
    one = mix(x * _U(0x9E3779B97F4A7C15))
    two = mix(one[:-1] + x[1:] * _U(0xC2B2AE3D27D4EB4F))
    three = mix(two[:-1] + x[2:] * _U(0x165667B19E3779F9))
    return (np.concatenate([one[c > 0], two, three]) & _U(BUCKETS - 1)).astype(np.int64)


def pieces(text: str) -> Iterator[np.ndarray]:
    """Gram buckets of a whole text, piece by piece."""
    for at in range(0, len(text), PIECE):
        c = letters(text[at:at + PIECE])
        if len(c):
            yield grams(c)


def codewords(k: int) -> np.ndarray:
    """(k, bits) of -1 and 1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        rows = [[1 if (b >> i) & 1 else -1 for i in range(k)] for b in range(1, 2 ** (k - 1))]
        return np.array(rows, float).T
    bits, rng, best = math.ceil(10 * math.log2(k)), np.random.default_rng(7), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        gap = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over rows (text, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for g in pieces(text):
                    if lang not in total:
                        total[lang] = np.zeros(BUCKETS, np.int64)
                    np.add.at(total[lang], g, 1) if len(g) < BUCKETS // 8 else np.add(
                        total[lang], np.bincount(g, minlength=BUCKETS), out=total[lang])
            # bounded memory, however many languages there are
            while len(total) > 64:
                yield _counts(*total.popitem())
        for lang, n in total.items():
            yield _counts(lang, n)
    return (map_batches(rows.select("text", "lang"), run, "lang string, gram int, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _counts(lang: str, n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: (languages, BUCKETS)."""
        self.languages = languages
        k = len(languages)
        self.code = codewords(k)
        if k == 0:
            return
        # each language weighs the same, however much text it has
        p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
        bits = self.code.shape[1]
        w = np.zeros((BUCKETS, bits))
        for b in range(bits):
            on = self.code[:, b] > 0
            if on.all():
                continue
            w[:, b] = np.log(p[on].mean(0)) - np.log(p[~on].mean(0))
        self.weights = w.astype(np.float32)
        # margins that each language's own text gets, per bit: how well the bit parts them
        own = p @ w
        right = own * self.code
        self.scale = 1.0 / np.maximum(np.abs(own).mean(0), 1e-9)
        self.trust = np.maximum(0.05, (right > 0).mean(0) * np.minimum(1, np.abs(own).min(0) * self.scale))

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        m = 4 * margins * self.scale
        loss = (self.trust * np.logaddexp(0, -self.code * m)).sum(1)
        first, second = np.argsort(loss, kind="stable")[:2]
        score = float(loss[second] / max(loss[first] + loss[second], 1e-12))
        return self.languages[first], min(1.0, max(0.0, score)), score < AMBIGUOUS

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        total, n = 0.0, 0
        for g in pieces(text or ""):
            total = total + self.weights[g].sum(0, dtype=np.float64) if self.languages else 0.0
            n += len(g)
        if not n or not self.languages:
            return "und", 0.0, False
        return self.decode(total / n)


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows with a text and a language."""
    rows = rows.select(rows[text_col].alias("text"), rows[lang_col].alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    got = count_grams(rows).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        counts[[place[x] for x in got["lang"].to_pylist()], got["gram"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, ambiguous of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array([x[0] for x in got], pa.string()),
                                   pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())],
                                  ["id", "lang_pred", "score", "ambiguous"])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {kind}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"),
                                       "lang_pred", "score", "ambiguous")
