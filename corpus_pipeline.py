"""Corpus pipeline: five stages over ``documents``, each one of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet below ``spark.checkpoint.dir`` and reads them again as the next one's
``docs``. All but the last return the columns of ``documents``:

1. quality: documents that a quality rule rejects go;
2. near_dedup: of each group of near copies (five-word shingles, similarity 0.8 or
   more) the document with the least id stays;
3. secrets: spans of secrets become ``[SECRET]``, ``n_chars`` follows;
4. mix: each document as often as the mix of its source takes it (0 to 3 times);
5. bpe: doc_id, source, lang, n_tokens, ids and whether the decoded ids give the text.

Defined results: a null or empty text fails the quality rules, so later stages meet none; null ids, sources and languages
are values like any others, as the operators define them; rows that repeat an id and a text count as exact copies, of which
one stays; of equal candidates the least id stays; an empty table gives an empty table after each stage; further columns of
``documents``, whatever their names, pass through the first four stages and are left out by the last.

SQL can't express the stages 3 and 4 (inferred automata, pivotal rounding), so there
is no oracle; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rfmlens.llm import bpe, common, minhash, mixing, quality, secret_scan

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, width=5, pct=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.learn(docs), length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode_rows(docs, public_tokenizers.path(TOKENIZER), carry=("source", "lang"))


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("bpe", bpe_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None
