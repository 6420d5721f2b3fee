r"""Chat formatting, relational: Spark expressions only.

Turns are collected per conversation and sorted, adjacent turns of one role are
merged into one message by array functions, and the pieces are joined into one
text:

    <|turn|>user<|text|>first text<|part|>text of the next user turn<|end|>\n

Inside roles and texts every control string (the template's own and those of
common chat templates) gets one more backslash after its first character, so
none is left as it was; reading back takes one off, which restores any text,
also one that already looked escaped.

Each conversation gets its formatted text and the loss mask: spans (start, end in
code points, end exclusive) of the assistants' escaped texts. ``read_back``
parses the formatted text again into turns and cuts the masked text out of it.

Defined results: a null text is empty; a null role reads back as an empty one;
turns sort by (turn, role, text) with null first, so ties and repeated rows have
one order and each row stays a turn; rows with a null conv_id form one
conversation; further columns are ignored; an empty table gives an empty result.
One conversation is one row of the output and must fit in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rfmlens.llm.common import let, table

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
#: Control strings: first character, then the rest (fixed values).
CONTROL = r"([<\[])(\\*)(\|(?:turn|text|part|end|system|user|assistant|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of struct<start, end>)."""
    empty = F.lit("")
    turns = F.sort_array(F.collect_list(F.struct(
        F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))))

    def pieces(t: Column) -> Column:
        """Per turn: the marks before its text, the text, the marks after it."""
        def one(x: Column, i: Column) -> Column:
            new = F.coalesce(F.get(t, i - 1)["role"] != x["role"], F.lit(True))
            last = F.coalesce(F.get(t, i + 1)["role"] != x["role"], F.lit(True))
            return F.struct(
                F.when(new, F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT))).otherwise(F.lit(PART)).alias("head"),
                escape(x["text"]).alias("body"),
                F.when(last, F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"),
                (x["role"] == loss_role).alias("loss"))
        return F.transform(t, one)

    def spans(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"),
                        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["head"])
            b = a + F.length(x["body"])
            return F.struct((b + F.length(x["tail"])).alias("at"),
                            F.when(x["loss"], F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end")))))
                            .otherwise(acc["out"]).alias("out"))
        return F.aggregate(p, zero, step, lambda acc: acc["out"])

    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    return (rows.groupBy("conv_id").agg(turns.alias("t"))
            .select("conv_id", let(F.col("t"), pieces).alias("p"))
            .select("conv_id", text.alias("formatted"), spans(F.col("p")).alias("loss_spans")))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text: array of struct<role, text>."""
    messages = F.filter(F.split(formatted, r"<\|turn\|>"), lambda m: m != "")

    def turns_of(m: Column) -> Column:
        cut = F.regexp_replace(m, r"<\|end\|>\n$", "")
        return let(F.split(cut, r"<\|text\|>"), lambda rt: F.transform(
            F.split(rt[1], r"<\|part\|>"),
            lambda x: F.struct(unescape(rt[0]).alias("role"), unescape(x).alias("text"))))
    return F.flatten(F.transform(messages, turns_of))


def masked(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionAll(spark.sql(
        f"SELECT -7L AS conv_id, turn, role, '{hard}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"))
    out = format_chats(rows)
    listed = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return (out.select("conv_id", read_back(F.col("formatted")).alias("turns"),
                       masked(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    "formatted_chars"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, lag(role) OVER o AS before, lead(role) OVER o AS after,
         length(text) + len(regexp_extract_all(text, '[<\[]\\*(\|(turn|text|part|end|system|user|assistant|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>|/?INST\])')) AS n
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN before IS DISTINCT FROM role THEN 16 + length(role) ELSE 8 END
             + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
