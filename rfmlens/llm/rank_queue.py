"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks.

A text is split by the vocabulary's pattern; each match is a pre-token. A pre-token that is a
token is that token. In any other, neighbours whose joined bytes are a token are merged, the least rank
first and the leftmost of it first, until no two neighbours join:

* the tokens form a linked list over byte positions (next, previous, and the rank of each token
  joined with its next);
* a bucket for each rank holds the positions of its pairs. Which buckets have any is a bitmap of
  ``WORD``-bit words under a bitmap of the words that aren't zero, so the next rank is two
  find-first-set steps away, however many positions wait;
* a merge changes the pairs on both sides: their positions go into the buckets of the new ranks, and
  what they leave in the old ones is stale and skipped, being told by the rank kept in the list.

Every merge is found in constant time, so a pre-token of a million bytes costs as much a byte as a short
one, at about 20 bytes of arrays for each of its bytes. The distinct pre-tokens of a piece of text that a worker
doesn't know yet go through one queue together (no pair spans two of them); it remembers those of up to
``LONG`` characters. Longer texts than ``PIECE`` characters are taken ``MATCHES`` pre-tokens at a time.
The rank file has a fixed size, is read on the driver and sent to the executors. No shuffle.

Defined results: a null text is empty and has no ids; a null list of ids decodes to an empty text;
rows are encoded one by one, so repeated rows and ids get equal results; further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rfmlens.llm.common import map_batches, table

WORD = 256                 # bits of a bitmap word
PIECE = 1 << 18            # characters encoded at once
MATCHES = 50_000           # pre-tokens of a longer text taken at once
WORDS_KEPT = 150_000       # distinct pre-tokens a worker remembers, and as many from before that
LONG = 64                  # longer pre-tokens are not remembered


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if len(set(ranks.values())) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("each token needs its own rank, and each byte must be a token")
    return ranks


class RankQueue:
    """Positions by rank, the least rank first. A position whose rank has a bucket is appended to it."""

    def __init__(self):
        self.buckets: dict[int, array] = {}
        self.words: dict[int, int] = {}    # which ranks of a word have positions
        self.top = 0                       # which words are not zero

    def put(self, rank: int, bucket: array) -> None:
        self.buckets[rank] = bucket
        word, bit = divmod(rank, WORD)
        self.words[word] = self.words.get(word, 0) | 1 << bit
        self.top |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        """The least rank and its positions, ascending."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        rank = word * WORD + (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.words[word] = bits
        if not bits:
            self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pairs = np.full(1 << 16, -1, np.int32)
        for t, r in ranks.items():
            if len(t) == 2:
                self.pairs[t[0] << 8 | t[1]] = r
        self.ids: dict[str, bytes] = {}    # decimal ids of a known pre-token, a blank after each
        self.back: dict[str, bytes] = {}   # its decoded bytes
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}    # those known before
        self.long: list[str] = []          # known ones that are not to be remembered

    def merged(self, data: bytes, starts: np.ndarray) -> tuple[array, bytearray]:
        """The list of tokens (next position of each token's start) of the strings that begin at
        ``starts`` (ascending, from 0) in ``data``, and the marks of their borders."""
        n = len(data)
        border = bytearray(n + 1)
        border[n] = 1
        for s in starts.tolist():
            border[s] = 1
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        first = np.append(self.pairs[b[:-1] << 8 | b[1:]], np.int32(-1))
        first[starts[1:] - 1] = -1
        queue = RankQueue()
        waiting = np.flatnonzero(first >= 0)
        waiting = waiting[np.argsort(first[waiting], kind="stable")].astype(np.int32)
        known, at = np.unique(first[waiting], return_index=True)
        for r, part in zip(known.tolist(), np.split(waiting, at[1:])):
            queue.put(r, array("i", part.tobytes()))
        rank = array("i", first.astype(np.int32).tobytes())
        after = array("i", np.arange(1, n + 2, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n, dtype=np.int32).tobytes())
        get, bucket_of, put = self.ranks.get, queue.buckets.get, queue.put
        while queue.top:
            now, positions = queue.take()
            lower = False
            for done, i in enumerate(positions):
                if rank[i] != now:                 # stale
                    continue
                if lower:                          # a pair of less rank came up: it goes first
                    queue.put(now, array("i", positions[done:]))
                    break
                j = after[i]
                k = after[j]
                after[i] = k
                before[k] = i
                rank[j] = -1
                if border[k]:
                    rank[i] = -1
                else:
                    rank[i] = r = get(data[i:after[k]], -1)
                    if r >= 0:
                        bucket = bucket_of(r)
                        if bucket is None:
                            put(r, array("i", (i,)))
                        else:
                            bucket.append(i)
                        lower = r < now
                if not border[i]:
                    p = before[i]
                    rank[p] = r = get(data[p:k], -1)
                    if r >= 0:
                        bucket = bucket_of(r)
                        if bucket is None:
                            put(r, array("i", (p,)))
                        else:
                            bucket.append(p)
                        lower = lower or r < now
        return after, border

    def encode_words(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each non-empty pre-token."""
        ranks = self.ranks
        whole = [ranks.get(w) for w in words]
        rest = [w for w, t in zip(words, whole) if t is None]
        if rest:
            data = b"".join(rest)
            starts = np.cumsum([0, *map(len, rest[:-1])])
            after, border = self.merged(data, starts)
        i = 0
        for t in whole:
            if t is not None:
                yield [t]
                continue
            ids = []
            while True:
                j = after[i]
                ids.append(ranks[data[i:j]])
                i = j
                if border[i]:
                    break
            yield ids

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        ids, back = self.old
        for w in new.intersection(ids):
            self.ids[w], self.back[w] = ids[w], back[w]
        new = [w for w in new if w not in ids]
        self.long = [w for w in new if len(w) > LONG]
        for w, ids in zip(new, self.encode_words([w.encode() for w in new])):
            self.ids[w] = b"%d " * len(ids) % tuple(ids)
            self.back[w] = b"".join([self.bytes_of[t] for t in ids])

    def forget(self) -> None:
        """Keep the memory bounded between pieces."""
        if len(self.ids) > WORDS_KEPT:
            self.old, self.ids, self.back = (self.ids, self.back), {}, {}
        for w in self.long:
            self.ids.pop(w, None)
            self.back.pop(w, None)

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(row, decimal ids with a blank after each, decoded bytes), in order; a long text's come in
        several parts."""
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> Iterator[tuple[int, bytes, bytes]]:
            self.learn(set().union(*[ws for _, ws in held]))
            for row, ws in held:
                yield row, b"".join(map(self.ids.__getitem__, ws)), b"".join(map(self.back.__getitem__, ws))
            self.forget()
            held.clear()

        for row, text in enumerate(texts):
            if len(text) <= PIECE:
                held.append((row, self.pattern.findall(text)))
                size += len(text)
                if size >= PIECE:
                    yield from flush()
                    size = 0
            else:
                yield from flush()
                size = 0
                matches = self.pattern.finditer(text)
                while part := [m[0] for m in islice(matches, MATCHES)]:
                    held.append((row, part))
                    yield from flush()
        yield from flush()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, columns: str, new, add, finish) -> DataFrame:
    """id_col and ``columns`` of each row: ``new`` makes a row's state, ``add`` takes the next part of its ids
    and bytes, ``finish`` gives its columns."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    schema = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[t])
                        for c, t in (c.split() for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get((path, pattern))
        if enc is None:
            enc = _ENCODERS[path, pattern] = Encoder(ranks.value, pattern)
        for batch in batches:
            rows = [new() for _ in range(batch.num_rows)]
            for row, ids, back in enc.encode_texts([t or "" for t in batch.column(1).to_pylist()]):
                add(rows[row], ids, back)
            done = pa.Table.from_pylist([finish(r) for r in rows], schema).combine_chunks()
            yield pa.record_batch([batch.column(0), *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in done.columns]],
                                  ["id", *schema.names])
    rest = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = map_batches(rest, run, f"id {rest.schema['id'].dataType.simpleString()}, {columns}")
    return out.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids, decoded: the ids of each text, without special tokens, and the text decoded from them."""
    def add(row: list, ids: bytes, back: bytes) -> None:
        row.append((np.array(ids.split(), np.int32), back))

    def finish(row: list) -> dict:
        ids = np.concatenate([np.zeros(0, np.int32), *[a for a, _ in row]])
        return {"n_tokens": len(ids), "ids": ids, "decoded": b"".join(b for _, b in row).decode("utf-8", "replace")}
    return _encoded(docs, path, pattern, id_col, text_col, "n_tokens long, ids array<int>, decoded string", list, add, finish)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (decoded bytes): the digests
    of the same results, hashed as they come."""
    class Row:
        def __init__(self):
            self.n, self.ids, self.back = 0, hashlib.sha256(), hashlib.sha256()

    def add(row, ids: bytes, back: bytes) -> None:
        if ids:
            row.ids.update(b" " + ids[:-1] if row.n else ids[:-1])
            row.n += ids.count(b" ")
            row.back.update(back)

    def finish(row) -> dict:
        return {"n_tokens": row.n, "ids_sha256": row.ids.hexdigest(), "decoded_sha256": row.back.hexdigest()}
    return _encoded(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", Row, add, finish)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the texts of lists of ids; bytes that aren't UTF-8 become U+FFFD. An id that the
    vocabulary doesn't have is an error."""
    tokens = rows.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens.value
        for batch in batches:
            texts = [b"".join([of[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])
    rest = rows.select(rows[id_col].alias("id"), rows[ids_col].alias("ids"))
    out = map_batches(rest, run, f"id {rest.schema['id'].dataType.simpleString()}, text string")
    return out.toDF(id_col, "text")


def op12_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public
    return encode_digests(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
