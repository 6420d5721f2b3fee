"""BPE encoding and decoding by prefix-sharing trie traversal.

A byte-level BPE's encoding of a prefix is decided by its last token alone: if
``last(p)`` is the last token of prefix p, the encoding of p is that of p without it,
followed by it. So the distinct words of a piece of text are a trie; depth first
(the words in sorted order, keeping the states of the path they share) each prefix
gets its last token once: the token t that ends there and *fits* the last token u of
the prefix before it, that is, whose pair (u, t) merges to just u, t. A word's
encoding is read off its path backwards. Fits are cached, as are words.

Texts are cut into pre-tokens in numpy over whole batches: characters get a class
(letter, number, white space, other) and tokens start where the class changes, with
the pattern's rules for one leading space, runs of white space and English
contractions. Added tokens are cut out first and have their own ids. Words are told
apart by a 64-bit hash within a worker; since decoding must give back the text, each
piece is compared with it, and a piece that differed would be encoded by its words.

The tokenizer's file is read on the driver; its vocabulary has a fixed size and is
sent to the executors. Long texts are cut, at a blank between two letters, into pieces
of about ``PIECE`` characters, so memory doesn't follow the longest text; their ids are
hashed as they come. No shuffle.

Defined results: a null text is empty and has no ids; rows are encoded one by
one, so repeated rows and ids get equal results; an empty table gives an empty result; further columns are ignored,
whatever their names (``encode_rows`` keeps those it is told to carry).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rfmlens.llm.common import map_batches, table
from rfmlens.llm.shingles import mix

PIECE = 1 << 19            # characters encoded at once
WORDS_KEPT = 400_000       # distinct words a worker remembers, then it starts anew
FITS_KEPT = 400_000        # pairs of tokens that a worker remembers
ONE = (1,)
ROWS = 1000                # rows whose results are held at once
#: White space beside the C0 controls 9 to 13 and the blank (fixed values).
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_CUT = re.compile(r"[A-Za-z] (?=[A-Za-z])")
_U = np.uint64
_RADIX, _ODD = _U(0x2545F4914F6CDD1D), _U(0x9E3779B97F4A7C15)
BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _ODD)


def _byte_chars() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable Latin-1
    bytes as themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """Tokens, merges and added tokens of a byte-level BPE file, as bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, chars = spec["model"], _byte_chars()
    if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("a byte-level BPE without a normalizer is needed")
    raw = {t: bytes(chars[c] for c in t) for t in model["vocab"] if all(c in chars for c in t)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = model["vocab"]
    return {"tokens": {raw[t]: ids[t] for t in raw},
            "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges],
            "added": {x["content"]: x["id"] for x in spec.get("added_tokens", [])}}


class Encoder:
    def __init__(self, vocabulary: dict):
        self.tokens: dict[bytes, int] = vocabulary["tokens"]
        self.added: dict[str, int] = vocabulary["added"]
        self.merge = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(vocabulary["merges"])}
        self.single = [self.tokens[bytes([b])] for b in range(256)]
        self.bytes_of = {i: t for t, i in self.tokens.items()} | {i: s.encode() for s, i in self.added.items()}
        # lengths of the tokens that end in a given last byte pair, longest first
        ends: dict[bytes, set[int]] = {}
        for t in self.tokens:
            ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.fit: dict[int, bool] = {}
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        kinds = {"L": LETTER, "N": NUMBER}
        self.kind = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        self.kind[SPACES] = SPACE
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, _U)          # hashes of the words, ascending
        self.place = np.zeros(0, np.int32)   # their places below
        self.texts: list[bytes] = []         # decimal ids, each followed by a comma
        self.back: list[bytes] = []          # decoded bytes
        self.sizes: list[int] = []

    # -- merges ---------------------------------------------------------------
    def by_merges(self, ids: list[int]) -> list[int]:
        """Plain BPE: the merge of least rank, leftmost first, until none applies."""
        get = self.merge.get
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                m = get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at:at + 2] = best[1:]
        return ids

    def fits(self, pair: int) -> bool:
        """Whether two tokens' bytes merge to just these two (or, with -1 for
        the first, a token's own bytes to the token)."""
        got = self.fit.get(pair)
        if got is None:
            if len(self.fit) > FITS_KEPT:
                self.fit.clear()
            u, t = pair >> 32, pair & 0xFFFFFFFF
            both = [t] if u == -1 else [u, t]
            got = u != -2 and self.by_merges([self.single[b] for i in both for b in self.bytes_of[i]]) == both
            self.fit[pair] = got
        return got

    # -- the trie -------------------------------------------------------------
    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of sorted distinct words: a depth-first walk of their trie, whose
        path holds for each prefix its last token and that token's start."""
        out, last, since, before = [], [-1], [0], b""
        token, ending, known, fits = self.tokens.get, self.ends.get, self.fit.get, self.fits
        for w in words:
            n = min(len(w), len(before))
            same = 0
            while same < n and w[same] == before[same]:
                same += 1
            del last[same + 1:]
            del since[same + 1:]
            for end in range(same + 1, len(w) + 1):
                for size in ending(w[end - 2:end], ONE) if end > 1 else ONE:
                    start = end - size
                    if start >= 0 and (t := token(w[start:end])) is not None:
                        pair = last[start] << 32 | t       # -1: the token is the whole prefix
                        fit = known(pair)
                        if fit or fit is None and fits(pair):
                            break
                else:                  # a token of one byte ends everywhere, but need not fit
                    start = end - 1
                    t = self.single[w[start]]
                    if not fits(last[start] << 32 | t):
                        t = -2
                last.append(t)
                since.append(start)
            before, ids, end = w, [], len(w)
            while end:
                t = last[end]
                if t < 0:              # merges that aren't made in order of rank: plain merging
                    ids = self.by_merges([self.single[b] for b in w])[::-1]
                    break
                ids.append(t)
                end = since[end]
            out.append(ids[::-1])
        return out

    # -- pre-tokens -----------------------------------------------------------
    def starts(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in the characters ``c`` of several pieces, which
        start at ``first`` (ascending, no piece empty)."""
        n = len(c)
        k = self.kind[c]
        head = np.zeros(n + 1, bool)
        head[first] = True
        head[n] = True
        start = head[:n].copy()
        start[1:] |= k[1:] != k[:-1]
        # the last white space before anything else is a token's start, and goes with it if it is a blank
        turn = np.flatnonzero((k[:-1] == SPACE) & (k[1:] != SPACE) & ~head[1:n])
        start[turn] = True
        start[turn[c[turn] == 0x20] + 1] = False
        # contractions
        at = np.flatnonzero((c == 0x27) & start)
        if len(at):
            pad = np.concatenate([c, np.zeros(2, c.dtype)])
            a, b = pad[at + 1], pad[at + 2]
            two = ~head[np.minimum(at + 1, n)]
            short = two & np.isin(a, [ord(x) for x in "stmd"])
            long = two & ~head[np.minimum(at + 2, n)] & (
                ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            start[at[short | long] + 1] = False
            for hit, size in ((at[short], 2), (at[long], 3)):
                nxt = hit + size
                start[nxt[nxt < n]] = True
        return np.flatnonzero(start)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids each followed by a comma, decoded bytes) of
        each non-empty piece."""
        joined = "".join(pieces)
        data = np.frombuffer(joined.encode(), np.uint8)
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in pieces])
        begin = self.starts(c, np.concatenate([[0], ends[:-1]]))
        width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        lo = byte_at[begin]
        hi = np.append(lo[1:], len(data))
        size = hi - lo
        place = np.arange(len(data)) - np.repeat(lo, size)
        power = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(int(size.max()) - 1, _RADIX, _U)]))
        h = np.add.reduceat(BYTE_HASH[data] * power[place], lo)
        h = mix(h + size.astype(_U) * _ODD)
        seen, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        if len(self.texts) > WORDS_KEPT:
            self.clear()
        slot = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == seen[inside]
        place_of = np.empty(len(seen), np.int32)
        place_of[known] = self.place[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found = sorted(zip([raw[a:b] for a, b in zip(lo[where[new]].tolist(), hi[where[new]].tolist())], new.tolist()))
            place_of[[j for _, j in found]] = np.arange(len(self.texts), len(self.texts) + len(found))
            self.keys = np.insert(self.keys, slot[new], seen[new])
            self.place = np.insert(self.place, slot[new], place_of[new])
            for ids in self.encode_words([w for w, _ in found]):
                self.texts.append(",".join(map(str, ids)).encode() + b",")
                self.back.append(b"".join([self.bytes_of[i] for i in ids]))
                self.sizes.append(len(ids))
        words = place_of[inverse]
        counts = np.array([self.sizes[i] for i in place_of.tolist()])[inverse]
        cuts = np.searchsorted(begin, np.concatenate([[0], ends]))
        words = words.tolist()
        out, at = [], 0
        for p, a, b in zip(pieces, cuts[:-1], cuts[1:]):
            part = words[a:b]
            back = b"".join([self.back[i] for i in part])
            end = at + len(back)
            if raw[at:end] == back and end == byte_at[at_end := int(begin[b]) if b < len(begin) else len(c)]:
                out.append((int(counts[a:b].sum()), b"".join([self.texts[i] for i in part]), back))
            else:                      # two words with one hash
                end = int(byte_at[at_end])
                plain = [raw[lo[i]:hi[i]] for i in range(a, b)]
                known = sorted(set(plain))
                ids = dict(zip(known, self.encode_words(known)))
                all_ids = list(chain.from_iterable(ids[w] for w in plain))
                out.append((len(all_ids), "".join(f"{i}," for i in all_ids).encode(), b"".join(self.bytes_of[i] for i in all_ids)))
            at = end
        return out

    # -- texts ----------------------------------------------------------------
    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(piece, id of the added token after it) of a text."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from self._cut(text[at:m.start()], self.added[m[0]])
            at = m.end()
        yield from self._cut(text[at:], None)

    def _cut(self, text: str, then: int | None) -> Iterator[tuple[str, int | None]]:
        at = 0
        while len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
            yield text[at:m.start() + 1], None
            at = m.start() + 1
        yield text[at:], then


_ENCODERS: dict[str, Encoder] = {}


class _Digest:
    """Hashes of a row's decimal ids, joined by commas, and decoded bytes, as they come."""

    def __init__(self):
        self.n, self.ids, self.back = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, n: int, listed: bytes, decoded: bytes) -> None:
        self.ids.update(b"," + listed[:-1] if self.n else listed[:-1])
        self.n += n
        self.back.update(decoded)


class _Whole:
    """A row's ids and decoded bytes."""

    def __init__(self):
        self.n, self.listed, self.back = 0, [], []

    def add(self, n: int, listed: bytes, decoded: bytes) -> None:
        self.n += n
        self.listed.append(listed)
        self.back.append(decoded)

    def ids(self) -> np.ndarray:
        return np.fromstring(b"".join(self.listed)[:-1].decode(), np.int32, sep=",") if self.n else np.zeros(0, np.int32)


def _encoded(docs: DataFrame, path: str, carry: tuple[str, ...], text_col: str, kind, columns: str, finish) -> DataFrame:
    """A row (the carried columns, n_tokens, ...) for each row: ``finish`` makes the
    further columns of a batch's texts and filled ``kind`` objects."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(vocabulary.value)
        enc = _ENCODERS[path]
        names = [*(f"c{i}" for i in range(len(carry))), "n_tokens", *(c.split()[0] for c in columns.split(", "))]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = [kind() for _ in range(batch.num_rows)]
                todo: list[tuple[int, str, int | None]] = []
                held = 0

                def flush() -> None:
                    parts = [p for _, p, _ in todo if p]
                    got = iter(enc.encode_pieces(parts) if parts else ())
                    for row, p, then in todo:
                        if p:
                            rows[row].add(*next(got))
                        if then is not None:
                            rows[row].add(1, b"%d," % then, enc.bytes_of[then])
                    todo.clear()

                for row, text in enumerate(batch.column("text")):
                    for p, then in enc.pieces(text.as_py() or ""):
                        todo.append((row, p, then))
                        held += len(p)
                        if held >= PIECE:
                            flush()
                            held = 0
                flush()
                yield pa.record_batch([*batch.columns[1:], pa.array([r.n for r in rows], pa.int64()), *finish(batch.column("text"), rows)],
                                      names)
    rest = docs.select(docs[text_col].alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(rest.schema.fields[1:]))
    out = map_batches(rest, run, f"{kinds}n_tokens long, {columns}")
    return out.toDF(*carry, *out.columns[len(carry):])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids, decoded of each row: ids as the tokenizers library gives them
    (added tokens in a text are found, none are added), and the text decoded
    from the ids."""
    def finish(texts: pa.Array, rows: list[_Whole]) -> list[pa.Array]:
        return [pa.array([r.ids() for r in rows], pa.list_(pa.int32())),
                pa.array([b"".join(r.back).decode("utf-8", "replace") for r in rows], pa.string())]
    return _encoded(docs, path, (id_col,), text_col, _Whole, "ids array<int>, decoded string", finish)


def encode_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the carried columns, n_tokens, ids and round_trip: whether the decoded
    ids are the text."""
    def finish(texts: pa.Array, rows: list[_Whole]) -> list[pa.Array]:
        same = [b"".join(r.back) == (t.as_py() or "").encode() for t, r in zip(texts, rows)]
        return [pa.array([r.ids() for r in rows], pa.list_(pa.int32())), pa.array(same, pa.bool_())]
    return _encoded(docs, path, (id_col, *carry), text_col, _Whole, "ids array<int>, round_trip boolean", finish)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of each row: digests of the same ids
    and decoded bytes, without sending them back to the JVM."""
    def finish(texts: pa.Array, rows: list[_Digest]) -> list[pa.Array]:
        return [pa.array([r.ids.hexdigest() for r in rows]), pa.array([r.back.hexdigest() for r in rows])]
    return _encoded(docs, path, (id_col,), text_col, _Digest, "ids_sha256 string, decoded_sha256 string", finish)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
