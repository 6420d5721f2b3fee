"""Prefix trie, rank queue and run detection against brute force."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as public
from rfmlens.llm import catalog, periodic, prefix_trie, rank_queue

SF = "/root/testdata/sf0.001"
RANKS = "byte_bpe_50k.tiktoken"
CLASH = "doc_id long, text string, id string, ids string, words string, part int, n_tokens string"


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# -- byte-level BPE -------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=rank_queue.load_ranks(public.path(RANKS)), special_tokens={})


def _encode(encoder, texts):
    ids, back = [[] for _ in texts], [b""] * len(texts)
    for row, i, b in encoder.encode_texts(texts):
        ids[row] += map(int, i.split())
        back[row] += b
    return ids, back


def test_rank_queue_equals_the_library(texts, library):
    rnd = random.Random(5)
    hard = ["a" * 70_000, "".join(rnd.choice("etaoinshr") for _ in range(40_000)), "中" * 9_000, "0123456789" * 3_000, " " * 5_000 + "x",
            "\n \t" * 99, "don't we'll I'M 'S 'd''ll   　x\x1c\x85y", "", " ", "́é", "".join(map(chr, range(1, 3000))),
            "words and " * 40_000]                 # longer than a piece
    encoder = rank_queue.Encoder(rank_queue.load_ranks(public.path(RANKS)), public.PATTERN)
    ids, back = _encode(encoder, texts + hard)
    for text, i, b in zip(texts + hard, ids, back):
        assert i == library.encode_ordinary(text)
        assert b == text.encode()


def test_pre_tokens_known_before_are_found_again(texts, library, monkeypatch):
    monkeypatch.setattr(rank_queue, "WORDS_KEPT", 300)
    monkeypatch.setattr(rank_queue, "PIECE", 5_000)
    encoder = rank_queue.Encoder(rank_queue.load_ranks(public.path(RANKS)), public.PATTERN)
    for _ in range(2):
        ids, _ = _encode(encoder, texts)
        assert ids == [library.encode_ordinary(t) for t in texts]
    assert max(len(encoder.ids), len(encoder.old[0])) < 300 + 5_000


def test_merges_that_bring_up_a_lower_rank():
    """In this vocabulary a merge makes a pair of less rank than its own, which then goes first."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 9, b"abc": 2, b"abcab": 1, b"bc": 30, b"ca": 12, b"cab": 3, b"aa": 20}
    encoder = rank_queue.Encoder(ranks, r"[^ ]+| +")

    def plain(word: bytes) -> list[int]:
        if word in ranks:
            return [ranks[word]]
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    rnd = random.Random(2)
    for _ in range(300):
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 20))) for _ in range(6)]
        got, _ = _encode(encoder, [" ".join(words)])
        want = []
        for i, w in enumerate(words):
            want += ([ranks[b" "]] if i else []) + plain(w.encode())
        assert got[0] == want


def test_queue_takes_the_least_rank_and_its_positions_in_order():
    queue, rnd, held = rank_queue.RankQueue(), random.Random(3), []
    for position in range(2000):
        rank = rnd.randrange(60_000)
        if rank in queue.buckets:
            queue.buckets[rank].append(position)
        else:
            queue.put(rank, array("i", (position,)))
        held.append((rank, position))
    out = []
    while queue.top:
        rank, positions = queue.take()
        out += [(rank, p) for p in positions]
    assert out == sorted(held)


def test_rank_queue_rows(spark, library):
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "no id"), (None, None), (4, "x" * 400_000), (5, " \n ")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", 0, "d") for r in rows], CLASH)
    got = rank_queue.encode(docs, public.path(RANKS), public.PATTERN)
    assert sorted(((r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in got.collect()), key=str) == sorted(
        ((i, len(t), t, s or "") for i, s in rows for t in [library.encode_ordinary(s or "")]), key=str)
    digests = rank_queue.encode_digests(docs, public.path(RANKS), public.PATTERN).collect()
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (sha(" ".join(map(str, library.encode_ordinary(s or "")))), sha(s or "")) for _, s in rows)
    back = rank_queue.decode(got, public.path(RANKS))
    assert sorted(r.text for r in back.collect()) == sorted(s or "" for _, s in rows)
    assert rank_queue.encode(docs.limit(0), public.path(RANKS), public.PATTERN).count() == 0


# -- periodic runs --------------------------------------------------------------------------------
def brute_runs(s) -> list[tuple[int, int, int]]:
    found, n = {}, len(s)
    for q in range(1, n // 4 + 1):
        j = 0
        while j < n - q:
            k = j
            while k < n - q and s[k] == s[k + q]:
                k += 1
            if k > j and k - j + q >= max(6, 4 * q):
                found.setdefault((j, k - j + q), q)
            j = max(k, j + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def brute_row(doc_id, text) -> tuple:
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n = len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    dropped = {i for a, e, q in runs for i in range(a + q, a + e)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{e},{q}\n" for a, e, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randrange(1, 7)):
            k = rnd.choice([1, 2, 3, 5])
            s = [rnd.randrange(k) for _ in range(rnd.choice([0, 1, 5, 6, 7, 20, 60, 150]))]
            while rnd.random() < .7:
                unit = [rnd.randrange(k) for _ in range(rnd.randrange(1, 9))]
                at = rnd.randrange(len(s) + 1)
                s[at:at] = (unit * 9)[:rnd.randrange(1, 60)]
            texts.append(np.array(s * (rnd.randrange(1, 6) if rnd.random() < .2 else 1), np.int64))
        which, start, length, period = periodic.find_runs(texts)
        got = [[] for _ in texts]
        for t, *run in zip(which.tolist(), start.tolist(), length.tolist(), period.tolist()):
            got[t].append(tuple(run))
        assert got == [brute_runs(t.tolist()) for t in texts]


def test_grammar_extensions_are_exact(monkeypatch):
    rnd = np.random.default_rng(6)
    for size, kinds in ((1, 1), (50, 1), (400, 2), (999, 5), (700, 400)):
        body = rnd.integers(0, kinds, size)
        body[size // 3:2 * size // 3] = body[:2 * size // 3 - size // 3]
        string = np.concatenate([[kinds], body, [kinds + 1]])
        border = np.zeros(size + 2, bool)
        border[[0, -1]] = True
        grammar = periodic.Grammar(string, border)
        assert len(grammar.symbol) < 8 * (size + 2)
        x = rnd.integers(1, size + 1, 300)
        y = rnd.integers(1, size + 1, 300)
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        for a, b, right, left in zip(x, y, grammar.reach(x, y), grammar.reach_back(x, y)):
            n = 0
            while string[a + n] == string[b + n]:
                n += 1
            m = 0
            while string[a - m] == string[b - m]:
                m += 1
            assert (right, left) == (n, m)


def test_queries_are_split_without_losing_runs(monkeypatch):
    s = np.array(([1, 2, 3] * 50 + [4] * 9 + list(range(10, 40))) * 4, np.int64)
    whole = [x.tolist() for x in periodic.find_runs([s, s[:70], s])]
    monkeypatch.setattr(periodic, "QUERIES", 7)
    assert [x.tolist() for x in periodic.find_runs([s, s[:70], s])] == whole


def test_run_rows(spark, texts):
    loop = "a b c " * 20 + "z"
    rows = [(1, loop), (1, loop), (2, None), (3, ""), (None, "no no no no no no no"), (None, None), (4, "x y " * 5000), (5, " \n "),
            (6, "same " * 30_000)] + [(100 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", 0, "d") for r in rows], CLASH)
    docs = docs.withColumn("text", periodic.looped(F.col("doc_id"), F.col("text")))
    got = [tuple(r) for r in periodic.run_digests(docs).collect()]
    want = [brute_row(i, t if i != 6 else None) for i, t in rows]
    assert sorted((g for g in got if g[0] != 6), key=str) == sorted((w for w in want if w[0] != 6), key=str)
    hot = next(g for g in got if g[0] == 6)
    assert hot[1:5] == (1, 0, 30_000, 1)
    full = {(r.doc_id, r.n_words): r for r in periodic.periodic_runs(docs.where("doc_id < 7")).collect()}
    assert [tuple(r) for r in full[1, 61].runs] == [(0, 60, 3)] and full[1, 61].collapsed == "a b c z"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_registered_run_query(spark):
    got = {r.doc_id: tuple(r) for r in catalog.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows) and any(r[1] for r in got.values())
    for r in rows:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)


# -- prefix trie ----------------------------------------------------------------------------------
def brute_trie(rows) -> set[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out, sums = set(), {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves = sum(sums[c][0] for c in children[p]) or 1
        saved = sum(sums[c][1] for c in children[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode().split()) if p else 0)
        sums[p] = leaves, saved
        out.add((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves, saved,
                 sha(",".join(str(c) for c in sorted(nodes[p]) if len(built[c]) == len(p)))))
    return out


def _trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int, part int")
    nodes, ends = prefix_trie.conversation_trie(df, 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    got = nodes.join(prefix_trie.list_digests(ends), ["depth", "x1", "x2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha(""))))
    return [tuple(r) for r in got.collect()]


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    rnd = random.Random(8)
    rows = []
    for c in [*range(0, 70), 400, 415, -5, -40, -41]:
        for turn in range(rnd.randrange(0, 6)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "one two three", "x y"])))
    rows += [(c, 0, "user", "the very same first turn") for c in range(1000, 1060)] + [(c, 1, "assistant", "yes") for c in range(1000, 1060)]
    long_role = "r" * 40
    rows += [(500, i, "user", f"turn {i % 7} words") for i in range(40)]                     # a long chain
    rows += [(600, None, None, None), (600, None, "a", "b"), (600, None, "a", "b"), (600, 1, long_role + "b", "t"), (600, 1, long_role + "a", "z"),
             (600, 1, long_role, "q"), (601, 0, "", ""), (None, 0, "user", "lost"), (None, None, None, None), (602, 0, "user", "w " * 5000),
             (603, 5, "user", "hi"), (603, 5, "user", "hi"), (603, None, "user", "hi")]
    got = _trie(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert _trie(spark, []) == [] and _trie(spark, [(None, 0, "user", "x")]) == []


def test_subtree_sums_of_any_tree(spark):
    rnd = random.Random(9)
    parent = {0: None, 5000: None, 6000: None}
    parent |= {i: i - 1 for i in range(1, 120)}                          # a chain
    parent |= {i: 0 for i in range(200, 260)}                            # a star
    parent |= {i: rnd.choice([5000, *range(300, i)]) if i > 300 else 5000 for i in range(300, 500)}
    value = {v: rnd.randrange(1000) for v in parent}
    want = dict.fromkeys(parent, 0)
    for v in parent:
        u = v
        while u is not None:
            want[u] += value[v]
            u = parent[u]
    tree = spark.createDataFrame([(v, p, value[v], 1) for v, p in parent.items()], "node long, parent long, a long, b long")
    got = prefix_trie.subtree_sums(tree, ["a", "b"]).collect()
    assert len(got) == len(parent) and {r.node: r.a for r in got} == want and {r.node: r.b for r in got}[5000] == 201
