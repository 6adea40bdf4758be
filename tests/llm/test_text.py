import base64
import hashlib
import random
import zlib
from functools import lru_cache

import brute
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kindred.llm import bpe, packing, token_counts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
JSON = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
WHOLE = Tokenizer.from_str(JSON)
MIXED = st.text(alphabet="aébß ЖX北'’.,!_-\n\t\u00a0 \U0001F600\u0301²½1\u0663", max_size=40)


@lru_cache
def own_bpe():
    return bpe.Bpe(tuple(RANKS.items()), P.PATTERN)


@lru_cache
def own_tokenizer():
    return packing.ByteLevelTokenizer(JSON)


def ids_bytes(text):
    return np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_edges(spark, edge_rows, edge_docs, no_docs):
    op = lambda d: bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for i, t, *_ in edge_rows:
        ids, raw = TIKTOKEN.encode_ordinary(t or ""), (t or "").encode()
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert sorted(map(tuple, op(edge_docs).collect()), key=str) == sorted(want, key=str)
    assert op(no_docs).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(MIXED, max_size=8))
def test_bpe_mixed(texts):
    for t, (n, line, raw) in zip(texts, own_bpe().run(texts)):
        ids = TIKTOKEN.encode_ordinary(t)
        assert (n, line, raw) == (len(ids), " ".join(map(str, ids)), t.encode())


@pytest.mark.parametrize("long", [4000, 100])
def test_long_words(monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG_WORD", long)
    b = own_bpe()
    r = random.Random(1)
    words = ["".join(r.choices("abcdeé", k=k)).encode() for k in (1, 99, 100, 101, 399, 3000)] + [b"ab" * 900, b"x" * 100_000]
    words += ["".join(r.choices("etaoin shrdlu", k=r.randrange(101, 300))).encode() for _ in range(300)]
    assert b.encode_words(words) == [TIKTOKEN._encode_single_piece(w) for w in words]


def test_long_words_of_odd_ranks(monkeypatch):
    """Ranks in no order of merging: contracted tokens make pairs of lesser rank, so places must be taken one by one."""
    monkeypatch.setattr(bpe, "LONG_WORD", 100)
    r = random.Random(4)
    for _ in range(60):
        longer = sorted({bytes(r.choices(b"ab", k=r.randrange(2, 6))) for _ in range(14)})
        r.shuffle(longer)
        ranks = {t: k for k, t in enumerate([bytes([i]) for i in range(256)] + longer)}
        odd = bpe.Bpe(tuple(ranks.items()), P.PATTERN)
        words = [bytes(r.choices(b"abc", [5, 5, 1], k=r.randrange(101, 140))) for _ in range(6)]
        assert odd.encode_words(words) == [leftmost_least(w, ranks) for w in words]


def leftmost_least(word, ranks):
    parts = [bytes([x]) for x in word]
    while True:
        found = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        parts[found[1]:found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_chunked_ids(text):
    assert own_tokenizer().encode(text) == ids_bytes(text)


def check_packing(rows, df, capacity):
    got = [r.asDict() for r in df.collect()]
    want = []
    for i, t in rows:
        ids = ids_bytes(t or "") + bytes(4)
        n = len(ids) // 4
        head = n % capacity or capacity
        cuts = [0, *range(min(head, n), n + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got], key=str) == sorted(want, key=str)
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(g["length"] for g in got) / capacity


def test_packing_edges(spark, edge_rows, edge_docs, no_docs):
    for capacity in (2048, 16):
        check_packing([r[:2] for r in edge_rows], packing.pack_documents(edge_docs, P.path("byte_bpe_50k.json"), capacity), capacity)
    assert packing.pack_documents(no_docs, P.path("byte_bpe_50k.json")).count() == 0


def test_packing_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 40)  # several levels of groups
    r = random.Random(2)
    rows = [(i, "a " * r.randrange(1, 900)) for i in range(400)]
    bins, least = check_packing(rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"), 1024), 1024)
    assert bins <= 1.1 * least + 1  # groups of 40 can't pack as tightly as whole ones


def test_groups_pack_tightly():
    sizes = np.sort(np.random.default_rng(3).integers(1, 2048, 30_000))[::-1]
    bins, _ = packing.sum_of_squares(sizes, 2048, any_fit=True)
    assert bins.max() + 1 <= 1.005 * sizes.sum() / 2048


def test_sum_of_squares_takes_the_least():
    r = np.random.default_rng(0)
    sizes, capacity = r.integers(1, 30, 300), 31
    bins, offsets = packing.sum_of_squares(sizes, capacity)
    fill, n = {}, np.zeros(capacity + 1, int)
    for s, b, o in zip(sizes, bins, offsets):
        def after(gap):  # gap: of the bin taken, capacity for a new one
            m = n.copy()
            if gap < capacity:
                m[gap] -= 1
            if gap > s:
                m[gap - s] += 1
            return int((m[1:capacity] ** 2).sum())
        gap = capacity - fill.get(b, 0)
        assert o == fill.get(b, 0) and gap >= s
        options = [after(g) for g in range(s, capacity) if n[g]] + [after(capacity)]
        assert after(gap) == min(options)
        if gap < capacity:
            n[gap] -= 1
        if gap > s:
            n[gap - s] += 1
        fill[b] = fill.get(b, 0) + s


def plain_counts(rows):
    first, rest = map(set, token_counts.piece_sets(P.path("byte_bpe_50k.tiktoken")))
    longest, known, out = max(map(len, first | rest)), {}, []
    for i, t in rows:
        words = (t or "").encode().split()
        n = [known[w] if w in known else known.setdefault(w, brute.greedy_pieces(b" " + w, first, rest, longest)) for w in words]
        out.append((i, len(words), sum(n), 0))
    return sorted(out, key=str)


def test_counts_edges(spark, edge_rows, edge_docs, no_docs):
    op = lambda d: sorted(map(tuple, token_counts.count_tokens(d, P.path("byte_bpe_50k.tiktoken")).collect()), key=str)
    assert op(edge_docs) == plain_counts([r[:2] for r in edge_rows]) and op(no_docs) == []
    rows = [(1, "한국어 русский ж 北京大学 ไทย — \0abc \x01\x7f 😀"), (2, "语" * 5000), (3, "q" * 1500 + " " + "Ж" * 1500)]
    got = op(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == plain_counts(rows) and got[1][2] > 5000


PIECES = st.sets(st.text(alphabet="abc", min_size=1, max_size=5).map(str.encode), max_size=14)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES, st.text(alphabet="abc", min_size=1, max_size=14).map(str.encode))
def test_automaton_is_greedy(first, rest, word):
    assert token_counts.LongestMatch(tuple(first), tuple(rest)).count(word) == brute.greedy_pieces(word, first, rest)


def test_workers_hold_one_operator():
    from kindred.llm import shared
    made = []
    one, two = (shared.held_by_worker(lambda k=k: made.append(k) or k) for k in (1, 2))
    one(), two(), one(), list(shared.text_slices([], one)), one(), two()
    assert made == [1, 2, 2]
    del shared.HELD[-2:]
