"""Plain versions of the operators, for small inputs."""

import hashlib

import numpy as np
import xxhash


def least_reachable(n, links, ids):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b, key=lambda i: ids[i])] = min(a, b, key=lambda i: ids[i])
    return [ids[find(i)] for i in range(n)]


def simhash(text, size=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def without_repeats(rows, window=20):
    """Rows are documents in the order of id and text; where texts of one id differ the operator's order is any, by hash."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = -(2**63)
    order = {}
    for k, (i, t) in enumerate(rows):
        order[k] = (low if i is None else i, *text_order(t), k)
    first = {}
    for k, (i, w) in enumerate(words):
        for s in range(len(w) - window + 1):
            g = tuple(w[s:s + window])
            first[g] = min(first.get(g, (order[k], s)), (order[k], s))
    out = []
    for k, (i, w) in enumerate(words):
        keep = np.ones(len(w), bool)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (order[k], s):
                keep[s:s + window] = False
        out.append((i, len(w), int((~keep).sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest()))
    return out


def text_order(text):
    """Texts of one id come in the order of Spark's xxhash64 (seed 42; after a literal 1 for the second)."""
    if text is None:
        return (42, 42)
    signed = lambda h: h - 2**64 if h >> 63 else h
    raw = text.encode()
    one = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    return signed(xxhash.xxh64_intdigest(raw, 42)), signed(xxhash.xxh64_intdigest(raw, one))


def greedy_pieces(word, first, rest, longest=200):
    """No piece is longer than ``longest`` bytes."""
    n, at = 0, 0
    while at < len(word):
        known = first if at == 0 else rest
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n
