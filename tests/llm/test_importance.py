import hashlib
import math
import re
import zlib

import pytest

from kindred.llm import importance


def brute_draw(docs, target, order, buckets=50, percent=30, least=3):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return w, [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, count in ((docs, s), (target, t)):
        for _, text in texts:
            for g in grams(text)[1]:
                count[at(g)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, text in docs:
        w, g = grams(text)
        weight = sum(gain[at(x)] for x in g) // len(g) if g else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(g), weight, score, None, len(w)])
    may = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(may[:percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_draw(spark, edge_rows, edge_docs, no_docs, order):
    target = spark.createDataFrame([("b", "one two words", 1), (None, None, 2), ("c", "WORD É x7 w3", 3)], "item_id string, text string, pos int")
    named = [(None, "one two words"), (None, None), (None, "WORD É x7 w3")]
    options = {"order": order, "buckets": 50, "percent": 30, "least_words": 3}
    got = importance.draw(edge_docs, target, **options).collect()
    docs = [(r[0], r[1]) for r in edge_rows]
    assert sorted(map(tuple, got), key=str) == brute_draw(docs, named, order)
    assert importance.draw(no_docs, target, **options).count() == 0
    none = importance.draw(edge_docs, target.limit(0), **options).collect()
    assert sorted(map(tuple, none), key=str) == brute_draw(docs, [], order)
