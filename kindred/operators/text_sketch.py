"""128-bit SimHash of a text's words, folded within each row: nothing is exploded or shuffled."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[a-z]+")
#: Bytes of words and digests that a task holds, about, with what Python adds to each.
HELD_BYTES, ENTRY_BYTES = 32 << 20, 200


class _Digests(dict):
    held = 0

    def __missing__(self, word: str) -> bytes:
        if self.held >= HELD_BYTES:
            self.clear()
            self.held = 0
        self[word] = d = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        self.held += len(word) + ENTRY_BYTES
        return d


def majority(digests: list[bytes]) -> bytes:
    """A bit is 1 if set in over half of the digests of 16 bytes."""
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    votes = np.zeros(128, np.int64)
    for k in range(0, len(rows), 255):  # counts fit a byte
        votes += np.unpackbits(rows[k:k + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(rows)).tobytes()


def word_sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, b0..b3): per bit the majority of the md5 of the distinct words ``[a-z]+`` of the lower-cased text.

    Block k is the k-th 32 bits of the digest. Texts without words have no sketch.
    """
    def run(batches):
        of = _Digests()
        for b in batches:
            on, out = [], bytearray()
            for t in b.column(1):  # a text's words go before the next one's come
                words = {m.group() for m in WORD.finditer(t.as_py() or "")}
                on.append(bool(words))
                if words:
                    out += majority([of[x] for x in words])
            blocks = np.frombuffer(bytes(out), ">u4").astype(np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(on, pa.bool_())), *(pa.array(c) for c in np.ascontiguousarray(blocks.T))],
                                             names=[key, "b0", "b1", "b2", "b3"])

    rows = df.select(key, F.lower(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, b0 bigint, b1 bigint, b2 bigint, b3 bigint")
