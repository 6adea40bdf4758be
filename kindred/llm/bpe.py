"""Byte-level BPE encoding and decoding by recursive DuckDB queries per partition."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import tempfile
from collections.abc import Iterable
from itertools import chain, islice
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HELD_BYTES, held_by_worker, text_slices

#: Distinct words and their bytes in one recursive query (or one longer word).
QUERY_WORDS, QUERY_BYTES = 30_000, 2 << 20
HELD_CHUNKS, HELD_PIECES = 500_000, 600_000
#: ENCODE contracts one pair of a word a step; words beyond this many bytes go to ENCODE_LONG, which
#: contracts all that the next steps would contract anyway. Its steps cost more and are fewer.
LONG_WORD = 4000

ENCODE = """
WITH RECURSIVE enc(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM words
  UNION
  SELECT word, ids[:p - 1] || [merged] || ids[p + 2:] FROM (
    SELECT word, (best >> 32)::INT AS merged, best & 4294967295 AS p FROM (
      SELECT word, min(merged::BIGINT << 32 | pos) AS best
      FROM (SELECT word, unnest(ids) AS tok, unnest(ids[2:]) AS nxt, generate_subscripts(ids, 1) AS pos FROM enc)
      JOIN merges ON tok::BIGINT << 32 | nxt = pair GROUP BY word)
  ) JOIN enc USING (word)
)
SELECT word, ids, array_to_string(ids, ' ') AS line FROM enc ORDER BY word
"""
# A step contracts every place of the least rank, from the left and without overlaps: as long as no pair with
# a contracted token has a lesser rank, one leftmost contraction after the other would do just that.
# Where such a pair exists, only the leftmost place is contracted.
ENCODE_LONG = """
WITH RECURSIVE enc(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM words
  UNION
  SELECT word, list(CASE WHEN hit THEN best ELSE tok END ORDER BY pos) FILTER (NOT gone) FROM (
    SELECT word, pos, tok, best, hit, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM (
      SELECT word, pos, tok, best, fit AND (pos = first OR NOT bool_or(fit AND least(l.merged, r.merged, m.merged) < best) OVER (PARTITION BY word)) AS hit
      FROM (
        SELECT *, least_one AND row_number() OVER (PARTITION BY word, least_one, pos - nth ORDER BY pos) % 2 = 1 AS fit,
               min(CASE WHEN least_one THEN pos END) OVER (PARTITION BY word) AS first
        FROM (
          SELECT *, row_number() OVER (PARTITION BY word, least_one ORDER BY pos) AS nth FROM (
            SELECT *, coalesce(merged = best, false) AS least_one FROM (
              SELECT word, pos, tok, merged, min(merged) OVER (PARTITION BY word) AS best,
                     lag(tok) OVER (PARTITION BY word ORDER BY pos) AS before, lead(nxt) OVER (PARTITION BY word ORDER BY pos) AS after
              FROM (SELECT word, unnest(ids) AS tok, unnest(ids[2:]) AS nxt, generate_subscripts(ids, 1) AS pos FROM enc)
              LEFT JOIN merges ON tok::BIGINT << 32 | nxt = pair
            ) WHERE best IS NOT NULL)))
      LEFT JOIN merges l ON fit AND before::BIGINT << 32 | best = l.pair
      LEFT JOIN merges r ON fit AND best::BIGINT << 32 | after = r.pair
      LEFT JOIN merges m ON fit AND best::BIGINT << 32 | best = m.pair
    )) GROUP BY word
)
SELECT word, ids, array_to_string(ids, ' ') AS line FROM enc ORDER BY word
"""
DECODE = """
SELECT word, array_to_string(list(hex ORDER BY pos), '') AS hex
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded) JOIN vocabulary USING (id)
GROUP BY word ORDER BY word
"""
WHITE_THEN_SPACE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) rows of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return [(base64.b64decode(t), int(r)) for t, r in (line.split() for line in f if line.strip())]


class _Places(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Bpe:
    """A vocabulary of ranks as DuckDB tables, and the words that were encoded with it."""

    def __init__(self, ranks: tuple[tuple[bytes, int], ...], pattern: str):
        import duckdb
        import regex
        self.ranks, self.split = dict(ranks), regex.compile(pattern).findall
        rows = []
        for token, merged in self.ranks.items():
            for k in range(1, len(token)):
                l, r = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if l is not None and r is not None:
                    rows.append((l, r, merged))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.spill = tempfile.TemporaryDirectory(prefix="bpe-")  # the worker's own; goes with it
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": self.spill.name})
        self._table("merges", {"pair": pa.array([l << 32 | r for l, r, _ in rows], pa.int64()),
                               "merged": pa.array([m for *_, m in rows], pa.int32())})
        self._table("vocabulary", {"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.letters_go_together = self.split(" " + ascii_letters) == [" " + ascii_letters]
        #: Of chunks, without their leading space, the place in two lists: ids as text, and what these stand for. Of pieces both.
        self.place = _Places()
        self.lines: list[str] = []
        self.bytes: list[bytes] = []
        self.pieces: dict[bytes, tuple[str, bytes]] = {}
        self.chunk_bytes = self.piece_bytes = 0

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _encoded(self, words: list[bytes]):
        """Parts of the words, as (their places, ids, ids as text) in Arrow arrays; empty words are left out."""
        for query, some in ((ENCODE, [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]),
                            (ENCODE_LONG, [i for i, w in enumerate(words) if len(w) > LONG_WORD])):
            sizes = np.array([len(words[i]) for i in some], np.int64)
            ends, lo = np.cumsum(sizes), 0
            while lo < len(some):
                hi = int(np.searchsorted(ends, ends[lo] - sizes[lo] + QUERY_BYTES, "right"))
                hi = max(lo + 1, min(hi, lo + QUERY_WORDS))
                part, n, lo = some[lo:hi], sizes[lo:hi], hi
                flat = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(self.byte_ids[flat]))
                self._table("words", {"word": pa.array(np.arange(len(part), dtype=np.int32)), "ids": own})
                found = self.db.sql(query).to_arrow_table()
                yield part, found.column("ids").combine_chunks(), found.column("line")

    def _decoded(self, ids) -> list[bytes]:
        """The bytes that each of some lists of ids stands for, none empty, by ordered aggregation."""
        self._table("encoded", {"word": pa.array(np.arange(len(ids), dtype=np.int32)), "ids": ids})
        return list(map(bytes.fromhex, self.db.sql(DECODE).to_arrow_table().column("hex").to_pylist()))

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: its leftmost pair of least rank is contracted until none is left."""
        out: list[list[int]] = [[]] * len(words)
        for part, ids, _ in self._encoded(words):
            for i, x in zip(part, ids.to_pylist()):
                out[i] = x
        return out

    def round_trip_words(self, words: list[bytes]):
        """(word, ids as text, decoded bytes) of each word that is not empty."""
        for part, ids, lines in self._encoded(words):
            yield from zip([words[i] for i in part], lines.to_pylist(), self._decoded(ids))

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The chunk before the first cut, and the others without their leading space.

        The pattern's matches never span a cut: it lets a match begin at any space after a
        non-white character, as that space can only start a match there.
        """
        if WHITE_THEN_SPACE.search(text):
            first, *rest = CUT.split(text)
            return first, [c[1:] for c in rest]
        first, *rest = text.split(" ")
        return first, rest

    def _learn(self, chunks: Iterable[str], lead: str) -> list[tuple[str, str, bytes]]:
        """(chunk, ids as text, decoded bytes) of chunks with ``lead`` before them."""
        chunks = list(chunks)
        gc.disable()  # very many lists and tuples at once, none of them in a cycle
        try:
            plain = lead == " " and self.letters_go_together
            pieces = [[(lead + c).encode()] if plain and c.isascii() and c.isalpha() else [p.encode("utf-8", "surrogatepass") for p in self.split(lead + c)] for c in chunks]
            if len(self.pieces) > HELD_PIECES or self.piece_bytes > HELD_BYTES:
                self.pieces.clear()
                self.piece_bytes = 0
            known = self.pieces
            for word, line, raw in self.round_trip_words(list(set(chain.from_iterable(pieces)).difference(known))):
                known[word] = line, raw
                self.piece_bytes += len(word) + len(line) + len(raw)
            return [(c, *known[ps[0]]) if len(ps) == 1 else (c, " ".join([known[p][0] for p in ps]), b"".join([known[p][1] for p in ps]))
                    for c, ps in zip(chunks, pieces)]
        finally:
            gc.enable()

    def run(self, texts: list[str]):
        """(n_tokens, ids line, decoded bytes) of each text."""
        cut = [self.cut(t) for t in texts]
        firsts = {c: x for c, *x in self._learn({f for f, _ in cut if f}, "")} | {"": ["", b""]}
        if len(self.place) > HELD_CHUNKS or self.chunk_bytes > HELD_BYTES:
            self.place, self.lines, self.bytes, self.chunk_bytes = _Places(), [], [], 0
        place_of, known = self.place.__getitem__, len(self.lines)
        places = [list(map(place_of, rest)) for _, rest in cut]
        for chunk, line, raw in self._learn(islice(self.place, known, None), " "):
            self.chunk_bytes += len(chunk) + len(line) + len(raw)
            self.lines.append(line)
            self.bytes.append(raw)
        line_of, raw_of = self.lines.__getitem__, self.bytes.__getitem__
        for (first, rest), at in zip(cut, places):
            line, head = " ".join(map(line_of, at)), firsts[first]
            if first:
                line = f"{head[0]} {line}" if rest else head[0]
            yield (line.count(" ") + 1 if line else 0), line, head[1] + b"".join(map(raw_of, at))


@held_by_worker
def _bpe(ranks, pattern) -> Bpe:
    return Bpe(ranks, pattern)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    Each match of ``pattern`` is encoded separately by the ranks, without special tokens, as the
    library tiktoken would, and the ids are decoded again. Distinct words are encoded
    once for some megabytes of text: their token-position rows join the merge table in a
    recursive DuckDB query that contracts each word's leftmost pair of least rank until none is
    left; decoding is an ordered aggregation over the ids. Words of more than LONG_WORD bytes
    contract all places of the least rank in one step of such a query, which comes to the same. Null texts
    count as empty; repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
    """
    ranks = tuple(read_ranks(rank_file))

    def run(batches):
        bpe = _bpe(ranks, pattern)
        for b in text_slices(batches, _bpe):
            rows = [(k, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
                    for k, line, raw in bpe.run([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
