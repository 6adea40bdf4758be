"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HELD_BYTES, held_by_worker, text_slices

HELD_WORDS = 400_000


def piece_sets(rank_file: str) -> tuple[tuple[bytes, ...], tuple[bytes, ...]]:
    """Pieces that begin a word, with the space before it, and pieces that go on, from a file of base64 tokens and ranks.

    The lone space is one of the former, so that every word can be cut if all single bytes are tokens.
    """
    with open(rank_file, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return tuple(t for t in tokens if t[:1] == b" "), tuple(t for t in tokens if t[:1] != b" ")


class LongestMatch:
    """Counts the pieces of greedy longest-match-first segmentation in one pass over a word.

    Nodes form a trie with two roots, 0 for the begin of a word and 1 for its rest. Where no
    edge goes on, a failure link leads to the node of what is left after the longest matches are
    taken off, and ``popped`` says how many pieces those were; nothing is ever read twice and no
    piece is built. Both are fixed breadth first when the vocabulary is read.
    """

    def __init__(self, first: tuple[bytes, ...], rest: tuple[bytes, ...]):
        edges: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                u = root
                for c in piece:
                    if c not in edges[u]:
                        edges[u][c] = len(edges)
                        edges.append({})
                        ends.append(False)
                    u = edges[u][c]
                ends[u] = u > 1
        fail, popped = [-1] * len(edges), [0] * len(edges)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for c, v in edges[u].items():
                queue.append(v)
                if ends[v]:
                    fail[v], popped[v] = 1, 1
                    continue
                z, taken = fail[u], popped[u]
                while z >= 0 and c not in edges[z]:
                    taken += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = edges[z][c], taken
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: bytes) -> int:
        """Number of pieces; -1 if the word can't be cut into pieces."""
        edges, fail, popped = self.edges, self.fail, self.popped
        u = n = 0
        for c in word:
            while c not in edges[u]:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return -1
            u = edges[u][c]
        while u > 1:
            n += popped[u]
            u = fail[u]
        return n if u == 1 else -1


@held_by_worker
def _automaton(first, rest):
    return LongestMatch(first, rest)


def count_tokens(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``; each is cut, with one space before it, greedily, longest piece
    first, by the bytes of its UTF-8. Where no piece joins the space and the word's begin, the space
    is a piece of its own, so a vocabulary with all single bytes cuts every word. A word that a
    poorer one can't cut is one unknown token, counted in both n_tokens and n_unknown. Null and empty
    texts count zero; repeated rows are counted each; words of any length take one pass; an empty table
    gives no rows; other columns are ignored. Words recur, so counts of seen words are held (up to HELD_WORDS and HELD_BYTES) in a task.
    """
    first, rest = piece_sets(rank_file)

    def run(batches):
        count, held, size = _automaton(first, rest).count, {}, 0
        for b in text_slices(batches, _automaton):
            rows = []
            for text in b.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                tokens = unknown = 0
                for w in words:
                    n = held.get(w)
                    if n is None:
                        n = count(b" " + w)
                        if len(held) >= HELD_WORDS or size > HELD_BYTES:
                            held.clear()
                            size = 0
                        held[w] = n
                        size += len(w)
                    if n < 0:
                        unknown += 1
                    else:
                        tokens += n
                rows.append((len(words), tokens + unknown, unknown))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)],
                                             names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
