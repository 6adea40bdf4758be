"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, held_by_worker, small_batches, text_slices

CAPACITY = 2048
#: Items that one task packs; sequences with at least LOOSE tokens free are packed again together.
GROUP_ITEMS = 100_000
LOOSE = 32
HELD_CHUNKS = 800_000
WHITE_THEN_SPACE = re.compile(r"\s ")
#: ASCII marks that are neither letters, numbers nor white, and no apostrophe.
PUNCTUATION = ".,;:!?|#$%&*()[]{}<>\"/\\=+_~^@`-"
CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else "" for b in range(256)]
    rest = iter(map(chr, range(256, 512)))
    return [c or next(rest) for c in own]


class _Held(dict):
    """Chunk without its leading space to the ids of the chunk with it; emptied when large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        out = self.make(" " + chunk)
        if len(self) >= HELD_CHUNKS:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = out
        return out


class ByteLevelTokenizer:
    """Ids, as little-endian unsigned 32-bit bytes, of a byte-level BPE file of the library tokenizers.

    Its pre-tokenizer never joins what stands before and after a space that follows a
    non-white character, so texts are cut there and equal chunks are encoded once. A chunk of
    letters, with punctuation after them or not, is known to be one or two pieces; others go
    through the pre-tokenizer, and texts with a string of an added token to the library whole.
    """

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(json_text)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.letters = byte_letters()
        self.rest, self.tails = _Held(self._chunk), {"": b""}
        if self.whole.pre_tokenizer.pre_tokenize_str("é x")[0][0] != self.letters[0xC3] + self.letters[0xA9]:
            raise ValueError("not a byte-level tokenizer")

    def _piece(self, mapped: str) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in self.whole.model.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(PUNCTUATION)
        if word[:1] == " " and word[1:].isalpha():
            tail = chunk[len(word):]
            end = self.tails.get(tail)
            if end is None:
                end = self._plain(tail)
                if len(tail) < 8:
                    self.tails[tail] = end
            if tail:
                return self.rest[word[1:]] + end
            letters = self.letters
            return self._piece(letters[32] + word[1:] if word.isascii() else "".join([letters[c] for c in word.encode()]))
        return self._plain(chunk)

    def _plain(self, chunk: str) -> bytes:
        return b"".join([self._piece(p) for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(chunk)])

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if WHITE_THEN_SPACE.search(text):
            first, *rest = CUT.split(text)
            rest = [c[1:] for c in rest]
        else:
            first, *rest = text.split(" ")
        return (self._plain(first) if first else b"") + b"".join(map(self.rest.__getitem__, rest))


@held_by_worker
def _tokenizer(json_text: str) -> ByteLevelTokenizer:
    return ByteLevelTokenizer(json_text)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, in pieces.

    Documents longer than ``capacity`` are cut from the end, so only the first piece may be
    shorter. Null text counts as empty.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text_of_file = f.read()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        t = _tokenizer(text_of_file)
        for b in text_slices(batches, _tokenizer):
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = t.encode(text.as_py() or "") + end
                n = len(ids) // 4
                head = n % capacity or min(n, capacity)
                cuts = [0, *range(head, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    out.append((i, k, lo, hi - lo, zlib.crc32(ids[4 * lo:4 * hi])))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int, any_fit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the given order.

    With N(g) open bins of free room g, an item goes where the sum of N(g)^2 over all g in
    1..capacity-1 becomes smallest; the tightest such bin on ties, a new bin last. With
    ``any_fit`` a new bin is opened only if the item fits no open one.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        have = n[size:capacity]
        # of g, halved and less 1: (N(g - s) + 1)^2 - N(g - s)^2 + (N(g) - 1)^2 - N(g)^2; a filled bin counts no more
        change = n[:capacity - size] - have
        change[have == 0] = never
        gap = capacity
        if len(change):
            k = int(change.argmin())
            if change[k] != never and (any_fit or 2 * change[k] + (1 if k == 0 else 2) <= 2 * n[capacity - size] + 1):
                gap = k + size
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = open_bins[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = at, capacity - gap
        gap -= size
        if gap:
            open_bins[gap].append(at)
            n[gap] += 1
    return bins, offsets


def _pack(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """items(item, size) with bin (unique) and at, its place there; each group packs on its own.

    The rule is run over the items longest first, where open bins go first, and in hash order,
    where the rule alone decides; the packing of fewer bins is taken.
    """
    def run(table):
        size, item, mix = (table.column(c).to_numpy() for c in ("size", "item", "mix"))
        tries = []
        for order, any_fit in ((np.lexsort((item, -size)), True), (np.lexsort((item, mix)), False)):
            tries.append((order, *sum_of_squares(size[order], capacity, any_fit)))
        order, bins, at = min(tries, key=lambda t: t[1].max())
        own = table.column("g")[0].as_py()
        return pa.table({"item": item[order], "size": size[order], "bin": bins * groups + own, "at": at})

    mixed = items.select("item", "size", F.xxhash64("item").alias("mix"))
    return mixed.withColumn("g", F.pmod("mix", F.lit(groups)).cast("int")).groupBy("g").applyInArrow(
        run, "item long, size long, bin long, at long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all pieces, packed.

    Pieces of full length are sequences of their own. The others are dealt by hash into groups
    of about GROUP_ITEMS and packed there by the sum-of-squares rule; what has
    LOOSE tokens free or more is packed again as one item in fewer, wider groups, until one group
    holds the rest or nothing joins any more. Offsets add up over the levels.

    Null text counts as empty and gives the end id alone; repeated rows and ids are packed like
    others; null ids stay null; texts of any length are cut into pieces, none left out; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    with small_batches(docs.sparkSession):
        pieces = checkpointed(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn(
            "item", F.monotonically_increasing_id()))
    todo = pieces.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
    count = todo.count()
    placed, free = None, 0  # ids of bins are kept apart by level
    for level in count_from(0):  # every level has fewer items than the one before
        groups = max(1, -(-count // GROUP_ITEMS))
        packed = checkpointed(_pack(todo, groups, capacity)) if count else _pack(todo, groups, capacity)
        packed = packed.select("item", "size", (F.col("bin") * 64 + level).alias("bin"), "at")
        if placed is None:
            placed = packed.select("item", "bin", "at")
        else:
            up = packed.select(F.col("item").alias("bin"), F.col("bin").alias("bin2"), F.col("at").alias("at2"))
            placed = placed.join(up, "bin", "left").select(
                "item", F.coalesce("bin2", "bin").alias("bin"), (F.col("at") + F.coalesce("at2", F.lit(0))).alias("at"))
        if groups == 1:
            break
        loose = packed.groupBy("bin").agg(F.sum("size").alias("size")).where(F.col("size") <= capacity - LOOSE)
        todo, before = loose.select(F.col("bin").alias("item"), "size"), count
        count = todo.count()
        if not count or count >= before:
            break
    # a level packs a fraction of the one before, so 63 are never reached and 64 * item + 63 is no bin's id
    return pieces.join(placed, "item", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("bin", F.col("item") * 64 + 63).alias("sequence_id"), F.coalesce("at", F.lit(0)).cast("long").alias("offset"))
