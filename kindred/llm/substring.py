"""Substring dedup: repeated word sequences by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import groups_for, repeated, twins
from .shared import HELD_BYTES, NO_ID, Sieve, checkpointed, small_batches, text_slices, written

WINDOW = 20
GRAM = 5
#: Words that a map task holds before it deals out their suffixes.
HELD_WORDS = 500_000
HELD_VOCABULARY = 150_000
#: Bytes of suffixes, each cut at the window, that one group is to get; a prefix with more is lengthened.
GROUP_BYTES = 32 << 20
#: Prefixes are counted in so many buckets at most.
MOST_BUCKETS = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A row's name: its id, and two hashes of its text, so that rows that share or lack an id stay apart.
NAME = ["doc", "k1", "k2"]
NAME_SCHEMA = "doc long, k1 long, k2 long"
TREE, SPAN = 0, 1


class _Hashes(dict):
    """Word to signed 64-bit hash; emptied when large."""
    held = 0

    def __missing__(self, word):
        if len(self) > HELD_VOCABULARY or self.held > HELD_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word)
        h = xxhash.xxh64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * ODD
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sequence_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position, by doubling."""
    parts, at, width = None, 0, 1
    while length:
        if length & 1:
            piece = h[at:]
            if parts is None:
                parts = piece
            else:
                m = min(len(parts), len(piece))
                parts = _join(parts[:m], piece[:m])
            at += width
        length >>= 1
        if length:
            h = _join(h[:-width], h[width:]) if len(h) > width else h[:0]
            width *= 2
    return parts


def _runs(start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of consecutive starts that agree in all of ``same``."""
    new = np.ones(len(start), bool)
    if len(start):
        new[1:] = start[1:] != start[:-1] + 1
        for s in same:
            new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(start))


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _name_columns(id_col: str, text_col: str) -> dict:
    text = F.col(text_col).cast("string")
    return {"doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def _candidates(rows: DataFrame, window: int) -> DataFrame:
    """(doc, k1, k2, spans): where windows stand whose hash occurs again, as starts and stops in words.

    A suffix whose first ``window`` words occur once lies below no deep node, so only the others
    need their words compared.
    """
    def hashed(b: pa.RecordBatch):
        for part in text_slices([b]):
            names, hashes = [], []
            for name, t in zip(zip(*(part.column(k).to_pylist() for k in range(3))), part.column(3)):
                w = _split(t.as_py())
                if len(w) >= window:
                    names.append(name)
                    hashes.append(np.fromiter(map(seen.__getitem__, w), np.int64, len(w)))
            if hashes:
                digest, at = _sequence_hash(np.concatenate(hashes).view(np.uint64), window), 0
                for name, h in zip(names, hashes):
                    yield name, digest[at:at + len(h) - window + 1]
                    at += len(h)

    def finish(meta, row, place, _):
        first, n = _runs(place, row)
        own, cut = np.unique(row[first], return_index=True)
        spans = np.column_stack([place[first], place[first] + n - 1 + window]).astype(np.int64)
        return pa.table([*(pa.array(meta[own, k], pa.int64()) for k in range(3)),
                         pa.array([x.tobytes() for x in np.split(spans, cut[1:])] if len(own) else [], pa.binary())], names=[*NAME, "spans"])

    seen = _Hashes()
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeated(rows.select(*NAME, "text"), hashed, finish, NAME_SCHEMA + ", spans binary", groups_for(words // 6), order=NAME)
    return checkpointed(found.dropDuplicates(NAME))


def _words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, k1, k2, start, n, words): the words that the spans of each row cover."""
    sieve = Sieve(spans, "k1")

    def sift(batches):
        for b in text_slices(batches):
            yield b.filter(pa.array(sieve(b.column(1).to_numpy())))

    def cut(batches):
        for b in text_slices(batches):
            at, start, words = [], [], []
            for i, (t, s) in enumerate(zip(b.column(3), b.column(4))):
                w = _split(t.as_py())
                for lo, hi in np.frombuffer(s.as_py(), np.int64).reshape(-1, 2).tolist():
                    at.append(i)
                    start.append(lo)
                    words.append(w[lo:hi])
            part = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(start, pa.int64()), pa.array(list(map(len, words)), pa.int64()),
                 pa.array(list(map(b" ".join, words)), pa.binary())], names=[*NAME, "start", "n", "words"])

    rows = rows.select(*NAME, "text").mapInArrow(sift, NAME_SCHEMA + ", text string")
    return rows.join(spans, NAME).select(*NAME, "text", "spans").mapInArrow(cut, NAME_SCHEMA + ", start long, n long, words binary")


class _Suffixes:
    """All suffixes of some rows of words that have ``window`` words or more: where they begin, hash, prefix and bytes."""

    def __init__(self, words: list[list[bytes]], known: _Hashes, window: int):
        self.words = [x for w in words for x in w]
        sizes = np.array([len(w) for w in words])
        h = np.fromiter(map(known.__getitem__, self.words), np.int64, len(self.words)).view(np.uint64)
        digest = _sequence_hash(h, window)
        row = np.repeat(np.arange(len(sizes)), sizes)[:len(digest)]
        inner = np.arange(len(digest)) - (np.cumsum(sizes) - sizes)[row]
        whole = inner + window <= sizes[row]
        prefix, left, width = _sequence_hash(h, GRAM), window - GRAM + 1, 1
        while width < left:  # the prefix ends with the least of the grams that begin within the window
            step = min(width, left - width)
            prefix = np.minimum(prefix[:-step], prefix[step:])
            width += step
        self.ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)])
        self.place = np.flatnonzero(whole)
        self.row, self.inner, self.digest = row[whole], inner[whole], digest[whole]
        self.prefix = prefix[:len(digest)][whole]
        self.size = self.ends[self.place + window] - self.ends[self.place]

    def bucket(self, buckets: int) -> np.ndarray:
        return ((self.prefix * ODD >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


class Partition(NamedTuple):
    """Groups of prefixes: of each bucket the first group and how many, over which longer prefixes are dealt."""
    first: np.ndarray
    pieces: np.ndarray
    groups: int

    @staticmethod
    def of(sizes: np.ndarray, budget: int) -> Partition:
        """Neighbouring buckets share a group up to the budget; one beyond it is a prefix to be lengthened."""
        pieces = np.maximum(1, -(-sizes // budget))
        first, group, held = np.zeros(len(sizes), np.int64), 0, 0
        for i, (size, n) in enumerate(zip(sizes.tolist(), pieces.tolist())):
            if held and held + size > budget:
                group, held = group + 1, 0
            first[i], held = group, held + size
            if n > 1:
                group, held = group + n, 0
        return Partition(first, pieces, group + 1)

    def group(self, bucket: np.ndarray, digest: np.ndarray) -> np.ndarray:
        return self.first[bucket] + (digest % self.pieces[bucket].astype(np.uint64)).astype(np.int64)


def _partition(words: DataFrame, window: int) -> Partition:
    """Suffixes are counted by prefix, in bytes; of a bounded number of buckets each gets its groups."""
    total = words.agg(F.sum(F.col("n") - (window - 1)), F.sum(F.octet_length("words"))).first()
    buckets = 64
    while buckets < MOST_BUCKETS and buckets * GROUP_BYTES < 8 * window * (total[1] or 0):
        buckets *= 2

    def count(batches):
        known = _Hashes()
        for b in text_slices(batches):
            s = _Suffixes([w.as_py().split() for w in b.column(0)], known, window)
            at, inverse = np.unique(s.bucket(buckets), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(inverse, s.size, len(at)).astype(np.int64))], names=["bucket", "size"])

    counted = words.select("words").mapInArrow(count, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size")).toArrow()
    sizes = np.zeros(buckets, np.int64)
    sizes[counted.column("bucket").to_numpy()] = counted.column("size").to_numpy()
    return Partition.of(sizes, GROUP_BYTES)


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the ``window`` words from place a are those from place b."""
    on = np.arange(len(a))
    for k in range(window):
        on = on[ids[a[on] + k] == ids[b[on] + k]]
    out = np.zeros(len(a), bool)
    out[on] = True
    return out


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


TREE_SCHEMA = "g int, kind int, " + NAME_SCHEMA + ", start long, n long, words binary"
TREE_KINDS = (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())


def _deal(rows: list[tuple], window: int, known: _Hashes, to: Partition):
    """Suffixes by group, consecutive ones of a group as one run with its words, and the spans found repeated here already."""
    rows = sorted({r[:4]: r for r in rows}.values(), key=lambda r: r[:4])
    s = _Suffixes([r[4].split() for r in rows], known, window)
    later = np.zeros(len(s.place), bool)
    at = np.flatnonzero(twins(s.digest))
    if len(at):
        at = at[np.lexsort((at, s.digest[at]))]
        d = s.digest[at]
        new = np.concatenate([[True], d[1:] != d[:-1]])
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        again = ~new & _same(_numbered(s.words), s.place[at], s.place[first], window)
        later[at[again]] = True
    at = np.flatnonzero(later)
    first, n = _runs(s.inner[at], s.row[at])
    for a, k in zip(at[first].tolist(), n.tolist()):
        i, start = int(s.row[a]), int(s.inner[a])
        yield (rows[i][1] + start) % to.groups, SPAN, *rows[i][:3], rows[i][3] + start, k - 1 + window, b""
    at = np.flatnonzero(~later)
    g = to.group(s.bucket(len(to.first)), s.digest)[at]
    first, n = _runs(s.inner[at], s.row[at], g)
    begin = s.ends[s.place[at[first]]].tolist()
    end = (s.ends[s.place[at[first]] + n - 1 + window] - 1).tolist()
    flat = b" ".join(s.words)
    for a, k, own, lo, hi in zip(at[first].tolist(), n.tolist(), g[first].tolist(), begin, end):
        i, start = int(s.row[a]), int(s.inner[a])
        yield own, TREE, *rows[i][:3], rows[i][3] + start, k, flat[lo:hi]


def suffix_names(ids: np.ndarray, length: int) -> np.ndarray:
    """Of every suffix the rank of its first ``length`` words among all, by prefix doubling: exact, no hashes."""
    def pair(a, b):
        m = min(len(a), len(b))
        return np.unique(a[:m] * (int(b.max(initial=0)) + 1) + b[:m], return_inverse=True)[1]

    parts, at, width = None, 0, 1
    while length:
        if length & 1:
            parts = ids[at:] if parts is None else pair(parts, ids[at:])
            at += width
        length >>= 1
        if length:
            ids = pair(ids, ids[width:])
            width *= 2
    return parts


def _tree(table: pa.Table, window: int) -> pa.Table:
    """Spans of one group's suffixes that have an earlier leaf below the same node of depth ``window``.

    The subtree is kept as its suffix array: suffixes ordered by the ranks of their first ``window``
    words, then by document and place. Suffixes of one rank hang below one node of that depth; the
    first is its earliest leaf, runs of later ones are the node's maximal extensions.
    """
    kind = table.column("kind").to_numpy()
    spans = table.filter(pa.array(kind == SPAN)).select([*NAME, "start", "n"])
    runs = table.filter(pa.array(kind == TREE))
    if runs.num_rows:
        n = runs.column("n").to_numpy()
        ids = _numbered(b" ".join(runs.column("words").to_pylist()).split())
        begin = np.cumsum(n + window - 1) - (n + window - 1)
        run = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        name = suffix_names(ids, window)[begin[run] + inner]
        doc, k1, k2, start = (runs.column(c).to_numpy()[run] for c in (*NAME, "start"))
        start = start + inner
        at = np.flatnonzero(twins(name))
        at = at[np.lexsort((start[at], k2[at], k1[at], doc[at], name[at]))]
        own = name[at]
        first = at[np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), np.arange(len(at)), 0))] if len(at) else at
        at = at[(doc[at] != doc[first]) | (k1[at] != k1[first]) | (k2[at] != k2[first]) | (start[at] != start[first])]
        at = at[np.lexsort((start[at], k2[at], k1[at], doc[at]))]
        head, k = _runs(start[at], doc[at], k1[at], k2[at])
        at = at[head]
        spans = pa.concat_tables([spans, pa.table([pa.array(c) for c in (doc[at], k1[at], k2[at], start[at], k - 1 + window)], names=spans.column_names)])
    return spans


def _spans(rows: DataFrame, window: int) -> DataFrame:
    """(doc, k1, k2, copies, spans): the repeated spans of each row that has any, and how many rows are equal to it."""
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} words or more")
    with small_batches(rows.sparkSession):
        return _found(rows, window)


def _found(rows: DataFrame, window: int) -> DataFrame:
    words, remove = written(_words(rows, _candidates(rows, window)), "words")
    to = _partition(words, window)

    def deal(batches):
        known, held, n = _Hashes(), [], 0
        names = [x.split()[0] for x in TREE_SCHEMA.split(", ")]

        def out():
            dealt = list(_deal(held, window, known, to))
            for lo in range(0, len(dealt), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*dealt[lo:lo + 20_000]), TREE_KINDS)], names=names)

        for b in text_slices(batches):
            for row in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 5))):
                held.append(row)
            n += sum(b.column(4).to_pylist())
            if n > HELD_WORDS:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()

    found = words.mapInArrow(deal, TREE_SCHEMA).groupBy("g").applyInArrow(
        lambda t: _tree(t, window), NAME_SCHEMA + ", start long, n long").groupBy(*NAME).agg(
        F.collect_list(F.struct("start", "n")).alias("spans"))
    # equal rows of window words or more are one span from their begin each
    copies = words.where("start = 0").groupBy(*NAME).count().where("count > 1")
    found = checkpointed(found.join(copies, NAME, "full").select(*NAME, F.coalesce("count", F.lit(1)).alias("copies"), "spans"))
    remove()
    return found


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (doc_id, k1, k2, start, stop) of words covered by a window that also starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``window`` consecutive words. Every row is a document
    of its own, named by its id and two 64-bit hashes of its text, k1 and k2; earlier means a smaller
    (id, k1, k2), or the same document and an earlier start. A null id comes first. Rows equal in id and
    text share their name and spans here; the functions below keep one of them and clear the rest.

    1. Windows whose hash occurs once drop out (repeats.repeated); nothing that repeats is missed.
    2. The others' words are taken out of the texts. A suffix, cut at ``window`` words, has a prefix of
       variable length, which ends with its least GRAM-word gram; equal suffixes have equal prefixes.
    3. Suffixes are counted by prefix, in bytes. Prefixes share a group up to GROUP_BYTES; one that has
       more is lengthened to all of the suffix's words and dealt over as many groups as it needs.
       Consecutive suffixes of a group travel as one run, so their words go once.
    4. Each group's subtree is built over the words themselves, and its deep nodes give the repeats.

    Suffixes that repeat within a map task are settled there, words compared, so that a passage
    which very many documents share sends one leaf a task. Null texts have no words; an empty table
    gives no rows; names of other columns don't matter.
    """
    found = _spans(docs.select(*(c.alias(k) for k, c in _name_columns(id_col, text_col).items()), F.col(text_col).cast("string").alias("text")), window)
    s = found.select(*NAME, F.explode("spans").alias("s"))
    return s.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "k1", "k2", "s.start", (F.col("s.start") + F.col("s.n")).alias("stop"))


def _kept(n: int, spans, window: int, equal: int) -> np.ndarray:
    """Which of n words stay; of equal rows all but one (``equal`` above 1) repeat another whole."""
    if equal > 1 and n >= window:
        return np.zeros(n, bool)
    keep = np.ones(n, bool)
    for s in spans or ():
        keep[s["start"]:s["start"] + s["n"]] = False
    return keep


def _joined(rows: DataFrame, found: DataFrame, own: list[str]) -> DataFrame:
    """rows with spans and number among rows equal in id and text, joined by the name columns ``own``."""
    found = found.select(*(F.col(a).alias(b) for a, b in zip(NAME, own)), F.col("spans").alias("__kindred_spans"), F.col("copies").alias("__kindred_copies"))
    rows = rows.join(found, own, "left")
    if found.where("__kindred_copies > 1").isEmpty():
        return rows.withColumn("__kindred_equal", F.lit(1))
    once = rows.where("coalesce(__kindred_copies, 1) = 1").withColumn("__kindred_equal", F.lit(1))
    more = rows.where("__kindred_copies > 1").withColumn(
        "__kindred_equal", F.row_number().over(Window.partitionBy(*own).orderBy("__kindred_copies")))
    return once.unionByName(more)


def digest_without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row without its repeated spans.

    See repeated_spans() for what repeats. Of rows equal in id and text one counts as the first; the
    others lose all their words if these make a window. Null and empty texts have no words; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(k) for k, c in _name_columns(id_col, text_col).items()),
                       F.col(text_col).cast("string").alias("text"))
    found = _spans(rows.select(*NAME, "text"), window)
    sieve = Sieve(found, "k1")
    digest = lambda words: hashlib.sha256(b" ".join(words)).hexdigest()
    own = lambda words: (len(words), digest(words))

    def settle(batches):
        """Rows without spans have their result; only the others' texts travel."""
        for b in text_slices(batches):
            on = sieve(b.column(2).to_numpy())
            done = [(None, None) if x else own(_split(t.as_py())) for x, t in zip(on, b.column(4))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([t.as_py() if x else None for x, t in zip(on, b.column(4))], pa.string()),
                 pa.array([n for n, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["doc_id", *NAME, "text", "n_words", "sha"])

    def run(batches):
        for b in text_slices(batches):
            n_words, n_removed, sha = [], [], []
            for t, n, done, spans, equal in zip(*(b.column(k) for k in range(1, 6))):
                if n.is_valid:
                    n_words.append(n.as_py())
                    n_removed.append(0)
                    sha.append(done.as_py())
                    continue
                words = _split(t.as_py())
                keep = _kept(len(words), spans.as_py(), window, equal.as_py())
                n_words.append(len(words))
                n_removed.append(len(words) - int(keep.sum()))
                sha.append(digest([words[i] for i in np.flatnonzero(keep).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    settled = rows.mapInArrow(settle, "doc_id long, " + NAME_SCHEMA + ", text string, n_words long, sha string")
    return _joined(settled, found, NAME).select("doc_id", "text", "n_words", "sha", "__kindred_spans", "__kindred_equal").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated spans cut out of their texts; other texts and all other columns stay.

    Cut text loses the removed words and the white space after each of them. See
    digest_without_repeats() for equal rows, nulls and empty tables. Texts without spans don't travel.
    """
    names, own = docs.columns, ["__kindred_doc", "__kindred_k1", "__kindred_k2"]
    at = names.index(text_col)
    rows = docs.withColumns(dict(zip(own, _name_columns(id_col, text_col).values())))
    found = _spans(rows.select(*(F.col(o).alias(k) for o, k in zip(own, NAME)), F.col(text_col).cast("string").alias("text")), window)
    sieve = Sieve(found, "k1")

    def part(touched: bool):
        def run(batches):
            for b in text_slices(batches):
                on = sieve(b.column(len(names) + 1).to_numpy())
                yield b.filter(pa.array(on if touched else ~on))
        return rows.mapInArrow(run, rows.schema)

    def cut(batches):
        for b in text_slices(batches):
            texts = []
            for t, spans, equal in zip(b.column(at), b.column(len(names)), b.column(len(names) + 1)):
                t, spans, equal = t.as_py(), spans.as_py(), equal.as_py()
                if t and (spans or equal > 1):
                    raw = t.encode("utf-8", "surrogatepass")
                    starts = [m.start() for m in WORD.finditer(raw)]
                    keep = _kept(len(starts), spans, window, equal)
                    if not keep.all():
                        starts.append(len(raw))
                        flips = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
                        t = b"".join(raw[starts[x]:starts[y]] for x, y in zip(flips[::2], flips[1::2])).decode("utf-8", "surrogatepass")
                texts.append(t)
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    left = _joined(part(True), found, own).select(*names, "__kindred_spans", "__kindred_equal").mapInArrow(cut, docs.schema)
    return part(False).select(*names).unionByName(left)
