"""SimHash near-dedup: fingerprints, links by pivot distance tables, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import groups_for, repeated
from .shared import NO_ID, Forest, Sieve, checkpointed, connected_components, small_batches, text_slices, written

BITS = 64
#: Reference fingerprints; bit patterns from a hash, so they need no storage.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(24)], dtype=np.uint64)
#: Rows of one bucket that are compared in one piece; larger buckets go in pairs of pieces.
PIECE = 20_000


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def majority(hashes: bytes, width: int) -> bytes:
    """A bit is 1 if set in over half of the hashes of ``width`` bytes each; of none: zero."""
    planes = np.frombuffer(hashes, np.uint8).reshape(-1, width)
    votes = np.zeros(8 * width, np.int64)
    for k in range(0, len(planes), 255):  # so that counts fit a byte
        votes += np.unpackbits(planes[k:k + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(planes)).tobytes()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; fewer words make one, none none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends += 1
    np.cumsum(ends, out=ends)
    starts = [0, *ends[:len(words) - size].tolist()]
    return [line[a:b] for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> bytes:
    """8 bytes, big-endian: the majority of the shingles' XXH64; no words: zero."""
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(x, seed) for x in shingles(_words(text), shingle)]), 8)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text, as a signed long."""
    def run(batches):
        for b in text_slices(batches):
            fps = b"".join(fingerprint(t.as_py(), shingle, seed) for t in b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _close(bucket: np.ndarray, fp: np.ndarray, radius: int) -> Forest:
    """A forest over the rows that joins those of equal bucket at ``radius`` or fewer bits.

    Rows must be sorted by bucket and then by distance to the first pivot: partners of a row
    then follow it within its bucket until the first coordinate has grown by more than radius.
    Every other coordinate of the pivot table discards by the same bound, and only
    survivors have their own distance computed.
    """
    table = [np.bitwise_count(fp ^ p).astype(np.int8) for p in PIVOTS]
    forest, a, step = Forest(len(fp)), np.arange(len(fp)), 0
    while True:
        step += 1
        a = a[a < len(fp) - step]
        b = a + step
        on = (bucket[a] == bucket[b]) & (table[0][b] - table[0][a] <= radius)
        a, b = a[on], b[on]
        if not len(a):
            return forest
        x, y = a, b
        for column in table[1:]:
            near = np.abs(column[x] - column[y]) <= radius
            x, y = x[near], y[near]
            if not len(x):
                break
        real = np.bitwise_count(fp[x] ^ fp[y]) <= radius
        forest.union(x[real], y[real])


def _masks(radius: int, rows: int) -> list[int]:
    """Bit masks such that two fingerprints within radius agree on all bits of one of them.

    The 64 bits are cut into radius + extra blocks; some extra of them agree. More rows take
    more extra blocks, so longer keys: exact at any size, only bucket sizes differ.
    """
    extra = 1
    while extra < 4 and rows >> (BITS * extra // (radius + extra)) > 128:
        extra += 1
    cuts = [BITS * i // (radius + extra) for i in range(radius + extra + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, extra)]


def _buckets(batches, width: int):
    """The columns of sorted Arrow batches, cut so that rows equal in the first ``width`` come together."""
    held = None  # the rows of the last bucket, which may go on
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for c in cols[:width]:
            last &= c == c[-1]
        at = int(np.argmax(last))  # sorted, so the last bucket is the tail
        if at:
            yield [c[:at] for c in cols]
        held = [c[at:] for c in cols]
    if held is not None:
        yield held


def _dealt(keyed: DataFrame, keys: list[str], own: list[str], cols: list[str]) -> DataFrame:
    """keyed(*keys, i, j, *cols), a bucket of more than PIECE rows as all pairs (i, j) of its pieces."""
    hot = keyed.groupBy(*keys).count().where(F.col("count") > PIECE)
    hot = hot.select(*keys, F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    pieces = F.coalesce("pieces", F.lit(1))
    return keyed.join(hot, keys, "left").withColumn("own", F.pmod(F.xxhash64(*own), pieces).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), pieces - 1))).select(
        *keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *cols)


def link(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fps(fp, id)``, distinct in fp, within radius bits.

    Fingerprints meet in buckets of equal masked bits; a
    bucket of more than PIECE rows is dealt to several tasks as pairs of pieces. Tasks return
    spanning forests, never all pairs of a group.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(radius, fps.count())]
    keyed = fps.select("fp", "id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")
    ).select("fp", "id", "k.t", "k.key")
    dealt = _dealt(keyed, ["t", "key"], ["fp"], ["id", "fp"])
    dealt = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def edges(cols):
        ids, fp = cols[4], cols[5].view(np.uint64)
        new = np.zeros(len(fp), bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        bucket = np.cumsum(new)
        order = np.lexsort((np.bitwise_count(fp ^ PIVOTS[0]), bucket))
        root = _close(bucket[order], fp[order], radius).root
        linked = np.flatnonzero(root != np.arange(len(root)))
        u, v = ids[order][linked], ids[order][root[linked]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        for cols in _buckets(batches, 4):
            yield edges(cols)

    return dealt.mapInArrow(run, "u long, v long")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """rows(doc_id, fp) with component, the smallest doc_id reachable by links."""
    rows = checkpointed(rows)
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = connected_components(link(nodes, radius))
    named = nodes.join(found, F.col("id") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "id").alias("component"))
    return rows.join(named, "fp")


def _given(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))


def components(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, shingles are space-joined with
    repeats; fewer words than a shingle make one shingle, none (or null text) the fingerprint
    zero, which links like any other. Documents of one fingerprint are one node; nodes within
    ``radius`` bits link; component_id is the smallest doc_id reachable. A null id counts as
    smallest and stays null; repeated ids keep one row each; an empty table gives no rows.

    Copies collapse to one node before any comparison, so a group of copies costs as one. Texts of any length
    are read whole; other columns are ignored, whatever their names.
    """
    found = _components(fingerprints(docs, shingle, seed, id_col, text_col), radius)
    return found.select(_given("doc_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        _given("component").alias("component_id"))


#: Bits of the fingerprints that near copies are sifted by, and how many of them may differ. Two sets of
#: similarity 0.8 differ in 15 % of their bits; 40 is some five standard deviations further.
NEAR_BITS, NEAR_RADIUS = 128, 40
#: Sets of so few shingles have too few votes for that estimate; they are compared exactly at once.
FEW_SHINGLES = 24
#: Fingerprints of a task's largest buckets that serve as references.
REFERENCES = 16
#: Texts in which frequent shingles are counted, and the most shingles listed. Both only order shingles.
SAMPLE_ROWS, LISTED = 10_000, 100_000
#: Sets, and bytes of them, of one component that are compared in one piece.
SETS, SET_BYTES = 1024, 4 << 20


def profile(text: str | None, shingle: int = 5) -> tuple[np.ndarray, bytes]:
    """Sorted 64-bit hashes of the distinct shingles of a text, and the 128-bit majority over them."""
    digests = b"".join(map(xxhash.xxh3_128_digest, shingles(_words(text), shingle)))
    whole = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    own, first = np.unique(whole[:, 0], return_index=True)
    return own, majority(whole[first].tobytes(), NEAR_BITS // 8)


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the shingles that three or more of some SAMPLE_ROWS distinct texts hold."""
    def run(batches):
        for b in text_slices(batches):
            sets = [profile(t.as_py(), shingle)[0] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    every = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod("tkey", F.lit(every)) == 0).dropDuplicates(["tkey"]).select("text")
    counts = some.mapInArrow(run, "h long").groupBy("h").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "h").limit(LISTED).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["count"] for r in top], np.int64)[order]


def _may_agree(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False where sets of n shingles whose first common one is at pos can't reach a similarity of 0.8."""
    return 9 * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= 4 * (n[a] + n[b])


def near_in_buckets(bucket: np.ndarray, n: np.ndarray, pos: np.ndarray, fp: tuple[np.ndarray, ...]) -> tuple[Forest, np.ndarray]:
    """A forest over the rows that joins those of a bucket that may be near, and pairs met, left by the table and near.

    Rows are sorted by bucket and then size, so the partners that sizes permit follow a row. A table
    holds every row's distance to some reference fingerprints, members of the largest buckets;
    a pair whose largest difference there exceeds the radius is discarded, and only survivors have their
    own distance computed. Buckets already joined into one tree are left early.
    """
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    sizes = np.diff(start, append=len(bucket))
    own = start[np.argsort(-sizes, kind="stable")[:REFERENCES]]
    apart = lambda x, y: sum(np.bitwise_count(f[x] ^ f[y]).astype(np.int16) for f in fp)
    table = [apart(slice(None), r) for r in own]
    forest, a, step, counts = Forest(len(bucket)), np.arange(len(bucket)), 0, np.zeros(3, np.int64)
    index = np.repeat(np.arange(len(start)), sizes)
    while len(a):
        step += 1
        a = a[a < len(bucket) - step]
        b = a + step
        on = (index[a] == index[b]) & (5 * n[a] >= 4 * n[b])
        a, b = a[on], b[on]
        x = np.flatnonzero((forest.root[a] != forest.root[b]) & _may_agree(n, pos, a, b))
        x, y = a[x], b[x]
        counts[0] += len(x)
        few = n[y] <= FEW_SHINGLES
        forest.union(x[few], y[few])
        x, y = x[~few], y[~few]
        for column in table:
            on = np.abs(column[x] - column[y]) <= NEAR_RADIUS
            x, y = x[on], y[on]
        counts[1] += len(x)
        on = apart(x, y) <= NEAR_RADIUS
        forest.union(x[on], y[on])
        counts[2] += int(on.sum())
        if step & (step - 1) == 0 and len(a):
            mixed = np.minimum.reduceat(forest.root, start) != np.maximum.reduceat(forest.root, start)
            a = a[mixed[index[a]]]
    return forest, counts


def _likely(met: DataFrame) -> DataFrame:
    """Edges (u, v) of forests over ``met(key, node, n, pos, f0, f1)``, joining nodes of one key that may be near."""
    dealt = _dealt(met, ["key"], ["node"], ["n", "node", "pos", "f0", "f1"])

    def run(batches):
        for key, i, j, n, node, pos, f0, f1 in _buckets(batches, 3):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            forest, _ = near_in_buckets(np.cumsum(new), n, pos, (f0.view(np.uint64), f1.view(np.uint64)))
            at = np.flatnonzero(forest.root != np.arange(len(key)))
            u, v = node[at], node[forest.root[at]]
            pairs = np.unique(np.column_stack([np.minimum(u, v), np.maximum(u, v)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node").mapInArrow(run, "u long, v long")


def _sets(keyed: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, component, set) for nodes(node, component), from their texts; texts don't travel but are sifted by their hash."""
    wanted = checkpointed(rows.select("node", "doc_id", "tkey").join(nodes, "node").groupBy("node", "component").agg(
        F.min(F.struct("doc_id", "tkey")).alias("k")).select("node", "component", "k.doc_id", "k.tkey"))
    sieve = Sieve(wanted, "tkey")

    def run(batches):
        for b in text_slices(batches):
            b = b.filter(pa.array(sieve(b.column(1).to_numpy())))
            sets = pa.array([profile(t.as_py(), shingle)[0].tobytes() for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets], names=["doc_id", "tkey", "set"])

    found = keyed.select("doc_id", "tkey", "text").mapInArrow(run, "doc_id long, tkey long, set binary")
    return found.join(wanted, ["doc_id", "tkey"]).select("node", "component", "set").dropDuplicates(["node"])


def similar_sets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with a Jaccard similarity of 0.8 or more, by products of their shared columns."""
    n = np.array(list(map(len, sets)))
    row = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    on = count[column] > 1
    row, column = row[on], shared[column[on]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = max(1, (4 << 20) // len(sets))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, (lo, lo + wide))
        m = np.zeros((len(sets), int(column[b - 1]) - lo + 1), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    x, y = np.nonzero(np.triu(9 * both >= 4 * (n[:, None] + n), 1))
    return x, y


def _similar(sets: DataFrame) -> DataFrame:
    """Edges (u, v) of forests over sets(node, component, set) joining those of a component with similarity 0.8 or more.

    A component of more than SETS sets or SET_BYTES is dealt to several tasks, as all pairs of its pieces.
    """
    pieces = F.ceil(F.greatest(F.count("*") / SETS, F.sum(F.octet_length("set")) / SET_BYTES)).cast("int").alias("pieces")
    sets, remove = written(sets, "sets")
    hot = sets.groupBy("component").agg(pieces).where("pieces > 1")
    count = F.coalesce("pieces", F.lit(1))
    dealt = sets.join(hot, "component", "left").withColumn("own", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), count - 1))).select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "set")

    def run(batches):
        for component, i, j, node, s in _buckets(text_slices(batches), 3):
            new = np.ones(len(node), bool)
            new[1:] = (component[1:] != component[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            first, u, v = np.flatnonzero(new), [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(node)]):
                x, y = similar_sets([np.frombuffer(c, np.uint64) for c in s[a:b]])
                forest = Forest(b - a)
                forest.union(x, y)
                at = np.flatnonzero(forest.root != np.arange(b - a))
                u.append(node[a:b][at])
                v.append(node[a:b][forest.root[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    links = checkpointed(dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, "u long, v long"))
    remove()
    return links


def _set_components(keyed: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tkey, component) for keyed(doc_id, tkey, text): components of Jaccard similarity 0.8 or more.

    Texts of one shingle set are one node, named by the 64-bit hash of the set. Nodes meet in buckets of
    equal shingles: shingles are put in one order, rare ones first, and two sets of similarity 0.8 share
    one of the first n / 5 + 1 of either. Shingles that only one node lists drop out first. In
    a bucket 128-bit fingerprints are sifted by a table of distances to references, and compared. What
    that joins is a component of likely copies, whose sets are then compared exactly.
    """
    listed, counts = _frequent(keyed, shingle)

    def prefixes(batches):
        for b in text_slices(batches):
            node, size, keys, fps = [], [], [], []
            for t in b.column(2):
                s, fp = profile(t.as_py(), shingle)
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                size.append(len(s))
                fps.append(fp)
                count = np.zeros(len(s), np.int64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, s), len(listed) - 1)
                    count = np.where(listed[at] == s, counts[at], 0)
                keys.append(s[np.lexsort((s, count))[:len(s) // 5 + 1]])
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            fp = np.frombuffer(b"".join(fps), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()),
                 pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "tkey", "node", "n", "f0", "f1", "keys"])

    def hashed(b: pa.RecordBatch):
        ends, flat = b.column(4).offsets.to_numpy(), b.column(4).values.to_numpy().view(np.uint64)
        for k, name in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
            yield name, flat[ends[k]:ends[k + 1]]

    def finish(meta, row, place, h):
        return pa.table([pa.array(h.view(np.int64)), *(pa.array(meta[row, c], pa.int64()) for c in (0, 1)), pa.array(place, pa.int64()),
                         *(pa.array(meta[row, c], pa.int64()) for c in (2, 3))], names=["key", "node", "n", "pos", "f0", "f1"])

    rows = checkpointed(keyed.select("doc_id", "tkey", "text").mapInArrow(
        prefixes, "doc_id long, tkey long, node long, n long, f0 long, f1 long, keys array<long>"))
    total = rows.agg(F.sum(F.size("keys"))).first()[0]
    nodes = rows.select("node", "n", "f0", "f1", "keys").dropDuplicates(["node"])
    met, remove = written(repeated(nodes, hashed, finish, "key long, node long, n long, pos long, f0 long, f1 long", groups_for(total or 0), 8, ["node"]), "met")
    likely = connected_components(_likely(met))
    remove()
    found = connected_components(_similar(_sets(keyed, rows, likely, shingle)))
    return rows.select("doc_id", "tkey", "node").join(found, "node", "left").select(
        "doc_id", "tkey", F.coalesce("component", "node").alias("component"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the smallest id, of each group of exact and near copies.

    Two documents link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
    Every such pair shares a bucket; it is lost only if its fingerprints differ in more than NEAR_RADIUS
    bits, some five standard deviations from what that similarity gives. None below is linked, up to
    clashes of 64-bit hashes. Groups are the components. Null and empty texts are copies of each
    other; null ids count as smallest, but every row is a document of its own: of each group one row stays,
    that of the least (id, hash of the text), and of rows equal in both any one. All columns are
    returned as they are, whatever their names; an empty table gives no rows. Texts that stay don't travel.
    """
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    text = F.col(text_col).cast("string")
    with small_batches(docs.sparkSession):
        found = _set_components(docs.select(key.alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text")), shingle)
        each = checkpointed(found.groupBy("component", "doc_id", "tkey").count())
    least = each.groupBy("component").agg(F.min(F.struct("doc_id", "tkey")).alias("k")).select("component", "k.doc_id", "k.tkey")
    once = least.join(each.where("count = 1"), ["component", "doc_id", "tkey"]).select("doc_id", "tkey")
    name = F.xxhash64("doc_id", "tkey")
    sieve = Sieve(each.join(once, ["doc_id", "tkey"], "left_anti").select(name.alias("name")), "name")
    kept = least.select(F.col("doc_id").alias("__kindred_key"), F.col("tkey").alias("__kindred_text"))
    own = ["__kindred_key", "__kindred_text"]
    rows = docs.withColumns({own[0]: key, own[1]: F.xxhash64(text)}).withColumn("__kindred_name", F.xxhash64(*own))

    def part(touched: bool):
        def run(batches):
            for b in text_slices(batches):
                on = sieve(b.column(b.num_columns - 1).to_numpy())
                yield b.filter(pa.array(on if touched else ~on))
        return rows.mapInArrow(run, rows.schema)

    left = part(True).join(kept, own).dropDuplicates(own)
    return part(False).select(*docs.columns).unionByName(left.select(*docs.columns))
