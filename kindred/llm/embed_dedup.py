"""Embedding near-dedup: int8 tile products with error bounds, full precision where needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, checkpointed, connected_components, usable_vector
from .topk import _matrix

TILE_ROWS = 8192
#: Columns of one int8 product: 1024 * 127 * 127 < 2^24, so sums in 32-bit floats are whole and exact.
EXACT_COLUMNS = 1024
#: Room for the rounding of what follows the product: eight steps at most on numbers up to 2, 2^-24 each.
SLACK = 2e-6


def quantise(vectors: np.ndarray):
    """Vectors scaled by a power of two each, their int8 codes, scale, norm of what the codes miss of the unit vector, and norm.

    The scaling is exact, changes no cosine and keeps very small and very large numbers from vanishing or
    overflowing in squares.
    """
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    unit = v / norm[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return v, codes, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)), norm


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a . b of int8 codes, exact: by blocks of columns in 32-bit floats, summed in doubles if there are several."""
    blocks = range(0, a.shape[1], EXACT_COLUMNS)
    parts = (a[:, k:k + EXACT_COLUMNS].astype(np.float32) @ b[:, k:k + EXACT_COLUMNS].astype(np.float32).T for k in blocks)
    if len(blocks) == 1:
        return next(parts)
    total = np.zeros((len(a), len(b)))
    for p in parts:
        total += p
    return total.astype(np.float32)


def tile_links(a, b, same: bool, threshold: float):
    """Index pairs (i of a, j of b) of cosine >= threshold; a and b are quantise() of their vectors.

    With unit vectors u = s c + e, u.w = s c . t d + u.f + e.w - e.f, so the code product misses
    the cosine by |e| + |f| + |e||f| at most. Only pairs whose upper bound reaches the threshold
    get their cosine in double precision.
    """
    va, ca, sa, ea, na = a
    vb, cb, sb, eb, nb = b
    for lo in range(0, len(va), 512):
        i = slice(lo, lo + 512)
        near = code_products(ca[i], cb)
        near *= sa[i].astype(np.float32)[:, None] * sb.astype(np.float32)
        near += (ea[i] + SLACK).astype(np.float32)[:, None] * (1 + eb).astype(np.float32) + eb.astype(np.float32)
        x, y = np.nonzero(near >= threshold - SLACK)
        x += lo
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 1 << 18):
            p, q = x[k:k + (1 << 18)], y[k:k + (1 << 18)]
            cos = np.einsum("ij,ij->i", va[p], vb[q]) / (na[p] * nb[q])
            yield p[cos >= threshold], q[cos >= threshold]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two vectors of one dimension link if their cosine in double precision is ``threshold`` or
    more. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do null ids; they stay as rows of their own, kept. component_id is the smallest
    id reachable; kept: it is the row's own. Repeated ids keep one row each.

    Equal vectors collapse to one with a count. The rest is dealt by hash into g groups of about
    TILE_ROWS; each pair of groups i <= j is one cell, its int8 product is taken in blocks, and
    the cell returns link counts and a spanning forest, never the pairs. Vectors travel as they are, in
    32-bit floats if given so: with codes alone the surviving pairs, squares of a group of near vectors,
    would have to leave the cell to be computed in full. An empty table gives no rows; other columns are
    ignored.
    """
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vec_col).alias("v") if floats else F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    zero = F.forall("v", lambda x: x == 0)
    live = rows.where(usable_vector(F.col("v")) & F.col("vec_id").isNotNull() & ~zero)
    classes = checkpointed(live.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    groups = max(1, -(-classes.count() // TILE_ROWS))

    own = F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int")
    cells = classes.withColumn("own", own).withColumn("dim", F.size("v")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        "id", "copies", "v", "own", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def cell(t: pa.Table) -> pa.Table:
        group, ids, copies = (t.column(c).to_numpy() for c in ("own", "id", "copies"))
        order = np.lexsort((ids, group))
        group, ids, copies, v = group[order], ids[order], copies[order], _matrix(t.column("v"))[order]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        cut = int(np.searchsorted(group, i, "right")) if i < j else 0
        whole = quantise(v)
        left = [x[:cut] for x in whole] if i < j else whole
        right = [x[cut:] for x in whole] if i < j else whole
        forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
        for a, b in tile_links(left, right, i == j, threshold):
            b = b + cut
            links += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
            forest.union(a, b)
        at = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[at], pa.int64()), "links": pa.array(links[at], pa.int64()),
                         "root": pa.array(ids[forest.root[at]], pa.int64())})

    found = checkpointed(cells.groupBy("dim", "i", "j").applyInArrow(cell, "id long, links long, root long"))
    named = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    judged = classes.join(links, "id", "left").join(named, F.col("id") == F.col("node"), "left").select(
        F.col("v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    alive = usable_vector(F.col("v")) & F.col("vec_id").isNotNull() & ~zero
    keyed = rows.withColumn("w", F.when(alive, F.col("v"))).select("vec_id", "w")
    out = keyed.join(judged, F.col("w") == F.col("v"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
