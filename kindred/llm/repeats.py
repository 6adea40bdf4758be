"""Which of very many hashes occur more than once: the filter that comes before whole comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Hashes that a map task holds before it deals them out, and that one group is to get.
HELD_HASHES, GROUP_HASHES = 500_000, 1_000_000
#: What a dealt row is: hashes of a group, places found repeated already, the rows of a chunk.
DEALT, FOUND, ROWS = 0, 1, 2
SCHEMA = "g int, chunk long, kind int, place binary, value binary"
NAMES = ("g", "chunk", "kind", "place", "value")
KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())


def groups_for(hashes: int) -> int:
    """Groups of about GROUP_HASHES each."""
    return max(1, -(-int(hashes) // GROUP_HASHES))


def _planes(place: np.ndarray) -> bytes:
    """Ascending places as differences, the low bytes first: the high ones are mostly zero and compress."""
    step = np.diff(place, prepend=0).astype("<u4")
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes()


def _places(planes: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T)
    return np.cumsum(step.view("<u4")[:, 0].astype(np.int64))


def twins(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(values), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _chunk(meta: list[tuple[int, ...]], hashes: list[np.ndarray], groups: int, width: int):
    """Dealt rows of one chunk. Hashes repeated here are found already and go out once for the others."""
    sizes, h = np.array([len(x) for x in hashes], np.int64), np.concatenate(hashes).view(np.uint64)
    rows = np.column_stack([np.array(meta, np.int64).reshape(len(meta), -1), sizes])
    name = xxhash.xxh64(h.tobytes())
    name.update(rows.tobytes())
    name = int(np.uint64(name.intdigest()).view(np.int64))
    yield name % groups, name, ROWS, rows.tobytes(), np.int64(rows.shape[1]).tobytes()
    if not len(h):
        return
    place = np.arange(len(h))
    again = twins(h)
    if again.any():
        at = np.flatnonzero(again)
        yield name % groups, name, FOUND, _planes(at), (h[at].tobytes() if width == 8 else b"")
        own, first = np.unique(h[at], return_index=True)
        place = np.sort(np.concatenate([np.flatnonzero(~again), at[first]]))
        h = h[place]
    g = ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(g, kind="stable")
    g, h, place = g[order], h[order], place[order]
    value = h if width == 8 else h.astype(np.uint32)
    cut = np.flatnonzero(np.diff(g.astype(np.int64), prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(g)]):
        yield int(g[a]), name, DEALT, _planes(place[a:b]), value[a:b].tobytes()


def _batch(rows, names=NAMES, kinds=KINDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _flag(table: pa.Table, width: int) -> pa.Table:
    """Of one group: places whose hash occurs more than once; other rows pass."""
    kind = table.column("kind").to_numpy()
    rest = table.filter(pa.array(kind != DEALT)).select(NAMES[1:])
    dealt = table.filter(pa.array(kind == DEALT))
    if not dealt.num_rows:
        return rest
    place = [_places(p.as_py()) for p in dealt.column("place")]
    value = np.frombuffer(b"".join(dealt.column("value").to_pylist()), np.uint64 if width == 8 else np.uint32)
    on = twins(value)
    out, at = [], 0
    for chunk, p in zip(dealt.column("chunk").to_pylist(), place):
        own = on[at:at + len(p)]
        if own.any():
            out.append((chunk, FOUND, _planes(p[own]), value[at:at + len(p)][own].tobytes() if width == 8 else b""))
        at += len(p)
    return pa.concat_tables([rest, pa.Table.from_batches([_batch(out, NAMES[1:], KINDS[1:])])]) if out else rest


def _gather(table: pa.Table, width: int):
    """Of one chunk: its rows, and (row, place within it, hash) of every repeated hash, by place."""
    kind, place, value = (table.column(c).to_pylist() for c in ("kind", "place", "value"))
    rows = [(p, v) for k, p, v in zip(kind, place, value) if k == ROWS]
    if not rows:
        raise RuntimeError("the input changed between two attempts of a task; checkpoint it first")
    meta = np.frombuffer(rows[0][0], np.int64).reshape(-1, int(np.frombuffer(rows[0][1], np.int64)[0]))
    found = [(_places(p), v) for k, p, v in zip(kind, place, value) if k == FOUND]
    at = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    h = np.frombuffer(b"".join([v for _, v in found]), np.uint64) if width == 8 else np.zeros(len(at), np.uint64)
    at, first = np.unique(at, return_index=True)
    ends = np.cumsum(meta[:, -1])
    row = np.searchsorted(ends, at, "right")
    return meta[:, :-1], row, at - (ends - meta[:, -1])[row], h[first]


def repeated(rows: DataFrame, hashed: Callable[[pa.RecordBatch], Iterable[tuple[tuple[int, ...], np.ndarray]]],
             finish: Callable, schema: str, groups: int, width: int = 4, order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``finish(meta, row, place, hash)`` for all places of rows whose hash occurs more than once.

    ``hashed`` gives of a batch each row's name, some whole numbers, and its 64-bit hashes. Tasks deal
    hashes out to ``groups`` by their upper half, packed in arrays, so no word, document or source
    makes a group hot; a hash that recurs within a chunk of HELD_HASHES goes out once. Groups compare
    ``width`` bytes of each: 8 are the hash and are given to ``finish``; 4 are its lower half, so that
    among n hashes of a group a single one counts as repeated with probability n / 2^32. None that
    repeats is ever missed.

    A chunk is named by its content. A lost task that runs again must meet its rows in the same order, as
    it does from a table. Rows that come out of a shuffle are therefore sorted by ``order``, which must be total
    up to equal rows; were the order another all the same, names would differ and the job fail, rather
    than mix places and rows of two attempts.
    GROUP_HASHES and HELD_HASHES bound what a task holds. At very many groups a chunk has few hashes for each: raise
    both with the memory of the executors.
    """
    def deal(batches: Iterator[pa.RecordBatch]):
        meta, held, n = [], [], 0
        for b in batches:
            for name, h in hashed(b):
                meta.append(name)
                held.append(h)
                n += len(h)
                if n >= HELD_HASHES or len(held) >= HELD_HASHES:
                    yield _batch(list(_chunk(meta, held, groups, width)))
                    meta, held, n = [], [], 0
        if held:
            yield _batch(list(_chunk(meta, held, groups, width)))

    if order and "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = rows.sortWithinPartitions(*order)
    flagged = rows.mapInArrow(deal, SCHEMA).groupBy("g").applyInArrow(lambda t: _flag(t, width), SCHEMA.split(", ", 1)[1])
    return flagged.groupBy("chunk").applyInArrow(lambda t: finish(*_gather(t, width)), schema)
