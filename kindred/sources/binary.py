"""Binary files of rows as a Spark data source: cut into byte ranges on row borders, written with a job commit.

Readers plan spans of files, so neither a file nor a span has to fit into memory. Writers put files into a hidden
folder; a job that ends well moves them into place and then names them in a manifest, which is what readers go by.
Files that other programs have left in a folder without a manifest are read as they are.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from kindred.operators.ordering import checkpointed

FORMAT = "kindred_binary"
#: Bytes of a span that one task reads, of a piece that it holds, and of a file that it writes, about.
SPAN_BYTES, CHUNK_BYTES, FILE_BYTES = 64 << 20, 4 << 20, 128 << 20
HIDDEN, MANIFEST, SPLITS, JOB = ("_", "."), "_manifest-", "_splits-", "_job-"
KEYS = (0, 2**32 - 1)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a uri, as Arrow names them."""
    return fs.FileSystem.from_uri(path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


# kinds of rows
@dataclass(frozen=True)
class Kind:
    """How rows look as bytes. ``width``: of a row, if all have one; ``parse`` gives the columns of the whole rows at the
    beginning of a buffer and the bytes they take; ``pack`` the bytes of each row of a batch, or of all of them at once."""
    schema: str
    parse: Callable[[memoryview, dict], tuple[list[pa.Array], int]]
    pack: Callable[[pa.RecordBatch, dict], Iterator[bytes]]
    width: Callable[[dict], int] | None = None
    head: int = 0
    key_at: Callable[[dict], int] | None = None

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


def _number(options: dict, name: str, default: int) -> int:
    return int(options.get(name, default))


def _rows(buffer: memoryview, width: int) -> tuple[np.ndarray, int]:
    n = len(buffer) // width
    return np.frombuffer(buffer, np.uint8, n * width).reshape(n, width), n * width


def _longs(rows: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(rows).view("<u4").ravel().astype(np.int64))


def _floats(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view("<f4")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel(), pa.float32()))


def _key_first(options: dict) -> bool:
    return options.get("key_first") == "true"


def _parse_points(buffer, options):
    rows, used = _rows(buffer, 20)
    at = 4 if _key_first(options) else 0
    sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows[:, at:at + 16]).tobytes())])
    return [sketch.cast(pa.binary()), _longs(rows[:, :4] if at else rows[:, 16:])], used


def point_rows(sketches: pa.Array, keys: np.ndarray, key_first: bool = False) -> bytes:
    rows = np.zeros((len(keys), 20), np.uint8)
    at = 4 if key_first else 0
    rows[:, at:at + 16] = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, 16)
    rows[:, slice(0, 4) if at else slice(16, 20)] = keys.astype("<u4").view(np.uint8).reshape(-1, 4)
    return rows.tobytes()


def _pack_points(batch, options):
    yield point_rows(batch.column(0), batch.column(1).to_numpy() + _number(options, "by", 0), _key_first(options))


def _parse_bins(buffer, options):
    rows, used = _rows(buffer, 8)
    return [_longs(rows[:, :4]), _longs(rows[:, 4:])], used


def _pack_bins(batch, options):
    yield np.column_stack([batch.column(0).to_numpy() + _number(options, "by", 0), batch.column(1).to_numpy()]).astype("<u4").tobytes()


def _parse_vectors(buffer, options):
    rows, used = _rows(buffer, 4 * _number(options, "columns", 128))
    return [_floats(rows)], used


def _pack_vectors(batch, options):
    yield np.array(batch.column(0).to_pylist(), "<f4").tobytes()


def _walk(buffer, sizes: Callable[[memoryview, int], tuple[int, ...] | None]) -> Iterator[tuple[int, ...]]:
    """What ``sizes`` tells of each whole record, its end last; it gives None where a record is not whole."""
    at = 0
    while (found := sizes(buffer, at)) is not None:
        yield found
        at = found[-1]


def _key_pid(buffer, at):
    if at + 8 > len(buffer):
        return None
    key, n = struct.unpack_from("<Ii", buffer, at)
    return (key, at + 8, at + 8 + n) if 0 <= n <= len(buffer) - at - 8 else None


def _parse_key_pids(buffer, options):
    found = list(_walk(buffer, _key_pid))
    return [pa.array([k for k, _, _ in found], pa.int64()),
            pa.array([bytes(buffer[a:b]).decode("utf-8", "replace") for _, a, b in found], pa.string())], found[-1][-1] if found else 0


def _pack_key_pids(batch, options):
    for key, pid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        pid = (pid or "").encode()
        yield struct.pack("<Ii", key + _number(options, "by", 0), len(pid)) + pid


def _record(width: int):
    def sizes(buffer, at):
        """(where the name begins and ends, items, the record's end)"""
        if at + 16 > len(buffer):
            return None
        n, = struct.unpack_from("<Q", buffer, at)
        if n > len(buffer) - at - 16:
            return None
        k, = struct.unpack_from("<Q", buffer, at + 8 + n)
        end = at + 16 + n + k * width
        return (at + 8, at + 8 + n, k, end) if end <= len(buffer) else None
    return sizes


def _parse_records(buffer, options):
    width = _number(options, "width", 16)
    found = list(_walk(buffer, _record(width)))
    items = [[bytes(buffer[x:x + width]) for x in range(z - k * width, z, width)] for _, _, k, z in found]
    return [pa.array([bytes(buffer[a:b]).decode("utf-8", "replace") for a, b, _, _ in found], pa.string()), pa.array(items, pa.list_(pa.binary()))], found[-1][-1] if found else 0


def _pack_records(batch, options):
    for pid, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        pid = (pid or "").encode()
        yield struct.pack("<Q", len(pid)) + pid + struct.pack("<Q", len(items or ())) + b"".join(items or ())


def _parse_raw_records(buffer, options):
    columns = _number(options, "columns", 128)
    found = list(_walk(buffer, _record(4 * columns)))
    names = [bytes(buffer[a:b]).decode("utf-8", "replace") for a, b, _, _ in found]
    counts = [k for _, _, k, _ in found]
    data = b"".join(bytes(buffer[z - 4 * columns * k:z]) for _, _, k, z in found)
    return [pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), counts), pa.int64())),
            pa.array(np.concatenate([np.arange(k) for k in counts]) if counts else [], pa.int32()),
            _floats(np.frombuffer(data, np.uint8).reshape(-1, 4 * columns))], found[-1][-1] if found else 0


def _pack_raw_records(batch, options):
    for url, descs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        url = (url or "").encode()
        yield struct.pack("<Q", len(url)) + url + struct.pack("<Q", len(descs or ())) + np.array(descs or (), "<f4").tobytes()


KINDS = {
    "points": Kind("sketch binary, key bigint", _parse_points, _pack_points, lambda o: 20, key_at=lambda o: 0 if _key_first(o) else 16),
    "bins": Kind("key bigint, count bigint", _parse_bins, _pack_bins, lambda o: 8, key_at=lambda o: 0),
    "vectors": Kind("vec array<float>", _parse_vectors, _pack_vectors, lambda o: 4 * _number(o, "columns", 128)),
    "matrix": Kind("row_id bigint, vec array<float>", _parse_vectors, _pack_vectors, lambda o: 4 * _number(o, "columns", 128), head=12),
    "key_pids": Kind("key bigint, pid string", _parse_key_pids, _pack_key_pids),
    "records": Kind("pid string, items array<binary>", _parse_records, _pack_records),
    "raw_records": Kind("url string, ord int, desc array<float>", _parse_raw_records, _pack_raw_records),
}


# reading
@dataclass
class Span(InputPartition):
    """Whole rows of a file: bytes ``offset`` to ``end``; ``row`` is the first one's number, ``columns`` a matrix's width."""
    path: str
    offset: int
    end: int
    row: int = 0
    in_order: bool = False
    columns: int = 0


def listed(store: fs.FileSystem, base: str) -> list[tuple[str, int, dict]]:
    """(path, bytes, what the manifest says) of the files to read: those in manifests, or all where there is none."""
    top = store.get_file_info(base)
    if top.type == fs.FileType.File:
        return [(top.path, top.size, {})]
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(base)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    manifests = [f for f in found if f.type == fs.FileType.File and posixpath.dirname(f.path) == top.path and f.base_name.startswith(MANIFEST)]
    if manifests:
        read = {f.base_name: json.loads(store.open_input_file(f.path).read()) for f in manifests}
        gone = {old for m in read.values() for old in m["replaces"]}
        return sorted((f"{top.path}/{x['name']}", x["bytes"], x) for name, m in read.items() if name not in gone for x in m["files"])
    seen = lambda path: not any(part.startswith(HIDDEN) for part in path[len(top.path):].strip("/").split("/"))
    return sorted((f.path, f.size, {}) for f in found if f.type == fs.FileType.File and seen(f.path))


class BinaryReader(DataSourceReader):
    """Plans and reads spans. Options: kind, span_bytes, low and high (keys to read), sorted (rows lie by key), and the kind's own.

    A bound on ``key``, given as options or by a filter, leaves out files whose manifest says that they hold none, and
    is looked up by bisection in files of rows of one width that lie by key, so other rows are not read.
    """

    def __init__(self, options: dict):
        self.options, self.kind = options, KINDS[options["kind"]]
        self.low, self.high = _number(options, "low", KEYS[0]), _number(options, "high", KEYS[1])
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f  # Spark still applies it

    @property
    def bounded(self) -> bool:
        return (self.low, self.high) != KEYS and "key" in self.kind.names

    def partitions(self) -> list[Span]:
        store, base = place(self.options["path"])
        out, most = [], _number(self.options, "span_bytes", SPAN_BYTES)
        for path, size, told in listed(store, base):
            if self.bounded and told.get("low") is not None and (told["high"] < self.low or told["low"] > self.high):
                continue
            in_order = told.get("sorted", self.options.get("sorted") == "true")
            columns, width = 0, 0
            if self.kind.head:
                _, _, columns = struct.unpack("<3I", store.open_input_file(path).read_at(12, 0))
                width = 4 * columns
            elif self.kind.width:
                width = self.kind.width(self.options)
            if width:
                rows, per = (size - self.kind.head) // width, max(1, most // width)
                out += [Span(path, self.kind.head + a * width, self.kind.head + min(a + per, rows) * width, a, in_order, columns) for a in range(0, rows, per)]
            elif not self.kind.head:
                borders = self._borders(store, path, size, most)
                out += [Span(path, a, b) for a, b in zip(borders, borders[1:])]
        return out

    def _borders(self, store, path: str, size: int, most: int) -> list[int]:
        """Borders of records that index_records() has found in this very file, ``most`` bytes apart or more; or the whole file."""
        beside = f"{posixpath.dirname(path)}/{SPLITS}{posixpath.basename(path)}"
        if store.get_file_info(beside).type != fs.FileType.File:
            return [0, size]
        known = json.loads(store.open_input_file(beside).read())
        if known["bytes"] != size:
            return [0, size]
        out = [0]
        for border in known["borders"]:
            if border - out[-1] >= most and border < size:
                out.append(border)
        return [*out, size]

    def _bytes(self, f, at: int, n: int) -> bytes:
        got = f.read_at(n, at)
        self.bytes_read += len(got)
        return got

    def _narrowed(self, f, span: Span) -> tuple[int, int]:
        """The rows of a span in key order whose keys are from low to high."""
        width, key_at = self.kind.width(self.options), self.kind.key_at(self.options)

        def first(wanted: int) -> int:
            a, b = 0, (span.end - span.offset) // width
            while a < b:
                mid = (a + b) // 2
                key, = struct.unpack("<I", self._bytes(f, span.offset + mid * width + key_at, 4))
                a, b = (mid + 1, b) if key < wanted else (a, mid)
            return span.offset + a * width
        return first(self.low), first(self.high + 1)

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:
            return
        store, _ = place(self.options["path"])
        options = self.options | ({"columns": str(span.columns)} if span.columns else {})
        with store.open_input_file(span.path) as f:
            at, end, row = span.offset, span.end, span.row
            if self.bounded and span.in_order and self.kind.key_at:
                at, end = self._narrowed(f, span)
            held = b""
            while at < end:
                more = self._bytes(f, at, min(CHUNK_BYTES, end - at))
                if not more:
                    break
                at += len(more)
                held = held + more if held else more
                columns, used = self.kind.parse(memoryview(held), options)
                held = held[used:]
                if len(columns[0]):
                    if self.kind.head:
                        columns = [pa.array(np.arange(row, row + len(columns[0]))), *columns]
                        row += len(columns[0])
                    batch = pa.RecordBatch.from_arrays(columns, names=self.kind.names)
                    if self.bounded:
                        key = batch.column("key").to_numpy()
                        batch = batch.filter(pa.array((key >= self.low) & (key <= self.high)))
                    yield batch


# writing
@dataclass
class Written(WriterCommitMessage):
    """What one task has put into the job's folder: (name, bytes, rows, least key, greatest key, in key order) a file."""
    files: list[dict]


class BinaryWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.kind = options, overwrite, KINDS[options["kind"]]
        self.job = options.get("job") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = place(self.options["path"])
        task, files, most = TaskContext.get(), [], _number(self.options, "file_bytes", FILE_BYTES)
        keyed = self.kind.names.index("key") if "key" in self.kind.names else None
        if keyed is not None and self.options["kind"] == "points":
            keyed = 1
        by, out, held = _number(self.options, "by", 0), None, []

        def opened():
            name = f"part-{self.job[:8]}-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files)}"
            files.append({"name": name, "bytes": 0, "rows": 0, "low": None, "high": None, "sorted": keyed is not None})
            store.create_dir(f"{base}/{JOB}{self.job}", recursive=True)
            return store.open_output_stream(f"{base}/{JOB}{self.job}/{name}")

        def closed(stream) -> None:
            if self.kind.head and held:
                rows = files[-1]["rows"]
                data = b"".join(held)
                files[-1]["bytes"] = self.kind.head + len(data)
                stream.write(struct.pack("<3I", 4, rows, len(data) // (4 * rows)))
                stream.write(data)
                held.clear()
            stream.close()

        for batch in iterator:
            for lo in range(0, batch.num_rows, 1024):  # files end between these
                part = batch.slice(lo, 1024)
                if out is None:
                    out = opened()
                told = files[-1]
                for data in self.kind.pack(part, self.options):
                    if self.kind.head:
                        held.append(data)
                    else:
                        out.write(data)
                    told["bytes"] += len(data)
                told["rows"] += part.num_rows
                if keyed is not None:
                    keys = part.column(keyed).to_numpy() + by
                    told["sorted"] = bool(told["sorted"] and (told["high"] is None or keys[0] >= told["high"]) and (np.diff(keys) >= 0).all())
                    told["low"] = int(keys.min() if told["low"] is None else min(told["low"], keys.min()))
                    told["high"] = int(keys.max() if told["high"] is None else max(told["high"], keys.max()))
                if told["bytes"] >= most:
                    closed(out)
                    out = None
        if out is not None:
            closed(out)
        return Written(files)

    def _manifest(self, store, base: str, name: str, content: dict) -> None:
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/_new-{self.job}") as f:
            f.write(json.dumps(content).encode())
        store.move(f"{base}/_new-{self.job}", f"{base}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        store, base = place(self.options["path"])
        there = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        older = [f for f in there if f.base_name.startswith(MANIFEST)]
        if not older:  # what lay here stays readable; what is moved now is not, before it is named
            known = [] if self.overwrite or not there else [{"name": p[len(base) + 1:], "bytes": n} for p, n, _ in listed(store, base)]
            self._manifest(store, base, f"{MANIFEST}before-{self.job}", {"files": known, "replaces": []})
            older = [store.get_file_info(f"{base}/{MANIFEST}before-{self.job}")]
        files = [f for m in messages if m for f in m.files]
        for f in files:
            store.move(f"{base}/{JOB}{self.job}/{f['name']}", f"{base}/{f['name']}")
        stale = [x for f in older for x in json.loads(store.open_input_file(f.path).read())["files"]] if self.overwrite else []
        self._manifest(store, base, f"{MANIFEST}{self.job}", {"files": files, "replaces": [f.base_name for f in older] if self.overwrite else []})
        if self.overwrite:
            for path in [*(f"{base}/{x['name']}" for x in stale), *(f.path for f in older)]:
                if store.get_file_info(path).type == fs.FileType.File:
                    store.delete_file(path)
        self._drop(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = place(self.options["path"])
        self._drop(store, base)

    def _drop(self, store, base: str) -> None:
        if store.get_file_info(f"{base}/{JOB}{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{JOB}{self.job}")


def clean(path: str) -> list[str]:
    """Removes folders of jobs that did not end, as tasks that outlive an abort can leave one; nobody must be writing."""
    store, base = place(path)
    left = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith(JOB)]
    for folder in left:
        store.delete_dir(folder)
    return left


class BinarySource(DataSource):
    """``spark.read.format("kindred_binary").option("kind", ...)`` and the same with ``write``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return KINDS[self.options["kind"]].schema

    def reader(self, schema) -> BinaryReader:
        return BinaryReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BinaryWriter:
        return BinaryWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to Python sources unless the session says otherwise."""
    spark.dataSource.register(BinarySource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _texts(options: dict) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}


def read(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """The rows of one file, or of all files below a folder. A cut last row is left out.

    Files in a store that Arrow does not reach come through Spark's binaryFile source, whole, one file in one task.
    """
    try:
        place(path)
    except (pa.ArrowInvalid, OSError):
        return _whole_files(spark, path, KINDS[kind], _texts(options))
    register(spark)
    return spark.read.format(FORMAT).options(kind=kind, **_texts(options)).load(path)


def _whole_files(spark: SparkSession, path: str, kind: Kind, options: dict) -> DataFrame:
    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                own = options
                if kind.head:
                    own = options | {"columns": str(struct.unpack("<3I", content[:kind.head])[2])}
                columns, _ = kind.parse(memoryview(content)[kind.head:], own)
                if kind.head:
                    columns = [pa.array(np.arange(len(columns[0]))), *columns]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return content.mapInArrow(run, kind.schema)


def write(rows: DataFrame, path: str, kind: str, mode: str = "append", **options) -> DataFrame:
    """Writes rows of the kind's columns; gives (file, bytes, rows) of what the job has committed."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    register(spark)
    rows.write.format(FORMAT).mode(mode).options(kind=kind, job=job, **_texts(options)).save(path)
    store, base = place(path)
    told = json.loads(store.open_input_file(f"{base}/{MANIFEST}{job}").read())["files"]
    return spark.createDataFrame([(f"{base}/{f['name']}", f["bytes"], f["rows"]) for f in told], "file string, bytes bigint, rows bigint")


def write_matrix_file(rows: DataFrame, path: str) -> int:
    """All of rows(vec) as one matrix file at ``path``, whatever their number; gives the number of rows.

    The rows are checkpointed and counted by partition (a row a partition), then the file is made at its full size and
    each task puts its own rows where they belong, so no task and no driver holds or passes them all. A task that
    runs again writes the same bytes. That takes a folder which tasks can write into at any place: a local or mounted one.
    """
    store, at = place(path)
    if not isinstance(store, fs.LocalFileSystem):
        raise ValueError(f"one matrix file takes a store that is written at any place: {path}")
    held = checkpointed(rows.select(F.col("vec").cast("array<float>").alias("vec")).withColumn("part", F.spark_partition_id()))
    told = held.groupBy("part").agg(
        F.count("*").alias("n"), F.min(F.coalesce(F.size("vec"), F.lit(-1))).alias("low"), F.max(F.size("vec")).alias("high"))
    parts = {r["part"]: r for r in told.collect()}
    columns = max((r["high"] for r in parts.values()), default=0)
    if any(r["low"] != columns for r in parts.values()):
        raise ValueError("a matrix takes vectors of one length")
    starts, n = {}, 0
    for k in sorted(parts):
        starts[k], n = n, n + parts[k]["n"]
    store.create_dir(posixpath.dirname(at), recursive=True)
    with open(at, "wb") as f:
        f.write(struct.pack("<3I", 4, n, columns))
        f.truncate(12 + 4 * columns * n)

    def put(batches):
        row = {}
        with open(at, "r+b") as f:
            for b in filter(len, batches):
                part = b.column(1)[0].as_py()
                first = row.get(part, starts[part])
                f.seek(12 + 4 * columns * first)
                f.write(b.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                row[part] = first + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([sum(row[p] - starts[p] for p in row)], pa.int64())], names=["rows"])

    wrote = held.mapInArrow(put, "rows bigint").agg(F.sum("rows")).first()[0] or 0
    if wrote != n:
        raise RuntimeError(f"{wrote} rows of {n} written to {path}")
    return n


def index_records(spark: SparkSession, path: str, kind: str, every: int = SPAN_BYTES, **options) -> DataFrame:
    """Borders of records in files whose records have no common width, ``every`` bytes apart, kept beside each file.

    Such files hold no marks where a record begins, so each is walked once, by a task of its own that hops from length
    to length; after that they are read in spans. Gives (file, bytes, borders).
    """
    store, base = place(path)
    width = {"records": _number(options, "width", 16), "raw_records": 4 * _number(options, "columns", 128)}.get(kind)
    files = [(p, n) for p, n, _ in listed(store, base)]
    asked = spark.createDataFrame(files, "file string, bytes bigint").repartition(max(1, len(files)), F.col("file"))

    def hop(f, size: int) -> list[int]:
        at, last, out = 0, 0, []
        while at + 8 <= size:
            if width is None:
                end = at + 8 + struct.unpack("<Ii", f.read_at(8, at))[1]
            else:
                name, = struct.unpack("<Q", f.read_at(8, at))
                if at + 16 + name > size:
                    break
                end = at + 16 + name + width * struct.unpack("<Q", f.read_at(8, at + 8 + name))[0]
            if end > size or end <= at:
                break
            if end - last >= every:
                out.append(end)
                last = end
            at = end
        return out

    def walk(batches):
        for b in batches:
            here, _ = place(path)
            for file, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with here.open_input_file(file) as f:
                    borders = hop(f, size)
                beside = f"{posixpath.dirname(file)}/{SPLITS}{posixpath.basename(file)}"
                own = f"{posixpath.dirname(file)}/_new-{uuid.uuid4().hex}"
                with here.open_output_stream(own) as out:
                    out.write(json.dumps({"bytes": size, "borders": borders}).encode())
                here.move(own, beside)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size]), pa.array([len(borders)], pa.int64())], names=["file", "bytes", "borders"])

    rows = asked.mapInArrow(walk, "file string, bytes bigint, borders bigint").collect()  # a row a file
    return spark.createDataFrame([tuple(r) for r in rows], "file string, bytes bigint, borders bigint")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, element_size, rows, columns) of matrix files: twelve bytes of each are read, by tasks."""
    store, base = place(path)
    files = [(p,) for p, _, _ in listed(store, base)]

    def peek(batches):
        for b in batches:
            here, _ = place(path)
            told = []
            for file in b.column(0).to_pylist():
                with here.open_input_file(file) as f:
                    told.append(struct.unpack("<3I", f.read_at(12, 0)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([t[k] for t in told], pa.int64()) for k in range(3))], names=["path", "element_size", "rows", "columns"])

    return spark.createDataFrame(files, "path string").mapInArrow(peek, "path string, element_size bigint, rows bigint, columns bigint")
