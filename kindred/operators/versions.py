"""An image store on disk: every change writes new files and a manifest that names the current version.

Rows lie in segments, one a change, and are never altered. What a change takes away goes into a list of its own that is
merged when the store is read, so reading is one scan and one join a relation however many changes there were;
compact() folds the lists in. A version is a small JSON file below ``_versions``; it counts once its file is whole.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import checkpointed
from .store import Store, additions

IMAGES, SKETCHES, FREE, LOST = "images", "sketches", "free", "lost"
SCHEMAS = {IMAGES: "image_id bigint, pid string, fingerprint string, siftnum bigint, _seq bigint",
           SKETCHES: "sketch_id bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, _seq bigint",
           FREE: "image_id bigint, _seq bigint", LOST: "image_id bigint, whole boolean, _seq bigint"}
CURRENT, PREVIOUS = 0, 1


class Conflict(RuntimeError):
    """Another change has made the next version first; load again and repeat."""


class Manifest:
    """Numbered versions of what files below ``path`` are to be read, each a JSON file below ``_versions``.

    A version counts once its file is whole; of two writers of the same number one gets Conflict. Folders are
    reached through Hadoop's file systems, so any store that Spark writes to will do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, path: str):
        """(path, file system) in the JVM."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        at, files = self.at(path)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.names(f"{self.path}/_versions") if (m := re.fullmatch(r"v-(\d+)\.json", n)))

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """A version, the latest whole one unless ``number`` says otherwise. One that a writer left unfinished is passed over."""
        for n in reversed(self.versions()) if number is None else [number]:
            at, files = self.at(f"{self.path}/_versions/v-{n:08d}.json")
            stream = files.open(at)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return n, json.loads(text)
            except ValueError:
                continue
        raise FileNotFoundError(f"no version below {self.path}")

    def commit(self, before: int | None, told: dict) -> int:
        """Makes the version after ``before``; Conflict if there is one already. None: whatever comes next."""
        number = max(self.versions(), default=-1) + 1
        if before is not None and number != before + 1:
            raise Conflict(f"version {number - 1} came after {before}")
        at, files = self.at(f"{self.path}/_versions/v-{number:08d}.json")
        try:
            out = files.create(at, False)  # fails where another writer was first
        except Py4JJavaError as taken:
            raise Conflict(f"version {number} is taken") from taken
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        return number

    def remove(self, number: int) -> None:
        at, files = self.at(f"{self.path}/_versions/v-{number:08d}.json")
        files.delete(at, False)

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def short(self, folder: str) -> str:
        return folder[len(self.path) + 1:]

    def parts(self, folder: str, depth: int) -> list[str]:
        """Folders ``depth`` levels below that hold partitions, as paths below ``folder``."""
        found = [""]
        for _ in range(depth):
            found = [f"{f}/{n}" if f else n for f in found for n in self.names(f"{folder}/{f}") if "=" in n]
        return found


@dataclass(frozen=True)
class Version:
    """``segments``: (table, folder, generation). ``changes`` counts all changes; each row holds the number of its own."""
    number: int
    changes: int
    next_id: int
    segments: list[tuple[str, str, int]] = field(default_factory=list)

    def folders(self, table: str, generation: int | None = None) -> list[str]:
        return [f for t, f, g in self.segments if t == table and generation in (None, g)]


class VersionedStore:
    """The store below ``path``, which every executor must reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Manifest(spark, path)
        self.path = self.log.path

    # versions
    def version(self, number: int | None = None) -> Version:
        n, told = self.log.read(number)
        return Version(n, told["changes"], told["next_id"], [tuple(s) for s in told["segments"]])

    def _commit(self, before: Version | None, next_id: int, segments: list[tuple[str, str, int]]) -> Version:
        changes = (before.changes if before else 0) + 1
        number = self.log.commit(before.number if before else None, {"changes": changes, "next_id": next_id, "segments": segments})
        return Version(number, changes, next_id, segments)

    def _write(self, rows: DataFrame, table: str, change: int) -> str:
        folder = f"{self.path}/{table}/{uuid.uuid4().hex}"
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        rows.withColumn("_seq", F.lit(change).cast("bigint")).select(*names).write.parquet(folder)
        return folder[len(self.path) + 1:]

    # reading
    def _rows(self, v: Version, table: str, generation: int | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in v.folders(table, generation)]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*folders)

    def _live(self, v: Version, table: str, generation: int | None = None) -> DataFrame:
        """Rows that no later change has taken away."""
        lost = self._rows(v, LOST)
        of = F.shiftright("sketch_id", 8) if table == SKETCHES else F.col("image_id")
        until = (lost.where("whole") if table == SKETCHES else lost).groupBy(F.col("image_id").alias("_lost")).agg(F.max("_seq").alias("_until"))
        rows = self._rows(v, table, generation)
        return rows.join(until, of == F.col("_lost"), "left").where("_until IS NULL OR _seq >= _until").drop("_lost", "_until")

    def load(self, number: int | None = None, generation: int | None = None) -> Store:
        """The relations of a version, of both generations unless one is named."""
        v = self.version(number)
        images = self._live(v, IMAGES, generation).drop("_seq")
        return Store(images, self._live(v, SKETCHES, generation).drop("_seq"), self._free(v), v.next_id)

    def _free(self, v: Version) -> DataFrame:
        given = self._rows(v, FREE).select("image_id").distinct()
        return given.join(self._live(v, IMAGES).select("image_id"), "image_id", "left_anti")

    # changes
    def create(self, store: Store) -> Version:
        parts = ((IMAGES, store.images), (SKETCHES, store.sketches), (FREE, store.free))
        return self._commit(None, store.next_id, [(t, self._write(rows, t, 0), CURRENT) for t, rows in parts])

    def _change(self, make: Callable[[Version, int], tuple[int, list[tuple[str, DataFrame]]]]) -> Version:
        """A version with the rows that ``make(version, number of the change)`` adds to its tables."""
        v = self.version()
        next_id, added = make(v, v.changes)
        return self._commit(v, next_id, [*v.segments, *((t, self._write(rows, t, v.changes), CURRENT) for t, rows in added)])

    def insert(self, records: DataFrame, sketches: DataFrame) -> DataFrame:
        """store.insert() with what it adds written; gives its (request, image_id, reply)."""
        told = []

        def make(v, change):
            images, marks, used, replies = additions(self.load(v.number), records, sketches)
            told.append(replies)
            return v.next_id + used, [(IMAGES, images), (SKETCHES, marks)]
        self._change(make)
        return told[0]

    def delete_by_pid(self, pids: DataFrame) -> DataFrame:
        """All images of ``pids(pid)`` go and their ids are free again; gives (pid, reply)."""
        told = []

        def make(v, change):
            known = checkpointed(self._live(v, IMAGES).join(pids.select("pid").distinct(), "pid", "left_semi").select("image_id", "pid"))
            marked = known.select("pid").distinct().withColumn("known", F.lit(True))
            told.append(checkpointed(pids.join(marked, "pid", "left").select("pid", F.when(F.col("known"), "REPLY_OK").otherwise("REPLY_INVALID_PID").alias("reply"))))
            return v.next_id, [(LOST, known.withColumn("whole", F.lit(True))), (FREE, known)]
        self._change(make)
        return told[0]

    def upsert(self, changes: DataFrame) -> Version:
        """Non-null fields of changes(image_id, pid, fingerprint, siftnum) replace those of images; unknown ids are added. Missing columns count as null."""
        fields = ["pid", "fingerprint", "siftnum"]
        new = changes.select("image_id", *[F.col(c).alias(f"_{c}") if c in changes.columns else F.lit(None).alias(f"_{c}") for c in fields])

        def make(v, change):
            rows = checkpointed(new.join(self._live(v, IMAGES), "image_id", "left").select("image_id", *[F.coalesce(f"_{c}", c).alias(c) for c in fields]))
            return v.next_id, [(LOST, rows.withColumn("whole", F.lit(False))), (IMAGES, rows)]
        return self._change(make)

    def rotate(self) -> Version:
        """The current generation becomes the previous one; what was previous goes. Nothing is read or rewritten."""
        v = self.version()
        aged = [(t, f, PREVIOUS if t in (IMAGES, SKETCHES) else g) for t, f, g in v.segments if t not in (IMAGES, SKETCHES) or g == CURRENT]
        return self._commit(v, v.next_id, aged)

    def compact(self) -> Version:
        """The same rows in one segment a relation and generation, without lists of what is gone."""
        v = self.version()
        parts = [(t, self._live(v, t, g), g) for t in (IMAGES, SKETCHES) for g in (CURRENT, PREVIOUS) if v.folders(t, g)]
        made = [(t, self._write(rows.drop("_seq"), t, v.changes), g) for t, rows, g in [*parts, (FREE, self._free(v), CURRENT)]]
        return self._commit(v, v.next_id, made)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes segments and versions that none of the last ``keep`` versions names; gives the folders deleted.

        Nobody must be reading an older version or writing meanwhile.
        """
        numbers = self.log.versions()
        held = {f for n in numbers[-keep:] for _, f, _ in self.version(n).segments}
        gone = [f"{t}/{n}" for t in SCHEMAS for n in self.log.names(f"{self.path}/{t}") if f"{t}/{n}" not in held]
        for folder in gone:
            at, files = self.log.at(f"{self.path}/{folder}")
            files.delete(at, True)
        for n in numbers[:-keep]:
            self.log.remove(n)
        return gone
