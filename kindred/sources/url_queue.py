"""A queue of urls in a spool folder as a stream: offsets are places in files, so what failed is read again."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .binary import HIDDEN, place

FORMAT = "kindred_urls"
#: Bytes that one micro-batch admits, and that one task reads, about.
BATCH_BYTES, SPAN_BYTES, LOOK = 256 << 20, 32 << 20, 64 << 10
URL, GAP = re.compile(rb"\S+"), re.compile(rb"\s")


@dataclass
class UrlSpan(InputPartition):
    """The urls of a file whose first byte lies from ``begin`` to ``end``."""
    path: str
    begin: int
    end: int


class UrlQueueReader(DataSourceStreamReader):
    """Reads files in the order of their names, of which new ones must come last, up to a bound of bytes a micro-batch.

    An offset is a file's name and a byte in it. A source is not told where a restarted stream stands, so it looks up
    the last offset in the stream's own log, in the option ``checkpoint``: a batch that was planned but did not
    end is replayed by Spark from there, with the same offsets and so the same urls.
    """

    def __init__(self, options: dict):
        self.options = options
        self.most, self.span = int(options.get("max_bytes", BATCH_BYTES)), int(options.get("span_bytes", SPAN_BYTES))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def _files(self) -> list[tuple[str, int]]:
        """(name, bytes) of the files there are, by name; hidden ones are not there yet."""
        store, base = place(self.options["path"])
        found = store.get_file_info(fs.FileSelector(base))
        return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(HIDDEN))

    def _logged(self) -> dict:
        """The last offset in the stream's log, where a restarted stream goes on."""
        if "checkpoint" not in self.options:
            return self.initialOffset()
        store, base = place(f"{self.options['checkpoint']}/offsets")
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        batches = sorted((int(f.base_name), f.path) for f in found if f.base_name.isdigit())
        if not batches:
            return self.initialOffset()
        told = store.open_input_file(batches[-1][1]).read().decode().split("\n")
        offset = json.loads(told[2 + int(self.options.get("source", 0))])
        return offset if "file" in offset else self.initialOffset()

    def latestOffset(self) -> dict:
        at, left = self.at or self._logged(), self.most
        for name, size in self._files():
            if name < at["file"] or (name == at["file"] and at["byte"] >= size):
                continue
            begin = at["byte"] if name == at["file"] else 0
            end = self._border(name, begin + left, size) if size - begin > left else size
            at, left = {"file": name, "byte": end}, left - (end - begin)
            if left <= 0:
                break
        self.at = at
        return at

    def _border(self, name: str, at: int, size: int) -> int:
        """The first place from ``at`` on where no url goes on."""
        store, base = place(self.options["path"])
        with store.open_input_file(f"{base}/{name}") as f:
            while at < size:
                block = f.read_at(min(LOOK, size - at), at)
                if gap := GAP.search(block):
                    return at + gap.start()
                at += len(block)
        return size

    def partitions(self, start: dict, end: dict) -> list[UrlSpan]:
        _, base = place(self.options["path"])
        out = []
        for name, size in self._files():
            if start["file"] <= name <= end["file"]:
                a = start["byte"] if name == start["file"] else 0
                b = end["byte"] if name == end["file"] else size
                out += [UrlSpan(f"{base}/{name}", x, min(x + self.span, b)) for x in range(a, b, self.span)]
        self.at = max(end, self.at or end, key=lambda o: (o["file"], o["byte"]))
        return out

    def read(self, partition: UrlSpan) -> Iterator[pa.RecordBatch]:
        """A url belongs to the span of its first byte: one that begins before is skipped, the last is read to its end."""
        store, _ = place(self.options["path"])
        name = posixpath.basename(partition.path)
        with store.open_input_file(partition.path) as f:
            size, at = f.size(), partition.begin
            skip = at > 0 and not GAP.match(f.read_at(1, at - 1))
            held, base = b"", at
            while base < partition.end:
                more = f.read_at(min(LOOK, size - at), at) if at < size else b""
                at, held = at + len(more), held + more
                if skip:
                    gap = GAP.search(held)
                    cut = gap.start() if gap else len(held)
                    base, held, skip = base + cut, held[cut:], gap is None
                urls, places, cut = [], [], len(held)
                for m in URL.finditer(held):
                    if base + m.start() >= partition.end:
                        break
                    if m.end() == len(held) and more:  # may go on
                        cut = m.start()
                        break
                    urls.append(m[0].decode("utf-8", "replace"))
                    places.append(base + m.start())
                yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array([name] * len(urls), pa.string()), pa.array(places, pa.int64())], names=["url", "file", "byte"])
                base, held = base + cut, held[cut:]
                if not more:
                    break

    def commit(self, end: dict) -> None:
        pass  # files stay; whoever fills the queue removes what has been read

    def stop(self) -> None:
        pass


class UrlQueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "url string, file string, byte bigint"

    def streamReader(self, schema) -> UrlQueueReader:
        return UrlQueueReader(dict(self.options))


def url_stream(spark: SparkSession, path: str, checkpoint: str, max_bytes: int = BATCH_BYTES, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(url, file, byte): white-space separated urls of the files in a folder, as a stream.

    ``checkpoint`` is the checkpointLocation that the stream will be started with; max_bytes is what a micro-batch admits, to
    the next url's end. Each url comes once, however often the stream is stopped or fails. Empty files give none.
    """
    spark.dataSource.register(UrlQueueSource)
    return spark.readStream.format(FORMAT).option("checkpoint", checkpoint).option("max_bytes", max_bytes).option("span_bytes", span_bytes).load(path)
