import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.plans.catalogue import QUERIES
from kindred.sources import binary, points


def visible(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith(("_", "."))) if path.exists() else []


def point_rows(n, key=lambda i: i):
    return [(bytes([i % 251] * 15 + [i // 251 % 251]), key(i)) for i in range(n)]


def point_bytes(rows):
    return b"".join(s + struct.pack("<I", k) for s, k in rows)


@pytest.mark.parametrize("spans", [1, 7, 1000])
def test_a_file_cut_in_ranges_loses_no_row_at_borders(spark, tmp_path, spans):
    rows = point_rows(1000)
    (tmp_path / "f").write_bytes(point_bytes(rows) + b"cut")
    got = points.read_points(spark, str(tmp_path), span_bytes=20 * -(-1000 // spans))
    assert got.rdd.getNumPartitions() == spans
    assert sorted((bytes(r.sketch), r.key) for r in got.collect()) == sorted(rows)


def test_pieces_smaller_than_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "CHUNK_BYTES", 7)
    rows = [(i, "p" * (i % 40)) for i in range(60)]
    (tmp_path / "k").write_bytes(b"".join(struct.pack("<Ii", k, len(p)) + p.encode() for k, p in rows) + struct.pack("<Ii", 5, 99) + b"cut")
    reader = binary.BinaryReader({"kind": "key_pids", "path": str(tmp_path)})
    got = [r for s in reader.partitions() for b in reader.read(s) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert got == rows


def test_a_key_range_reads_fewer_bytes(spark, tmp_path):
    rows = point_rows(5000, lambda i: 3 * i)
    (tmp_path / "f").write_bytes(point_bytes(rows))

    def read(**options):
        reader = binary.BinaryReader({"kind": "points", "path": str(tmp_path), "span_bytes": "15000"} | options)
        return reader, [k for s in reader.partitions() for b in reader.read(s) for k in b.column(1).to_pylist()]

    whole, all_keys = read()
    assert whole.bytes_read == 100_000 and all_keys == [k for _, k in rows]
    some, keys = read(sorted="true", low="3001", high="3300")
    assert keys == list(range(3003, 3301, 3)) and some.bytes_read < 5000
    unsorted, keys = read(low="3001", high="3300")
    assert keys == list(range(3003, 3301, 3)) and unsorted.bytes_read == 100_000
    got = points.read_points(spark, str(tmp_path), sorted=True).where((F.col("key") > 3000) & (F.col("key") <= 3300))
    assert sorted(r.key for r in got.collect()) == list(range(3003, 3301, 3))
    assert points.read_points(spark, str(tmp_path), sorted=True).where("key = 6").count() == 1
    assert points.read_points(spark, str(tmp_path), sorted=True).where("key = 7").count() == 0


def test_filters_narrow_the_bounds():
    reader = binary.BinaryReader({"kind": "points", "path": "/none"})
    given = [binary.GreaterThan(("key",), 4), binary.LessThan(("key",), 9), binary.EqualTo(("sketch",), b"x"), binary.GreaterThanOrEqual(("key",), 2)]
    assert list(reader.pushFilters(given)) == given and (reader.low, reader.high) == (5, 8)


def test_files_without_the_keys_are_left_out(spark, tmp_path):
    at = str(tmp_path / "p")
    df = spark.createDataFrame(point_rows(4000), "sketch binary, key long").repartitionByRange(4, "key").sortWithinPartitions("key")
    assert points.write_points(df, at).count() == 4
    reader = binary.BinaryReader({"kind": "points", "path": at, "low": "10", "high": "20"})
    assert len({s.path for s in reader.partitions()}) == 1 and all(s.in_order for s in reader.partitions())
    assert points.read_points(spark, at).where("key between 10 and 20").count() == 11


def test_one_matrix_file_takes_the_rows_of_all_tasks(spark, tmp_path):
    at = f"{tmp_path}/one/m"
    df = spark.range(25_000).select(F.array(*[(F.col("id") + i).cast("float") for i in range(4)]).alias("vec"))
    assert points.write_matrix_file(df.repartition(5), at) == 25_000
    assert [tuple(r)[1:] for r in points.peek_matrix(spark, at).collect()] == [(4, 25_000, 4)]
    got = points.read_matrix(spark, at, span_bytes=10_000).collect()
    assert sorted(r.vec[0] for r in got) == sorted(r.row_id for r in got) == list(range(25_000))
    assert points.write_matrix_file(df.limit(0), f"{tmp_path}/none") == 0
    assert [tuple(r)[1:] for r in points.peek_matrix(spark, f"{tmp_path}/none").collect()] == [(4, 0, 0)]
    with pytest.raises(ValueError):
        points.write_matrix_file(df.union(spark.createDataFrame([([1.0],)], "vec array<float>")), f"{tmp_path}/ragged")


def test_a_matrix_query_counts_its_one_file(spark, sf):
    assert QUERIES["matrix_heads"](spark, sf).columns == ["files", "rows", "columns"]


def test_raw_records_of_a_label_share_its_url(spark, sf):
    labels = {f"label{r.label}" for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct().collect()}
    assert {r.url for r in QUERIES["raw_record_files"](spark, sf).select("url").distinct().collect()} == labels


def test_matrices_of_several_files_come_back_whole(spark, tmp_path):
    at = str(tmp_path / "m")
    df = spark.range(25_000).select(F.array(*[(F.col("id") + i).cast("float") for i in range(4)]).alias("vec"))
    told = points.write_matrix(df.repartition(3), at, file_bytes=64_000)
    assert told.agg(F.sum("rows")).first()[0] == 25_000 and told.count() > 6
    assert points.peek_matrix(spark, at).agg(F.sum("rows"), F.max("columns")).first() == (25_000, 4)
    got = points.read_matrix(spark, at, span_bytes=10_000)
    assert sorted(r.vec[0] for r in got.collect()) == list(range(25_000))
    files = told.collect()
    for f in files[:2]:
        one = points.read_matrix(spark, f.file, span_bytes=5000).collect()
        assert sorted(r.row_id for r in one) == list(range(f.rows))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    at = tmp_path / "p"
    df = spark.createDataFrame(point_rows(4000), "sketch binary, key long").repartitionByRange(8, "key")

    def broken(batches):
        for b in batches:
            if max(b.column(1).to_pylist()) > 3900:
                raise ValueError("lost")
            yield b

    points.write_points(df.where("key < 100"), str(at))
    before = visible(at)
    with pytest.raises(Exception, match="lost"):
        points.write_points(df.mapInArrow(broken, df.schema), str(at))
    assert visible(at) == before
    time.sleep(1)  # tasks that outlive the abort
    binary.clean(str(at))
    assert not list(at.glob("_job*"))
    assert points.read_points(spark, str(at)).count() == 100
    with pytest.raises(Exception, match="lost"):
        points.write_points(df.mapInArrow(broken, df.schema), str(tmp_path / "new"))
    assert visible(tmp_path / "new") == []


def test_a_commit_that_breaks_off_shows_nothing(spark, tmp_path):
    at = tmp_path / "p"
    (at / "_job-x").mkdir(parents=True)
    (at / "foreign").write_bytes(point_bytes(point_rows(5)))
    writer = binary.BinaryWriter({"kind": "points", "path": str(at), "job": "x"}, False)
    told = []
    for name in ("a", "b"):
        (at / "_job-x" / name).write_bytes(point_bytes(point_rows(7)))
        told.append(binary.Written([{"name": name, "bytes": 140, "rows": 7}]))
    (at / "_job-x" / "b").unlink()  # the second move fails
    with pytest.raises(FileNotFoundError):
        writer.commit(told)
    assert points.read_points(spark, str(at)).count() == 5
    writer.abort(told)
    assert not (at / "_job-x").exists()


def test_append_and_overwrite(spark, tmp_path):
    at = str(tmp_path / "b")
    df = spark.range(100).select(F.col("id").alias("key"), (F.col("id") * 2).alias("count"))
    points.write_bins(df, at)
    points.write_bins(df.where("key < 10"), at)
    assert points.read_bins(spark, at).count() == 110
    points.write_bins(df.where("key >= 95"), at, mode="overwrite")
    assert sorted(map(tuple, points.read_bins(spark, at).collect())) == [(k, 2 * k) for k in range(95, 100)]
    points.write_bins(df.limit(0), at, mode="overwrite")
    assert points.read_bins(spark, at).count() == 0 and len(json.loads(next((tmp_path / "b").glob("_manifest-*")).read_text())["files"]) == 0


def test_records_are_cut_at_their_borders(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(f"p{i}", [bytes(r.integers(0, 256, 16, np.uint8)) for _ in range(i % 9)]) for i in range(300)]
    df = spark.createDataFrame(rows, "pid string, items array<binary>")
    at = str(tmp_path / "r")
    points.write_records(df.coalesce(1), at)
    assert points.read_records(spark, at, span_bytes=500).rdd.getNumPartitions() == 1
    told = binary.index_records(spark, at, "records", every=500).first()
    got = points.read_records(spark, at, span_bytes=500)
    assert told.borders > 20 and got.rdd.getNumPartitions() > 20
    assert sorted((x.pid, [bytes(i) for i in x["items"]]) for x in got.collect()) == sorted(rows)
    file = next(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part"))
    file.write_bytes(file.read_bytes()[:-1])  # another file under this name: its borders no longer count
    assert points.read_records(spark, str(file)).count() == 299 and points.read_records(spark, str(file), span_bytes=500).rdd.getNumPartitions() == 1
    raw = spark.createDataFrame([(f"u{i}", [[float(i), float(j)] for j in range(i % 5)]) for i in range(50)], "url string, descs array<array<float>>")
    points.write_raw_records(raw.coalesce(1), str(tmp_path / "w"))
    binary.index_records(spark, str(tmp_path / "w"), "raw_records", every=100, columns=2)
    got = points.read_raw_records(spark, str(tmp_path / "w"), 2, span_bytes=100)
    assert got.rdd.getNumPartitions() > 5
    assert sorted((x.url, x.ord, x.desc) for x in got.collect()) == sorted((f"u{i}", j, [float(i), float(j)]) for i in range(50) for j in range(i % 5))


def test_whole_files_by_sparks_own_reader(spark, tmp_path):
    (tmp_path / "m").write_bytes(struct.pack("<3I", 4, 2, 2) + struct.pack("<4f", 1, 2, 3, 4))
    got = binary._whole_files(spark, str(tmp_path), binary.KINDS["matrix"], {})
    assert [(x.row_id, x.vec) for x in got.collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
