import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from kindred.operators import images
from kindred.sources import points
from kindred.streaming import requests


def png(pixels):
    body = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_points(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randbytes(16), k) for k in (0, 2**31, 2**32 - 1)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a").write_bytes(b"".join(s + struct.pack("<I", k) for s, k in rows) + b"cut")
    got = points.read_points(spark, str(tmp_path / "p"))
    assert [(bytes(x.sketch), x.key) for x in got.collect()] == rows
    out = points.pack_points(got.coalesce(1)).collect()
    assert b"".join(bytes(x.rows) for x in out) == b"".join(s + struct.pack("<I", k) for s, k in rows)


def test_length_prefixed_files(spark, tmp_path):
    for d in "rkbm":
        (tmp_path / d).mkdir()
    (tmp_path / "r/x").write_bytes(struct.pack("<Q", 2) + b"ab" + struct.pack("<Q", 2) + b"1" * 16 + b"2" * 16 + struct.pack("<Q", 0) + struct.pack("<Q", 0))
    assert [(x.pid, [bytes(i) for i in x["items"]]) for x in points.read_records(spark, str(tmp_path / "r")).collect()] == [("ab", [b"1" * 16, b"2" * 16]), ("", [])]
    (tmp_path / "k/x").write_bytes(struct.pack("<Ii", 2**32 - 1, 3) + b"pid" + struct.pack("<Ii", 1, 0))
    assert [tuple(x) for x in points.read_key_pids(spark, str(tmp_path / "k")).collect()] == [(2**32 - 1, "pid"), (1, "")]
    (tmp_path / "b/x").write_bytes(struct.pack("<4I", 7, 1, 8, 2))
    assert [tuple(x) for x in points.read_bins(spark, str(tmp_path / "b")).collect()] == [(7, 1), (8, 2)]
    (tmp_path / "m/x").write_bytes(struct.pack("<3I", 4, 2, 2) + struct.pack("<4f", 1, 2, 3, 4))
    assert [(x.row_id, x.vec) for x in points.read_matrix(spark, str(tmp_path / "m")).collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_text_files(spark, tmp_path):
    (tmp_path / "manifest").write_text(f"5\t2\t{2**64 - 1}\thttp://a\n")
    assert [tuple(r) for r in points.read_manifest(spark, str(tmp_path / "manifest")).collect()] == [(5, 2, str(2**64 - 1), "http://a")]
    (tmp_path / "names").write_text("a  b\n\nc\n")
    assert [r.name for r in points.read_names(spark, str(tmp_path / "names")).collect()] == ["a", "b", "c"]
    ranked = spark.createDataFrame([(1, 1, 9, 0.5), (1, 2, 8, 0.7), (2, 1, 3, 1.0)], "q_id long, rank int, id long, dist double")
    points.write_neighbours(ranked, str(tmp_path / "nn"))
    assert sorted(map(tuple, points.read_neighbours(spark, str(tmp_path / "nn")).collect())) == sorted(map(tuple, ranked.collect()))


def test_images(spark, tmp_path):
    tree = tmp_path / "i" / "deep"
    tree.mkdir(parents=True)
    ramp = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    (tree / "a.png").write_bytes(png(ramp))
    (tree / "b.png").write_bytes(png(np.full((64, 64), 9, np.uint8)))
    (tmp_path / "i" / "c.txt").write_text("no image")
    read = points.read_images(spark, str(tmp_path / "i"))
    got = {r.path[-5]: r for r in read.collect()}
    assert set(got) == {"a", "b"}
    assert np.frombuffer(bytes(got["a"].data), np.uint8).reshape(64, 64).tolist() == ramp.tolist()
    assert images.decode_png(png(ramp))[:, :, 0].tolist() == ramp.tolist()
    fps = {r.image_id: r.fingerprint % 2**64 for r in images.fingerprints(read).collect()}
    assert fps == {got["a"].image_id: int("f0" * 8, 16), got["b"].image_id: 0}
    assert points.files(spark, str(tmp_path / "i")).where(points.is_gif(F.col("content"))).count() == 0


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_equal_batches(spark, sf, tmp_path):
    batch = events(spark, sf)
    batch.repartition(4).write.parquet(str(tmp_path / "e"))
    stream = lambda: requests.stream_table(spark, str(tmp_path / "e"), batch.schema)
    n = requests.drain(requests.counters(stream(), "event_type"), "t_counters", "update", ["event_type"])
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in requests.counters(batch, "event_type").collect()}
    first = requests.drain(requests.first_seen(stream(), "user_id", "ts", "3650 days"), "t_first")
    assert first.count() == batch.select("user_id").distinct().count()
    w = requests.drain(requests.windowed(stream(), "ts", delay="3650 days"), "t_windows", "update", ["window"])
    assert sum(r.n for r in w.collect()) == batch.count()


def test_routing(spark, sf, tmp_path):
    batch = events(spark, sf)
    batch.write.parquet(str(tmp_path / "e"))
    kinds = [r.event_type for r in batch.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    out = {k: str(tmp_path / f"out{i}") for i, k in enumerate(kinds)}
    handlers = {k: (lambda df, p=p: df.write.mode("append").parquet(p)) for k, p in out.items()}
    requests.route(requests.stream_table(spark, str(tmp_path / "e"), batch.schema), handlers, str(tmp_path / "c"), "event_type").awaitTermination()
    for k, p in out.items():
        assert spark.read.parquet(p).count() == batch.where(F.col("event_type") == k).count()


def test_commands(spark):
    df = spark.createDataFrame([("query http://a",), ("insert http://a p",), ("delete p",), ("other x",), ("query",), ("query " + "u" * 600,)], "command string")
    got = [(r.op, r.url[:8], r.pid, r.valid) for r in requests.parse_commands(df).collect()]
    assert got == [("query", "http://a", "", True), ("insert", "http://a", "p", True), ("delete", "", "p", True),
                   ("other", "x", "", False), ("query", "", "", False), ("query", "u" * 8, "", False)]


def test_log(spark, tmp_path):
    points.write_log(spark.createDataFrame([("2024-01-01", "query", "ok", 1)], "date string, op string, outcome string, n int"), str(tmp_path / "log"))
    assert (tmp_path / "log" / "date=2024-01-01" / "op=query" / "outcome=ok").is_dir()


def test_records_over_the_wire(spark):
    rows = [(2**63, "http://a", [b"1" * 16, b"2" * 16]), (0, "", []), (5, "u" * 400, [b"x" * 16] * 200), (6, "u" * 401, []), (7, "v", [b"x" * 16] * 201)]
    sent = points.pack_wire(spark.createDataFrame([(i, f - 2**64 if f >> 63 else f, u, x) for i, (f, u, x) in enumerate(rows)], "i int, fingerprint long, url string, items array<binary>"))
    wire = {r.i: bytes(r.wire) for r in sent.collect()}
    assert wire[0] == b"record" + struct.pack("<QI", 2**63, 8) + b"http://a" + struct.pack("<I", 2) + b"1" * 16 + b"2" * 16
    cut = spark.createDataFrame([(9, wire[0][:-1]), (10, b"rekord" + wire[0][6:]), (11, b""), (12, None), (13, wire[0][:20])], "i int, wire binary")
    got = {r.i: r for r in points.parse_wire(sent.unionByName(cut)).collect()}
    assert [i for i in sorted(got) if got[i].valid] == [0, 1, 2]
    assert (got[0].fingerprint, got[0].url, [bytes(x) for x in got[0]["items"]]) == (-(2**63), "http://a", [b"1" * 16, b"2" * 16])


def test_binary_replies(spark):
    ranked = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 2 / 3, 2), (1, "c", 0.0625, 3)], "query_id long, pid string, score double, rank long")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: bytes(r.wire) for r in points.wire_replies(asked, ranked, 3).collect()}
    text = b"a\t1\nb\t0.666667\nc\t0.0625\n"
    assert got == {1: struct.pack("<2I", 3, len(text)) + text, 2: struct.pack("<2I", 3, 0)}


def test_writers(spark, tmp_path):
    p = str(tmp_path)
    pairs = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "key long, pid string").repartition(2)
    assert points.write_key_pids(pairs, p + "/k", 10).agg(F.sum("bytes")).first()[0] == 25
    assert sorted(map(tuple, points.read_key_pids(spark, p + "/k").collect())) == [(11, "a"), (12, ""), (13, "")]
    raw = spark.createDataFrame([("u", [[1.0, 2.0], [3.0, 4.0]]), ("v", [])], "url string, descs array<array<float>>")
    points.write_raw_records(raw, p + "/r")
    assert sorted((r.url, r.ord, r.desc) for r in points.read_raw_records(spark, p + "/r", 2).collect()) == [("u", 0, [1.0, 2.0]), ("u", 1, [3.0, 4.0])]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x").write_bytes(struct.pack("<4f", 1, 2, 3, 4) + b"cut")
    assert sorted(r.vec for r in points.read_descriptors(spark, p + "/b", 2).collect()) == [[1.0, 2.0], [3.0, 4.0]]
    points.write_index_conf(spark.createDataFrame([(1, 9, 4)], "min_key long, max_key long, n long"), p + "/conf")
    assert [r.value for r in spark.read.text(p + "/conf").collect()] == ["1\t9\t4"]
    images_ = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "image_id long, fingerprint string")
    points.write_by_fingerprint(images_, p + "/fp")
    assert (tmp_path / "fp" / "fingerprint=f").is_dir() and spark.read.parquet(p + "/fp").count() == 3
    from datetime import datetime
    points.write_text_log(spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5), "hello")], "ts timestamp, m string"), p + "/log", "ts", "m")
    assert [r.value for r in spark.read.text(p + "/log").collect()] == ["Tue Jan 02 03:04:05 2024\thello"]
    assert points.write_points(spark.createDataFrame([], "sketch binary, key long"), p + "/none").count() == 0


def gif(frames, palette, size, interlaced=False):
    """A GIF whose codes are never compressed: a clear code comes before the table grows."""
    w, h = size
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 1, 0, 0) + bytes(x for c in palette for x in c)
    for (x, y, fw, fh), pixels, how, clear in frames:
        out += b"\x21\xf9\x04" + bytes([how << 2 | (clear is not None), 0, 0, clear or 0, 0])
        out += b"\x2c" + struct.pack("<HHHHB", x, y, fw, fh, 0x40 if interlaced else 0) + b"\x02"
        bits = "".join(f"{c:03b}"[::-1] for p in pixels for c in (4, p)) + f"{5:03b}"[::-1]
        data = bytes(int(bits[k:k + 8][::-1], 2) for k in range(0, len(bits), 8))
        out += b"".join(bytes([len(data[k:k + 255])]) + data[k:k + 255] for k in range(0, len(data), 255)) + b"\0"
    return out + b"\x3b"


def test_frames(spark, tmp_path):
    red, green, blue, white = palette = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)]
    bgr = lambda rows: [[list(palette[p][::-1]) for p in r] for r in rows]
    first = ((0, 0, 3, 2), [0, 1, 2, 3, 0, 1], 0, None)
    got = images.decode_gif(gif([first, ((1, 0, 2, 1), [3, 2], 2, 2), ((0, 1, 1, 1), [1], 0, None)], palette, (3, 2)))
    assert got[0].tolist() == bgr([[0, 1, 2], [3, 0, 1]])
    assert got[1].tolist() == bgr([[0, 3, 2], [3, 0, 1]])  # blue is see-through there
    assert got[2].tolist() == [[list(red[::-1]), [0, 0, 0], [0, 0, 0]], *bgr([[1, 0, 1]])]  # the second frame was cleared
    order = [0, 4, 2, 1, 3]  # rows of an interlaced frame of five
    tall = images.decode_gif(gif([((0, 0, 1, 5), [order[k] % 4 for k in range(5)], 0, None)], palette, (1, 5), True))
    assert tall[0][:, 0].tolist() == [list(palette[k % 4][::-1]) for k in range(5)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "many.gif").write_bytes(gif([first] * 13, palette, (3, 2)))
    (tmp_path / "f" / "one.png").write_bytes(png(np.full((4, 5), 7, np.uint8)))
    (tmp_path / "f" / "cut.gif").write_bytes(gif([first], palette, (3, 2))[:30])
    (tmp_path / "f" / "text").write_text("no picture")
    rows = points.read_frames(spark, str(tmp_path / "f")).collect()
    assert sorted((r.path[-8:], r.frame, r.width, r.height, r.channels) for r in rows if "cut" not in r.path) == sorted(
        [("many.gif", k, 3, 2, 3) for k in range(10)] + [("/one.png", 0, 5, 4, 1)])


def test_compressed_frames():
    """Codes that refer to the entry being made, and tables that grow to twelve bits, against a plain encoder."""
    r = random.Random(2)
    pixels = [r.choice([0, 0, 0, 1, 2]) for _ in range(30_000)]
    table, codes, word, width = {bytes([i]): i for i in range(4)}, [], b"", 3
    n, bits = 6, [f"{4:03b}"[::-1]]
    for p in pixels:
        if word + bytes([p]) in table:
            word += bytes([p])
            continue
        bits.append(f"{table[word]:0{width}b}"[::-1])
        if n < 4096:
            table[word + bytes([p])] = n
            n += 1
            if n > 1 << width and width < 12:
                width += 1
        word = bytes([p])
    bits.append(f"{table[word]:0{width}b}"[::-1])
    flat = "".join(bits)
    data = bytes(int(flat[k:k + 8][::-1], 2) for k in range(0, len(flat), 8))
    assert images._lzw(data, 2, len(pixels)).tolist() == pixels


def test_server_config():
    from kindred.sources.config import parse_server_config
    c = parse_server_config("9000\nhost1 1\nhost2 2\nhost3")
    assert (c.port, c.servers) == (9000, (("host1", 1), ("host2", 2)))


def test_keypoints_of_known_blobs():
    """A Gaussian blob of deviation s is an extremum at its centre, at a scale near s; turning the image turns the keypoint."""
    from kindred.operators import sift
    y, x = np.mgrid[0:97, 0:97]  # odd, so that even places stay even when turned
    for cx, cy, s in ((40, 50, 4.0), (52, 44, 6.0)):
        image = 200 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2 + 0.6 * (x - cx) * (y - cy)) / (2 * s * s))
        found = [f for f in sift.describe(image) if abs(f[0] - cx) < 1.5 and abs(f[1] - cy) < 1.5]
        assert found and min(abs(np.log2(f[2] / s)) for f in found) < 0.6
        turned = [f for f in sift.describe(np.rot90(image).copy()) if abs(f[0] - cy) < 1.5 and abs(f[1] - (96 - cx)) < 1.5]
        assert turned and min(sift.distance(f[4], g[4]) for f in found for g in turned) < 0.2
    assert sift.place_keypoint(40, 52, 1.6, 4) == (0, 0, 40, 52, 0.0)
    octave, level, column, row, exact = sift.place_keypoint(41, 52, 1.6 * 2 ** (1 + 2 / 3), 4)
    assert (octave, level, column, row) == (1, 2, 21, 26) and abs(exact - 2) < 1e-9
    assert sift.place_keypoint(8, 8, 100, 2)[:2] == (1, 2) and sift.place_keypoint(8, 8, 0.1, 2)[:2] == (0, 0)


def test_smoothing_and_histogram_against_plain_sums():
    from kindred.operators import sift
    image = np.random.default_rng(0).random((12, 10)) * 255
    k = np.exp(-0.5 * (np.arange(-5, 6) / 1.2) ** 2)
    k /= k.sum()
    want = sum(k[i + 5] * k[j + 5] * image[np.clip(np.arange(12) + i, 0, 11)][:, np.clip(np.arange(10) + j, 0, 9)] for i in range(-5, 6) for j in range(-5, 6))
    assert np.allclose(sift._smooth(image, 1.2), want)
    import colorsys
    pixels = np.random.default_rng(1).integers(0, 256, (6, 7, 3), dtype=np.uint8)
    hist = np.zeros((6, 6))
    for b, g, r in pixels.reshape(-1, 3).tolist():
        h, s, _ = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        hist[min(int(h * 180 * 6 / 180 + 1e-9), 5), min(int(s * 6 + 1e-9), 6) if s < 1 else 6 - 1] += s < 1
    assert np.allclose(images.hue_saturation(pixels) * hist.sum(), hist.ravel())


def png_of(lines, width, height, depth, colour, interlaced=0, palette=b""):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines))) + chunk(b"IEND", b"")


def test_png_depths_and_passes():
    assert images.decode_png(png_of([b"\xa0", b"\x40"], 3, 2, 1, 0))[:, :, 0].tolist() == [[255, 0, 255], [0, 255, 0]]
    assert images.decode_png(png_of([b"\x1b"], 4, 1, 2, 0))[:, :, 0].tolist() == [[0, 85, 170, 255]]
    assert images.decode_png(png_of([b"\x0f\x80"], 3, 1, 4, 0))[:, :, 0].tolist() == [[0, 255, 136]]
    assert images.decode_png(png_of([b"\x12\x34\xff\x00"], 2, 1, 16, 0))[:, :, 0].tolist() == [[0x12, 0xff]]
    assert images.decode_png(png_of([b"\x1b"], 4, 1, 2, 3, palette=bytes(range(12)))).tolist() == [[[2, 1, 0], [5, 4, 3], [8, 7, 6], [11, 10, 9]]]
    r = np.random.default_rng(0)
    for w, h in ((9, 7), (1, 1), (5, 3), (8, 8)):
        pixels = r.integers(0, 256, (h, w, 3), dtype=np.uint8)
        parts = [pixels[y::b, x::a] for x, y, a, b in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))]
        lines = [row.tobytes() for p in parts if p.size for row in p]
        assert images.decode_png(png_of(lines, w, h, 8, 2, 1)).tolist() == pixels[:, :, ::-1].tolist()
