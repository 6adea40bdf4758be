"""Images: decoding, gray and area-resized pixels, fingerprints, colour histograms, SIFT features.

An image row holds width, height, channels and its bytes row by row from the top, as Spark's
``image`` source gives them (BGR). Work on pixels is numpy in Arrow batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sift

HELD_IMAGES = 256  # of many sizes, until one has a stack
FINGERPRINTS = ("rows", "mean", "sum", "nibbles")


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of BGR(A) pixels; two channels or one keep the first."""
    if pixels.shape[2] <= 2:
        return pixels[:, :, 0].astype(np.uint8)
    return np.rint(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])).clip(0, 255).astype(np.uint8)


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each new pixel is the mean of the old area that it covers."""
    def weights(old, new):
        edges = np.linspace(0, old, new + 1)
        cover = np.minimum(edges[1:, None], np.arange(1, old + 1)) - np.maximum(edges[:-1, None], np.arange(old))
        cover = cover.clip(0)
        return cover / cover.sum(axis=1, keepdims=True)
    out = weights(image.shape[0], height) @ image.astype(float) @ weights(image.shape[1], width).T
    return np.rint(np.round(out, 9)).clip(0, 255).astype(np.uint8)


def fingerprint(image: np.ndarray, kind: str = "rows") -> int:
    """64 unsigned bits of a gray image.

    rows: 8 x 12, the first 8 rows, bit i * 8 + j if above their mean. mean: 8 x 12, rows 0 to 6 at or
    above their mean, then 8 bits of the mean. sum: 8 x 6, 5 rows at or above the mean in the
    upper 40 bits, the low 16 bits of the pixel sum below. nibbles: 4 x 5, the upper 4 bits of 4 x 4 pixels.
    """
    if kind == "rows":
        p = area_resize(image, 8, 12)[:8].astype(int).ravel()
        return sum(1 << k for k in np.flatnonzero(p > p.sum() // 64).tolist())
    if kind == "mean":
        p = area_resize(image, 8, 12)[:7].astype(int).ravel()
        mean = int(p.sum()) // 56
        return sum(1 << k for k in np.flatnonzero(p >= mean).tolist()) | mean << 56
    if kind == "sum":
        p = area_resize(image, 8, 6)[:5].astype(int).ravel()
        total = int(p.sum())
        return sum(1 << (24 + k) for k in np.flatnonzero(p >= total // 40).tolist()) | total & 0xFFFF
    p = (area_resize(image, 4, 5)[:4].astype(int) >> 4).ravel()
    return int("".join(f"{x:x}" for x in p.tolist()), 16)


def hue_saturation(pixels: np.ndarray, bins: int = 6) -> np.ndarray:
    """bins x bins histogram of hue [0, 180) and saturation [0, 255), summing to 1."""
    b, g, r = (pixels[:, :, k].astype(float) for k in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = np.where(top > low, top - low, 1)
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span))
    hue = np.where(top > low, hue * 30 % 180, 0)
    sat = np.where(top > 0, (top - low) / np.where(top > 0, top, 1) * 255, 0)
    h, s = (hue * bins / 180).astype(int), (sat * bins / 255).astype(int)
    inside = (s < bins) & (h < bins)
    out = np.bincount(h[inside] * bins + s[inside], minlength=bins * bins).astype(float)
    return out / max(out.sum(), 1)


def fit_size(width: int, height: int, most: int = 120, short_side: int = 100, ratio: int = 4) -> tuple[int, int]:
    """functions.text.resized for one image."""
    long, short = max(width, height), min(width, height)
    if long <= most or long // short >= 100:
        return width, height
    a, b = (long // short * short_side, short_side) if long // short > ratio else (most, short * most // long)
    return (a, b) if width >= height else (b, a)


def scaled(image: np.ndarray, ratio: float) -> np.ndarray:
    return area_resize(image, max(1, int(image.shape[1] * ratio)), max(1, int(image.shape[0] * ratio)))


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned by degrees modulo 180 on a canvas that holds all of it; nearest pixels, black around."""
    t = np.deg2rad(degrees % 180)
    c, s = np.cos(t), np.sin(t)
    h, w = image.shape
    new_h, new_w = (int(np.ceil(round(a, 6))) for a in (abs(h * c) + abs(w * s), abs(h * s) + abs(w * c)))
    y, x = np.mgrid[0:new_h, 0:new_w]
    y, x = y - (new_h - 1) / 2, x - (new_w - 1) / 2
    from_x, from_y = np.rint(c * x + s * y + (w - 1) / 2).astype(int), np.rint(-s * x + c * y + (h - 1) / 2).astype(int)
    inside = (from_x >= 0) & (from_x < w) & (from_y >= 0) & (from_y < h)
    out = np.zeros((new_h, new_w), image.dtype)
    out[inside] = image[from_y[inside], from_x[inside]]
    return out


def _png_lines(raw: bytes, at: int, height: int, line_bytes: int, pixel_bytes: int) -> tuple[np.ndarray, int]:
    """Unfiltered lines of one pass from place ``at``, and the place after them."""
    step = max(1, pixel_bytes)
    rows = np.frombuffer(raw, np.uint8, height * (1 + line_bytes), at).reshape(height, 1 + line_bytes)
    out = np.zeros((height, line_bytes), np.uint8)
    for y in range(height):
        line, above = rows[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(line_bytes, int)
        kind = rows[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + above) & 255
        else:
            cur = out[y]
            for x in range(line_bytes):
                left = int(cur[x - step]) if x >= step else 0
                corner = int(above[x - step]) if x >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                cur[x] = (line[x] + guess) & 255
    return out, at + height * (1 + line_bytes)


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels, BGR order) of a PNG of any depth and colour type, interlaced or not.

    Depths below 8 are spread over 0..255, unless they number a palette; of 16 bits the upper 8 are kept.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette = 8, b"", None
    while at < len(data):
        n, kind = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8]
        body = data[at + 8:at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = (
                int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), *body[8:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, at, image = zlib.decompress(packed), 0, np.zeros((height, width, channels), np.uint8)
    # first column and row of each pass, and the steps to the next; the seven passes of an interlaced image
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if interlaced else ((0, 0, 1, 1),)
    for x0, y0, dx, dy in passes:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        lines, at = _png_lines(raw, at, h, -(-w * channels * depth // 8), channels * depth // 8)
        if depth == 16:
            lines = lines[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1])
            lines = bits[:, :w] if colour == 3 else bits[:, :w] * 255 // ((1 << depth) - 1)
        image[y0::dy, x0::dx] = lines.reshape(h, w, channels)
    if colour == 3:
        image = palette[image[:, :, 0]]
    return image[:, :, ::-1] if image.shape[2] == 3 else image[:, :, [2, 1, 0, 3]] if image.shape[2] == 4 else image


#: Frames of an animation that are looked at.
MOST_FRAMES = 10


def _lzw(data: bytes, least: int, pixels: int) -> np.ndarray:
    """Colour numbers of a GIF frame: codes of growing width, lowest bit first."""
    clear, out = 1 << least, bytearray()
    table: list[bytes] = []
    width, before, bits, held, at = least + 1, None, 0, 0, 0
    while len(out) < pixels:
        while bits < width:
            if at == len(data):
                return np.frombuffer(bytes(out.ljust(pixels, b"\0")), np.uint8)
            held |= data[at] << bits
            bits, at = bits + 8, at + 1
        code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
        if code == clear or not table:
            table = [bytes([i]) for i in range(clear)] + [b"", b""]
            width, before = least + 1, None
            if code == clear:
                continue
        if code == clear + 1:
            break
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
        out += entry
        before = entry
    return np.frombuffer(bytes(out[:pixels].ljust(pixels, b"\0")), np.uint8)


def decode_gif(data: bytes, most: int = MOST_FRAMES) -> list[np.ndarray]:
    """The first ``most`` frames of a GIF as whole pictures (height, width, 3), BGR.

    Frames are drawn over one another; see-through pixels keep what is below, and a frame may ask to be cleared.
    """
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, common, frames = 13, None, []

    def colours(n, where):
        return np.frombuffer(data, np.uint8, 3 * n, where).reshape(-1, 3)[:, ::-1]

    if flags & 0x80:
        common = colours(2 << (flags & 7), at)
        at += 3 * (2 << (flags & 7))
    canvas, clear_with, see_through = np.zeros((height, width, 3), np.uint8), 0, None
    while at < len(data) and len(frames) < most:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                clear_with, see_through = data[at + 3] >> 2 & 7, data[at + 6] if data[at + 3] & 1 else None
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        elif kind == 0x2C:
            x, y, w, h = (int.from_bytes(data[at + k:at + k + 2], "little") for k in (1, 3, 5, 7))
            own, at = data[at + 9], at + 10
            palette = common
            if own & 0x80:
                palette = colours(2 << (own & 7), at)
                at += 3 * (2 << (own & 7))
            least, at, packed = data[at], at + 1, b""
            while data[at]:
                packed += data[at + 1:at + 1 + data[at]]
                at += data[at] + 1
            at += 1
            number = _lzw(packed, least, w * h).reshape(h, w)
            if own & 0x40:  # rows come in four passes
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                number = number[np.argsort(order)]
            below = canvas.copy()
            part = canvas[y:y + h, x:x + w]
            number = number[:part.shape[0], :part.shape[1]]
            drawn = number != see_through if see_through is not None else np.ones(number.shape, bool)
            part[drawn] = palette[number[drawn]]
            frames.append(canvas.copy())
            if clear_with == 2:
                part[:] = 0
            elif clear_with == 3:
                canvas = below
            clear_with, see_through = 0, None
        else:
            break
    return frames


def frames(files: DataFrame, most: int = MOST_FRAMES) -> DataFrame:
    """(image_id, path, frame, width, height, channels, data) of files(path, content): GIFs with up to ``most`` frames, PNGs with one.

    Other files and broken ones give nothing. The frames of one file share its image_id.
    """
    def pictures(content):
        try:
            return decode_gif(content, most) if content[:3] == b"GIF" else [decode_png(content)]
        except (ValueError, IndexError, TypeError, KeyError, UnboundLocalError, zlib.error):
            return []

    def run(batches):
        for b in batches:
            rows = [(i, p, n, *x.shape[1::-1], x.shape[2], np.ascontiguousarray(x).tobytes())
                    for i, p, c in zip(*(b.column(k).to_pylist() for k in range(3))) for n, x in enumerate(pictures(c))]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)],
                                             names=["image_id", "path", "frame", "width", "height", "channels", "data"])

    return files.select(F.xxhash64("path"), "path", "content").mapInArrow(
        run, "image_id bigint, path string, frame int, width int, height int, channels int, data binary")


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])


def _kinds(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    return [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema)]


def _per_image(images: DataFrame, schema: str, names: list[str], compute) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [out for row in b.to_pylist() for out in compute(row)]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    kinds = _kinds(schema)
    return images.select("image_id", "width", "height", "channels", "data").mapInArrow(run, schema)


def fingerprints(images: DataFrame, kind: str = "rows") -> DataFrame:
    """(image_id, fingerprint), the 64 bits as a signed long."""
    def compute(row):
        f = fingerprint(gray(_pixels(row)), kind)
        yield row["image_id"], f - (1 << 64) if f >> 63 else f
    return _per_image(images, "image_id bigint, fingerprint bigint", ["image_id", "fingerprint"], compute)


def colour_histograms(images: DataFrame, bins: int = 6) -> DataFrame:
    def compute(row):
        p = _pixels(row)
        yield row["image_id"], hue_saturation(p if p.shape[2] >= 3 else np.repeat(p[:, :, :1], 3, axis=2), bins).tolist()
    return _per_image(images, "image_id bigint, histogram array<double>", ["image_id", "histogram"], compute)


def _stacks(batches, most: int, least: int):
    """(image ids, factors back to their own widths, stack) of resized gray images of one size, few enough to be described at once."""
    open_ = {}
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            w, h = fit_size(row["width"], row["height"], most)
            if min(w, h) < least:
                continue
            image = gray(_pixels(row))
            if (w, h) != image.shape[::-1]:
                image = area_resize(image, w, h)
            held = open_.setdefault((w, h), [])
            held.append((row["image_id"], row["width"] / w, image))
            if (len(held) + 1) * w * h > sift.STACK_PIXELS:
                yield open_.pop((w, h))
            elif sum(len(z) for z in open_.values()) >= HELD_IMAGES:
                yield open_.pop(max(open_, key=lambda size: len(open_[size])))
    yield from open_.values()


def features(images: DataFrame, most: int = 120, least: int = 50) -> DataFrame:
    """(image_id, ord, x, y, size, dir, desc): SIFT features of the resized gray image.

    Images with a side below ``least`` pixels after resizing have none. Images are dealt to all tasks first, as the
    work costs far more than moving them.
    """
    def run(batches):
        for held in _stacks(batches, most, least):
            ids, scale, stack = (np.array(z) for z in zip(*held))
            of, x, y, size, turn, desc = sift.describe_stack(stack.astype(float))
            ord_ = np.arange(len(of)) - np.searchsorted(of, of)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * 128, pa.int32()), pa.array(desc.ravel()), type=kinds[-1])
            plain = (ids[of], ord_, x * scale[of], y * scale[of], size * scale[of], turn)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds)), flat], names=names)

    names = ["image_id", "ord", "x", "y", "size", "dir", "desc"]
    schema = "image_id bigint, ord int, x double, y double, size double, dir double, desc array<double>"
    kinds = _kinds(schema)
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = images.select("image_id", "width", "height", "channels", "data")
    return rows.repartition(parts, "image_id").mapInArrow(run, schema)
