"""EXIF tags of JPEG and WebP files and pixel sizes, read inside tasks by walking headers.

A row is a path, whose file is opened in the task and walked from header to header, so
little more than its first bytes is read; or, where there is a column ``content``, those
bytes. Only raw tags and sizes are read in Python; dates, places and offsets come from Column
functions (``exif_values``). What can't be walked gives a row with ``readable`` false, or
with dims_error; a file that can't be opened is ``unreadable``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filelens.functions.media import container_of, decimal_degrees, real_place
from filelens.functions.paths import basename
from filelens.functions.times import camera_clock, first_clock, offset_seconds
from filelens.sources.ranges import Ranges, opened

# The tags that are read, and the bytes of a value of each type.
TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "date_time", 0x9003: "date_original", 0x9004: "date_digitized", 0x9011: "offset_original", 0x829A: "exposure", 1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
BELOW = (0x8769, 0x8825)
TEXTS = ("make", "model", "software", "date_time", "date_original", "date_digitized", "offset_original", "lat_ref", "lon_ref")
SCHEMA = "path string, readable boolean, " + ", ".join(f"{t} string" for t in TEXTS) + ", lat array<double>, lon array<double>, exposure double"


def exif_block(file: Ranges) -> bytes | None:
    """The TIFF block of a JPEG's APP1 segment or a WebP's EXIF chunk."""
    start = file.read(0, 12)
    if start[:2] == b"\xff\xd8":
        at = 2
        while len(h := file.read(at, 10)) >= 4 and h[0] == 0xFF and h[1] != 0xDA:
            size = int.from_bytes(h[2:4], "big")
            if h[1] == 0xE1 and h[4:] == b"Exif\0\0":
                return file.read(at + 10, max(0, size - 8))
            at += 2 + size
    elif start[:4] == b"RIFF" and start[8:] == b"WEBP":
        at = 12
        while len(h := file.read(at, 8)) == 8:
            size = int.from_bytes(h[4:], "little")
            if h[:4] == b"EXIF":
                return file.read(at + 8, size).removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
    return None


def tags_of(file: Ranges) -> dict | None:
    """Raw tags by name; None where there is no block or it can't be walked."""
    block = exif_block(file)
    if not block or block[:2] not in (b"II", b"MM"):
        return None
    order, out = "<" if block[:2] == b"II" else ">", {}
    try:
        todo, seen = [struct.unpack_from(order + "I", block, 4)[0]], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for i in range(struct.unpack_from(order + "H", block, at)[0]):
                tag, kind, n, value = struct.unpack_from(order + "HHII", block, at + 2 + 12 * i)
                if tag in BELOW:
                    todo.append(value)
                elif (name := TAGS.get(tag)) and kind in SIZES:
                    place = at + 2 + 12 * i + 8 if SIZES[kind] * n <= 4 else value
                    if place + SIZES[kind] * n > len(block):
                        continue  # a damaged count or place
                    if kind == 2:
                        out.setdefault(name, block[place : place + n].decode("ascii", "replace").strip("\0 "))
                    elif kind == 5:
                        pairs = struct.unpack_from(order + "II" * n, block, place)
                        out.setdefault(name, [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)])
    except (struct.error, UnicodeDecodeError):
        return None
    return out


@contextmanager
def _ranges(path: str | None, content: bytes | None, in_place: bool) -> Iterator[Ranges]:
    if not in_place:
        yield Ranges(content or b"", len(content or b""))
    elif path is None:
        raise OSError("no path")
    else:
        with opened(path) as file:
            yield file


def _walked(files: DataFrame, schema: str, values: Callable[[Ranges | None], tuple]) -> DataFrame:
    """path and the ``values`` of each file, in the columns that ``schema`` declares; None stands for a file that can't be opened."""
    in_place = "content" not in files.columns
    fields = T._parse_datatype_string(schema)

    def one(path: str | None, content: bytes | None) -> tuple:
        try:
            with _ranges(path, content, in_place) as file:
                return values(file)
        except OSError:
            return values(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(fields)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            contents = [None] * len(paths) if in_place else batch.column("content").to_pylist()
            rows = [(p, *one(p, c)) for p, c in zip(paths, contents, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return files.select("path", *([] if in_place else ["content"])).mapInArrow(run, schema)


def _tag_values(file: Ranges | None) -> tuple:
    tags = tags_of(file) if file else None
    found = tags or {}
    text = lambda n: found[n] if isinstance(found.get(n), str) else None
    numbers = lambda n: found[n] if isinstance(found.get(n), list) else None
    return tags is not None, *map(text, TEXTS), numbers("lat"), numbers("lon"), (numbers("exposure") or [None])[0]


def exif_tags(files: DataFrame) -> DataFrame:
    """files (path, and perhaps content) with the raw tags of each."""
    return _walked(files, SCHEMA, _tag_values)


def exif_values(tags: DataFrame, *keep: str) -> DataFrame:
    """What raw tags say: taken (the first of three dates that parses), clock (the original date alone), offset_seconds, place, and has_date, has_gps; and the columns ``keep``."""

    def degrees(name: str):
        parts = F.col(name)
        return F.when(F.size(parts) >= 3, decimal_degrees(parts[0], parts[1], parts[2], F.coalesce(f"{name}_ref", F.lit(""))))

    rows = tags.withColumns({"latitude": degrees("lat"), "longitude": degrees("lon")})
    place = F.coalesce(real_place(F.col("latitude"), F.col("longitude")), F.lit(False))
    taken = first_clock(F.col("date_original"), F.col("date_digitized"), F.col("date_time"))
    return rows.select(
        "path",
        "readable",
        "make",
        "model",
        "software",
        "exposure",
        taken.alias("taken"),
        camera_clock(F.col("date_original")).alias("clock"),
        offset_seconds(F.col("offset_original"), strict=False).alias("offset_seconds"),
        F.when(place, F.col("latitude")).alias("latitude"),
        F.when(place, F.col("longitude")).alias("longitude"),
        taken.isNotNull().alias("has_date"),
        place.alias("has_gps"),
        *keep,
    )


#: Containers without a still frame: their dimensions are not asked for.
NO_PIXELS = ("mov", "mp4", "unknown", "unreadable")
#: JPEG markers of frames, which hold height and width.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def pixel_size(file: Ranges) -> tuple[int, int]:
    """Width and height from the headers of a PNG, GIF, JPEG, WebP, TIFF or BMP; ValueError where they don't say."""
    data = file.read(0, 32)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack_from("<HH", data, 6)
    if data[:2] == b"\xff\xd8":
        at = 2
        while len(h := file.read(at, 9)) == 9 and h[0] == 0xFF:
            if h[1] in FRAMES:
                height, width = struct.unpack_from(">HH", h, 5)
                return width, height
            at += 2 + int.from_bytes(h[2:4], "big")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 ":
            width, height = struct.unpack_from("<HH", data, 26)
            return width & 0x3FFF, height & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff_size(file, "<" if data[:1] == b"I" else ">")
    if data[:2] == b"BM" and len(data) >= 26:
        if struct.unpack_from("<I", data, 14)[0] == 12:  # the oldest header has short sizes
            return struct.unpack_from("<HH", data, 18)
        width, height = struct.unpack_from("<ii", data, 18)
        return width, abs(height)  # negative: rows from the top
    raise ValueError("no dimensions in the header")


def _tiff_size(file: Ranges, order: str) -> tuple[int, int]:
    """From the first directory, wherever in the file it is."""
    try:
        at = struct.unpack(order + "I", file.read(4, 4))[0]
        n = struct.unpack(order + "H", file.read(at, 2))[0]
        entries, found = file.read(at + 2, 12 * n), {}
        for i in range(n):
            tag, kind, _ = struct.unpack_from(order + "HHI", entries, 12 * i)
            if tag in (256, 257) and kind in (3, 4):
                found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), entries, 12 * i + 8)[0]
        return found[256], found[257]
    except (struct.error, KeyError):
        raise ValueError("no dimensions in the first directory") from None


SIGNALS = SCHEMA + ", head binary, px_width int, px_height int, px_error string"


def _signal_values(file: Ranges | None) -> tuple:
    if file is None:
        return *_tag_values(None), None, None, None, None
    try:
        size = (*pixel_size(file), None)
    except ValueError as e:
        size = None, None, f"{type(e).__name__}: {e}"[:120]
    return *_tag_values(file), file.read(0, 64), *size


def media_signals(files: DataFrame) -> DataFrame:
    """files (path, and perhaps content) with what classification reads: name, container, width, height, make, model, software, exposure, gps, dims_error."""
    if "content" in files.columns:
        missing = files.filter("content IS NULL").select("path")
        rows = _walked(files.filter("content IS NOT NULL"), SIGNALS, _signal_values)
        rows = rows.unionByName(missing, allowMissingColumns=True)
    else:
        rows = _walked(files, SIGNALS, _signal_values)
    values = exif_values(rows, "head", "px_width", "px_height", "px_error")
    container = F.when(F.col("head").isNull(), "unreadable").otherwise(container_of(F.col("head")))
    still = ~F.col("container").isin(*NO_PIXELS) | (F.substring("head", 1, 2) == F.lit(b"BM"))
    asked = lambda c: F.when(still, F.col(c))
    return values.withColumn("container", container).select(
        "path", basename(F.col("path")).alias("name"), "container", asked("px_width").alias("width"), asked("px_height").alias("height"), "make", "model", "software",
        (F.coalesce("exposure", F.lit(0.0)) != 0).alias("exposure"), F.col("has_gps").alias("gps"), asked("px_error").alias("dims_error"),
    )
