"""Entries of zip archives, read inside tasks.

Each archive's directory is read once, by one task, into a table of entries: where an
entry's bytes begin and how they are packed. The rows of that table are then dealt out in
runs, so a large archive is read by many tasks, and a task seeks to its entries without
the directory. ``read_entries(spark, glob)`` gives one row for each stored file:
archive_path, ordinal, entry_path, size, content, error. An entry that can't be read is a row
with an error, and so is an archive that can't be opened.

Archives must be mounted at the same place on the driver and on every executor.
"""

from __future__ import annotations

import bz2
import glob
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.storage import stored

ENTRIES = "archive_path string, ordinal bigint, entry_path string, size bigint, content binary, error string"
DIRECTORY = "archive_path string, ordinal bigint, entry_path string, size bigint, at bigint, packed bigint, method int, crc bigint, locked boolean, error string"
# A local header's signature, its length, and where the lengths of name and extra field stand in it.
LOCAL, LOCAL_SIZE, LENGTHS = b"PK\x03\x04", 30, 26


def directory_of(path: str) -> list[tuple]:
    """The entries of one archive but folders; one row with an error where it can't be opened."""
    try:
        with zipfile.ZipFile(path) as z:
            return [(path, n, i.filename, i.file_size, i.header_offset, i.compress_size, i.compress_type, i.CRC, bool(i.flag_bits & 1), None) for n, i in enumerate(z.infolist()) if not i.is_dir()]
    except (OSError, zipfile.BadZipFile) as e:
        return [(path, 0, *[None] * 7, f"unreadable: {e}"[:200])]


def directories(spark: SparkSession, pattern: str) -> DataFrame:
    """The entry table of the archives that match: a task for some of them reads each directory once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        fields = [f.split(" ") for f in DIRECTORY.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = directory_of(path)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])

    paths = sorted(glob.glob(pattern))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 16))
    return listed.mapInArrow(read, DIRECTORY)


def unpacked(data: bytes, method: int) -> bytes:
    """Bytes as they were before packing; an error for methods that aren't known."""
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -15)
    if method == zipfile.ZIP_BZIP2:
        return bz2.decompress(data)
    if method == zipfile.ZIP_LZMA:
        size = struct.unpack_from("<H", data, 2)[0]  # a version, and how long the properties are
        kept = lzma._decode_filter_properties(lzma.FILTER_LZMA1, data[4 : 4 + size])
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[kept]).decompress(data[4 + size :])
    raise NotImplementedError(f"method {method}")


def content_of(file, at: int, packed: int, method: int, crc: int, locked: bool) -> bytes | None:
    """An entry's bytes, by its place in the open archive; None where they are damaged or locked."""
    try:
        file.seek(at)
        header = file.read(LOCAL_SIZE)
        if locked or header[:4] != LOCAL:
            return None
        name, extra = struct.unpack_from("<HH", header, LENGTHS)
        file.seek(at + LOCAL_SIZE + name + extra)
        data = unpacked(file.read(packed), method)
    except (OSError, EOFError, ValueError, NotImplementedError, struct.error, lzma.LZMAError, zlib.error):
        return None
    return data if zlib.crc32(data) == crc else None


def read_entries(spark: SparkSession, pattern: str, content: bool = True, step: int = 256) -> DataFrame:
    """Entries of the archives that match, about ``step`` a task; without content only directories are read."""
    table = directories(spark, pattern)
    if not content:
        return table.select("archive_path", "ordinal", "entry_path", "size", "error")
    table = stored(table, "entry-table")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            for r in batch.to_pylist():
                found, error = None, r["error"]
                if error is None:
                    if r["archive_path"] != path:
                        if file:
                            file.close()
                        path, file = r["archive_path"], open(r["archive_path"], "rb")  # noqa: SIM115  # entries of one archive follow each other
                    found = content_of(file, r["at"], r["packed"], r["method"], r["crc"], r["locked"])
                    error = None if found is not None else "corrupt"
                values = (r["archive_path"], r["ordinal"], r["entry_path"], r["size"], found, error)
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[f.split(" ")[0] for f in ENTRIES.split(", ")])
        if file:
            file.close()

    tasks = max(1, -(-table.count() // step))
    return table.repartitionByRange(tasks, "archive_path", "ordinal").sortWithinPartitions("archive_path", "ordinal").mapInArrow(read, ENTRIES)


def skip_known(entries: DataFrame, known: DataFrame) -> DataFrame:
    return entries.join(known.select("archive_path", "entry_path").distinct(), ["archive_path", "entry_path"], "left_anti")


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("archive_path").agg(F.count("entry_path").alias("entries"))
