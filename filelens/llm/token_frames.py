"""Token-id files: one independent zstandard frame a document, and a seek table.

A file holds, in ascending doc_id order,

* one frame for each document: its ids as little-endian unsigned 32-bit integers,
  with the frame's own content checksum;
* one frame with the index: the doc_ids (8 bytes each), then a byte each that
  is 1 where the doc_id is null;
* a skippable frame with the seek table of the public seekable format: for every
  frame its compressed size, its size and the low half of its XXH64, 4 bytes
  each; at the very end the number of frames, a descriptor byte and a magic
  number.

So a reader fetches the end of a file, then only the frames it was asked for.
Tasks write under a name of their own attempt and rename at the end: a lost
executor's tasks are written again, and a second attempt changes nothing.

Results: null texts are empty, so they hold the end id alone. Null doc_ids come
first; rows with equal doc_id follow each other in the order of their texts. An
empty table gives no files and an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.llm.common import materialize, new_path
from filelens.llm.common_arrow import give_back, steps, worker_state
from filelens.llm.pieces import HAS_SPACE, PieceTable, text_groups

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER, ENTRY = struct.Struct("<IBI"), struct.Struct("<III")
KEPT, GROUP_BYTES = 500_000, 8 << 20  # pieces of a worker; texts encoded at once
MANIFEST = "file_no long, name string, n_docs long, n_tokens long, n_bytes long"


class LibraryEncoder:
    """The tokenizers library behind a table of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line_end = self._whole("\n")
        self.encode = PieceTable(special, self._new, self._whole, KEPT).encode

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Pieces without white space inside go to the library as lines of one text, the others one by one."""
        lines = [p for p in pieces if p and not HAS_SPACE.search(p, 1) and p != "\n" and p != " "]
        found = {}
        if len(self.line_end) == 4:
            for at in range(0, len(lines), 8192):
                part = lines[at : at + 8192]
                ids = np.frombuffer(self._whole("\n".join(part)), dtype="<u4")
                ends = np.append(np.flatnonzero(ids == np.frombuffer(self.line_end, dtype="<u4")), len(ids))
                if len(ends) == len(part):
                    data, begin = ids.tobytes(), 0
                    for p, end in zip(part, (4 * ends).tolist(), strict=True):
                        found[p] = data[begin:end]
                        begin = end + 4
        return [found[p] if p in found else self._whole(p) for p in pieces]


def task_encoder(path: str) -> LibraryEncoder:
    """One encoder for each Python worker and vocabulary file, kept from task to task with what it has looked up."""
    with open(path, "rb") as f:
        name = "library " + hashlib.file_digest(f, "sha256").hexdigest()
    return worker_state(name, lambda: LibraryEncoder(path))


class FrameWriter:
    """Writes one file to an open stream."""

    def __init__(self, stream, level: int = 1):
        import zstandard

        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.entries, self.ids, self.nulls, self.n_tokens, self.n_bytes = [], [], bytearray(), 0, 0

    def _put(self, data: bytes) -> None:
        import xxhash

        frame = self.pack(data)
        self.entries.append(ENTRY.pack(len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.stream.write(frame)
        self.n_bytes += len(frame)

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self._put(packed)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.n_tokens += len(packed) // 4

    def close(self) -> None:
        self._put(np.array(self.ids, dtype="<i8").tobytes() + bytes(self.nulls))
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.n_bytes += 8 + len(table)


class FrameReader:
    """Reads documents of one open, seekable file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        n, _, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        length = n * ENTRY.size
        self.table = np.frombuffer(self._at(size - FOOTER.size - length, length), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(n - 1)
        self.n_docs = n - 1
        self.null = np.frombuffer(index[8 * self.n_docs :], dtype=np.uint8)
        self.doc_ids = [None if z else int(i) for i, z in zip(np.frombuffer(index[: 8 * self.n_docs], dtype="<i8"), self.null, strict=True)]
        self.n_tokens = self.table[: self.n_docs, 1] // 4

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def frame(self, i: int) -> bytes:
        import xxhash

        data = self.unpack(self._at(int(self.offsets[i]), int(self.table[i, 0])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"checksum of frame {i}")
        return data

    def find(self, wanted: Iterable[int]) -> list[int]:
        """The numbers of the frames of these documents."""
        wanted = set(wanted)
        return [i for i, d in enumerate(self.doc_ids) if d in wanted]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None, n_files: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``folder`` (a URI) and return their manifest.

    ``n_files`` is the session's number of shuffle partitions unless given; files
    follow each other in doc_id order, by file_no.
    """
    spark = docs.sparkSession
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, writer, stream = TaskContext.get(), None, None, None
        store, base = _open(folder)
        name = f"tokens-{task.partitionId():06d}.zst"
        own = f"{base}/_{name}.{task.taskAttemptId()}"
        for batch in steps(batches, "text"):
            names = batch.column("doc_id").to_pylist()
            for at, texts in text_groups(batch.column("text"), GROUP_BYTES):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    encoder, stream = task_encoder(tokenizer), store.open_output_stream(own)
                    writer = FrameWriter(stream)
                ids, begin = encoder.encode(texts)
                packed, begin = ids.tobytes(), (4 * begin).tolist()
                for i, low, high in zip(names[at : at + len(texts)], begin, begin[1:]):
                    writer.add(i, packed[low:high] + end)
        if writer is not None:
            writer.close()
            stream.close()
            store.move(own, f"{base}/{name}")
            give_back()
            row = [task.partitionId(), name, len(writer.ids), writer.n_tokens, writer.n_bytes]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file_no", "name", "n_docs", "n_tokens", "n_bytes"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each file, a file a task."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # one row a file
    return files.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary); of ``wanted`` documents only their frames are decompressed."""
    return _read(manifest, folder, "ids binary", lambda data: data, wanted)


def read_token_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    return _read(manifest, folder, "ids_crc32 long", zlib.crc32, None)


def _read(manifest: DataFrame, folder: str, field: str, value, wanted: list[int] | None) -> DataFrame:
    name, kind = field.split(" ")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if kind == "binary" else pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for file, file_start in zip(batch.column("name").to_pylist(), batch.column("file_start").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{file}") as source:
                    f = FrameReader(source)
                    starts = file_start + np.concatenate([[0], np.cumsum(f.n_tokens)])
                    chosen = range(f.n_docs) if wanted is None else f.find(wanted)
                    for at in range(0, len(chosen), 512):
                        part = chosen[at : at + 512]
                        columns = [[f.doc_ids[i] for i in part], [int(starts[i]) for i in part], [int(f.n_tokens[i]) for i in part], [value(f.frame(i)) for i in part]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "n_tokens", name])

    return _dealt(manifest).mapInArrow(read, f"doc_id long, start long, n_tokens long, {field}")


def token_folder(spark: SparkSession) -> str:
    path = new_path(spark, "token-files")
    return path if "://" in path else f"file://{path}"
