"""Bytes of files, read inside tasks and no more of them than is asked for.

Paths are those of a mounted folder or URIs of a store that Arrow opens; every executor
must reach them. What is read stays in its task: tables carry paths, digests and values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

# How much of a file its head and its tail are.
HEAD_BYTES, TAIL_BYTES, STEP = 65536, 4096, 1 << 20


class Ranges:
    """One open file, or bytes, read by place; counts what it reads. The head is read once, at the first read within it."""

    def __init__(self, source, size: int):
        self.source, self.size, self.count = source, size, 0
        self.head = source[:HEAD_BYTES] if isinstance(source, bytes) else None

    def _fetch(self, at: int, n: int) -> bytes:
        if isinstance(self.source, bytes):
            return self.source[at : at + n]
        self.source.seek(at)
        found = self.source.read(n)
        self.count += len(found)
        return found

    def read(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; fewer at the end."""
        if at < 0 or at >= self.size:
            return b""
        n = min(n, self.size - at)
        if at + n > HEAD_BYTES:
            return self._fetch(at, n)
        if self.head is None:
            self.head = self._fetch(0, min(HEAD_BYTES, self.size))
        return self.head[at : at + n]


@contextmanager
def opened(path: str) -> Iterator[Ranges]:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(place) as f:
        yield Ranges(f, f.size())


def head_of(file: Ranges) -> str:
    return hashlib.sha256(file.read(0, HEAD_BYTES)).hexdigest()


def tail_of(file: Ranges) -> str:
    """The digest of the last bytes; of a file no longer than a tail, that of its head."""
    return hashlib.sha256(file.read(file.size - TAIL_BYTES, TAIL_BYTES)).hexdigest() if file.size > TAIL_BYTES else head_of(file)


def full_of(file: Ranges) -> str:
    digest = hashlib.sha256()
    for at in range(0, file.size, STEP):
        digest.update(file.read(at, STEP))
    return digest.hexdigest()


DIGESTS = {"head": head_of, "tail": tail_of, "full": full_of}


def read_digests(files: DataFrame, *stages: str) -> DataFrame:
    """``files`` (path, ...) with the named digests (head, tail, full) and bytes, how many were read; nulls where a file can't be."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), *(f"{s} string" for s in stages), "bytes bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as file:
                        found.append((*(DIGESTS[s](file) for s in stages), file.count))
                except (OSError, TypeError):
                    found.append((*[None] * len(stages), 0))
            made = [pa.array([r[i] for r in found], pa.string()) for i in range(len(stages))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array([r[-1] for r in found], pa.int64())], names=[*batch.schema.names, *stages, "bytes"])

    return files.mapInArrow(run, schema)
