"""Arrow helpers of the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts of one step together are at most about so long, whatever the batch.
STEP_BYTES = 4 << 20


_kept: dict[str, object] = {}


def worker_state(name: str | None, build: Callable[[], object] | None = None):
    """What a Python worker keeps from task to task under ``name``; all it kept under other names is given up."""
    for other in [k for k in _kept if k != name]:
        del _kept[other]
    if build and name not in _kept:
        _kept[name] = build()
    return _kept.get(name)


def give_back() -> None:
    """At the end of a task, return freed memory to the system: workers stay, and wait beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def raw(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, None where null."""
    return column.cast(pa.binary()).to_pylist()


def steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose ``column`` holds about STEP_BYTES at most."""
    for batch in batches:
        n, rows = batch.num_rows, batch.num_rows
        size = max(1, batch.column(column).nbytes)
        if size > STEP_BYTES:
            rows = max(1, n * STEP_BYTES // size)
        for at in range(0, n, rows):
            yield batch.slice(at, rows)


def map_texts(docs: DataFrame, text: str, keep: list[str], added: str, make: Callable[[], Callable[[list[bytes | None]], dict[str, list]]]) -> DataFrame:
    """``map_arrays`` with the texts as a list of UTF-8 bytes, None where null."""

    def of_arrays():
        score = make()
        return lambda column: score(raw(column))

    return map_arrays(docs, text, keep, added, of_arrays)


def map_arrays(docs: DataFrame, text: str, keep: list[str], added: str, make: Callable[[], Callable[[pa.Array], dict[str, list]]], keeps: str | None = None) -> DataFrame:
    """Add columns computed from ``text``, row by row, to the columns ``keep``.

    ``make()`` runs once a task and gives a function from the texts to the columns
    that ``added`` (a schema string) declares; ``keeps`` names the worker state it uses. Only ``keep`` and ``text`` are sent
    to Python; names in ``added`` must not be in ``keep``.
    """
    used = list(dict.fromkeys([*keep, text]))
    extra = T._parse_datatype_string(added)
    clash = set(keep) & set(extra.fieldNames())
    if clash:
        raise ValueError(f"columns both kept and added: {sorted(clash)}")
    schema = T.StructType([docs.schema[c] for c in keep] + extra.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(keeps)
        score = make()
        out = to_arrow_schema(schema)
        for batch in steps(batches, text):
            got = score(batch.column(text))
            kept = [batch.column(c) for c in keep]
            new = [pa.array(got[f.name], type=out.field(f.name).type) for f in extra.fields]
            yield pa.RecordBatch.from_arrays([c.cast(out.field(i).type) for i, c in enumerate(kept)] + new, schema=out)
        give_back()

    return docs.select(*used).mapInArrow(run, schema)
