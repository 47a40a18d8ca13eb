"""Ranked lexical search over a length-stratified index.

A score depends on a document only through its terms' frequencies tf and its normaliser
m, which comes from its length. So documents of equal m form a stratum; a stratum of many
is cut into blocks of bounded size. A block holds for each term its documents by tf: what a
term adds to a score is computed once for each tf of a block, never for each document.

A search collects, from the blocks' term lists alone, document frequencies and the largest
tf of each term: these bound every score in the block. For each item the blocks of the
highest bounds are visited first; their best scores give a threshold, and of the others
only blocks whose bound reaches it are visited. So results are exact.

Items are searched in groups of about ``item_terms`` terms, all of whose terms a task
keeps; the index is built once and holds every term. A task keeps one block, and for each
item of the group its best rows so far.

Odd rows: texts without a term, null ones too, count as no documents and no items: an item
without terms, or whose terms are nowhere, has no rows. Each row of either table is a
document or an item of its own, also where ids repeat or are null; of equal scores null
ids come last. Other columns than the two named aren't read, so their names can't clash.
Empty tables give an empty result. Terms are compared as UTF-8; no text is cut.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.llm.common import materialize
from filelens.llm.common_arrow import give_back, map_texts, worker_state


@dataclass(frozen=True)
class SearchConfig:
    top: int = 20
    floor: int = 75  # of m; the mean length adds ``spread``
    spread: int = 25
    saturation: int = 12
    block_terms: int = 1 << 20  # terms of documents, each counted once, in a block
    item_terms: int = 1 << 18
    first_blocks: int = 4  # visited for each item to find its threshold


#: ASCII letters and digits, lower-cased, and all of UTF-8 beyond ASCII; the rest parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def counted_terms(rows: DataFrame, id_column: str) -> DataFrame:
    """(id, n, terms, tfs, n_terms, row): how many terms a row has, the distinct ones, spaced, their counts as uint32, and a number of the row."""

    def make():
        def count(texts: list[bytes | None]) -> dict[str, list]:
            n, terms, tfs, kinds = [], [], [], []
            for text in texts:
                words = terms_of(text)
                c = Counter(words)
                n.append(len(words))
                kinds.append(len(c))
                terms.append(b" ".join(c))
                tfs.append(np.fromiter(c.values(), np.uint32, len(c)).tobytes())
            return {"n": n, "terms": terms, "tfs": tfs, "n_terms": kinds}

        return count

    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col("text"))
    counted = map_texts(named, "text", ["id"], "n long, terms binary, tfs binary, n_terms long", make)
    return materialize(counted.filter("n > 0").withColumn("row", F.monotonically_increasing_id()), f"terms-of-{id_column}")


_BLOCK = "m long, part int, doc_ids binary, has_id binary, terms binary, term_groups binary, group_tf binary, group_docs binary, docs binary"
_BLOCK_FIELDS = [(c.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split(" ")[1]]) for c in _BLOCK.split(", ")]


def _build_block(table: pa.Table) -> pa.Table:
    """One block: its documents by place, and for each term, for each tf, the places of its documents."""
    worker_state(None)
    numbers: dict[bytes, int] = {}
    of, docs, tfs = [], [], []
    for place, (terms, counts) in enumerate(zip(table["terms"].to_pylist(), table["tfs"].to_pylist(), strict=True)):
        words = terms.split(b" ")
        of.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        tfs.append(np.frombuffer(counts, np.uint32))
        docs.append(np.full(len(words), place, np.int32))
    of, docs, tfs = np.concatenate(of), np.concatenate(docs), np.concatenate(tfs).astype(np.int64)
    order = np.lexsort((docs, tfs, of))
    of, docs, tfs = of[order], docs[order], tfs[order]
    begins = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (tfs[1:] != tfs[:-1])))  # groups of one term and tf
    term_groups = np.searchsorted(of[begins], np.arange(len(numbers) + 1))
    ids = table["id"].combine_chunks()
    fields = [
        table["m"][0].as_py(),
        table["part"][0].as_py(),
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
        ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
        b" ".join(numbers),
        term_groups.astype(np.int32).tobytes(),
        tfs[begins].astype(np.uint32).tobytes(),
        np.append(begins, len(of)).astype(np.int64).tobytes(),
        docs.tobytes(),
    ]
    return pa.table([pa.array([x], type=t) for x, (_, t) in zip(fields, _BLOCK_FIELDS, strict=True)], names=[n for n, _ in _BLOCK_FIELDS])


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    n_docs: int
    config: SearchConfig


def build_index(docs: DataFrame, config: SearchConfig = SearchConfig()) -> Index:
    """The index of all documents (doc_id, text), one row a block, written to the shared folder."""
    counted = counted_terms(docs, "doc_id")
    n_docs, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    measured = counted.withColumn("m", F.expr(f"{config.floor} + ({config.spread} * n * {n_docs}L) div {length}L"))
    parts = measured.groupBy("m").agg(F.ceil(F.sum("n_terms") / config.block_terms).cast("int").alias("parts"))
    dealt = measured.join(parts, "m").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    blocks = dealt.select("m", "part", "id", "terms", "tfs").groupBy("m", "part").applyInArrow(_build_block, _BLOCK)
    return Index(materialize(blocks, "search-index"), n_docs, config)


@dataclass(frozen=True)
class _Items:
    """A group of items: by item its terms, as places in ``terms``, and how often it has them."""

    ids: list[int | None]
    terms: list[bytes]
    begins: np.ndarray
    of: np.ndarray
    times: np.ndarray


def _items(rows: list) -> _Items:
    numbers: dict[bytes, int] = {}
    of, times, begins = [], [], [0]
    for r in rows:
        words = bytes(r["terms"]).split(b" ")
        of += [numbers.setdefault(w, len(numbers)) for w in words]
        times += np.frombuffer(bytes(r["tfs"]), np.uint32).tolist()
        begins.append(len(of))
    return _Items([r["id"] for r in rows], list(numbers), np.array(begins), np.array(of, np.int64), np.array(times, np.int64))


def _ints(batch: pa.RecordBatch, column: str, i: int, kind=np.int32) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_py(), kind)


def _places(terms: bytes) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(terms.split(b" "))}


def _term_hits(blocks: DataFrame, terms: list[bytes]) -> DataFrame:
    """Of every block the items' terms it has: their numbers, documents and largest tf."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                places = _places(batch.column("terms")[i].as_py())
                held = [(k, p) for k, t in enumerate(terms) if (p := places.get(t)) is not None]
                numbers, at = np.array([k for k, _ in held], np.int64), np.array([p for _, p in held], np.int64)
                groups, docs = _ints(batch, "term_groups", i), _ints(batch, "group_docs", i, np.int64)
                n = docs[groups[at + 1]] - docs[groups[at]]
                most = _ints(batch, "group_tf", i, np.uint32)[groups[at + 1] - 1]
                rows.append((batch.column("m")[i].as_py(), batch.column("part")[i].as_py(), numbers, n, most.astype(np.int64)))
            kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=["m", "part", "numbers", "n", "most"])
        give_back()

    needed = blocks.select("m", "part", "terms", "term_groups", "group_tf", "group_docs")
    return needed.mapInArrow(look, "m long, part int, numbers array<long>, n array<long>, most array<long>")


def _impact(tf: np.ndarray, m: int, config: SearchConfig) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + config.saturation * m)


def _bounds(hits: DataFrame, items: _Items, weights: np.ndarray, config: SearchConfig) -> DataFrame:
    """(m, part, item, bound) for every block that has terms of an item: no document of the block scores higher."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, numbers, most in zip(*(batch.column(c).to_pylist() for c in ("m", "numbers", "most")), strict=True):
                best = np.zeros(len(items.terms), np.int64)
                best[numbers] = _impact(np.array(most, np.int64), m, config) * weights[numbers]
                out.append(np.add.reduceat(best[items.of] * items.times, items.begins[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("part"), pa.array(out, type=pa.list_(pa.int64()))], names=["m", "part", "bounds"])

    rows = hits.select("m", "part", "numbers", "most").mapInArrow(bound, "m long, part int, bounds array<long>")
    return rows.select("m", "part", F.posexplode("bounds").alias("item", "bound")).filter("bound > 0")


class _Best:
    """The best rows of each item so far: score, id; ids that are null come last of equals."""

    def __init__(self, top: int):
        self.top, self.rows = top, {}

    def least(self, item: int) -> int:
        """A document with a lower score isn't among the best."""
        rows = self.rows.get(item, [])
        return rows[-1][0] if len(rows) == self.top else 1

    def add(self, item: int, found: list[tuple[int, int | None]]) -> None:
        rows = self.rows.get(item, []) + found
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        self.rows[item] = rows[: self.top]


def _visit(blocks: DataFrame, visits: DataFrame, items: _Items, weights: np.ndarray, config: SearchConfig) -> DataFrame:
    """(item, id, score): of each task the best rows of each item in the blocks that ``visits`` (m, part, item, bound) names."""

    def score(batch: pa.RecordBatch, i: int, best: _Best) -> None:
        m, places = batch.column("m")[i].as_py(), _places(batch.column("terms")[i].as_py())
        term_groups, group_docs, docs = _ints(batch, "term_groups", i), _ints(batch, "group_docs", i, np.int64), _ints(batch, "docs", i)
        impact = _impact(_ints(batch, "group_tf", i, np.uint32), m, config)  # once for each term and tf
        ids, has_id = _ints(batch, "doc_ids", i, np.int64), _ints(batch, "has_id", i, np.bool_)
        added: dict[int, tuple | None] = {}

        def adds(k: int) -> tuple | None:
            """What term k adds, and to which documents."""
            if k not in added:
                p = places.get(items.terms[k])
                if p is None or not weights[k]:
                    added[k] = None
                else:
                    a, b = term_groups[p], term_groups[p + 1]
                    edges = group_docs[a : b + 1]
                    added[k] = docs[edges[0] : edges[-1]], np.repeat(impact[a:b] * weights[k], np.diff(edges))
            return added[k]

        for item, bound in sorted(zip(batch.column("items")[i].as_py(), batch.column("bounds")[i].as_py(), strict=True), key=lambda x: -x[1]):
            if bound < best.least(item):
                continue
            scores = np.zeros(len(ids), np.int64)
            for at in range(items.begins[item], items.begins[item + 1]):
                if more := adds(int(items.of[at])):
                    scores[more[0]] += more[1] * items.times[at]
            least = best.least(item)
            if len(scores) > config.top:
                least = max(least, int(np.partition(scores, -config.top)[-config.top]))
            found = np.flatnonzero(scores >= max(least, 1))
            best.add(item, [(int(scores[d]), int(ids[d]) if has_id[d] else None) for d in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None)
        best = _Best(config.top)
        for batch in batches:
            for i in range(batch.num_rows):
                score(batch, i, best)
        rows = [(item, *r) for item, found in best.rows.items() for r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in ((0, pa.int32()), (2, pa.int64()), (1, pa.int64()))], names=["item", "id", "score"])
        give_back()

    asked = visits.groupBy("m", "part").agg(F.collect_list("item").alias("items"), F.collect_list("bound").alias("bounds"))  # at most the group's items
    return blocks.join(asked, ["m", "part"]).mapInArrow(run, "item int, id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_group(index: Index, items: _Items) -> DataFrame:
    config, spark = index.config, index.blocks.sparkSession
    hits = materialize(_term_hits(index.blocks, items.terms), "search-hits")
    seen = hits.select(F.explode(F.arrays_zip("numbers", "n")).alias("t")).groupBy("t.numbers").agg(F.sum("t.n").alias("df"))
    df = np.zeros(len(items.terms), np.int64)
    for number, n in seen.collect():  # a row a term of the group
        df[number] = n
    weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    bounds = materialize(_bounds(hits, items, weights, config), "search-bounds")
    highest = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "part")
    first = materialize(bounds.withColumn("turn", F.row_number().over(highest)).filter(F.col("turn") <= config.first_blocks), "search-first")
    early = materialize(_visit(index.blocks, first, items, weights, config), "search-early")
    threshold = _ranked(early, config.top).filter(F.col("rank") == config.top).select("item", F.col("score").alias("least"))
    rest = bounds.join(first.select("m", "part", "item"), ["m", "part", "item"], "left_anti").join(threshold, "item", "left").filter("bound >= coalesce(least, 1)")
    late = _visit(index.blocks, materialize(rest, "search-rest"), items, weights, config)
    ranked = _ranked(early.unionByName(late), config.top)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], "item int, item_id long")
    return materialize(ranked.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "search-ranked")


def search(index: Index, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each row of ``items`` (item_id, text)."""
    spark, config = index.blocks.sparkSession, index.config
    counted = counted_terms(items, "item_id")
    total = counted.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    n_groups = max(1, -(-total // config.item_terms))
    done = []
    for g in range(n_groups):
        rows = counted.filter(F.pmod(F.xxhash64("row"), F.lit(n_groups)) == g).select("id", "terms", "tfs").collect()  # about item_terms terms
        if rows:
            done.append(_search_group(index, _items(rows)))
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
