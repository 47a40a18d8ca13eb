"""Near-duplicate documents by min-max hashing.

Texts are lower-cased (A-Z) and cut into words; a document's set holds its
distinct shingles of ``shingle_words`` words. Under each permutation both the
smallest and the largest value are kept, so half the hash evaluations give as
many values; bands of them are the keys of buckets.

1. Documents with equal sets form a class, whatever their ids; only classes go
   on, each read from one of its documents, so a thousand copies cost what one does.
2. In every bucket all classes are compared with one pivot, on full sets.
   Links make components.
3. Two classes of a bucket that no component joins yet are compared by the
   shingles in which each differs from the pivot, which gives their similarity
   exactly (see ``_cross_links``). Nothing is capped: every two classes of a
   bucket are joined by a component or compared.

At a similarity of 0.8 a pair shares no bucket with probability under 2e-7
(5 values a band, 40 bands).

Results: null texts and texts without words have an empty set and link with
nothing; texts with fewer words than a shingle have one shingle, the whole. In
``near_duplicates`` rows with equal doc_id are one document with several texts:
it reaches what any of them reaches, and all its rows get one component. A null
doc_id links with nothing and is kept, with no component. In
``without_near_duplicates`` rows are documents: of each group of linked texts one
row stays, whatever ids repeat or are null. Columns other than doc_id and text
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm.common import materialize
from filelens.llm.common_arrow import map_texts
from filelens.llm.components import connected_components


@dataclass(frozen=True)
class NearDupConfig:
    shingle_words: int = 5
    percent: int = 80  # links: 100 * intersection >= percent * union
    band_values: int = 5
    bands: int = 40
    filter_rows: int = 1 << 22  # classes to compare up to which a bitmap finds their texts, 16 bits each; beyond it a join does
    block_rows: int = 256  # of a pivot's group in one task
    seed: int = 11


KNOWN_WORDS = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """A text's set: the sorted distinct 64-bit hashes of its shingles."""

    def __init__(self, k: int):
        self.k, self.known = k, _WordHashes()

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").lower().split()  # bytes: A-Z only, ASCII white space only
        if not words:
            return np.empty(0, dtype=np.uint64)
        k = min(self.k, len(words))
        h = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(words) - k + 1
        x = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            x = _mixed(x * ODD + h[i : i + n])
        return np.unique(x)


class MinMax:
    """Band keys from the smallest and largest values under ``bands * band_values / 2`` permutations."""

    def __init__(self, cfg: NearDupConfig):
        if cfg.bands % 2:
            raise ValueError("bands must be even: half hold smallest values, half largest ones")
        rng, n = np.random.default_rng(cfg.seed), cfg.bands * cfg.band_values // 2
        self.a = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]
        self.shape = (cfg.bands, cfg.band_values)
        self.band = np.arange(1, cfg.bands + 1, dtype=np.uint64) * ODD

    def __call__(self, x: np.ndarray) -> list[int]:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        high = np.zeros(len(self.a), dtype=np.uint64)
        for at in range(0, len(x), 2048):
            y = x[at : at + 2048] * self.a
            y += self.b
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        values = np.concatenate([low, high]).reshape(self.shape)
        key = self.band.copy()
        for i in range(self.shape[1]):
            key = _mixed(key * ODD + values[:, i])
        return key.view(np.int64).tolist()


def signatures(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """doc_id, text_key, n_shingles, digest (of the full set), keys (one a band; none for empty sets)."""

    def make():
        shingles, keys = Shingler(cfg.shingle_words), MinMax(cfg)

        def run(texts: list[bytes | None]) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets],
                "digest": [_digest(s) for s in sets],
                "keys": [keys(s) if len(s) else [] for s in sets],
            }

        return run

    return map_texts(docs, "text", ["doc_id", "text_key"], "n_shingles long, digest binary, keys array<long>", make)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _among(docs: DataFrame, wanted: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """The documents that stand for the classes of ``wanted`` (rep_id, text_key), and few others.

    A bitmap of their hashes, of bounded size and so fit to broadcast, drops the
    others where they are read: no text is shuffled.
    """
    n = wanted.count()
    if n > cfg.filter_rows:
        keys = wanted.select(F.col("rep_id").alias("r_id"), F.col("text_key").alias("r_key")).distinct()
        return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")), "left_semi")
    bits = F.lit(64 << max(10, (n // 4).bit_length()))
    place = lambda i: F.pmod(F.xxhash64(i, "text_key"), bits)
    at = wanted.select(place("rep_id").alias("place")).select(F.floor(F.col("place") / 64).cast("int").alias("at"), (F.col("place") % 64).cast("int").alias("bit"))
    words = materialize(at.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")), "filter")
    marked = docs.withColumn("at", F.floor(place("doc_id") / 64).cast("int")).withColumn("bit", (place("doc_id") % 64).cast("int"))
    return marked.join(F.broadcast(words), "at").filter(F.getbit("word", F.col("bit")) == 1).select(*docs.columns)


def _compared(pairs: DataFrame, groups: DataFrame, docs: DataFrame, classes: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """The pairs (a, b) of nodes with linked, from full sets, the size n of b's set and differ, the shingles that only one has.

    A pivot's partners are dealt over the blocks that ``groups`` (a, blocks) gives it,
    so no task holds more than a block of one group.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(classes.join(nodes, "node").select("node", "digest", "rep_id", "text_key"), "wanted")

    def make():
        shingles = Shingler(cfg.shingle_words)

        def run(texts):
            sets = [shingles(t) for t in texts]
            return {"found": [_digest(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return run

    found = map_texts(_among(docs, wanted, cfg), "text", [], "found binary, shingles binary", make)
    sets = materialize(found.join(wanted.select("node", "digest"), F.col("found") == F.col("digest")).select("node", "shingles").dropDuplicates(["node"]), "sets")
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    dealt = _dealt(pairs, groups).select("a", "b", "block")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")).join(groups, "a", "left").select("a", "set_a", every)
    both = dealt.join(b, "b").join(a, ["a", "block"]).select("a", "b", "set_a", "set_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, size, differ = [], [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                d = np.setxor1d(x, y, assume_unique=True)
                linked.append((100 + cfg.percent) * len(d) <= (100 - cfg.percent) * (len(x) + len(y)))
                size.append(len(y))
                differ.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(differ, pa.binary())], names=["a", "b", "linked", "n", "differ"])

    return materialize(both.mapInArrow(compare, "a long, b long, linked boolean, n long, differ binary"), "compared")


def _dealt(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs with the number of blocks of their pivot and one of these; ``groups`` holds only pivots of several partners."""
    return pairs.join(groups, "a", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))


def _cross_links(compared: DataFrame, groups: DataFrame, components: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Links (a, b) between classes that were compared with the same one and that no component joins.

    With D(x) the shingles in which x differs from the common pivot, x and y differ
    in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles. So lists of these few shingles are
    enough, and only links become rows. A link not yet known needs one side that
    isn't linked with the pivot. Groups are cut into blocks; a task has two blocks.
    """
    apart = materialize(compared.filter("NOT linked").select("a").distinct().join(groups, "a"), "apart")
    led = components.select(F.col("node").alias("b"), "component")
    rows = compared.join(apart, "a").join(led, "b", "left").withColumn("component", F.coalesce("component", "b")).withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    u = rows.filter("NOT linked").select("a", F.col("block").alias("u_block"), every.alias("v_block"), "b", "n", "component", "differ")
    v = rows.select("a", every.alias("u_block"), F.col("block").alias("v_block"), "b", "n", "component", "linked", "differ")
    v = v.select(*[F.col(c).alias(f"v_{c}") for c in v.columns])
    low, high = 100 - cfg.percent, 100 + cfg.percent

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if left.num_rows and right.num_rows:
            lists = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in right.column("v_differ")]
            size = np.array([len(x) for x in lists])
            items, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), size)
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            ids, n, component, linked = (right.column(f"v_{c}").to_numpy() for c in ("b", "n", "component", "linked"))
            for one, n_one, c_one, d in zip(*(left.column(c).to_pylist() for c in ("b", "n", "component")), left.column("differ"), strict=True):
                d = np.frombuffer(d.as_buffer(), dtype=np.uint64)
                begin, end = np.searchsorted(items, d), np.searchsorted(items, d, side="right")
                met = [owner[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True) if i < j]
                common = np.bincount(np.concatenate(met), minlength=len(lists)) if met else np.zeros(len(lists), np.int64)
                near = high * (len(d) + size - 2 * common) <= low * (n_one + n)
                hit = ids[near & (component != c_one) & (linked.astype(bool) | (ids > one))]
                out[0].append(np.minimum(hit, one))
                out[1].append(np.maximum(hit, one))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["a", "b"])

    keys = ["a", "u_block", "v_block"]
    return materialize(u.groupBy(*keys).cogroup(v.groupBy(*[f"v_{k}" for k in keys])).applyInArrow(cell, "a long, b long").distinct(), "cross-links")


def _linked(docs: DataFrame, cfg: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, n_shingles, digest of each row of ``docs``, and digest, group of each set that isn't empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    signed = materialize(signatures(docs, cfg), "signatures")
    by_set = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("keys").alias("keys"))
    # Numbers of this one table: they choose pivots, never results.
    classes = materialize(by_set.select("digest", F.monotonically_increasing_id().alias("node"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("text_key"), "keys"), "classes")
    placed = classes.select(F.explode("keys").alias("key"), "node")
    shared = placed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    pairs = materialize(placed.join(shared, "key").filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    groups = pairs.groupBy("a").agg(F.count("*").alias("members")).filter("members > 1")
    groups = materialize(groups.select("a", F.ceil(F.col("members") / cfg.block_rows).cast("int").alias("blocks")), "groups")

    compared = _compared(pairs, groups, docs, classes, cfg)
    links = compared.filter("linked").select("a", "b")
    components = connected_components(links)
    cross = _cross_links(compared, groups, components, cfg)
    if not cross.isEmpty():
        components = connected_components(links.unionByName(cross))
    found = classes.select("digest", "node").join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("group"))
    return signed.drop("keys"), found


def near_duplicates(docs: DataFrame, cfg: NearDupConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of ``docs`` (doc_id, text)."""
    signed, found = _linked(docs, cfg or NearDupConfig())
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(found, "digest").select("doc_id", "n_shingles", "group")
    usable = materialize(usable, "grouped")
    # Ids with texts of several groups join these.
    spread = usable.groupBy("doc_id").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("doc_id", "low")
    edges = materialize(usable.join(spread, "doc_id").select(F.col("low").alias("a"), F.col("group").alias("b")).distinct(), "id-edges")
    if not edges.isEmpty():
        joined = connected_components(edges).select(F.col("node").alias("group"), "component")
        usable = usable.join(joined, "group", "left").withColumn("group", F.coalesce("component", "group")).drop("component")
    # Groups of one row need no look-up, and a table of known size is broadcast where it is small: a large group isn't shuffled to one task.
    least = usable.groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("group", "least")
    out = usable.join(materialize(least, "least"), "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    # Rows without words: where their id has other texts too, its component; else the id.
    rest = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles")
    empty = rest.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("r_id"))
    by_id = out.select(F.col("doc_id").alias("u_id"), F.col("component_id").alias("u_component")).join(empty, F.col("u_id") == F.col("r_id"), "left_semi").distinct()
    rest = rest.join(by_id, F.col("doc_id") == F.col("u_id"), "left").select("doc_id", "n_shingles", F.coalesce("u_component", "doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, cfg: NearDupConfig | None = None) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that of the smallest doc_id, null last, then of the smallest text key."""
    signed, found = _linked(docs, cfg or NearDupConfig())
    rows = signed.filter("n_shingles > 0").join(found, "digest").groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "grouped")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")).alias("first")).select("group", F.col("first.doc_id").alias("f_id"), F.col("first.text_key").alias("f_key"))
    chosen = rows.join(first, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")))
    keyed = chosen.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "stays", "copies")
    # Where rows of one id and one text repeat, one of them stays.
    settled = materialize(keyed.filter("NOT stays OR copies > 1"), "settled")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    out = docs.join(settled, same, "left_anti")
    again = settled.filter("stays").select("__id", "__key")
    if not again.isEmpty():
        one = docs.withColumn("__same", F.xxhash64("text")).join(again, same, "left_semi").dropDuplicates(["doc_id", "__same"]).select(*docs.columns)
        out = out.unionByName(one)
    return out.select(*docs.columns)
