"""Language-model scoring by online logistic context mixing.

A text is its words in lower case (A-Z), each followed by a space, the last by the
end mark. Bytes are predicted bit by bit: for each of several orders, the bytes
before and the bits of this byte so far have a slot of their own that holds how
often 0 and 1 followed. The stretched probabilities are mixed by logistic
mixers whose weights are chosen by two gates (how sure the longest contexts
are; the bits so far), and the mix is refined by an adaptive map. A text's score
is the sum over all its bits.

What is learned, in order, each from all training documents:

1. counts of all byte sequences of the longest order plus one, added up by Spark;
2. buckets of sequences that share the ``NEAR`` bytes before their last one. A
   bucket has all that the slots of orders NEAR and up count, so these are exact,
   and there are more buckets as the corpus grows. The slots of lower orders come
   from the counts of NEAR bytes, of which there are 2^24 at most;
3. the weights: each bucket learns online over its sequences, every event
   predicted as if it had not been counted, and Spark averages them;
4. the adaptive map, from the same events.

Every distinct sequence is scored once, in its bucket. The most frequent ones go
to the tasks that read texts; the others are joined by sequence.

The base score needs each word's count. The ``hot_words`` most frequent words go
to the tasks; the other words' counts are joined by word.

Results: null texts and texts without words are the end alone. Rows with equal
doc_id are separate documents. With no training documents every bit has
probability 1/2. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.llm.common import materialize
from filelens.llm.common_arrow import map_texts, raw, steps

CONTEXT = 5  # bytes of the longest context
NEAR = 3  # bytes before the last that a bucket's sequences share
START, END = b"\n" * CONTEXT, b"\n"
GATE_LEVELS = 24
STEP = 2 << 20


@dataclass(frozen=True)
class LmConfig:
    slot_bits: tuple[int, ...] = (16, 19, 21, 21, 21)  # of the orders 1 to CONTEXT, in a Mixer over hashed tables
    rate: float = 0.02
    weight_cap: int = 64  # of a sequence's count, while the weights are learned
    map_bins: int = 33
    hot_words: int = 65536
    bucket_grams: int = 1 << 17  # sequences of a bucket, about
    hot_grams: int = 1 << 21  # sequences whose scores go to the tasks, at most


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slots_of(grams: np.ndarray, node: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Slot of the context of ``order`` bytes before each gram's last byte, with the bits so far."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    key = (context << np.uint64(8)) | node
    if order == 1 and bits == 16:
        return key.astype(np.int64)
    return (_mix(key + (np.uint64(order) << np.uint64(56))) >> np.uint64(64 - bits)).astype(np.int64)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def grams_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence ending at each place of some texts, and where each text's places begin and end."""
    streams = [START + b" ".join(w) + END for w in words]
    buf = np.frombuffer(b"".join(streams), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(s) for s in streams])
    g = np.zeros(max(0, len(buf) - CONTEXT), dtype=np.uint64)
    for j in range(CONTEXT + 1):
        g = (g << np.uint64(8)) | buf[j : j + len(g)]
    begin = np.cumsum(size) - size
    return g, begin, begin + size - CONTEXT


def _groups(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= STEP or i + 1 == len(texts):
            yield texts[at : i + 1]
            at, total = i + 1, 0


def _word_key(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def corpus_counts(train: DataFrame) -> DataFrame:
    """kind, key, n: how often each byte sequence (kind 0) and each word, by its hash (kind 1), occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, words = [np.empty(0, np.uint64), np.empty(0, np.int64)], Counter()

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        def word_rows() -> pa.RecordBatch:
            return rows(1, np.fromiter(map(_word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))

        for batch in steps(batches, "text"):
            for group in _groups(raw(batch.column("text"))):
                cut = [(t or b"").lower().split() for t in group]
                for w in cut:
                    words.update(w)
                g, begin, end = grams_of(cut)
                real = np.ones(len(g), dtype=bool)
                for b in end[:-1]:
                    real[b : b + CONTEXT] = False
                g = np.sort(g[real])
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
                keys, n = np.concatenate([sums[0], g[first]]), np.concatenate([sums[1], np.diff(np.append(first, len(g)))])
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                sums = [keys[first], np.add.reduceat(n, first)]
                if len(sums[0]) > 1_000_000:
                    yield rows(0, *sums)
                    sums = [np.empty(0, np.uint64), np.empty(0, np.int64)]
                if len(words) > 500_000:
                    yield word_rows()
                    words.clear()
        yield rows(0, *sums)
        yield word_rows()

    parts = train.select("text").mapInArrow(count, "kind int, key long, n long")
    return materialize(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "corpus-counts")


def bucketed(grams: DataFrame, cfg: LmConfig) -> tuple[DataFrame, int]:
    """bucket, keys, counts (arrays as bytes), and how many buckets there are."""
    buckets = max(1, -(-grams.count() // cfg.bucket_grams))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
        g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([g.tobytes()]), pa.array([n.tobytes()])], names=["bucket", "keys", "counts"])

    rows = grams.withColumn("bucket", bucket_of(F.col("key"), buckets))
    return materialize(rows.groupBy("bucket").applyInArrow(pack, "bucket int, keys binary, counts binary"), "gram-buckets"), buckets


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.shiftright(key, 8).bitwiseAND((1 << (8 * NEAR)) - 1)), F.lit(buckets)).cast("int")


def low_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The last NEAR bytes of sequences, and how often they occur: 2^24 rows at most."""
    got = grams.groupBy(F.col("key").bitwiseAND((1 << (8 * NEAR)) - 1).cast("int").alias("key")).agg(F.sum("n").alias("n")).toArrow()
    return got.column("key").to_numpy().astype(np.int64), got.column("n").to_numpy()


class LowTables:
    """Slots of the orders below NEAR, by contexts that occur; row 0 is for the others."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.rows, self.tables = [], []
        for order in range(1, NEAR):
            context = (keys >> 8) & ((1 << (8 * order)) - 1)
            found, at = np.unique(context, return_inverse=True)
            rows = np.zeros(1 << (8 * order), dtype=np.int32)
            rows[found] = np.arange(1, len(found) + 1)
            table = np.zeros(512 * (len(found) + 1), dtype=np.float32)
            for j in range(8):
                slot = 2 * (256 * (at + 1) + ((1 << j) | ((keys & 255) >> (8 - j)))) + ((keys >> (7 - j)) & 1)
                slot, back = np.unique(slot, return_inverse=True)
                table[slot] = np.bincount(back, weights=n, minlength=len(slot))
            self.rows.append(rows)
            self.tables.append(table.reshape(-1, 2))

    def __call__(self, g: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        out = []
        for order, (rows, table) in enumerate(zip(self.rows, self.tables, strict=True), 1):
            context = ((g >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)).astype(np.int64)
            out.append(table[rows[context].astype(np.int64) * 256 + node.astype(np.int64)])
        return out


class Bucket:
    """Exact counts of all slots that the sequences ``g`` meet; among them are all with the same NEAR bytes."""

    def __init__(self, g: np.ndarray, n: np.ndarray, low: LowTables):
        self.g, self.low, self.slots, self.tables = g, low, [], []
        for order in range(NEAR, CONTEXT + 1):
            key = g & np.uint64((1 << (8 * (order + 1))) - 1)
            by = np.argsort(key, kind="stable")
            key, weight, slots, tables = key[by], n[by].astype(np.float64), [], []
            for j in range(8):
                top = key >> np.uint64(8 - j)
                at = np.cumsum(np.concatenate([[False], top[1:] != top[:-1]]))
                bit = ((key >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
                place = np.empty(len(g), dtype=np.int32)
                place[by] = at
                slots.append(place)
                tables.append(np.bincount(2 * at + bit, weights=weight, minlength=2 * int(at[-1]) + 2).reshape(-1, 2))
            self.slots.append(slots)
            self.tables.append(tables)

    def at(self, rows: np.ndarray) -> Counts:
        """The counts of some of the sequences."""
        return lambda j, node: self.low(self.g[rows], node) + [t[j][s[j][rows]] for t, s in zip(self.tables, self.slots, strict=True)]


Counts = Callable[[int, np.ndarray], list[np.ndarray]]  # n0 and n1 for each order, at a bit and its node


class Mixer:
    """Predicts the last byte of sequences, by counts that are given or those of hashed tables."""

    def __init__(self, tables: list[np.ndarray] | None, cfg: LmConfig, by_level: np.ndarray | None = None, by_node: np.ndarray | None = None, refined: np.ndarray | None = None):
        k = CONTEXT + 1
        self.tables, self.cfg = tables, cfg
        self.by_level = np.full((GATE_LEVELS, k), 0.3) if by_level is None else by_level
        self.by_node = np.full((256, k), 0.3) if by_node is None else by_node
        self.refined = refined  # node, bin

    def hashed(self, g: np.ndarray) -> Counts:
        return lambda j, node: [t[slots_of(g, node, order, bits)] for order, (t, bits) in enumerate(zip(self.tables, self.cfg.slot_bits, strict=True), 1)]

    def inputs(self, counts: list[np.ndarray], bit: np.ndarray, unseen: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions of each order and the level of the gate. unseen: without this very event."""
        x = np.ones((len(bit), len(counts) + 1))
        level = np.zeros(len(bit), dtype=np.int64)
        for order, n in enumerate(counts, 1):
            n = n.astype(np.float64)
            if unseen:
                n[np.arange(len(bit)), bit] = np.maximum(0.0, n[np.arange(len(bit)), bit] - 1)
            total = n[:, 0] + n[:, 1]
            x[:, order - 1] = stretch((n[:, 1] + 0.06) / (total + 0.12))
            sure = np.minimum(3, np.floor(np.log2(np.maximum(total, 0.5)) / 2 + 1)).astype(np.int64)
            level = np.where(total > 0, 4 * order + sure, level)
        x[:, -1] = 0.3
        return x, np.minimum(level, GATE_LEVELS - 1)

    def mixed(self, x: np.ndarray, level: np.ndarray, node: np.ndarray) -> np.ndarray:
        dot = np.einsum("ij,ij->i", x, self.by_level[level]) + np.einsum("ij,ij->i", x, self.by_node[node])
        return np.clip(0.5 * dot, -11.5, 11.5)

    def bins(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (s + 12) / 24 * (self.cfg.map_bins - 1)
        low = np.minimum(at.astype(np.int64), self.cfg.map_bins - 2)
        return low, at - low

    def log2(self, g: np.ndarray, counts: Counts | None = None) -> np.ndarray:
        """log2 probability of the last byte of each sequence, given those before."""
        counts = counts or self.hashed(g)
        out, byte = np.zeros(len(g)), g & np.uint64(255)
        for j in range(8):
            node = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
            x, level = self.inputs(counts(j, node), bit, unseen=False)
            node = node.astype(np.int64)
            s = self.mixed(x, level, node)
            p = squash(s)
            if self.refined is not None:
                low, part = self.bins(s)
                p = 0.5 * (p + (1 - part) * self.refined[node, low] + part * self.refined[node, low + 1])
            out += np.log2(np.where(bit == 1, p, 1 - p))
        return out

    def learn(self, g: np.ndarray, n: np.ndarray, counts: Counts) -> None:
        """One online step for each bit of some sequences."""
        weight = np.minimum(n, self.cfg.weight_cap).astype(np.float64)
        weight /= weight.mean()
        byte = g & np.uint64(255)
        for j in range(8):
            node = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
            x, level = self.inputs(counts(j, node), bit, unseen=True)
            node = node.astype(np.int64)
            error = (bit - squash(self.mixed(x, level, node))) * weight
            for gate, which in ((self.by_level, level), (self.by_node, node)):
                seen = np.bincount(which, weights=weight, minlength=len(gate))
                change = np.stack([np.bincount(which, weights=error * x[:, i], minlength=len(gate)) for i in range(x.shape[1])], axis=1)
                gate += self.cfg.rate * np.sqrt(seen / len(g))[:, None] * 20 * change / np.maximum(seen, 1)[:, None]


Low = tuple[np.ndarray, np.ndarray]
ROWS = 65536  # sequences worked on at once


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
            yield np.frombuffer(keys.as_buffer(), dtype=np.uint64), np.frombuffer(counts.as_buffer(), dtype=np.int64)


def _with_model(packs: DataFrame, low: Low, model: Mixer, size: int, work) -> np.ndarray:
    """Sum over buckets of (value, weight) pairs that ``work`` makes of their sequences."""
    sent = packs.sparkSession.sparkContext.broadcast((low, model.cfg, model.by_level, model.by_node))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, times), cfg, by_level, by_node = sent.value
        value, weight, tables = np.zeros(size), np.zeros(size), LowTables(keys, times)
        for g, n in _packs(batches):
            work(Mixer(None, cfg, by_level.copy(), by_node.copy()), Bucket(g, n, tables), n, value, weight)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(value), pa.array(weight)], names=["at", "value", "weight"])

    out = np.zeros((2, size))
    for r in packs.select("keys", "counts").mapInArrow(run, "at int, value double, weight double").groupBy("at").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).collect():
        out[:, r["at"]] = r["value"], r["weight"]
    sent.destroy()
    return out


def learn_mixer(packs: DataFrame, low: Low, cfg: LmConfig) -> Mixer:
    """The model, from the buckets of sequences."""
    model = Mixer(None, cfg)
    shape, at = (GATE_LEVELS + 256, model.by_level.shape[1]), GATE_LEVELS * model.by_level.shape[1]

    def train(own: Mixer, bucket: Bucket, n: np.ndarray, value, weight) -> None:
        order = np.argsort(_mix(bucket.g))
        for i in range(0, len(order), 2048):
            rows = order[i : i + 2048]
            own.learn(bucket.g[rows], n[rows], bucket.at(rows))
        value[:at] += own.by_level.ravel() * len(n)
        value[at:] += own.by_node.ravel() * len(n)
        weight += len(n)

    total, events = _with_model(packs, low, model, shape[0] * shape[1], train)
    if not events.any():
        zero = np.zeros(shape)
        return Mixer(None, cfg, zero[:GATE_LEVELS], zero[GATE_LEVELS:])
    mean = (total / events).reshape(shape)
    model = Mixer(None, cfg, mean[:GATE_LEVELS], mean[GATE_LEVELS:])
    size = 256 * cfg.map_bins

    def refine(own: Mixer, bucket: Bucket, times: np.ndarray, value, weight) -> None:
        for i in range(0, len(times), ROWS):
            rows = np.arange(i, min(i + ROWS, len(times)))
            byte, n, counts = bucket.g[rows] & np.uint64(255), times[rows].astype(np.float64), bucket.at(rows)
            for j in range(8):
                node = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
                bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
                x, level = own.inputs(counts(j, node), bit, unseen=True)
                node = node.astype(np.int64)
                low_bin, part = own.bins(own.mixed(x, level, node))
                for b, share in ((low_bin, 1 - part), (low_bin + 1, part)):
                    value += np.bincount(node * cfg.map_bins + b, weights=share * n * bit, minlength=size)
                    weight += np.bincount(node * cfg.map_bins + b, weights=share * n, minlength=size)

    ones, seen = _with_model(packs, low, model, size, refine)
    plain = np.tile(squash(np.linspace(-12, 12, cfg.map_bins)), 256)
    model.refined = ((ones + 8 * plain) / (seen + 8)).reshape(256, cfg.map_bins)
    return model


def _scored(model: Mixer, bucket: Bucket, rows: np.ndarray) -> np.ndarray:
    parts = [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)]
    return np.concatenate([np.empty(0)] + [model.log2(bucket.g[r], bucket.at(r)) for r in parts])


def _hot_scores(grams: DataFrame, packs: DataFrame, sent, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent sequences, the most frequent last, and their log2."""
    least = total = 0
    for r in grams.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
        total += r["rows"]
        if total > cfg.hot_grams:
            break
        least = r["n"]
    if not least:
        return np.empty(0, np.uint64), np.empty(0, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, times), model = sent.value
        tables = LowTables(keys, times)
        for g, n in _packs(batches):
            rows = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_arrays([pa.array(g[rows].astype(np.int64)), pa.array(n[rows]), pa.array(_scored(model, Bucket(g, n, tables), rows).astype(np.float32))], names=["key", "n", "log2"])

    got = packs.select("keys", "counts").mapInArrow(run, "key long, n long, log2 float").toArrow()  # hot_grams rows at most
    key = got.column("key").to_numpy().astype(np.uint64)
    order = np.lexsort((key, got.column("n").to_numpy()))
    return key[order], got.column("log2").to_numpy()[order]


def _cold_scores(cold: DataFrame, packs: DataFrame, buckets: int, sent) -> DataFrame:
    """key, log2 of the distinct sequences of ``cold``, whether they were counted or not."""

    def run(counted: pa.Table, asked: pa.Table) -> pa.Table:
        (keys, times), model = sent.value
        wanted = asked.column("key").to_numpy().astype(np.uint64)
        if len(wanted):
            parts = list(_packs(iter(counted.to_batches())))
            g = np.concatenate([p[0] for p in parts] + [wanted])
            n = np.concatenate([p[1] for p in parts] + [np.zeros(len(wanted), np.int64)])
            log2 = _scored(model, Bucket(g, n, LowTables(keys, times)), np.arange(len(g) - len(wanted), len(g)))
        else:
            log2 = np.empty(0)
        return pa.table({"key": pa.array(wanted.astype(np.int64)), "log2": pa.array(log2, pa.float64())})

    asked = cold.select("key").distinct().withColumn("asked", bucket_of(F.col("key"), buckets))
    return packs.groupBy("bucket").cogroup(asked.groupBy("asked")).applyInArrow(run, "key long, log2 double")


class _Hot:
    """log2 of frequent sequences; NaN for those that hold no place (the most frequent of a place holds it)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(1 << bits, dtype=np.float32)
        place = self.place(keys)
        self.keys[place], self.values[place] = keys, values

    def place(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, g: np.ndarray) -> np.ndarray:
        place = self.place(g)
        return np.where(self.keys[place] == g, self.values[place], np.float32(np.nan))


def score_texts(docs: DataFrame, train: DataFrame, cfg: LmConfig | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of ``docs``, learned from ``train``."""
    cfg = cfg or LmConfig()
    counts = corpus_counts(train)
    words = counts.filter("kind = 1").select("key", "n")
    ends = train.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    log_all = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    hot = {r["key"]: r["n"] for r in words.orderBy(F.desc("n"), "key").limit(cfg.hot_words).collect()}
    grams = counts.filter("kind = 0").select("key", "n")
    packs, buckets = bucketed(grams, cfg)
    low = low_counts(grams)
    model = learn_mixer(packs, low, cfg)
    context = docs.sparkSession.sparkContext
    sent_model = context.broadcast((low, model))
    sent = context.broadcast((*_hot_scores(grams, packs, sent_model, cfg), hot))
    added = "n_tokens long, known long, base double, bits double, n_bytes long, rest array<long>, cold array<long>"

    def make():
        keys, values, frequent = sent.value
        memo = _Hot(keys, values)
        gain = {k: float(np.log10(n + 0.5)) for k, n in frequent.items()}
        unseen, end = float(np.log10(0.5)), float(np.log10(ends + 0.5))

        class Known(dict):
            """A word's log10(c + 0.5) if hot; else its key, an int."""

            def __missing__(self, word: bytes):
                if len(self) > 200_000:
                    self.clear()
                key = _word_key(word)
                self[word] = value = gain.get(key, key)
                return value

        known = Known()

        def run(texts: list[bytes | None]) -> dict[str, list]:
            out = {name: [] for name in ("n_tokens", "known", "base", "bits", "n_bytes", "rest", "cold")}
            for group in _groups(texts):
                cut = [(t or b"").lower().split() for t in group]
                g, begin, stop = grams_of(cut)
                bits = np.append(memo(g), 0.0).astype(np.float64)
                at = np.flatnonzero(np.isnan(bits))
                bits[at] = 0.0
                left, cold_at, cold_to = g[at].astype(np.int64), np.searchsorted(at, begin), np.searchsorted(at, stop)
                sums = np.add.reduceat(bits, np.stack([begin, stop], axis=1).ravel())[::2]
                for w, s, n, i, j in zip(cut, sums.tolist(), (stop - begin).tolist(), cold_at.tolist(), cold_to.tolist(), strict=True):
                    values = list(map(known.__getitem__, w))
                    rest = [v for v in values if type(v) is int]
                    sure = len(values) - len(rest)
                    base = sum(v for v in values if type(v) is float) + unseen * len(rest) + end
                    out["n_tokens"].append(len(w) + 1)
                    out["known"].append(sure + (ends > 0))
                    out["base"].append(base - log_all * (len(w) + 1))
                    out["bits"].append(s)
                    out["n_bytes"].append(n)
                    out["rest"].append(rest)
                    out["cold"].append(left[i:j])
            return out

        return run

    scored = materialize(map_texts(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "text", ["doc_id", "row"], added, make), "scored")
    parts = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")).join(words, "key")
    more = parts.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("base"))
    more = more.withColumnsRenamed({"row": "m_row", "known": "m_known", "base": "m_base"})
    sent.destroy()
    cold = scored.select(F.col("row").alias("c_row"), F.explode("cold").alias("key"))
    found = materialize(_cold_scores(cold, packs, buckets, sent_model), "cold-scores")
    sent_model.destroy()
    cold = cold.join(found, "key").groupBy("c_row").agg(F.sum("log2").alias("c_bits"))
    both = scored.drop("rest", "cold").join(more, F.col("row") == F.col("m_row"), "left").join(cold, F.col("row") == F.col("c_row"), "left")
    bits = F.col("bits") + F.coalesce("c_bits", F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("m_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("m_base", F.lit(0.0))).alias("base_score"),
        (bits * float(np.log10(2))).alias("score"),
        (-bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
