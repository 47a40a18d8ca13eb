"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream (its documents in a fixed pseudorandom
order), packed into blocks of ``block_words``. Each output shard draws a
multinomial count for every source; a source's slots, numbered through all
shards, go through one pseudorandom permutation of its block numbers per pass,
and blocks are joined by (source, number).

Targets are exact: slots that a source draws beyond its target are dropped, a
closing shard tops up the sources that drew too few, and the last slot of a
source is cut to the words that are missing. No block is used more than
``max_repeat`` times.

Nulls, empty texts: size 0, nothing taken, the row stays. A null source is a
source of its own, last in order. Rows with equal doc_id are separate documents;
rows equal in doc_id, source and text are counted once and follow each other. An
empty table gives an empty result. Columns other than the three named are not
read, so their names can't clash. Texts are told apart by a 64-bit hash within
one doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.llm.common import WORD, materialize


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    total_share: float = 1.5
    max_repeat: int = 2
    block_words: int = 1024
    shard_blocks: int = 4096
    slots_a_task: int = 1 << 16
    bucket_rows: int = 1 << 11  # documents of all sources in one bucket, about; documents are numbered within buckets
    copies_a_task: int = 4096  # of one text with one id
    rounds: int = 24
    seed: int = 17


def permuted(i: Column, n: Column, key: Column, rounds: int, inverse: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..n-1 sends i: a swap-or-not shuffle.

    Every round pairs x with (k - x) mod n and swaps the pair on a hash bit, so
    each round is its own inverse and any n will do.
    """
    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

    return F.aggregate(order, i.cast("long"), step)


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def water_filled(sources: DataFrame, cfg: MixConfig) -> DataFrame:
    """Add weight and target: shares by weight, capped at max_repeat times the size.

    The level L solves sum(least(cap, L * weight)) = total; with sources sorted by
    cap / weight it is the largest level that any number of capped sources gives.
    One row a source goes through the windows here.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in cfg.weights]), (F.pmod(F.col("place") - 1, F.lit(len(cfg.weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * cfg.max_repeat
    level = (F.sum("source_size").over(everything) * cfg.total_share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sources.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("cap", cap.cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
        .select("source_key", "source", "source_size", "weight", "target")
    )


@dataclass
class Mix:
    """A planned mix. Tables: ``documents`` (doc_id, source_key, text_key, size, start), ``sources``.

    In a source, no two documents with words have one start: (source_key, start) names a document.
    """

    documents: DataFrame
    sources: DataFrame
    cfg: MixConfig = field(default_factory=MixConfig)

    def slots(self) -> DataFrame:
        """shard, source_key, slot, pass, block, words: every block the mix uses, in order of use."""
        cfg, spark = self.cfg, self.documents.sparkSession
        s = self.sources
        cut = Window.partitionBy().orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        s = s.filter("n_slots > 0").withColumn("high", F.sum("n_slots").over(cut)).withColumn("low", F.col("high") - F.col("n_slots"))
        total = s.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
        cell = max(1, -(-total // 4096))
        parts = s.select("source_key", "low", "high", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))).alias("cell"))
        drawn = spark.range(total).select(
            F.expr(f"id div {cfg.shard_blocks}").alias("shard"),
            F.pmod(F.xxhash64(F.lit(cfg.seed), F.lit("draw"), "id"), F.lit(max(1, total))).alias("u"),
        ).withColumn("cell", F.expr(f"u div {cell}"))
        counts = (
            drawn.join(parts, "cell").filter("u >= low AND u < high").groupBy("source_key", "shard").agg(F.count("*").alias("n_drawn"))
        )
        # A closing shard, of which each source takes what it lacks.
        counts = counts.unionByName(s.select("source_key", F.lit(-(-total // cfg.shard_blocks)).cast("long").alias("shard"), F.col("n_slots").alias("n_drawn")))
        so_far = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("end", F.sum("n_drawn").over(so_far)).withColumn("begin", F.col("end") - F.col("n_drawn"))
        keyed = counts.join(s.drop("low", "high"), "source_key").withColumn("end", F.least("end", "n_slots")).filter("begin < end")
        # These few rows make total rows: deal them by what they will make, not by their own size.
        keyed = keyed.repartition(int(max(8, total // cfg.slots_a_task)), "source_key", "shard")
        out = keyed.withColumn("slot", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)))
        out = out.withColumn("pass", F.expr("slot div n_blocks")).withColumn("i", F.col("slot") % F.col("n_blocks"))
        out = out.withColumn("block", permuted(F.col("i"), F.col("n_blocks"), F.xxhash64(F.lit(cfg.seed), "source_key", "pass"), cfg.rounds))
        full = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("last_words")).otherwise(F.lit(cfg.block_words).cast("long"))
        words = F.when(F.col("slot") == F.col("n_slots") - 1, F.least(F.col("final_words"), full)).otherwise(full)
        return out.select("shard", "source_key", "slot", "pass", "block", words.alias("words"))

    def spans(self) -> DataFrame:
        """shard, source_key, slot, pass, doc_id, text_key, size, start, first_word, n_words: which words of which document fill each slot."""
        b = self.cfg.block_words
        pieces = self.documents.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
        joined = pieces.join(self.slots(), ["source_key", "block"]).withColumn("n_words", high - low).filter("n_words > 0")
        return joined.select("shard", "source_key", "slot", "pass", "doc_id", "text_key", "size", "start", (low - F.col("start")).alias("first_word"), "n_words")

    def runs(self) -> DataFrame:
        """source_key, start, doc_id, text_key, size, cuts: for each document the runs of words (first_word, n_words) that the passes take."""
        whose = ["source_key", "start", "pass"]
        before = Window.partitionBy(*whose).orderBy("first_word").rowsBetween(Window.unboundedPreceding, -1)  # a document's blocks
        run = self.spans().withColumn("run", F.col("first_word") - F.coalesce(F.sum("n_words").over(before), F.lit(0)))
        run = run.groupBy(*whose, "run", "doc_id", "text_key", "size").agg(F.min("first_word").alias("first_word"), F.sum("n_words").alias("n_words"))
        return run.groupBy("source_key", "start", "doc_id", "text_key", "size").agg(F.collect_list(F.struct("first_word", "n_words")).alias("cuts"))

    def taken(self) -> DataFrame:
        """doc_id, source_key, size, taken for every document."""
        used = self.spans().select("doc_id", "source_key", "start", F.lit(None).cast("long").alias("size"), F.col("n_words").alias("taken"))
        rows = self.documents.select("doc_id", "source_key", "start", "size", F.lit(0).cast("long").alias("taken"))
        empty = rows.filter("size = 0")
        summed = rows.filter("size > 0").unionByName(used).groupBy("doc_id", "source_key", "start").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
        return summed.unionByName(empty).drop("start")

    def per_document(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for every document."""
        return (
            self.taken()
            .join(self.sources.select("source_key", "source_size", "target"), "source_key")
            .select("doc_id", "size", "source_size", "target", "taken")
        )

    def block_texts(self, docs: DataFrame) -> DataFrame:
        """shard, source_key, slot, text: the mixed blocks themselves."""
        whose = ["source_key", "start", "doc_id", "text_key", "size"]
        spans = self.spans().groupBy(*whose).agg(F.collect_list(F.struct("shard", "slot", "first_word", "n_words")).alias("cuts"))  # a document's blocks
        cut = _with_words(spans, docs).select("source_key", "start", F.explode(F.transform("cuts", lambda c: F.struct(c["shard"].alias("shard"), c["slot"].alias("slot"), F.when(_in_parts(), _run("words", c)).otherwise(_all_words("__d_text")).alias("piece")))).alias("c"))
        return cut.groupBy("c.shard", "source_key", "c.slot").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "c.piece"))), lambda x: x["piece"]), " ").alias("text")
        )


def _run(words: str, cut: Column) -> Column:
    return F.array_join(F.slice(F.col(words), (cut["first_word"] + 1).cast("int"), cut["n_words"].cast("int")), " ")


def _one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with __key and __text_key; of rows equal in doc_id, source and text, one."""
    keyed = docs.withColumn("__key", source_key()).withColumn("__text_key", F.xxhash64("text"))
    names = ["doc_id", "__key", "__text_key"]
    again = materialize(keyed.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(names)]), "mix-repeats")
    if again.isEmpty():
        return keyed
    same = F.col("doc_id").eqNullSafe(F.col("__r0")) & (F.col("__key") == F.col("__r1")) & (F.col("__text_key") == F.col("__r2"))
    return keyed.join(again, same, "left_anti").unionByName(keyed.join(again, same, "left_semi").dropDuplicates(names))


def _all_words(text: str) -> Column:
    """A text's words with single spaces."""
    space = r"[\x20\x09-\x0D]+"
    return F.regexp_replace(F.regexp_replace(text, f"^{space}|{space}$", ""), space, " ")


def _in_parts() -> Column:
    """Whether a document's words have to be told apart: unless all its cuts are the whole of it."""
    return F.exists("cuts", lambda c: c["n_words"] < F.col("size"))


def _with_words(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``spans`` with the columns of ``docs``, named with __ in front, and the words of the text."""
    texts = _one_each(docs)
    texts = texts.select("__key", "__text_key", *[F.col(c).alias(f"__d_{c}") for c in docs.columns])
    # Nearly every document has a span, so both sides grow alike: a merge join at any size.
    same = F.col("doc_id").eqNullSafe(F.col("__d_doc_id")) & (F.col("source_key") == F.col("__key")) & (F.col("text_key") == F.col("__text_key"))
    return spans.hint("merge").join(texts, same).withColumn("words", F.when(_in_parts(), F.regexp_extract_all("__d_text", F.lit(WORD), F.lit(0))))


def plan_mix(docs: DataFrame, cfg: MixConfig | None = None) -> Mix:
    """Plan a mix of ``docs`` (doc_id, text, source). The texts are read once, to count words."""
    cfg = cfg or MixConfig()
    b = cfg.block_words
    one = docs.select(
        "doc_id",
        "source",
        source_key().alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_key"),
    )
    sized = materialize(one.groupBy("doc_id", "source", "source_key", "size", "text_key").agg(F.count("*").alias("copies")), "mix-sizes")
    buckets = max(1, -(-sized.count() // cfg.bucket_rows))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(cfg.seed), "doc_id", "text_key"), F.lit(buckets)))
    by_bucket = sized.groupBy("source_key", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"), F.first("source").alias("source"))
    totals = by_bucket.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    s = water_filled(totals, cfg)
    s = s.withColumn("n_blocks", F.expr(f"(source_size + {b - 1}) div {b}")).withColumn("last_words", F.expr(f"source_size - (n_blocks - 1) * {b}"))
    # Whole passes, then the first slots of one more; where in it the short last block comes decides how many.
    s = s.withColumn("goal", F.round("target").cast("long")).withColumn("passes", F.expr("coalesce(try_divide(goal, source_size), 0)").cast("long"))
    s = s.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
    short = permuted(F.col("n_blocks") - 1, F.greatest(F.col("n_blocks"), F.lit(1)), F.xxhash64(F.lit(cfg.seed), "source_key", "passes"), cfg.rounds, inverse=True)
    s = s.withColumn("short_at", short).withColumn("m", F.expr(f"(rest + {b - 1}) div {b}"))
    s = s.withColumn("m", F.col("m") + F.when((F.col("short_at") < F.col("m")) & (F.col("m") * b - (b - F.col("last_words")) < F.col("rest")), 1).otherwise(0))
    before_last = (F.col("m") - 1) * b - F.when(F.col("short_at") < F.col("m") - 1, b - F.col("last_words")).otherwise(0)
    s = s.withColumn("n_slots", F.when(F.col("source_size") > 0, F.col("passes") * F.col("n_blocks") + F.col("m")).otherwise(0))
    s = s.withColumn("final_words", F.when(F.col("m") > 0, F.col("rest") - before_last).otherwise(F.lit(b)).cast("long"))
    s = materialize(s.select("source_key", "source", "source_size", "target", "n_blocks", "last_words", "n_slots", "final_words"), "mix-sources")
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    order = F.xxhash64(F.lit(cfg.seed), F.lit("order"), "doc_id", "text_key")
    within = Window.partitionBy("source_key", "bucket").orderBy(order, "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0))
    placed = sized.withColumn("at", at).join(starts, ["source_key", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("at"))
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(cfg.copies_a_task))))
    many = F.col("copies") > cfg.copies_a_task
    placed = placed.filter(~many).unionByName(placed.filter(many).repartition("source_key", "start", "k"))
    copy = F.explode(F.sequence(F.col("k"), F.least(F.col("k") + cfg.copies_a_task, "copies") - 1))
    documents = placed.withColumn("copy", copy).select("doc_id", "source_key", "text_key", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))
    return Mix(materialize(documents, "mix-documents"), s, cfg)


def mix_documents(docs: DataFrame, cfg: MixConfig | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of a mix of ``docs``."""
    return plan_mix(docs, cfg).per_document()


def mixed_rows(docs: DataFrame, cfg: MixConfig | None = None) -> DataFrame:
    """The words the mix takes, as rows like those of ``docs``; together they meet the targets exactly.

    A document that a pass takes whole is a row as it stands; of one that a pass
    takes in part each run of words is a row, its text these words with single
    spaces, and n_chars, if there is such a column, its length. Of rows equal in
    doc_id, source and text, the other columns are those of one of them.
    """
    mix = plan_mix(docs, cfg)
    whole = lambda c: c["n_words"] == F.col("size")
    rows = _with_words(mix.runs(), docs)
    rows = rows.withColumn("__text", F.explode(F.transform("cuts", lambda c: F.when(whole(c), F.col("__d_text")).otherwise(_run("words", c)))))
    named = {c: F.col(f"__d_{c}") for c in docs.columns} | {"text": F.col("__text")}
    if "n_chars" in named:
        named["n_chars"] = F.when(F.col("__text") == F.col("__d_text"), named["n_chars"]).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[c.alias(name) for name, c in named.items()])
