"""Streams of archive entries: matching, deduplication, once-only application."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from filelens.functions.names import parse_sidecar
from filelens.functions.paths import basename, dirname, join_path
from filelens.operators import offers
from filelens.operators.changes import current, publish_all
from filelens.storage import put_text, stored


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files below a path, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def match_streams(sidecars: DataFrame, media: DataFrame, late: str = "10 minutes", near: str = "1 hour") -> DataFrame:
    """sidecars (archive_id, entry_path, at) with their media file, whichever came first; null once it can't come any more.

    media (archive_id, entry_path, at). Candidate names become rows, so the join is on
    (archive, directory, name) with a bound on the times apart; state goes with the watermarks.
    A sidecar with two candidate names gives a row for each: ``settled_matches`` says which
    sidecars are without a media file.
    """
    parsed = parse_sidecar(basename(F.col("entry_path")))["candidates"]
    s = sidecars.withWatermark("at", late).select("archive_id", "entry_path", "at", F.posexplode_outer(parsed).alias("prio", "name"))
    s = s.select(F.col("archive_id").alias("s_archive"), F.col("entry_path").alias("sidecar_path"), "prio", F.size(parse_sidecar(basename(F.col("entry_path")))["candidates"]).alias("names"), join_path(dirname(F.col("entry_path")), F.col("name")).alias("wanted"), F.col("at").alias("s_at"))
    m = media.withWatermark("at", late).select(F.col("archive_id").alias("m_archive"), F.col("entry_path").alias("media_path"), F.col("at").alias("m_at"))
    near_by = F.expr(f"m_at BETWEEN s_at - INTERVAL {near} AND s_at + INTERVAL {near}")
    return s.join(m, (F.col("s_archive") == F.col("m_archive")) & (F.col("wanted") == F.col("media_path")) & near_by, "left_outer").select("s_archive", "sidecar_path", "prio", "names", "wanted", "media_path", "s_at")


def settled_matches(rows: DataFrame) -> DataFrame:
    """One row a sidecar, from the table that match_streams was written to: its media file of the best candidate.

    Sidecars none of whose candidates can come any more have none and are ``unmatched``;
    those that still wait for a candidate aren't there.
    """
    by = rows.groupBy("s_archive", "sidecar_path").agg(F.min_by("media_path", F.when(F.col("media_path").isNotNull(), F.col("prio"))).alias("media_path"), F.count_distinct("prio").alias("seen"), F.max(F.greatest("names", F.lit(1))).alias("names"))
    return by.filter("media_path IS NOT NULL OR seen >= names OR names <= 1").select("s_archive", "sidecar_path", "media_path", F.col("media_path").isNull().alias("unmatched"))


def counted(stream: DataFrame, name: str, **counters) -> DataFrame:
    """A stream with counters that every batch reports, see ``progress``."""
    return stream.observe(name, *[c.alias(k) for k, c in counters.items()])


def progress(query, name: str) -> list[dict]:
    """The counters of each finished batch of a running or ended query."""
    return [{**p["observedMetrics"][name], "batch": p["batchId"]} for p in (json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress) if name in p.get("observedMetrics", {})]


class CounterTable(StreamingQueryListener):
    """Writes the counters of every finished batch of ``counted`` streams below ``folder``, one file a batch.

    A query remembers its last batches only; this table has them all, and a batch that is
    run again overwrites its own row. Add it with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for name, row in (p.observedMetrics or {}).items():
            text = json.dumps({"query": str(p.id), "batch": p.batchId, "name": name, "counters": {k: str(v) for k, v in row.asDict().items()}})
            put_text(self.spark, f"{self.folder}/{name}-{p.id}-{p.batchId}.json", text + "\n", overwrite=True)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """query, batch, name and counters (texts by name) of all batches that a CounterTable wrote."""
    return spark.read.schema("query string, batch bigint, name string, counters map<string, string>").json(folder)


def fresh_entries(entries: DataFrame, history: DataFrame, root: str, checkpoint: str):
    """Add entries (digest, ...) whose bytes are neither in history nor earlier in the stream to the table "entries".

    Each batch is held against all that was published before, however far apart in
    time, and no entry is dropped as late. A batch that is run again changes nothing, and
    writes no more than its own new rows. Entries without a digest are told apart by their
    other columns.
    """
    whole = F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"})
    name = F.coalesce(F.concat(F.lit("d"), F.col("digest").cast("string")), F.concat(F.lit("n"), whole))

    def batch(rows: DataFrame, number: int) -> None:
        seen = current(rows.sparkSession, root, "entries")
        known = seen.select(name.alias("__name")).unionByName(history.filter("digest IS NOT NULL").select(F.concat(F.lit("d"), F.col("digest").cast("string")).alias("__name")))
        fresh = rows.withColumn("__name", name).dropDuplicates(["__name"]).join(known, "__name", "left_anti")
        publish_all({}, root, {"entries": fresh.select(*seen.columns)})

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The numbers of offers that were applied, by source: a bit each, in buckets of 32,768.
APPLIED = "source string, bucket bigint, bits binary"


def unapplied(offered: DataFrame, applied: DataFrame) -> DataFrame:
    """Offers (source, offer_seq, ...) whose number isn't among their source's applied ones, one of each number."""
    number = F.col("offer_seq")
    rows = offered.dropDuplicates(["source", "offer_seq"]).withColumns({"__bucket": F.bitmap_bucket_number(number), "__bit": F.bitmap_bit_position(number)})
    asked = rows.select("source", F.col("__bucket").alias("bucket")).distinct()
    held = applied.join(asked, ["source", "bucket"], "left_semi").groupBy("source", F.col("bucket").alias("__bucket")).agg(F.bitmap_or_agg("bits").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.col("__bits").isNotNull() & F.expr("true").eqNullSafe(F.call_function("getbit", byte, (F.col("__bit") % 8).cast("int")) == 1)
    return rows.join(held, ["source", "__bucket"], "left").filter(~is_set).drop("__bucket", "__bit", "__bits")


def apply_offers(stream: DataFrame, targets: DataFrame, root: str, checkpoint: str, on_batch: Callable[[int], None] | None = None):
    """Apply a stream of offers exactly once, in whatever order batches come: a batch that is run again changes nothing.

    Each batch is decided against the targets as the current log left them, and publishes
    new log and pending rows and the numbers it dealt with together. An offer is known by its
    source (a column ``source``, where several number their offers apart) and offer_seq, so a
    late file with lower numbers is applied as any other. Offers of one target and field
    are decided in the order of their batches, within one by number.
    """
    if "source" not in stream.columns:
        stream = stream.withColumn("source", F.lit(""))

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = stored(rows.na.fill("", ["source"]), "offered")  # a batch's source is read once
        fresh = stored(unapplied(rows, current(spark, root, "applied")), "offers")
        asked = fresh.select("target").distinct()
        log = current(spark, root, "log").join(asked.withColumnRenamed("target", "target_path"), "target_path", "left_semi")
        waits = current(spark, root, "pending").join(asked.withColumnRenamed("target", "file_path"), "file_path", "left_semi")
        decided = stored(offers.evaluate_offers(fresh, offers.targets_now(targets, log)), "decisions")
        new_log, new_waits = offers.change_sets(decided, log, waits)
        bits = fresh.groupBy("source", F.bitmap_bucket_number("offer_seq").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("offer_seq")).alias("bits"))
        parts = {
            "log": new_log.withColumn("merge_time", F.current_timestamp()).select("seq", "target_path", "source_desc", "field", "value", "merge_time"),
            "pending": new_waits.withColumn("applied_at", F.lit(None).cast("timestamp")).select("seq", "file_path", "field", "value", "reason", "state", "source_desc", "applied_at"),
            "applied": bits,
        }
        publish_all({}, root, parts)
        if on_batch:
            on_batch(number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
