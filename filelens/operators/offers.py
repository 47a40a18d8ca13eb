"""Offers of metadata to files, and what becomes of each.

An offer is (target, field, value, offer_seq): for a date, value is the epoch; for a
place, lat and lon. The state of an offer depends on those before it at the same
target, so it is decided by windows over (target, field) in offer order, never by a
loop. What earlier batches did is read from the log, see ``targets_now``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.functions.documents import date_payload, gps_payload, logged_epoch, refusal
from filelens.functions.media import EXIF_WRITABLE
from filelens.functions.times import capture_time
from filelens.operators.changes import insert_once, pending_once

#: Columns that an offer may do without, and how they are then filled in.
OPTIONAL = {"lat": "double", "lon": "double", "source_desc": "string"}


def completed(offers: DataFrame) -> DataFrame:
    """Offers with every column: without ``capture`` the offset of a date is assumed to be none."""
    offers = offers.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in offers.columns})
    if "capture" not in offers.columns:
        nothing, zone = F.lit(None).cast("int"), F.lit(None).cast("string")
        offers = offers.withColumn("capture", capture_time(F.col("value"), nothing, zone, nothing))
    if "assumed" not in offers.columns:
        offers = offers.withColumn("assumed", F.col("capture.tz_source") == "utc_fallback")
    return offers


def log_order(log: DataFrame) -> Column:
    """The order of a log's rows: by the time they were appended, if the log has it, then by number.

    Numbers order the rows of one batch alone: entries of an archive and unmatched sidecars are numbered apart.
    """
    return F.struct("merge_time", "seq") if "merge_time" in log.columns else F.struct("seq")


def targets_now(targets: DataFrame, log: DataFrame) -> DataFrame:
    """``targets`` as the logged merges left them: a date or place that was merged is there, an mtime is the last one set."""
    done = log.filter(F.col("field").isin("date", "gps", "merged_mtime_only"))
    epoch = F.when(F.col("field") != "gps", logged_epoch(F.col("value")))
    did = done.groupBy(F.col("target_path").alias("target")).agg(
        F.bool_or(F.col("field") == "date").alias("got_date"), F.bool_or(F.col("field") == "gps").alias("got_gps"), F.max_by(epoch, F.when(epoch.isNotNull(), log_order(log))).alias("set_mtime")
    )
    rows = targets.join(did.hint("merge"), "target", "left")
    either = lambda had, got: F.when(F.col(got), True).otherwise(F.col(had))
    return rows.withColumns({"has_date": either("has_date", "got_date"), "has_gps": either("has_gps", "got_gps"), "mtime": F.coalesce(F.col("set_mtime").cast("double"), "mtime")}).drop("got_date", "got_gps", "set_mtime")


def evaluate_offers(offers: DataFrame, targets: DataFrame) -> DataFrame:
    """A state and a reason for every offer that offers something, and what satisfied the refused ones.

    ``targets``: target, container, exif_ok (false: its EXIF can't be parsed), has_date,
    has_gps, mtime, and perhaps write_error, the kind of error that writing meets. Files that
    hold EXIF take the first usable value of a field. Other files take dates as mtime, each
    compared with the one before.
    """
    if "write_error" not in targets.columns:
        targets = targets.withColumn("write_error", F.lit(None).cast("string"))
    rows = completed(offers).filter("value IS NOT NULL OR lat IS NOT NULL").join(targets.hint("merge"), "target")  # a target that is gone gets no outcome
    order = Window.partitionBy("target", "field").orderBy("offer_seq")
    writable = F.col("container").isin(*EXIF_WRITABLE)
    had = F.coalesce(F.when(F.col("field") == "date", F.col("has_date")).otherwise(F.col("has_gps")), F.lit(False))
    first = F.row_number().over(order) == 1
    held = F.coalesce(F.lag("value").over(order), F.col("mtime").cast("bigint"))
    state = (
        F.when(writable & (~F.col("exif_ok") | (F.col("write_error").isNotNull() & ~had)), "failed")
        .when(writable & (had | ~first), "already_present")
        .when(writable, "merged")
        .when(F.col("field") == "gps", "deferred")
        .when(F.col("value") == held, "already_present")
        .otherwise("merged_mtime_only")
    )
    rows = rows.withColumn("state", state)
    reason = (
        F.when(F.col("state") == "failed", F.when(~F.col("exif_ok"), "failed_unparseable").otherwise(F.concat(F.lit("failed_write_error:"), "write_error")))
        .when((F.col("state") == "merged") & (F.col("field") == "date") & F.col("assumed"), "tz_unknown_assumed_utc")
        .when(F.col("state").isin("deferred", "merged_mtime_only"), F.concat(F.lit("unsupported_"), "container"))
    )
    by = F.when(F.col("state") == "already_present", F.when(~writable, "mtime").otherwise(F.concat(F.lit("exif_"), "field")))
    kept = ("target", "field", "value", "lat", "lon", "capture", "source_desc", "offer_seq")
    return rows.withColumn("reason", reason).withColumn("satisfied_by", by).select(*kept, "state", "reason", "satisfied_by")


def overlay(decisions: DataFrame) -> DataFrame:
    """The value that each file and field should carry after all offers."""
    taken = decisions.filter(F.col("state").isin("merged", "merged_mtime_only"))
    return taken.groupBy("target", "field").agg(F.max_by("value", "offer_seq").alias("value"))


def payload_of() -> Column:
    """The document of an offer: a date's or a place's."""
    return F.when(F.col("field") == "date", date_payload(F.col("value"), F.col("capture"))).otherwise(gps_payload(F.col("lat"), F.col("lon")))


def change_sets(decisions: DataFrame, log: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New log rows (seq, target_path, source_desc, field, value) and new pending rows; the same offers again give none of either.

    Merges are logged each, a date that only the mtime took as ``merged_mtime_only``.
    Refusals are logged once for a target and exact document, pending rows once
    while outstanding. seq is the offer's own place in the order of its source; what the log
    knows an offer by is all of the row, as sources number their offers apart.
    """
    rows = decisions.withColumn("payload", payload_of())
    log_row = (F.col("offer_seq").alias("seq"), F.col("target").alias("target_path"), "source_desc")
    refused = rows.filter("state = 'already_present'").select(*log_row, F.lit("already_present").alias("field"), refusal(F.col("field"), F.col("value"), F.col("lat"), F.col("lon"), F.col("satisfied_by")).alias("value"))
    once = insert_once(log.filter("field = 'already_present'"), refused, ["target_path", "value"], "seq")
    merged = rows.filter(F.col("state").isin("merged", "merged_mtime_only")).select(*log_row, F.when(F.col("state") == "merged", F.col("field")).otherwise(F.col("state")).alias("field"), F.col("payload").alias("value"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"l.{c}")) for c in merged.columns]
    fresh = merged.alias("m").join(log.select(*merged.columns).alias("l").hint("merge"), same, "left_anti")
    waits = rows.filter("reason IS NOT NULL").select(
        F.col("offer_seq").alias("seq"), F.col("target").alias("file_path"), "field", F.col("payload").alias("value"), "reason", F.when(F.col("state") == "failed", "failed").otherwise("deferred").alias("state"), "source_desc"
    )
    return fresh.unionByName(once), pending_once(pending, waits, "seq")


def first_usable(log: DataFrame, epoch: Column) -> DataFrame:
    """path, epoch: the first logged epoch of each path that is there and not zero."""
    rows = log.withColumn("epoch", epoch).filter("epoch IS NOT NULL AND epoch <> 0")
    return rows.groupBy(F.col("target_path").alias("path")).agg(F.min_by("epoch", log_order(log)).alias("epoch"))


def sidecar_offers(sidecars: DataFrame) -> DataFrame:
    """The offers that sidecars make: sidecars (seq, target, payload of utc_epoch, lat, lon, source_desc).

    A date and a place each make one; of the two of one sidecar the date comes first.
    """
    p = F.col("payload")
    none, date = F.lit(None).cast("double"), F.struct(F.lit("date").alias("field"), p["utc_epoch"].alias("value"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(0).alias("turn"))
    place = F.struct(F.lit("gps").alias("field"), F.lit(None).cast("bigint").alias("value"), F.coalesce(p["lat"], none).alias("lat"), p["lon"].alias("lon"), F.lit(1).alias("turn"))
    rows = sidecars.select("seq", "target", "source_desc", F.explode(F.array(date, place)).alias("o")).filter("o.value IS NOT NULL OR o.lat IS NOT NULL")
    return rows.select("target", "o.field", "o.value", "o.lat", "o.lon", (F.col("seq") * 2 + F.col("o.turn")).alias("offer_seq"), "source_desc")


def donations(pairs: DataFrame, sidecars: DataFrame, own: DataFrame) -> DataFrame:
    """Offers a duplicate makes to the survivor: its sidecar's first, then what it carries itself.

    pairs (source, target), sidecars and own (source, field, value, and perhaps lat, lon and
    offset_seconds). What a file carries itself keeps its own wall clock and offset, and says
    so: tz_source is ``source_file``.
    """

    def full(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in {"lat": "double", "lon": "double", "offset_seconds": "int"}.items() if c not in rows.columns})

    from_sidecar = pairs.join(full(sidecars), "source").withColumn("turn", F.lit(1)).withColumn("source_desc", F.concat(F.lit("takeout:"), "source"))
    from_file = pairs.join(full(own), "source").withColumn("turn", F.lit(2)).withColumn("source_desc", F.concat(F.lit("file:"), "source"))
    rows = from_sidecar.unionByName(from_file)
    nothing, zone = F.lit(None).cast("int"), F.lit(None).cast("string")
    clock = capture_time(F.col("value"), F.col("offset_seconds"), zone, nothing)
    own_clock = F.when(F.col("turn") == 2, F.lit("source_file")).otherwise(clock["tz_source"])
    rows = rows.withColumn("capture", F.struct(clock["local_epoch"].alias("local_epoch"), clock["offset"].alias("offset"), clock["tz_name"].alias("tz_name"), own_clock.alias("tz_source")))
    order = Window.partitionBy("target", "field").orderBy("turn", "source")
    return rows.withColumn("offer_seq", F.row_number().over(order)).select("target", "field", "value", "lat", "lon", "capture", "offer_seq", "source_desc")
