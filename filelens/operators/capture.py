"""Capture times, instants and mtimes from several witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.functions.times import EARLIEST_MTIME, INGEST_WINDOW, SIBLING_WINDOW, capture_time, matches_own_clock, resolve_instant

TAIL_BYTES = 4096


def sibling_offsets(wanted: DataFrame, siblings: DataFrame) -> DataFrame:
    """wanted (id, dir, epoch): the one offset that siblings of the same directory within 12 hours agree on.

    A directory's time is cut into blocks of 12 hours, so what is near a row is the end of the
    block before its own, all of its own and the beginning of the next. The smallest and largest
    offset of each of the three are running ones, from one end of a block to a place in it:
    each row asks at three places and is never paired with its siblings.
    """
    span = SIBLING_WINDOW
    block = F.floor(F.col("epoch") / span)
    near = siblings.filter("offset IS NOT NULL").groupBy("dir", "epoch").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    known = near.select(F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), "dir", block.alias("block"), F.col("epoch").alias("at"), "lo", "hi", F.lit("known").alias("kind"))
    place = lambda b, at, kind: F.struct(b.alias("block"), at.cast("bigint").alias("at"), F.lit(kind).alias("kind"))
    places = F.array(place(block - 1, F.col("epoch") - span, "end"), place(block, (block + 1) * span - 1, "begin"), place(block + 1, F.col("epoch") + span, "begin"))
    asked = wanted.filter("epoch IS NOT NULL").select("id", "dir", F.explode(places).alias("p"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    rows = asked.select("id", "dir", "p.block", "p.at", "lo", "hi", "p.kind").unionByName(known.withColumn("at", F.col("at").cast("bigint")))
    of_block = Window.partitionBy("dir", "block")
    upward, downward = (of_block.orderBy(at).rangeBetween(Window.unboundedPreceding, 0) for at in (F.asc("at"), F.desc("at")))
    both = lambda f, c: F.when(F.col("kind") == "begin", f(c).over(upward)).otherwise(f(c).over(downward))
    rows = rows.select("id", "kind", both(F.min, "lo").alias("lo"), both(F.max, "hi").alias("hi")).filter("kind <> 'known'")
    return rows.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo = hi").select("id", F.col("lo").alias("sibling_offset"))


def zones_of(places: DataFrame, zones: DataFrame) -> DataFrame:
    """places (id, lat, lon) with the zone whose box holds the rounded place; the first by priority.

    Looked up once for each distinct rounded place. Boxes are listed by the whole
    degrees they touch, so the lookup is an equi-join on the degree cell.
    """
    at = places.withColumn("rlat", F.bround("lat", 3)).withColumn("rlon", F.bround("lon", 3))
    cells = at.select("rlat", "rlon").distinct().withColumn("cy", F.floor("rlat")).withColumn("cx", F.floor("rlon"))
    span = lambda lo, hi, name: F.explode(F.sequence(F.floor(lo), F.floor(hi))).alias(name)
    boxes = zones.select("*", span("lat_lo", "lat_hi", "cy")).select("*", span("lon_lo", "lon_hi", "cx"))
    inside = "rlat >= lat_lo AND rlat <= lat_hi AND rlon >= lon_lo AND rlon <= lon_hi"
    found = cells.join(boxes, ["cy", "cx"]).filter(inside).groupBy("rlat", "rlon").agg(F.min_by("zone", "priority").alias("zone"))
    return at.join(found, ["rlat", "rlon"], "left").drop("rlat", "rlon")


def capture_times(rows: DataFrame) -> DataFrame:
    """rows (id, epoch, own_offset, zone, sibling_offset) with local_epoch, offset, tz_name, tz_source, is_assumed."""
    out = rows.withColumn("c", capture_time(F.col("epoch"), F.col("own_offset"), F.col("zone"), F.col("sibling_offset")))
    return out.select("id", "c.*", (F.col("c.tz_source") == "utc_fallback").alias("is_assumed"))


def _day(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def _moment(epoch: Column) -> Column:
    """A moment with its fraction, if it has one."""
    at = F.timestamp_seconds(epoch)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(epoch != F.floor(epoch), F.date_format(at, ".SSSSSS")).otherwise(""))


def mtime_adoption(pairs: DataFrame, now: int) -> DataFrame:
    """Whether the survivor of a pair takes the source's mtime: the first reason that holds, in words too.

    pairs: id, src_mtime, src_clock, dst_mtime, dst_clock, and perhaps error; a null mtime could not
    be read, as error says.
    """
    lo, hi = INGEST_WINDOW
    src, dst = matches_own_clock(F.col("src_mtime"), F.col("src_clock")), matches_own_clock(F.col("dst_mtime"), F.col("dst_clock"))
    reason = (
        F.when(F.col("src_mtime").isNull() | F.col("dst_mtime").isNull(), "stat_failed")
        .when(dst | (dst.isNull() & ~F.col("dst_mtime").between(lo, hi)), "survivor_mtime_not_clobbered")
        .when(~((F.col("src_mtime") > EARLIEST_MTIME) & (F.col("src_mtime") < now)), "source_mtime_implausible")
        .when(~src, "source_mtime_disagrees_with_its_own_exif")
        .when(src.isNull() & F.col("src_mtime").between(lo, hi), "source_mtime_also_from_ingest_window")
    )
    error = F.coalesce("error", F.lit("")) if "error" in pairs.columns else F.lit("")
    kept = F.when(dst, "survivor mtime sits a legal UTC offset from its own EXIF, so it describes the capture").otherwise(
        F.concat(F.lit("no EXIF to check against and "), _day(F.col("dst_mtime")), F.lit(" is outside the Takeout ingest window; it may be legitimate"))
    )
    detail = (
        F.when(F.col("reason") == "stat_failed", error)
        .when(F.col("reason") == "survivor_mtime_not_clobbered", kept)
        .when(F.col("reason") == "source_mtime_implausible", _moment(F.col("src_mtime")))
        .when(F.col("reason") == "source_mtime_disagrees_with_its_own_exif", "gap is not a whole 15-minute offset")
        .when(F.col("reason").isNotNull(), "")
        .otherwise(F.concat(_day(F.col("dst_mtime")), F.lit(" (ingest) -> "), _day(F.col("src_mtime")), F.lit(" (source)")))
    )
    rows = pairs.withColumn("reason", reason).withColumn("detail", detail)
    return rows.withColumn("adopted", F.when(F.col("reason").isNull(), F.col("src_mtime"))).select("id", "reason", "adopted", "detail")


def mtime_candidates(files: DataFrame, window: tuple[int, int] = INGEST_WINDOW) -> DataFrame:
    return files.filter(F.col("mtime").between(*window))


def mtime_changes(plan: DataFrame) -> DataFrame:
    """The audit of a repair: what each changed file had, what it gets, which witness said so and how; appended, never rewritten."""
    return plan.filter("decision = 'set'").select("path", "old_mtime", F.col("new_mtime").cast("double").alias("new_mtime"), F.col("reason").alias("source"), "detail")


def content_guard(full: bool) -> Column:
    """Null where a file is the one its row describes, else how it differs: by size, then by its full digest or by head and tail.

    Columns size, digest_full, digest_head, digest_tail of the row and now_size, now_full,
    now_head, now_tail of the file. What a row doesn't hold isn't compared, but for the full
    digest in full mode. The tail of a file that isn't longer than a tail is its head.
    """

    def differ(name: str, stored: str, now: Column) -> Column:
        shown = lambda c: F.coalesce(F.substring(c, 1, 16), F.lit("none"))
        words = F.concat(F.lit(f"{name} db "), shown(F.col(stored)), F.lit(" != disk "), shown(now))
        return F.when(~F.col(stored).eqNullSafe(now), words)

    size = F.when(F.col("size") != F.col("now_size"), F.concat(F.lit("size "), F.format_number("now_size", 0), F.lit(" != db "), F.format_number("size", 0)))
    if full:
        return F.coalesce(size, differ("full digest", "digest_full", F.col("now_full")))
    tail_now = F.when(F.col("now_size") > TAIL_BYTES, F.col("now_tail")).otherwise(F.col("now_head"))
    head = F.when(F.col("digest_head").isNotNull(), differ("head digest", "digest_head", F.col("now_head")))
    return F.coalesce(size, head, F.when(F.col("digest_tail").isNotNull(), differ("tail digest", "digest_tail", tail_now)))


def repair_plan(files: DataFrame, listing: DataFrame, clocks: DataFrame, epochs: DataFrame, full: bool = False) -> DataFrame:
    """For every file stamped by an ingest run: the decision, its reason or source, in words too, and the old and new mtime.

    listing (path, now_size, now_full, now_head, now_tail, now_mtime) is what is on disk:
    whether a file has its right time already is asked of the disk, as is the old time. clocks
    (path, readable, clock, offset), epochs (path, epoch). ``full`` holds files against their
    full digests, else against head and tail.
    """
    rows = mtime_candidates(files).join(listing, "path", "left").join(clocks, "path", "left").join(epochs.withColumnRenamed("epoch", "claimed"), "path", "left")
    rows = rows.withColumn("i", resolve_instant(F.coalesce("readable", F.lit(False)), F.col("clock"), F.col("offset"), F.col("claimed")))
    rows = rows.withColumn("differs", content_guard(full))
    reason = F.when(F.col("now_size").isNull(), "file_missing").when(F.col("i.epoch").isNull(), F.col("i.outcome")).when(F.col("differs").isNotNull(), "hash_mismatch")
    detail = F.when(F.col("now_size").isNull(), "").when(F.col("i.epoch").isNull(), F.col("i.detail")).otherwise(F.coalesce("differs", "i.detail"))
    right = F.col("i.epoch") == F.col("now_mtime").cast("bigint")
    decision = F.when(reason.isNotNull(), "skipped").when(right, "already_correct").otherwise("set")
    return rows.select(
        "path", decision.alias("decision"), F.coalesce(reason, "i.outcome").alias("reason"), detail.alias("detail"), F.when(decision == "set", F.col("i.epoch")).alias("new_mtime"), F.col("now_mtime").alias("old_mtime")
    )
