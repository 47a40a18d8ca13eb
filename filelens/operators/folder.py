"""Folder ingest: what a kept file takes from a duplicate that is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse_records(pairs: DataFrame, offered: DataFrame, mtimes: DataFrame, attempted: bool = True) -> DataFrame:
    """One record a pair (id, survivor_path, matched_on, source_root, rel) with adopted and declined as JSON arrays.

    offered: id, field, state, and perhaps reason, of every value the duplicate offered (a
    merge with a reason is deferred too); mtimes: id, reason, adopted, detail of
    capture.mtime_adoption. Items are {what, from, detail} and {what, reason, detail}. What is
    adopted ends with where the copy came from, so the lists are never both empty. Without
    ``attempted``, as in a dry run, no value was offered and no record claims one.
    """
    took = lambda what, origin, detail: F.struct(what.alias("what"), F.lit(origin).alias("from"), detail.alias("detail"))
    left = lambda what, reason, detail: F.struct(what.alias("what"), reason.alias("reason"), detail.alias("detail"))
    if "reason" not in offered.columns:
        offered = offered.withColumn("reason", F.lit(None).cast("string"))
    field, state = F.col("field"), F.col("state")
    whole, only_mtime = state == "merged", state == "merged_mtime_only"
    why = F.when(state == "already_present", "survivor_already_has_it").when(state == "failed", "write_failed").otherwise("deferred_container_cannot_hold_it")
    late = (state == "deferred") | ((whole | only_mtime) & F.col("reason").isNotNull())
    turn = F.when(state == "already_present", 0).when(state == "failed", 1).otherwise(2)
    # Whole values before those that only the mtime took; what was there before what failed, then what waits.
    lists = offered.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(whole | only_mtime, F.struct(only_mtime.alias("turn"), field.alias("field"))))).alias("took"),
        F.sort_array(F.collect_list(F.when(late | ~(whole | only_mtime), F.struct(turn.alias("turn"), field.alias("field"), why.alias("why"))))).alias("left"),
    )
    rows = pairs.join(lists, "id", "left").join(mtimes.select("id", F.col("reason").alias("m_reason"), "adopted", F.coalesce("detail", F.lit("")).alias("m_detail")), "id", "left")
    limits = F.lit("written as mtime; container cannot hold EXIF")
    mine = F.transform("took", lambda x: took(x["field"], "duplicate_exif", F.when(x["turn"], limits).otherwise("")))
    theirs = F.transform("left", lambda x: left(x["field"], x["why"], F.lit("")))
    if not attempted:
        mine, theirs = F.filter(mine, lambda x: F.lit(False)), F.array(left(F.lit("exif_merge"), F.lit("dry_run"), F.lit("not attempted")))
    origin = F.array(took(F.lit("provenance"), "source_root", F.concat(F.lit("also present at "), "source_root", F.lit("/"), "rel")))
    nothing = F.filter(origin, lambda x: F.lit(False))
    m_took = F.when(F.col("adopted").isNotNull(), F.array(took(F.lit("mtime"), "source_file", F.col("m_detail")))).otherwise(nothing)
    m_left = F.when(F.col("m_reason").isNotNull(), F.array(left(F.lit("mtime"), F.col("m_reason"), F.col("m_detail"))))
    none_left = F.filter(F.array(left(F.lit(""), F.lit(""), F.lit(""))), lambda x: F.lit(False))
    return rows.select(
        "id", "survivor_path", "matched_on", F.to_json(F.concat(F.coalesce(mine, nothing), m_took, origin)).alias("adopted"), F.to_json(F.concat(F.coalesce(theirs, none_left), F.coalesce(m_left, none_left))).alias("declined")
    )


def observed(df: DataFrame, name: str, **counters) -> tuple[DataFrame, object]:
    """``df`` with counters that fill as it runs, for progress reports: no extra pass."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in counters.items()]), watch
