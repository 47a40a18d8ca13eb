"""Change sets over catalog snapshots: upserts, insert-once rows, publishing.

A snapshot is an immutable DataFrame. An operator takes the current snapshot and
a change set and returns the next one; ``publish`` writes it beside the old one
and switches by one file of pointers, so readers see all of it or none.
"""

from __future__ import annotations

import json
import logging
import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.schema import DEFAULTS
from filelens.storage import exists, put_text


LOG = logging.getLogger(__name__)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that are missing, with their defaults, and log which; keep any others."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    if missing:
        LOG.warning("added columns: %s", ", ".join(f.name for f in missing))
    return df.withColumns({f.name: F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in missing})


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key within one change set."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return changes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge_upsert(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """The next snapshot: ``columns`` of changed keys come from the changes, others stay.

    ``rules`` overrides a column with an expression over ``cur`` and ``new``, such as
    coalesce(new.title, cur.title). New keys are inserted with the changed columns.
    """
    new = latest(changes, keys, order).select(*keys, *columns).withColumn("__hit", F.lit(True))
    cur = current.withColumn("__old", F.lit(True))
    same = [F.col(f"cur.{k}") == F.col(f"new.{k}") for k in keys]
    joined = cur.alias("cur").join(new.alias("new"), same, "full")
    rules = rules or {}
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.coalesce(f"cur.{c}", f"new.{c}").alias(c))
        elif c in columns:
            value = rules.get(c, F.col(f"new.{c}"))
            out.append(F.when(F.col("new.__hit"), value).otherwise(F.col(f"cur.{c}")).alias(c))
        else:
            out.append(F.col(f"cur.{c}").alias(c))
    return joined.select(*out)


def update(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """merge_upsert that inserts nothing: changes of unknown keys are left out."""
    known = changes.join(current.select(*keys).distinct(), keys, "left_semi")
    return merge_upsert(current, known, keys, columns, order)


def update_mtimes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files with the mtimes of changes (path, mtime, change_seq)."""
    return update(files, changes, ["path"], ["mtime"], "change_seq")


def reindex(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows follow the bytes that are stored now; the source digest and the source change only where they are given.

    saved: path, size, digest_full, digest_head, digest_tail, mtime, has_exif_date, has_exif_gps,
    digest_source, source, change_seq.
    """
    columns = ["size", "digest_full", "digest_head", "digest_tail", "mtime", "has_exif_date", "has_exif_gps", "digest_source", "source"]
    rules = {c: F.coalesce(f"new.{c}", f"cur.{c}") for c in ("digest_source", "source")}
    return merge_upsert(files, saved, ["path"], columns, "change_seq", rules)


def log_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """The entry log: status, kept path and skip reason are overwritten together."""
    return merge_upsert(entries, changes, ["archive_id", "entry_path"], ["status", "kept_path", "skip_reason"], "change_seq")


def store_collapses(collapses: DataFrame, changes: DataFrame) -> DataFrame:
    """Collapse records; of a known one only adopted, declined and collapsed_at follow."""
    keys, follow = ["archive_id", "entry_path"], ("adopted", "declined", "collapsed_at")
    columns = [c for c in collapses.columns if c not in keys and c in changes.columns]
    rules = {c: F.when(F.col("cur.__old"), F.col(f"cur.{c}")).otherwise(F.col(f"new.{c}")) for c in columns if c not in follow}
    return merge_upsert(collapses, changes, keys, columns, "change_seq", rules)


def store_verdicts(classes: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """Verdicts by (path, classifier); each names the catalog's row of its path, if there is one.

    results: path, classifier, verdict, reason, confidence, evidence, classified_at, change_seq.
    """
    rows = results.join(files.select("path", F.col("seq").alias("file_id")), "path", "left")
    columns = ["verdict", "reason", "confidence", "evidence", "classified_at"]
    rules = {"file_id": F.when(F.col("cur.__old"), F.col("cur.file_id")).otherwise(F.col("new.file_id"))}
    return merge_upsert(classes, rows, ["path", "classifier"], [*columns, "file_id"], "change_seq", rules)


def insert_once(existing: DataFrame, offered: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The offered rows that are new: not among ``existing``, and first of their key in the batch."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = offered.join(existing.select(*keys).distinct().hint("merge"), keys, "left_anti")
    return fresh.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def pending_once(pending: DataFrame, offered: DataFrame, order: str) -> DataFrame:
    """New pending rows: identical outstanding ones block, applied ones don't."""
    checked = offered.withColumn("state", checked_domain("state", ("deferred", "failed"))).withColumn("field", checked_domain("field", ("date", "gps")))
    return insert_once(pending.filter("applied_at IS NULL"), checked, ["file_path", "field", "value"], order)


def checked_domain(column: str, allowed: tuple[str, ...]) -> Column:
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} out of domain: "), F.coalesce(column, F.lit("null")))))


def archive_upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Register archives: digest and total follow, an empty title keeps the old one."""
    rules = {"title": F.coalesce(F.nullif(F.trim("new.title"), F.lit("")), F.col("cur.title"))}
    return merge_upsert(current, changes, ["path"], ["title", "digest", "entries_total"], "change_seq", rules)


def set_titles(archives: DataFrame, changes: DataFrame) -> DataFrame:
    """Titles as they are set by hand; an empty one clears."""
    return update(archives, changes.withColumn("title", F.nullif(F.trim("title"), F.lit(""))), ["path"], ["title"], "change_seq")


def archive_status(current: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Change the status; completed_at is set by 'complete' alone and never cleared."""
    rules = {"completed_at": F.when(F.col("new.status") == "complete", F.col("new.completed_at")).otherwise(F.col("cur.completed_at"))}
    return merge_upsert(current, changes.withColumn("completed_at", now), ["path"], ["status", "completed_at"], "change_seq", rules)


def mark_stale(resolutions: DataFrame) -> DataFrame:
    """Machine-made verdicts become stale; ``changed`` tells which did just now."""
    hit = F.coalesce("auto_resolved", F.lit(False)) & ~F.coalesce("stale", F.lit(False))
    return resolutions.withColumn("changed", hit).withColumn("stale", F.coalesce("stale", F.lit(False)) | hit)


def mark_rebound(sidecars: DataFrame, binds: DataFrame) -> DataFrame:
    """Mark bound sidecars and the identical offers collapsed onto them."""
    rows = binds.select(F.explode(F.concat(F.array("seq"), "duplicate_seqs")).alias("seq"), F.col("target").alias("__path"), F.col("outcome").alias("__outcome"), F.col("rebound_at").alias("__at"))
    joined = sidecars.join(rows.hint("merge"), "seq", "left")
    return joined.withColumns(
        {"rebound_path": F.coalesce("__path", "rebound_path"), "rebound_outcome": F.coalesce("__outcome", "rebound_outcome"), "rebound_at": F.coalesce("__at", "rebound_at")}
    ).drop("__path", "__outcome", "__at")


def repoint(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rewrite a path prefix."""
    c = F.col(column)
    return df.withColumn(column, F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(c))


def prefix_leaks(tables: list[tuple[DataFrame, str]], old: str) -> DataFrame:
    """at, leaks: how many rows of each (table, column) still begin with a prefix."""
    counts = [df.filter(F.startswith(column, F.lit(old))).agg(F.lit(column).alias("at"), F.count("*").alias("leaks")) for df, column in tables]
    return reduce(DataFrame.unionByName, counts)


def publish_all(tables: dict[str, DataFrame], root: str, parts: dict[str, DataFrame] | None = None) -> None:
    """Write snapshots of several tables, and ``parts`` that are added to others, and make them current together.

    The switch is one file of pointers, named by its number and created by whoever is
    first: readers see all of a unit of work or none, a failure before leaves the old state
    current, and of two publishers who began from the same state the second fails and
    has to begin again. Parts cost what they hold, whatever the table has already.
    """
    parts = parts or {}
    spark = next(iter((tables | parts).values())).sparkSession
    unit, rows, number = uuid.uuid4().hex, [], _last_unit(spark, root) + 1
    for whole, group in ((True, tables), (False, parts)):
        for name, df in group.items():
            version = f"{root}/{name}/v-{unit}"
            df.write.parquet(version)
            rows.append({"number": number, "unit": unit, "name": name, "version": version, "whole": whole})
    if not put_text(spark, f"{root}/_pointers/{number:012d}.json", "".join(json.dumps(r) + "\n" for r in rows)):
        raise RuntimeError(f"another publisher was first with unit {number} of {root}; read again and begin anew")


POINTERS = "number bigint, unit string, name string, version string, whole boolean"


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointer rows: one a published table or part; none before the first."""
    if not exists(spark, f"{root}/_pointers"):
        return spark.createDataFrame([], POINTERS)
    return spark.read.schema(POINTERS).json(f"{root}/_pointers").filter("whole IS NOT NULL")


def _last_unit(spark: SparkSession, root: str) -> int:
    return _pointers(spark, root).agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first()["n"]


def publish(df: DataFrame, root: str, name: str) -> None:
    """publish_all of one table."""
    publish_all({name: df}, root)


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current state: the last whole snapshot and the parts since; a pointer row each is read on the driver."""
    rows = _pointers(spark, root).filter(F.col("name") == name).orderBy("number").collect()
    last = max((i for i, r in enumerate(rows) if r["whole"]), default=None)
    if last is None:
        raise LookupError(f"{root} has no table {name}")
    first = spark.read.parquet(rows[last]["version"])
    return spark.read.schema(first.schema).parquet(*[r["version"] for r in rows[last:]])
