"""Reports over the catalog, and guards that stop a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.functions.paths import volume_root


def changed_since(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files whose path, size and mtime aren't in the catalog as they are."""
    return listing.join(files.filter("mtime IS NOT NULL").select("path", "size", "mtime").distinct(), ["path", "size", "mtime"], "left_anti")


def volumes(files: DataFrame) -> DataFrame:
    """Rows and an example path for each removable volume."""
    rows = files.withColumn("volume", volume_root(F.col("path"))).filter("volume IS NOT NULL")
    return rows.groupBy("volume").agg(F.count("*").alias("rows"), F.min("path").alias("example")).orderBy(F.desc("rows"), "volume")


def detached_volumes(files: DataFrame, attached: DataFrame) -> DataFrame:
    """The volumes that hold catalog rows and aren't attached."""
    return volumes(files).join(attached.select("volume").distinct(), "volume", "left_anti")


def require_volumes(files: DataFrame, attached: DataFrame, allow: bool = False) -> None:
    """Raise before any job writes if rows lie on volumes that are not attached; one row a volume is read."""
    gone = detached_volumes(files, attached).orderBy(F.desc("rows")).limit(20).collect()
    if gone and not allow:
        raise RuntimeError("rows on detached volumes: " + "; ".join(f"{r['volume']}: {r['rows']} rows, e.g. {r['example']}" for r in gone))


def open_counts(pending: DataFrame) -> DataFrame:
    """Outstanding rows by state, field and reason, the most first."""
    return pending.filter("applied_at IS NULL").groupBy("state", "field", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state", "field", "reason")


def outstanding(pending: DataFrame, path: str | None = None, limit: int = 0) -> DataFrame:
    rows = pending.filter("applied_at IS NULL")
    rows = rows if path is None else rows.filter(F.col("file_path") == path)
    rows = rows.orderBy("seq")
    return rows.limit(limit) if limit else rows


def resolution_stats(resolutions: DataFrame) -> DataFrame:
    """Live, automatic, manual and stale verdicts in one scan."""
    stale, auto = F.coalesce("stale", F.lit(False)), F.coalesce("auto_resolved", F.lit(False))
    return resolutions.agg(F.count_if(~stale).alias("live"), F.count_if(~stale & auto).alias("auto"), F.count_if(~stale & ~auto).alias("manual"), F.count_if(stale).alias("stale"))


def avoided(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Duplicates skipped and an estimate of the bytes that saved."""
    n = entries.filter("status = 'skipped' AND skip_reason = 'duplicate'").agg(F.count("*").alias("duplicates"))
    return n.crossJoin(files.agg(F.avg("size").alias("mean"))).select("duplicates", (F.col("duplicates") * F.col("mean")).cast("bigint").alias("bytes_saved"))  # one row each


def verdict_histogram(classified: DataFrame) -> DataFrame:
    """Counts and shares by verdict, and by verdict and reason (reason null: the verdict as a whole)."""
    rows = classified.groupingSets([["verdict"], ["verdict", "reason"]], "verdict", "reason").agg(F.count("*").alias("n"), F.grouping("reason").alias("whole"))
    total = F.sum(F.when(F.col("whole") == 1, F.col("n"))).over(Window.partitionBy())
    return rows.select("verdict", "reason", "n", F.round(F.col("n") * 100.0 / total, 4).alias("pct"))


def examples(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def seeded_sample(rows: DataFrame, key: Column, seed: int, n: int) -> DataFrame:
    """n rows in a pseudorandom order that depends on key and seed alone, however rows are dealt."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).limit(n)


def stratified_sample(rows: DataFrame, bucket: str, key: Column, seed: int, quota: int, total: int) -> DataFrame:
    """Up to ``quota`` rows a bucket, then others until there are ``total``."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    w = Window.partitionBy(bucket).orderBy("h")
    ranked = rows.withColumn("h", h).withColumn("extra", F.row_number().over(w) > quota)
    return ranked.orderBy("extra", "h").limit(total).drop("h", "extra")


def outcome_cardinality(outcomes: DataFrame) -> DataFrame:
    """How often each (target, field, state) occurs and with how many values."""
    return outcomes.groupBy("target", "field", "state").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def repeated_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("target", "field", "value").agg(F.count("*").alias("n")).filter("n > 1")


#: States that a target and field may have together.
LEGAL_TOGETHER = (("already_present",), ("already_present", "merged"), ("merged",), ("deferred",), ("failed",), ("merged_mtime_only",), ("already_present", "merged_mtime_only"))


def illegal_states(outcomes: DataFrame) -> DataFrame:
    """Targets and fields whose set of states is not a legal one."""
    sets = outcomes.groupBy("target", "field").agg(F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"))
    return sets.filter(~F.col("states").isin([",".join(s) for s in LEGAL_TOGETHER]))


def empty_collapses(collapses: DataFrame) -> DataFrame:
    """Collapse records that say nothing: there must be none."""
    return collapses.filter("coalesce(adopted, '[]') = '[]' AND coalesce(declined, '[]') = '[]'")


def count_differences(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (keys, n) that differ from what was expected; a missing one is 0."""
    both = found.select(*keys, F.col("n").alias("found")).join(expected.select(*keys, F.col("n").alias("expected")), keys, "full")
    return both.na.fill(0, ["found", "expected"]).filter("found <> expected")


def bounded_run(plan: DataFrame, order: str, counts: Column, n: int) -> DataFrame:
    """The rows of a plan that a run gets to which stops once ``n`` rows that count are done; 0 is no bound.

    Rows are taken in ``order``; those that don't count are passed over on the way.
    """
    if not n:
        return plan
    last = plan.filter(counts).orderBy(order).limit(n).agg(F.when(F.count("*") == n, F.max(order)).alias("__last"))  # one row
    return plan.join(F.broadcast(last), F.col("__last").isNull() | (F.col(order) <= F.col("__last"))).drop("__last")


def digest_mismatches(files: DataFrame, listing: DataFrame) -> DataFrame:
    both = files.select("path", "digest_full").join(listing.select("path", F.col("digest_full").alias("now")), "path")
    return both.filter(~F.col("digest_full").eqNullSafe(F.col("now")))


def missing_kept(entries: DataFrame, present: DataFrame) -> DataFrame:
    kept = entries.filter("status = 'kept' AND kept_path IS NOT NULL")
    return kept.join(present.select(F.col("path").alias("kept_path")).distinct(), "kept_path", "left_anti")


def differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of either run that the other lacks: none after a second run that changes nothing."""
    return one.exceptAll(two).withColumn("side", F.lit("first")).unionByName(two.exceptAll(one).withColumn("side", F.lit("second")))
