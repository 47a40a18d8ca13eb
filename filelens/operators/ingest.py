"""Ingest of archives and folders: routes, decisions, names, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.functions.paths import basename, dirname, is_album_metadata, is_media, is_sidecar, stem, suffix
from filelens.operators.dedup import content_matches, first_survivor
from filelens.operators.ranks import WIDTH, numbered, running

NON_MEDIA = ("sidecar", "album_metadata", "not_media")  # fixed values of skip_reason


def route(path: Column, error: Column, folder: bool = False) -> Column:
    """Where an entry goes; the first that holds. Folders treat album metadata as sidecars."""
    name = basename(path)
    album = F.lit("sidecar") if folder else F.lit("album_metadata")
    return F.when(error.isNotNull(), "error").when(is_album_metadata(name), album).when(is_sidecar(name), "sidecar").when(~is_media(path), "not_media").otherwise("media")


def media_entries(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("skip_reason").isNull() | ~F.col("skip_reason").isin(*NON_MEDIA))


def pending_entries(listed: DataFrame, processed: DataFrame) -> DataFrame:
    """What a resumed run has left to do."""
    done = processed.filter("status <> 'pending'").select("archive_id", "entry_path").distinct()
    return listed.join(done, ["archive_id", "entry_path"], "left_anti")


def known_archives(incoming: DataFrame, archives: DataFrame) -> DataFrame:
    """incoming (path, digest) that is complete already: the archive it is, that of its path before one of its digest.

    Of the archives that share a path or a digest only the first counts, so it alone
    meets the incoming ones: rows are those of the two tables, never their pairs.
    """
    kinds = lambda df: df.select("*", F.explode(F.array(F.struct(F.lit("path").alias("kind"), F.col("path").alias("key")), F.struct(F.lit("digest").alias("kind"), F.col("digest").alias("key")))).alias("k")).select("*", "k.kind", "k.key").filter("key IS NOT NULL")
    done = kinds(archives.filter("status = 'complete'")).groupBy("kind", "key").agg(F.min(F.struct(F.col("seq").alias("archive_seq"), F.col("path").alias("archive_path"))).alias("a"))
    hits = kinds(incoming).select("path", "kind", "key").join(done.hint("merge"), ["kind", "key"])
    best = F.min(F.struct(F.when(F.col("kind") == "path", 0).otherwise(1).alias("turn"), "a.archive_seq", "a.archive_path", "kind")).alias("b")
    return hits.groupBy("path").agg(best).select("path", "b.archive_seq", "b.archive_path", F.col("b.kind").alias("matched_by"))


def open_archives(incoming: DataFrame, archives: DataFrame) -> DataFrame:
    """Incoming archives (path, digest) without a complete one of the same path or digest."""
    keys = lambda df: df.select("path", F.explode(F.array(F.concat(F.lit("p:"), "path"), F.concat(F.lit("d:"), "digest"))).alias("key"))
    done = keys(archives.filter("status = 'complete'")).select("key").distinct()
    seen = keys(incoming).join(done, "key", "left_semi").select("path").distinct()
    return incoming.join(seen, "path", "left_anti")


def decide_entries(entries: DataFrame, files: DataFrame, present: DataFrame, dest: str) -> DataFrame:
    """kept or skipped for every media entry (ordinal, name, digest), and why.

    A copy that exists skips the entry; so does an earlier entry of the batch with its
    digest. An entry without a digest equals no other. A recorded copy that is gone
    is restored at its place if that lies right in ``dest``; else an unrecorded file of
    ``dest`` with these bytes is adopted (``present`` then has digests).
    """
    known = content_matches(entries.filter("digest IS NOT NULL").select("digest").distinct(), files)
    there = first_survivor(known, present, "digest").select("digest", F.col("path").alias("survivor"), "matched_on")
    prior = known.groupBy("digest").agg(F.min_by("path", F.when(dirname(F.col("path")) == dest, F.col("seq"))).alias("restore_path"))
    rows = entries.join(there, "digest", "left").join(prior.withColumn("had", F.lit(True)), "digest", "left")
    if "digest" in present.columns:
        rows = rows.join(adoptable(entries, present, files, dest).withColumnRenamed("path", "orphan"), "ordinal", "left")
    else:
        rows = rows.withColumn("orphan", F.lit(None).cast("string"))
    one = F.coalesce(F.concat(F.lit("d"), "digest"), F.concat(F.lit("o"), F.col("ordinal").cast("string")))
    # A digest's first entry by an aggregate and a join, which splits a digest of very many entries.
    rows = rows.withColumn("one", one)
    rows = rows.join(rows.groupBy("one").agg(F.min("ordinal").alias("first")), "one")
    rows = rows.withColumn("skip", F.col("survivor").isNotNull() | (F.col("ordinal") != F.col("first")))
    keep_reason = F.when(F.col("restore_path").isNotNull(), "prior_copy_restored").when(F.col("orphan").isNotNull(), "orphan_adopted").when(F.col("had"), "prior_copy_missing")
    return rows.select(
        "ordinal",
        "digest",
        F.when(F.col("skip"), "skipped").otherwise("kept").alias("status"),
        F.when(F.col("skip"), "duplicate").alias("skip_reason"),
        F.when(~F.col("skip"), keep_reason).alias("keep_reason"),
        "survivor",
        "matched_on",
        F.when(~F.col("skip"), F.coalesce("restore_path", "orphan")).alias("restore_path"),
    )


def name_slots(names: DataFrame) -> DataFrame:
    """of, n: the names (name) as slots of the names that lead to them: itself is its slot 0, stem(n).ext the slot n of stem.ext.

    A number counts only as the rule spells it: from 1 on, without leading zeros.
    """
    base, ext = stem(F.col("name")), suffix(F.col("name"))
    number = F.regexp_extract(base, r"\(([1-9][0-9]{0,17})\)$", 1)
    plain = F.struct(F.col("name").alias("of"), F.lit(0).cast("bigint").alias("n"))
    counted = F.struct(F.concat(F.regexp_replace(base, r"\([0-9]+\)$", ""), ext).alias("of"), F.nullif(number, F.lit("")).cast("bigint").alias("n"))
    return names.select("name", F.explode(F.array(plain, counted)).alias("s")).select("name", "s.of", "s.n").filter("n IS NOT NULL").distinct()


def adoptable(entries: DataFrame, listing: DataFrame, files: DataFrame, dest: str) -> DataFrame:
    """ordinal, path: the unrecorded file right in ``dest`` with an entry's bytes at the first such slot of its name.

    Slots are walked up to the first that no file and no row holds.
    """
    here = lambda df: df.filter(dirname(F.col("path")) == dest).select(basename(F.col("path")).alias("name"))
    slots = name_slots(here(listing).unionByName(here(files)).distinct())
    reached = slots.withColumn("before", F.row_number().over(Window.partitionBy("of").orderBy("n")) - 1).filter("before = n").select("of", "n", "name")
    loose = listing.filter(dirname(F.col("path")) == dest).join(files.select("path").distinct(), "path", "left_anti").select("path", "digest", basename(F.col("path")).alias("name"))
    hits = entries.select("ordinal", F.col("name").alias("of"), "digest").join(reached, "of").join(loose, ["name", "digest"])
    return hits.groupBy("ordinal").agg(F.min_by("path", "n").alias("path"))


def allocate_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (ordinal, name) with the name each gets: itself, or stem(n).ext with the first free n.

    Asking in order for the first free slot gives the k-th asker of a name the
    k-th free slot, as long as askers of other names don't want those slots too. So
    askers and taken numbers are ranked and merged, in rows that grow with both and
    windows over stretches of them (see ``ranks``); slots that two names reach are left
    to ``settle``.
    """
    rows = numbered(wanted.select("ordinal", "name"), ["name"], "ordinal", "k")
    used = name_slots(taken.select("name").distinct()).select(F.col("of").alias("name"), "n").distinct()
    used = used.join(rows.select("name").distinct(), "name", "left_semi")
    # Below the i-th used number are n - i + 1 free ones, so the k-th free number has passed all used ones with fewer
    # than k: askers and used numbers are one sequence, and the askers take the last i before them.
    gaps = numbered(used, ["name"], "n", "i").withColumn("at", F.col("n") - F.col("i") + 1).groupBy("name", "at").agg(F.max("i").alias("i"))
    merged = rows.select("name", "ordinal", F.col("k").alias("at"), F.lit(None).cast("bigint").alias("i")).unionByName(gaps.select("name", F.lit(None).cast("bigint").alias("ordinal"), "at", "i"))
    order = [F.col("at"), F.col("ordinal").isNull()]  # of equals the asker is first: it has not passed
    got = running(merged, ["name"], order, F.floor(F.col("at") / WIDTH), F.col("i"), "passed", largest=True).filter("ordinal IS NOT NULL")
    n = F.col("at") - 1 + F.coalesce("passed", F.lit(0))
    given = F.concat(stem(F.col("name")), F.lit("("), n.cast("string"), F.lit(")"), suffix(F.col("name")))
    return got.select("ordinal", "name", F.when(n == 0, F.col("name")).otherwise(given).alias("given"))


def settle(wanted: DataFrame, taken: DataFrame, materialize) -> DataFrame:
    """The names that asking one after another in ordinal order gives.

    Names meet only within a family, the names that are equal but for counters. In
    each round the askers of a family that come before its first conflict have what
    they would get in order: they are settled, and the others ask again.
    """
    done, rest = None, wanted.select("ordinal", "name")
    while True:
        given = materialize(allocate_names(rest, taken))
        family = F.concat(F.regexp_replace(stem(F.col("name")), r"(\([0-9]+\))+$", ""), F.lit("/"), suffix(F.col("name")))
        asked = given.withColumn("family", family).withColumn("place", F.row_number().over(Window.partitionBy("given").orderBy("ordinal")))
        conflict = F.min(F.when(F.col("place") > 1, F.col("ordinal"))).over(Window.partitionBy("family"))
        asked = materialize(asked.withColumn("settled", F.coalesce(F.col("ordinal") < conflict, F.lit(True))))
        won = asked.filter("settled").select("ordinal", "name", "given")
        done = won if done is None else done.unionByName(won)
        rest = asked.filter("NOT settled").select("ordinal", "name")
        if rest.isEmpty():
            return done
        taken = taken.select("name").unionByName(won.select(F.col("given").alias("name")))


def ingest_stats(decided: DataFrame) -> DataFrame:
    """Counts of outcomes, and whether they add up."""
    n = lambda s: F.count_if(F.col("status") == s)
    return decided.agg(F.count("*").alias("processed"), n("kept").alias("kept"), n("skipped").alias("skipped"), n("error").alias("errors")).withColumn(
        "reconciled", F.col("kept") + F.col("skipped") + F.col("errors") == F.col("processed")
    )


def first_candidates(parsed: DataFrame) -> DataFrame:
    """parsed (archive_id, ordinal, dir, candidates): the sidecar that each candidate name of a directory belongs to, the first that named it."""
    rows = parsed.select("archive_id", "ordinal", "dir", F.explode("candidates").alias("candidate"))
    return rows.groupBy("archive_id", "dir", "candidate").agg(F.min("ordinal").alias("ordinal"))


def completed_archives(archives: DataFrame) -> DataFrame:
    """Complete archives, the newest first."""
    return archives.filter("status = 'complete'").orderBy(F.desc("seq"))


def skip_reasons(decided: DataFrame) -> DataFrame:
    return decided.filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))


def archive_detail(entries: DataFrame, files: DataFrame, log: DataFrame) -> DataFrame:
    """For each archive its outcomes' counts, the bytes kept, and merges from takeouts into its kept files."""
    kept = entries.filter("status = 'kept'").join(files.select(F.col("path").alias("kept_path"), "size"), "kept_path", "left")
    merges = log.filter("source_desc LIKE 'takeout:%' AND field <> 'already_present'")
    owners = entries.filter("kept_path IS NOT NULL").select("archive_id", F.col("kept_path").alias("target_path")).distinct()
    counts = entries.groupBy("archive_id", F.coalesce("skip_reason", "status").alias("outcome")).agg(F.count("*").alias("n"))
    bytes_ = kept.groupBy("archive_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("kept_bytes"), F.count_if(F.col("size").isNull()).alias("missing_kept"))
    merged = merges.join(owners, "target_path").groupBy("archive_id").agg(F.count("*").alias("merges"))
    return counts.join(bytes_, "archive_id", "left").join(merged, "archive_id", "left").na.fill(0, ["kept_bytes", "missing_kept", "merges"])
