"""Binding sidecars to media files of the same directory, and across archives.

Tables that grow with the sidecars or the media files meet in sort-merge joins (the
hints): as broadcasts each would pass through the driver as long as it is small
when packed. Only what has a row a directory is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.functions.documents import json_document, sidecar_payload
from filelens.functions.names import MIN_PREFIX, parse_sidecar
from filelens.functions.paths import PICTURE_EXTENSIONS, basename, dirname, split_extension
from filelens.operators import offers
from filelens.operators.changes import mark_rebound
from filelens.storage import stored


def prefix_hits(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """dir, cut, counter with hits, same, same_name, only: how many of a directory's ``names`` begin with each cut name.

    wanted (dir, cut, counter), cut in lower case; names (dir, name). A name must also hold
    the counter, if there is one; ``same`` counts those that are the cut name but for their
    extension. Each name is cut to the lengths that its directory asks for, with each
    counter it holds, and only such prefixes as are asked for are counted: rows grow with the
    names times the lengths, never with names times cut names.
    """
    keys = wanted.select("dir", "cut", F.coalesce("counter", F.lit("")).alias("key")).filter("cut <> ''").distinct()
    lengths = keys.groupBy("dir").agg(F.collect_set(F.length("cut")).alias("lengths"))  # no more than a name has characters
    rows = names.select("dir", "name").join(lengths, "dir")
    held = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("name", F.lit(r"\([0-9]+\)"), F.lit(0))))
    rows = rows.select("dir", "name", F.explode("lengths").alias("n"), held.alias("held")).filter("n <= length(name)")
    cut = F.substring(F.lower("name"), F.lit(1), F.col("n"))
    rows = rows.select("dir", "name", cut.alias("cut"), F.explode("held").alias("key")).join(keys.hint("merge"), ["dir", "cut", "key"], "left_semi")
    same = F.lower(split_extension(F.col("name"))[0]) == F.col("cut")
    counts = rows.groupBy("dir", "cut", "key").agg(F.count("*").alias("hits"), F.count_if(same).alias("same"), F.max(F.when(same, F.col("name"))).alias("same_name"), F.max("name").alias("only"))
    return counts.withColumn("counter", F.nullif("key", F.lit(""))).drop("key")


def uncounted(p: str) -> Column:
    """The media name of a parsed name without its counter, at its first place."""
    name, counter = f"{p}.media_name", f"{p}.counter"
    without = F.expr(f"concat(substring({name}, 1, instr({name}, {counter}) - 1), substring({name}, instr({name}, {counter}) + length({counter})))")
    return F.when(F.col(counter).isNotNull(), without).otherwise(F.col(name))


def match_sidecars(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """sidecars (seq, dir, name) with media_name, fuzzy, reason, candidate_count.

    ``media`` (dir, name, pos) lists the directories. Tiers in order: a candidate
    name as it is, then case-folded (of names that fold alike the last listed),
    then, for cut names, the only media file with that prefix. All joins are
    equi-joins on the directory and a whole name or a whole prefix, see ``prefix_hits``.
    """
    media = media.groupBy("dir", "name").agg(F.max("pos").alias("pos"))
    # Dealt out first: names are small and parsing is not, so a part of the table would be a long task.
    parsed = stored(sidecars.select("seq", "dir", "name").repartition("seq").select("*", parse_sidecar(F.col("name")).alias("p")), "parsed")  # read four times below
    wanted = parsed.select("seq", "dir", F.posexplode("p.candidates").alias("prio", "wanted"))
    folded = media.groupBy("dir", F.lower("name").alias("folded")).agg(F.max_by("name", "pos").alias("hit"))
    exact = wanted.join(media.select("dir", F.col("name").alias("wanted")).hint("merge"), ["dir", "wanted"]).select("seq", F.struct(F.lit(1).alias("tier"), "prio", F.col("wanted").alias("hit")).alias("h"))
    loose = wanted.withColumn("folded", F.lower("wanted")).join(folded.hint("merge"), ["dir", "folded"]).select("seq", F.struct(F.lit(2).alias("tier"), "prio", "hit").alias("h"))
    by_name = exact.unionByName(loose).groupBy("seq").agg(F.min("h").alias("h")).select("seq", F.col("h.hit").alias("named"))
    listed = media.groupBy("dir").agg(F.lit(True).alias("listed"))
    rows = parsed.join(by_name.hint("merge"), "seq", "left").join(listed, "dir", "left")

    # The counter was put back by parsing: prefixes are compared without it.
    open_ = rows.filter("named IS NULL AND p.media_name IS NOT NULL AND NOT p.stem_complete").select("seq", "dir", F.lower(uncounted("p")).alias("cut"), F.col("p.counter").alias("counter"))
    open_ = stored(open_.filter(F.length("cut") >= MIN_PREFIX), "cut-names")
    _, ext = split_extension(F.col("name"))
    found = prefix_hits(open_, media.filter(F.lower(ext).isin(*PICTURE_EXTENSIONS)))
    here = (F.col("o.dir") == F.col("f.dir")) & (F.col("o.cut") == F.col("f.cut")) & F.col("o.counter").eqNullSafe(F.col("f.counter"))
    prefix = open_.alias("o").join(found.alias("f").hint("merge"), here).select("o.seq", "f.hits", "f.same", "f.same_name", "f.only")
    rows = rows.join(prefix.hint("merge"), "seq", "left")
    bound = F.when(F.col("hits") == 1, F.col("only")).when((F.col("hits") > 1) & (F.col("same") == 1), F.col("same_name"))
    reason = (
        F.when(F.col("p.media_name").isNull(), "unparseable")
        .when(F.col("named").isNotNull() | bound.isNotNull(), F.lit(None))
        .when(F.col("listed").isNull() | F.coalesce(F.col("hits"), F.lit(0)).isin(0), "no_media_in_dir")
        .otherwise("ambiguous")
    )
    return rows.select(
        "seq", "dir", "name", F.coalesce("named", bound).alias("media_name"), (F.col("named").isNull() & bound.isNotNull()).alias("fuzzy"), reason.alias("reason"), F.coalesce("hits", F.lit(0)).alias("candidate_count")
    )


def match_in_archives(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """match_sidecars within each archive: sidecars (seq, archive_id, entry_path), media (archive_id, entry_path, pos).

    The whole listing of an archive is there, so arrival order doesn't matter. Entries
    at an archive's root share the directory "".
    """
    place = F.concat(F.col("archive_id").cast("string"), F.lit("/"), dirname(F.col("entry_path")))
    names = (place.alias("dir"), basename(F.col("entry_path")).alias("name"))
    found = match_sidecars(sidecars.select("seq", *names), media.select(*names, "pos"))
    return found.drop("dir").join(sidecars.select("seq", "archive_id", dirname(F.col("entry_path")).alias("dir")).hint("merge"), "seq")


def unmatched_rows(matched: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Rows for the table of unmatched sidecars: those without a media file, with what their name says and their payload.

    matched: of match_in_archives; sidecars: seq, entry_path, payload (null where it could not be read: unparseable).
    """
    rows = matched.join(sidecars.select("seq", "entry_path", "payload").hint("merge"), "seq").filter("media_name IS NULL OR payload IS NULL")
    rows = rows.withColumn("p", parse_sidecar(F.col("name")))
    unread = F.col("payload").isNull()
    return rows.select(
        "seq",
        "archive_id",
        F.col("entry_path").alias("sidecar_path"),
        F.col("dir").alias("archive_dir"),
        F.col("name").alias("entry_name"),
        F.col("p.media_name").alias("media_stem"),
        F.col("p.counter").alias("counter"),
        F.when(unread, "unparseable").otherwise(F.col("reason")).alias("reason"),
        F.when(unread, 0).otherwise(F.col("candidate_count")).cast("bigint").alias("candidate_count"),
        "payload",
    )


def still_unmatched(sidecars: DataFrame, archive_id: int | None = None) -> DataFrame:
    """Rows that no later pass has bound, in order."""
    rows = sidecars.filter("rebound_at IS NULL")
    return (rows if archive_id is None else rows.filter(F.col("archive_id") == archive_id)).orderBy("seq")


def unmatched_summary(sidecars: DataFrame) -> DataFrame:
    return still_unmatched(sidecars).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def apply_rebind(plan: DataFrame, sidecars: DataFrame, targets: DataFrame, log: DataFrame, pending: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next sidecar table and the new log and pending rows of a plan (plan_rebind with media_name).

    Every bound sidecar's payload becomes offers to its target; then it and its
    identical duplicates are marked with the outcome: the fields by state, the media
    file's name and whether it had moved.
    """
    bound = plan.filter("decision = 'bound'").select("seq", "target", "media_name", "relocated")
    offered = bound.join(sidecars.select("seq", "sidecar_path", "payload").hint("merge"), "seq")
    made = offers.sidecar_offers(offered.select("seq", "target", sidecar_payload(F.col("payload")).alias("payload"), F.concat(F.lit("takeout:"), "sidecar_path").alias("source_desc")))
    decided = stored(offers.evaluate_offers(made, offers.targets_now(targets, log)), "rebind-decisions")
    new_log, new_pending = offers.change_sets(decided, log, pending)
    kinds = ("merged", "merged_mtime_only", "deferred", "failed", "already_present")
    states = F.explode(F.when(F.col("reason").isNotNull() & F.col("state").isin("merged", "merged_mtime_only"), F.array("state", F.lit("deferred"))).otherwise(F.array("state"))).alias("kind")
    by_kind = decided.select(F.floor(F.col("offer_seq") / 2).cast("bigint").alias("seq"), "field", states)
    lists = by_kind.groupBy("seq").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("field")))).alias(k) for k in kinds])
    none = F.array().cast("array<string>")
    outcome = json_document(**{k: F.coalesce(k, none) for k in kinds}, media_name=F.col("media_name"), relocated=F.col("relocated"))
    copies = plan.filter("decision = 'duplicate'").groupBy(F.col("first_seq").alias("seq")).agg(F.collect_list(F.col("seq")).alias("duplicate_seqs"))
    binds = bound.join(lists.hint("merge"), "seq", "left").join(copies.hint("merge"), "seq", "left").select("seq", F.coalesce("duplicate_seqs", F.array().cast("array<bigint>")).alias("duplicate_seqs"), "target", outcome.alias("outcome"), now.alias("rebound_at"))
    return mark_rebound(sidecars, binds), new_log, new_pending


def binds_elsewhere(sidecars: DataFrame, entries: DataFrame) -> DataFrame:
    """Marked sidecars that name no target, or whose target is no entry of their own directory and had not moved.

    entries: dir, name, kept_path.
    """
    v = F.try_parse_json("rebound_outcome")
    marked = sidecars.filter("rebound_at IS NOT NULL").withColumn("name", F.try_variant_get(v, "$.media_name", "string")).withColumn("moved", F.coalesce(F.try_variant_get(v, "$.relocated", "boolean"), F.lit(False)))
    own = entries.select(F.col("dir").alias("archive_dir"), "name", F.col("kept_path").alias("rebound_path")).distinct()
    outside = marked.filter("NOT moved").join(own, ["archive_dir", "name", "rebound_path"], "left_anti").select("seq", "rebound_path")
    return outside.unionByName(marked.filter("moved AND rebound_path IS NULL").select("seq", "rebound_path"))


def addressable(matched: DataFrame, names: DataFrame) -> DataFrame:
    """seq of the unmatched sidecars whose media file is in their directory all the same.

    A test of its own, which knows nothing of the matcher's verdict: some name of ``names``
    (dir, name: all of the directory but JSON, of any extension) begins, in lower case, with
    what the sidecar's name says, without counter and extension, and holds that counter.
    """
    parsed = matched.filter("media_name IS NULL").select("seq", "dir", parse_sidecar(F.col("name")).alias("p")).filter("p.media_name IS NOT NULL")
    stem = F.lower(F.regexp_replace(uncounted("p"), r"\.[^.]*$", ""))
    wanted = stored(parsed.select("seq", "dir", stem.alias("cut"), F.col("p.counter").alias("counter")), "stems")
    found = prefix_hits(wanted, names.select("dir", "name").distinct())
    here = (F.col("w.dir") == F.col("f.dir")) & (F.col("w.cut") == F.col("f.cut")) & F.col("w.counter").eqNullSafe(F.col("f.counter"))
    return wanted.alias("w").join(found.alias("f").hint("merge"), here, "left_semi").select("seq")


def matcher_gate(rates: DataFrame, limit_pct: float = 3.0) -> DataFrame:
    """Whether a run of the matcher (match_rates) is good enough: few addressable sidecars left unmatched, none bound to another directory's file."""
    passed = (F.col("addressable_unmatched_pct") <= limit_pct) & (F.col("cross_directory") == 0)
    return rates.select("addressable_unmatched_pct", "cross_directory", passed.alias("passed"))


def match_rates(matched: DataFrame, names: DataFrame) -> DataFrame:
    """One row: totals by outcome and the shares of all and of addressable sidecars left unmatched.

    names (dir, name): what each directory lists but JSON. ``name_resolvable`` counts names
    that say some media name, whether or not it is there; ``cross_directory`` binds to
    names that the sidecar's directory doesn't list.
    """
    names = names.select("dir", "name").distinct()
    rows = matched.select("seq", "dir", "name", "media_name", "fuzzy", "reason", parse_sidecar(F.col("name"))["media_name"].isNotNull().alias("says"))
    rows = rows.join(addressable(matched, names).withColumn("present", F.lit(True)).hint("merge"), "seq", "left")
    own = names.select("dir", F.col("name").alias("media_name"), F.lit(True).alias("own"))
    rows = rows.join(own.hint("merge"), ["dir", "media_name"], "left")
    bound = F.col("media_name").isNotNull()
    n, missed = F.count("*"), F.count_if("present")
    percent = lambda a, b: F.coalesce(F.round(F.try_divide(a * 100.0, b), 4), F.lit(0.0))
    return rows.agg(
        n.alias("total"),
        F.count_if("says").alias("name_resolvable"),
        F.count_if(bound).alias("matched"),
        F.count_if("fuzzy").alias("fuzzy"),
        F.count_if(F.col("reason") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("reason") == "unparseable").alias("unparseable"),
        percent(F.count_if(~bound), n).alias("unmatched_pct"),
        missed.alias("addressable_unmatched"),
        percent(missed, F.count_if(bound) + missed).alias("addressable_unmatched_pct"),
        F.count_if(bound & F.col("own").isNull()).alias("cross_directory"),
    )


def plan_rebind(unmatched: DataFrame, entries: DataFrame, present: DataFrame, files: DataFrame) -> DataFrame:
    """A decision for every unmatched sidecar (seq, archive_dir, entry_name, payload), over all archives.

    ``entries`` (seq, dir, name, kept_path) are the media entries, ``present``
    (path) what exists now, ``files`` the catalog. Identical offers collapse onto the first that is
    bound; refusals are counted each.
    """
    unmatched = unmatched.select("seq", "archive_dir", "entry_name", "payload")
    kept = entries.groupBy("dir", "name").agg(F.min(F.when(F.coalesce("kept_path", F.lit("")) != "", F.struct("seq", "kept_path")))["kept_path"].alias("kept_path"))
    listing = entries.select("dir", "name", F.col("seq").alias("pos"))
    found = stored(match_sidecars(unmatched.select("seq", F.col("archive_dir").alias("dir"), F.col("entry_name").alias("name")), listing), "matched")
    here = present.select("path").distinct()
    rows = unmatched.join(found.select("seq", "media_name", "reason", "candidate_count").hint("merge"), "seq").join(
        kept.select(F.col("dir").alias("archive_dir"), F.col("name").alias("media_name"), "kept_path").hint("merge"), ["archive_dir", "media_name"], "left"
    )
    rows = rows.join(here.select(F.col("path").alias("kept_path"), F.lit(True).alias("there")).hint("merge"), "kept_path", "left")
    # A kept file that moved is looked for by the digests it had.
    gone = rows.filter("kept_path IS NOT NULL AND there IS NULL").select("seq", "kept_path")
    had = gone.join(files.select(F.col("path").alias("kept_path"), F.explode(F.array_compact(F.array("digest_source", "digest_full"))).alias("digest")).hint("merge"), "kept_path")
    now = files.select("path", F.explode(F.array_distinct(F.array_compact(F.array("digest_source", "digest_full")))).alias("digest")).join(here.hint("merge"), "path", "left_semi")
    moved = had.join(now.hint("merge"), "digest").groupBy("seq").agg(F.count_distinct("path").alias("n_moved"), F.min("path").alias("moved_to"))
    rows = rows.join(moved.hint("merge"), "seq", "left")
    refused = (
        F.when(F.col("payload").isNull(), "no_payload")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("kept_path").isNull(), "media_not_kept")
        .when(F.col("there").isNotNull(), F.lit(None))
        .when(F.coalesce("n_moved", F.lit(0)) == 0, "target_missing")
        .when(F.col("n_moved") > 1, "ambiguous_target")
    )
    target = F.when(F.col("there").isNotNull(), F.col("kept_path")).otherwise(F.col("moved_to"))
    rows = rows.withColumn("refused", refused).withColumn("target", F.when(F.col("refused").isNull(), target))
    offer = Window.partitionBy("archive_dir", "entry_name", "payload", F.col("refused").isNull()).orderBy("seq")
    rows = rows.withColumn("first_seq", F.min("seq").over(offer))
    decision = F.when(F.col("refused").isNotNull(), "refused").when(F.col("first_seq") == F.col("seq"), "bound").otherwise("duplicate")
    return rows.select("seq", "media_name", decision.alias("decision"), F.col("refused").alias("reason"), "target", (F.col("there").isNull() & F.col("target").isNotNull()).alias("relocated"), "first_seq")
