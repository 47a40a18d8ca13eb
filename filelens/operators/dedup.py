"""Content-digest duplicates: groups, winners, the cascade, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from filelens.functions.documents import digests
from filelens.functions.media import EXIF_WRITABLE, quality_score
from filelens.functions.paths import basename, suffix
from filelens.operators.ranks import WIDTH, numbered, running
from filelens.sources.ranges import read_digests
from filelens.storage import stored


def scored(files: DataFrame) -> DataFrame:
    return files.withColumn("score", quality_score(*[F.col(c) for c in ("path", "size", "width", "height", "has_exif_date", "has_exif_gps")]))


def in_groups(files: DataFrame, min_size: int = 0) -> DataFrame:
    """Members of groups of equal digest with their number, place by seq and place by score.

    Numbers are summed up where the rows are; places run over stretches of seq, and of score and seq.
    """
    rows = scored(files.filter((F.col("digest_full").isNotNull()) & (F.col("size") >= min_size)))
    many = rows.groupBy("digest_full").agg(F.count("*").alias("members")).filter("members > 1")
    rows = numbered(rows.join(many, "digest_full"), ["digest_full"], "seq", "place")
    stretch = F.struct((-F.col("score")).alias("turn"), F.floor(F.col("seq") / WIDTH).alias("part"))
    return running(rows, ["digest_full"], [F.desc("score"), F.asc("seq")], stretch, F.lit(1), "rank")


def grouped(files: DataFrame, min_size: int = 0) -> DataFrame:
    """One row a group of equal digest: members, total size, its first member by seq and its best by score (structs).

    Aggregates alone, so a digest of very many copies is summed up where its rows are.
    """
    row = F.struct("path", "size", "score", "has_exif_date", "has_exif_gps", "seq")
    ext = F.lower(suffix(basename(F.col("path"))))
    rows = scored(files.filter((F.col("digest_full").isNotNull()) & (F.col("size") >= min_size)))
    return (
        rows.groupBy("digest_full")
        .agg(
            F.count("*").alias("members"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("total"),
            F.min_by(row, "seq").alias("first"),
            F.max_by(row, F.struct("score", (-F.col("seq")).alias("turn"))).alias("best"),
            ((F.min("size") == F.max("size")) & (F.min(ext) == F.max(ext))).alias("alike"),
        )
        .filter("members > 1")
    )


def winners(files: DataFrame) -> DataFrame:
    """One row a group: the winner and what its losers take up."""
    best = F.col("best")
    return grouped(files).select("digest_full", best["path"].alias("winner_path"), best["score"].alias("winner_score"), "members", (F.col("total") - F.coalesce(best["size"], F.lit(0))).alias("wasted"))


def winner_loser_pairs(files: DataFrame) -> DataFrame:
    """Each winner with each of its losers."""
    w = grouped(files).select("digest_full", F.col("best.path").alias("winner"), F.col("best.seq").alias("winner_seq"), "best.has_exif_date", "best.has_exif_gps")
    losers = files.select("digest_full", F.col("path").alias("loser"), F.col("seq").alias("loser_seq"), F.col("has_exif_date").alias("loser_date"), F.col("has_exif_gps").alias("loser_gps"))
    return losers.join(w, "digest_full").filter("loser_seq <> winner_seq").drop("loser_seq", "winner_seq")


def merge_eligible(pairs: DataFrame, container: Column) -> DataFrame:
    """Pairs whose winner can hold EXIF and still lacks a date or a place that the loser has."""
    lacks = lambda a, b: ~F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))
    date, gps = lacks(F.col("has_exif_date"), F.col("loser_date")), lacks(F.col("has_exif_gps"), F.col("loser_gps"))
    return pairs.withColumn("take_date", date).withColumn("take_gps", gps).filter(container.isin(*EXIF_WRITABLE) & (date | gps))


def collection_stats(files: DataFrame) -> DataFrame:
    """Groups, copies beyond the first of each, and the bytes these take, counted from the first member and from the best."""
    less = lambda one: F.coalesce(F.sum(F.col("total") - F.coalesce(f"{one}.size", F.lit(0))), F.lit(0))
    return grouped(files).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("extra_copies"), less("first").alias("wasted_bytes"), less("best").alias("wasted_by_score"))


def cascade(files: DataFrame, watch: dict[str, Observation] | None = None) -> DataFrame:
    """Files that survive size, head, tail and full digest in turn; ``files`` has path, size and content.

    The digests of each stage are written as a small table of paths, and only
    the content of those that aren't alone is digested in the next. ``watch`` may hold an Observation for
    size, head, tail and full, which then counts the files its stage read.
    """

    def repeated(rows: DataFrame, by: list[str], stage: str) -> DataFrame:
        if watch and stage in watch:
            rows = rows.observe(watch[stage], F.count("*").alias("files"))
        rows = stored(rows, f"cascade-{stage}")
        many = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
        return rows.join(many.drop("n"), by, "left_semi")

    by = ["size"]
    known = repeated(files.filter("size > 0").select("path", "size"), by, "size")
    for stage in ("head", "tail", "full"):
        # The survivors are on the left of a join whose result alone is digested: the digest stays above it.
        content = known.join(files.select("path", "content"), "path")
        by = [*by, stage]
        known = repeated(content.select(*known.columns, digests(F.col("content"))[stage].alias(stage)), by, stage)
    return known


def cascade_files(files: DataFrame, watch: dict[str, Observation] | None = None) -> DataFrame:
    """``cascade`` of files (path, size) that are read in place: each stage reads no more than the bytes it digests.

    Heads of files of equal size, tails of those of equal heads, whole files of those of equal
    tails. Only paths and digests leave the task that read a file. ``watch`` may hold an
    Observation for head, tail and full, which then counts files and bytes read. A file that
    can't be read has no digest and equals no other.
    """
    known, by = files.filter("size > 0").select("path", "size"), ["size"]
    for stage in ("size", "head", "tail", "full"):
        if stage != "size":
            known = read_digests(known, stage)
            if watch and stage in watch:
                known = known.observe(watch[stage], F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
            known, by = known.drop("bytes").filter(F.col(stage).isNotNull()), [*by, stage]
        rows = stored(known, f"cascade-{stage}")
        many = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
        known = rows.join(many.drop("n"), by, "left_semi")
    return known


def _by_digest(files: DataFrame) -> DataFrame:
    """digest, seq, path, matched_on: each file by its full and by its source digest; the two become rows."""
    sides = F.array(F.struct(F.lit("digest_full").alias("matched_on"), F.col("digest_full").alias("digest")), F.struct(F.lit("digest_source").alias("matched_on"), F.col("digest_source").alias("digest")))
    return files.select("seq", "path", F.explode(sides).alias("s")).select("seq", "path", "s.*").filter("digest IS NOT NULL")


def content_matches(incoming: DataFrame, files: DataFrame) -> DataFrame:
    """incoming (digest, ...) with every file of equal full or source digest, and which it was: one equi-join.

    These are pairs. Where only their number or the first of them is wanted, see
    ``match_counts`` and ``first_survivors``.
    """
    rows = _by_digest(files).groupBy("digest", "seq", "path").agg(F.min("matched_on").alias("matched_on"))
    return incoming.join(rows, "digest")


def match_counts(incoming: DataFrame, files: DataFrame, entry: str) -> DataFrame:
    """entry, matches, first_seq, matched_on of content_matches by entry: how many, the first by seq, the least of the kinds.

    Files are summed up by digest before they meet the entries, so a digest that many
    of both have makes no pairs. An entry that comes twice with one digest counts once.
    """
    rows = _by_digest(files).groupBy("digest", "seq", "path").agg(F.min("matched_on").alias("matched_on"))
    known = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.min("matched_on").alias("matched_on"))
    hits = incoming.select(entry, "digest").distinct().join(known.hint("merge"), "digest")
    return hits.groupBy(entry).agg(F.sum("n").alias("matches"), F.min("seq").alias("first_seq"), F.min("matched_on").alias("matched_on"))


def first_survivor(matches: DataFrame, present: DataFrame, entry: str) -> DataFrame:
    """The first match of each entry whose file is there now."""
    w = Window.partitionBy(entry).orderBy("seq")
    return matches.join(present.select("path").distinct(), "path", "left_semi").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_survivors(incoming: DataFrame, files: DataFrame, present: DataFrame, entry: str) -> DataFrame:
    """entry, path, matched_on: first_survivor of content_matches, without their pairs.

    Files that are there now are reduced to the first of each digest before they meet the entries.
    """
    there = files.join(present.select("path").distinct().hint("merge"), "path", "left_semi")
    first = _by_digest(there).groupBy("digest").agg(F.min(F.struct("seq", "path", "matched_on")).alias("f"))
    hits = incoming.select(entry, "digest").join(first.hint("merge"), "digest")
    return hits.groupBy(entry).agg(F.min("f").alias("f")).select(entry, "f.path", "f.matched_on")


def unresolved(groups: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Groups without a live verdict."""
    return groups.join(resolutions.filter("NOT coalesce(stale, false)").select("digest_full").distinct(), "digest_full", "left_anti")


def auto_resolved(files: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Verdicts for open groups whose members agree in size and extension."""
    rows = unresolved(grouped(files), resolutions).filter("alike")
    freed = F.col("total") - F.coalesce("best.size", F.lit(0))
    return rows.select("digest_full", F.col("best.path").alias("winner_path"), F.lit("keep_winner").alias("action"), F.lit(100).alias("confidence"), freed.alias("freed"))


def human_verdicts(decisions: DataFrame) -> DataFrame:
    """decisions (digest_full, left_path, right_path, action) as verdict rows; skipped ones make none."""
    winner = F.when(F.col("action") == "keep_left", F.col("left_path")).when(F.col("action") == "keep_right", F.col("right_path"))
    known = decisions.filter(F.col("action").isin("keep_left", "keep_right", "keep_both"))
    return known.select("digest_full", winner.alias("winner_path"), "action", F.lit(100).alias("confidence"), F.lit(False).alias("auto_resolved"))


def review_pairs(files: DataFrame, resolutions: DataFrame) -> DataFrame:
    """For each open group its two best members and how many more wait."""
    order = Window.partitionBy("digest_full").orderBy(F.desc("score"), "seq")
    two = scored(files.filter("digest_full IS NOT NULL")).withColumn("rank", F.row_number().over(order)).filter("rank <= 2")  # the first two of each task, then of each group
    second = two.filter("rank = 2").select("digest_full", F.col("path").alias("right_path"))
    waiting = (F.col("members") - 2).alias("waiting")
    return unresolved(grouped(files), resolutions).select("digest_full", F.col("best.path").alias("left_path"), waiting).join(second, "digest_full").select("digest_full", "left_path", "right_path", "waiting")
