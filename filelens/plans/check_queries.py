"""Queries over checks, reports and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filelens.functions.documents import digests, short_digest, short_error
from filelens.functions.paths import join_path
from filelens.functions.times import first_clock, gap_text, zone_offset
from filelens.operators import changes, ingest, match, offers, reports
from filelens.plans import change_queries as H
from filelens.plans import ingest_queries as I
from filelens.plans import views as V
from filelens.plans.registrar import Query, registrar

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)


@query(f"""WITH {I._REBIND}, bound AS (SELECT seq, dir, media_name, CASE WHEN seq % 5 = 0 THEN target || 'x' ELSE target END AS rebound_path FROM plan WHERE decision = 'bound' AND NOT relocated)
  SELECT seq, rebound_path FROM bound b WHERE NOT EXISTS (SELECT 1 FROM media m WHERE m.pos % 9 <> 8 AND m.dir = b.dir AND m.name = b.media_name AND '/vault/' || m.pos = b.rebound_path)""")
def qc_03_binds_elsewhere(spark, d):
    """Bound sidecars, of which every fifth names a target that its directory doesn't have."""
    plan = I._rebind(spark, d).filter("decision = 'bound'")
    outcome = F.to_json(F.struct("media_name", "relocated"))
    wrong = F.when(F.col("seq") % 5 == 0, F.concat("target", F.lit("x"))).otherwise(F.col("target"))
    marked = plan.select("seq", wrong.alias("rebound_path"), outcome.alias("rebound_outcome"), F.lit("2026-08-04 00:00:00").cast("timestamp").alias("rebound_at"))
    return match.binds_elsewhere(marked.join(I._unmatched(spark, d).select("seq", "archive_dir"), "seq"), I._kept_entries(spark, d))


@query(f"""WITH {H._ALL.replace("matched AS (", "found AS (")}, matched AS (SELECT seq, dir, name, CASE WHEN seq % 500 = 0 AND media_name IS NOT NULL THEN 'elsewhere.jpg' ELSE media_name END AS media_name, fuzzy, reason, candidate_count FROM found), {I.RATES}
  SELECT addressable_unmatched_pct, cross_directory, addressable_unmatched_pct <= 3.0 AND cross_directory = 0 AS passed FROM rates""")
def qc_06_matcher_gate(spark, d):
    """The gate over binds of which every five-hundredth was bent to a file that its directory doesn't have."""
    found = match.match_sidecars(V.sidecars(spark, d), V.media(spark, d))
    bent = F.when((F.col("seq") % 500 == 0) & F.col("media_name").isNotNull(), "elsewhere.jpg").otherwise(F.col("media_name"))
    return match.matcher_gate(match.match_rates(found.withColumn("media_name", bent), V.media(spark, d)))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 6 < 2")
def qc_08_empty_collapses(spark, d):
    k = F.col("c_custkey")
    rows = V.table(spark, d, "customer").select(k.alias("k"), F.when(k % 4 == 0, "[]").otherwise('[{"what":"mtime"}]').alias("adopted"), F.when(k % 6 == 0, "[]").when(k % 6 > 1, '["x"]').alias("declined"))
    return reports.empty_collapses(rows).select("k")


@query(f"WITH {V.ENTRIES}, c AS (SELECT archive_id, count(*) AS n FROM entries WHERE archive_id % 7 <> 3 GROUP BY 1), x AS (SELECT archive_id, count(*) + CASE WHEN archive_id % 5 = 0 THEN 1 ELSE 0 END AS n FROM entries GROUP BY 1) SELECT archive_id, coalesce(c.n, 0) AS found, x.n AS expected FROM x LEFT JOIN c USING (archive_id) WHERE coalesce(c.n, 0) <> x.n")
def qc_11_count_differences(spark, d):
    """Counts by archive against expected ones, some of which are off or missing."""
    e = V.archive_entries(spark, d)
    found = e.filter("archive_id % 7 <> 3").groupBy("archive_id").agg(F.count("*").alias("n"))
    more = F.when(F.col("archive_id") % 5 == 0, 1).otherwise(0)
    expected = e.groupBy("archive_id").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + more)
    return reports.count_differences(found, expected, ["archive_id"])


@query(f"WITH {H._SET}, last AS (SELECT CASE WHEN count(*) = 5 THEN max(path) END AS p FROM (SELECT path FROM z2 WHERE decision = 'set' ORDER BY path LIMIT 5)) SELECT path, decision FROM z2, last WHERE p IS NULL OR path <= p")
def srt_04_bounded_run(spark, d):
    """A repair that stops once five files were set."""
    return reports.bounded_run(I._repair(spark, d), "path", F.col("decision") == "set", 5).select("path", "decision")


@query("SELECT s_suppkey AS seq, 'a' || s_suppkey AS path FROM supplier WHERE s_suppkey % 4 = 0")
def flt_12_completed_archives(spark, d):
    k = F.col("s_suppkey")
    rows = V.table(spark, d, "supplier").select(k.alias("seq"), F.concat(F.lit("a"), k.cast("string")).alias("path"), F.when(k % 4 == 0, "complete").otherwise("pending").alias("status"))
    return ingest.completed_archives(rows).select("seq", "path")


_KNOWN = """i AS (SELECT c_custkey, 'a' || (c_custkey % 40) || '_' || c_custkey AS path, CASE WHEN c_custkey % 9 > 0 THEN 'd' || (c_custkey % 55) END AS digest FROM customer),
  a AS (SELECT s_suppkey AS seq, 'a' || (s_suppkey % 40) || '_' || s_suppkey AS path, 'd' || (s_suppkey % 60) AS digest FROM supplier WHERE s_suppkey % 3 = 0),
  h AS (SELECT i.path, 0 AS turn, a.seq, a.path AS archive_path, 'path' AS matched_by FROM i JOIN a ON a.path = i.path UNION ALL SELECT i.path, 1, a.seq, a.path, 'digest' FROM i JOIN a ON a.digest = i.digest)"""


@query(f"WITH {_KNOWN} SELECT path, seq AS archive_seq, archive_path, matched_by FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY turn, seq) = 1")
def join_16_known_archives(spark, d):
    """Which complete archive an incoming one is: that of its path before one of its digest."""
    name = lambda k: F.concat(F.lit("a"), (k % 40).cast("string"), F.lit("_"), k.cast("string"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    incoming = V.table(spark, d, "customer").select(name(c).alias("path"), F.when(c % 9 > 0, F.concat(F.lit("d"), (c % 55).cast("string"))).alias("digest"))
    archives = V.table(spark, d, "supplier").select(s.alias("seq"), name(s).alias("path"), F.concat(F.lit("d"), (s % 60).cast("string")).alias("digest"), F.when(s % 3 == 0, "complete").otherwise("pending").alias("status"))
    return ingest.known_archives(incoming, archives)


@query(f"WITH {V.ENTRIES} SELECT status, skip_reason, count(*) AS n FROM entries GROUP BY CUBE (status, skip_reason)")
def agg_22_status_cube(spark, d):
    return V.archive_entries(spark, d).cube("status", "skip_reason").agg(F.count("*").alias("n"))


@query(f"WITH {V.FILES} SELECT 'path' AS at, CAST(0 AS BIGINT) AS leaks UNION ALL SELECT 'kept_path', count(*) FROM files WHERE starts_with(path, '/run/media/u/src1/') AND seq % 2 = 0")
def snk_19_prefix_leaks(spark, d):
    """One table repointed whole, one by half: the rows that still name the old place."""
    old, new = "/run/media/u/src1/", "/mnt/one/"
    f = V.files(spark, d).select("seq", "path")
    half = changes.repoint(f.filter("seq % 2 = 1"), "path", old, new).unionByName(f.filter("seq % 2 = 0"))
    return changes.prefix_leaks([(changes.repoint(f, "path", old, new), "path"), (half.withColumnRenamed("path", "kept_path"), "kept_path")], old)


@query(f"WITH {I._DEC} SELECT offer_seq, payload FROM dec")
def json_03_payloads(spark, d):
    return I._decisions(spark, d).select("offer_seq", offers.payload_of().alias("payload"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'dir' || page_id || '/' || url END AS entry, sha256(html)[1:12] AS short, sha256(html)[1:16] AS longer, html[1:120] AS error FROM pages")
def str_10_short_texts(spark, d):
    """Entry paths from a directory and a name, and texts cut short for people."""
    digest = F.sha2("html", 256)
    folder = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("dir"), F.col("page_id").cast("string"))).otherwise("")
    return V.table(spark, d, "pages").select("page_id", join_path(folder, F.col("url")).alias("entry"), short_digest(digest).alias("short"), short_digest(digest, 16).alias("longer"), short_error(F.col("html"), 120).alias("error"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 1625421600 WHEN 1 THEN 1000000000 WHEN 2 THEN event_id END AS BIGINT) AS taken FROM events")
def dt_01_first_clock(spark, d):
    """The first of three dates that parses: the others are no dates or not there."""
    i = F.col("event_id")
    bad = F.lit("0000:00:00 00:00:00")
    original = F.when(i % 4 == 0, "2021:07:04 18:00:00").when(i % 4 == 3, "yesterday").otherwise(bad)
    digitized = F.when(i % 4 == 1, "2001:09:09 01:46:40\0")
    plain = F.when(i % 4 == 3, "").otherwise(F.date_format(F.timestamp_seconds(i), "yyyy:MM:dd HH:mm:ss"))
    return V.table(spark, d, "events").select("event_id", F.unix_timestamp(first_clock(original, digitized, plain).cast("timestamp")).alias("taken"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN -18000 ELSE -21600 END WHEN 1 THEN 20700 WHEN 2 THEN 0 END AS seconds FROM events")
def dt_07_zone_offset(spark, d):
    """Offsets at an instant of summer or winter; a name that is no zone gives none."""
    i = F.col("event_id")
    zone = F.when(i % 5 == 0, "America/Chicago").when(i % 5 == 1, "Asia/Kathmandu").when(i % 5 == 2, "UTC").when(i % 5 == 3, "Mars/Olympus")
    return V.table(spark, d, "events").select("event_id", zone_offset(F.lit(1625421600) + (i % 2) * 15811200, zone).cast("int").alias("seconds"))


@query("""SELECT event_id, CASE WHEN abs(s) <= 50400 AND abs(s - round_even(s / 900.0, 0) * 900) <= 60 THEN printf('%+.2fh', s / 3600.0) WHEN abs(s) <= 50400 THEN 'gap ' || printf('%+.3fh', s / 3600.0) || ' is not a whole 15-minute offset'
  ELSE CAST(round_even(abs(s) / 86400.0, 0) AS BIGINT) || 'd apart' END AS gap FROM (SELECT event_id, (event_id % 400 - 200) * 1236 AS s FROM events UNION ALL SELECT -event_id, (event_id % 400 - 200) * 43200 FROM events UNION ALL SELECT event_id + 100000000, (event_id % 120 - 60) * 900 + event_id % 3 * 60 FROM events)""")
def dt_13_gap_text(spark, d):
    """Gaps of odd seconds, of half days and of whole quarters of an hour within and beyond a minute."""
    i = F.col("event_id")
    e = V.table(spark, d, "events").select("event_id")
    far = e.select((-i).alias("event_id"), ((i % 400 - 200) * 43200).alias("s"))
    whole = e.select((i + 100000000).alias("event_id"), ((i % 120 - 60) * 900 + i % 3 * 60).alias("s"))
    return e.select("event_id", ((i % 400 - 200) * 1236).alias("s")).unionByName(far).unionByName(whole).select("event_id", gap_text(F.col("s")).alias("gap"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 65536 THEN sha256(text) ELSE sha256(encode(text)[strlen(text) - 4095:strlen(text)]) END AS tail FROM documents")
def bin_02_legacy_tail(spark, d):
    """Tails by the older rule."""
    return V.table(spark, d, "documents").select("doc_id", digests(F.encode("text", "UTF-8"), legacy_tail=True)["tail"].alias("tail"))
