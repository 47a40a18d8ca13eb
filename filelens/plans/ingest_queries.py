"""Queries over the sidecar, archive, offer, log and event views, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions.documents import logged_epoch, sidecar_payload, sorted_json
from filelens.functions.names import parse_sidecar
from filelens.functions.times import camera_clock, clock_epoch, is_legal_offset, offset_seconds, offset_text, resolve_instant
from filelens.operators import capture, changes, ingest, match, offers, reports
from filelens.plans import views as V
from filelens.plans.registrar import Query, registrar
from filelens.storage import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)


_PICTURE = "('.jpg','.jpeg','.png','.gif','.bmp','.tiff','.tif','.heic','.heif','.webp','.raw','.cr2','.nef','.arw','.dng','.mp4','.mov','.avi','.mkv','.wmv','.m4v','.mpg','.mpeg','.3gp')"
# Parsing of sidecar names; needs sidecars (seq, dir, name).
PARSED = f"""p0 AS (SELECT *, CASE WHEN lower(name) LIKE '%.json' THEN name[1:length(name) - 5] END AS whole FROM sidecars),
  p1 AS (SELECT *, nullif(regexp_extract(whole, '(\\([0-9]+\\))$', 1), '') AS counter FROM p0),
  p2 AS (SELECT *, whole[1:length(whole) - coalesce(length(counter), 0)] AS plain FROM p1),
  p3 AS (SELECT *, regexp_extract(plain, '([^.]*)$', 1) AS tail, contains(plain, '.') AND starts_with('supplemental-metadata', regexp_extract(plain, '([^.]*)$', 1)) AS worded FROM p2),
  p4 AS (SELECT *, CASE WHEN worded THEN plain[1:length(plain) - length(tail) - 1] ELSE plain END AS body FROM p3),
  p5 AS (SELECT *, coalesce(whole <> '' AND body <> '', false) AS sound, regexp_extract(body, '^.+?(\\.[^.]*)$', 1) AS ext FROM p4),
  parsed AS (SELECT seq, dir, name, CASE WHEN sound THEN CASE WHEN counter IS NULL THEN body ELSE body[1:length(body) - length(ext)] || counter || ext END END AS media_name,
    CASE WHEN sound THEN counter END AS counter, CASE WHEN sound AND counter IS NOT NULL THEN body || counter END AS other, CASE WHEN sound THEN body END AS body,
    coalesce(sound AND worded AND tail <> 'supplemental-metadata', false) AS truncated, coalesce(sound AND lower(ext) IN {_PICTURE}, false) AS stem_complete,
    CASE WHEN NOT sound THEN 'unparseable' END AS reason FROM p5)"""
# Matching; needs parsed and media (dir, name, pos).
MATCHED = f"""med AS (SELECT dir, name, max(pos) AS pos FROM media GROUP BY ALL),
  cand AS (SELECT seq, dir, 0 AS prio, media_name AS wanted FROM parsed WHERE media_name IS NOT NULL UNION ALL SELECT seq, dir, 1, other FROM parsed WHERE other IS NOT NULL AND other <> media_name),
  hits AS (SELECT seq, 1 AS tier, prio, wanted AS hit FROM cand JOIN med ON med.dir = cand.dir AND med.name = cand.wanted
    UNION ALL SELECT seq, 2, prio, f.hit FROM cand JOIN (SELECT dir, lower(name) AS folded, arg_max(name, pos) AS hit FROM med GROUP BY ALL) f ON f.dir = cand.dir AND f.folded = lower(wanted)),
  named AS (SELECT seq, hit FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY tier, prio) AS n FROM hits) WHERE n = 1),
  cut AS (SELECT parsed.seq, dir, counter, lower(CASE WHEN counter IS NULL THEN media_name ELSE media_name[1:instr(media_name, counter) - 1] || media_name[instr(media_name, counter) + length(counter):] END) AS cut
    FROM parsed LEFT JOIN named ON named.seq = parsed.seq WHERE hit IS NULL AND media_name IS NOT NULL AND NOT stem_complete),
  pre AS (SELECT cut.seq, count(*) AS hits, count(*) FILTER (WHERE base = cut) AS same, max(CASE WHEN base = cut THEN name END) AS same_name, max(name) AS sole
    FROM cut JOIN (SELECT dir, name, lower(regexp_replace(name, '\\.[^.]*$', '')) AS base FROM med WHERE lower(regexp_extract(name, '^.+?(\\.[^.]*)$', 1)) IN {_PICTURE}) m
      ON m.dir = cut.dir AND starts_with(lower(name), cut) AND (counter IS NULL OR contains(name, counter)) WHERE length(cut) >= 8 GROUP BY 1),
  b AS (SELECT parsed.*, named.hit AS by_name, CASE WHEN hits = 1 THEN sole WHEN hits > 1 AND same = 1 THEN same_name END AS by_prefix, coalesce(hits, 0) AS candidate_count
    FROM parsed LEFT JOIN named ON named.seq = parsed.seq LEFT JOIN pre ON pre.seq = parsed.seq),
  matched AS (SELECT seq, dir, name, coalesce(by_name, by_prefix) AS media_name, by_name IS NULL AND by_prefix IS NOT NULL AS fuzzy,
    CASE WHEN media_name IS NULL THEN 'unparseable' WHEN by_name IS NOT NULL OR by_prefix IS NOT NULL THEN NULL WHEN candidate_count = 0 THEN 'no_media_in_dir' ELSE 'ambiguous' END AS reason, candidate_count FROM b)"""


@query(f"WITH {V.SIDECARS}, {PARSED} SELECT seq, media_name, counter, truncated, stem_complete, reason, other FROM parsed")
def str_05_parse_sidecar(spark, d):
    p = V.sidecars(spark, d).select("seq", parse_sidecar(F.col("name")).alias("p"))
    other = F.when(F.col("p.counter").isNotNull(), F.concat("p.body", "p.counter"))
    return p.select("seq", "p.media_name", "p.counter", "p.truncated", "p.stem_complete", "p.reason", other.alias("other"))


@query(f"WITH {V.SIDECARS}, {V.MEDIA}, {PARSED}, {MATCHED} SELECT * FROM matched")
def join_07_08_match_sidecars(spark, d):
    return match.match_sidecars(V.sidecars(spark, d), V.media(spark, d))


# Every file of a directory is compared with each unmatched sidecar; needs parsed, matched and media.
RATES = """stems AS (SELECT m.seq, m.dir, p.counter, lower(regexp_replace(CASE WHEN p.counter IS NULL THEN p.media_name ELSE p.media_name[1:instr(p.media_name, p.counter) - 1] || p.media_name[instr(p.media_name, p.counter) + length(p.counter):] END, '\\.[^.]*$', '')) AS stem
    FROM matched m JOIN parsed p ON p.seq = m.seq WHERE m.media_name IS NULL AND p.media_name IS NOT NULL),
  present AS (SELECT seq FROM stems s WHERE stem <> '' AND EXISTS (SELECT 1 FROM media d WHERE d.dir = s.dir AND starts_with(lower(d.name), s.stem) AND (s.counter IS NULL OR contains(d.name, s.counter)))),
  rates AS (SELECT count(*) AS total, count(p.media_name) AS name_resolvable, count(m.media_name) AS matched, count(*) FILTER (WHERE fuzzy) AS fuzzy, count(*) FILTER (WHERE m.reason = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE m.reason = 'unparseable') AS unparseable,
    round(count(*) FILTER (WHERE m.media_name IS NULL) * 100.0 / count(*), 4) AS unmatched_pct, (SELECT count(*) FROM present) AS addressable_unmatched,
    round((SELECT count(*) FROM present) * 100.0 / (count(m.media_name) + (SELECT count(*) FROM present)), 4) AS addressable_unmatched_pct,
    count(*) FILTER (WHERE m.media_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM media d WHERE d.dir = m.dir AND d.name = m.media_name)) AS cross_directory FROM matched m JOIN parsed p ON p.seq = m.seq)"""


@query(f"WITH {V.SIDECARS}, {V.MEDIA}, {PARSED}, {MATCHED}, {RATES} SELECT * FROM rates")
def agg_18_match_rates(spark, d):
    return match.match_rates(match.match_sidecars(V.sidecars(spark, d), V.media(spark, d)), V.media(spark, d))


def _unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched sidecars with some payloads missing and every fourth offer made twice."""
    s = V.sidecars(spark, d)
    rows = s.withColumn("payload", F.when(F.col("seq") % 6 != 5, F.concat(F.lit('{"photoTakenTime": {"timestamp": "'), (F.col("seq") % 3 + 1000).cast("string"), F.lit('"}}'))))
    twice = rows.unionByName(rows.filter("seq % 4 = 0").withColumn("seq", F.col("seq") + 10_000_000))
    return twice.select("seq", F.col("dir").alias("archive_dir"), F.col("name").alias("entry_name"), "payload")


def _kept_entries(spark: SparkSession, d: str) -> DataFrame:
    pos = F.col("pos")
    kept = F.when(pos % 9 != 8, F.concat(F.lit("/vault/"), pos.cast("string")))
    return V.media(spark, d).select(pos.alias("seq"), "dir", "name", kept.alias("kept_path"))


def _rebind(spark: SparkSession, d: str) -> DataFrame:
    """A plan for the unmatched sidecars; some files are gone or have moved."""
    entries = _kept_entries(spark, d)
    files = entries.filter("kept_path IS NOT NULL").select(F.col("kept_path").alias("path"), F.sha2(F.col("seq").cast("string"), 256).alias("digest_full"), F.lit(None).cast("string").alias("digest_source"), "seq")
    moved = files.filter("seq % 8 IN (2, 6)").withColumn("path", F.concat(F.lit("/new"), "path"))
    more = files.filter("seq % 8 = 6").withColumn("path", F.concat(F.lit("/also"), "path"))
    catalog = files.unionByName(moved).unionByName(more)
    return match.plan_rebind(_unmatched(spark, d), entries, catalog.filter("NOT (path LIKE '/vault/%' AND seq % 4 = 2) AND seq % 16 <> 3").select("path"), catalog.drop("seq"))


_REBIND = f"""{V.SIDECARS}, {V.MEDIA}, {PARSED}, {MATCHED},
  un AS (SELECT seq, dir, name, CASE WHEN seq % 6 <> 5 THEN '{{"photoTakenTime": {{"timestamp": "' || (seq % 3 + 1000) || '"}}}}' END AS payload FROM sidecars),
  twice AS (SELECT *, seq AS s0 FROM un UNION ALL SELECT seq + 10000000, dir, name, payload, seq FROM un WHERE seq % 4 = 0),
  kept AS (SELECT dir, name, min(pos) AS pos FROM media WHERE pos % 9 <> 8 GROUP BY ALL),
  w AS (SELECT t.seq, t.dir, t.name, payload, m.reason, m.media_name, k.pos,
    k.pos % 4 <> 2 AND k.pos % 16 <> 3 AS there, CASE WHEN k.pos % 16 = 3 THEN 0 WHEN k.pos % 8 = 2 THEN 1 WHEN k.pos % 8 = 6 THEN 2 ELSE 0 END AS moved
    FROM twice t JOIN matched m ON m.seq = t.s0 LEFT JOIN kept k ON k.dir = m.dir AND k.name = m.media_name),
  x AS (SELECT *, CASE WHEN payload IS NULL THEN 'no_payload' WHEN reason IS NOT NULL THEN reason WHEN pos IS NULL THEN 'media_not_kept' WHEN there THEN NULL WHEN moved = 0 THEN 'target_missing' WHEN moved > 1 THEN 'ambiguous_target' END AS refused FROM w),
  y AS (SELECT *, min(seq) OVER (PARTITION BY dir, name, payload, refused IS NULL) AS first_seq FROM x),
  plan AS (SELECT seq, CASE WHEN refused IS NOT NULL THEN 'refused' WHEN first_seq = seq THEN 'bound' ELSE 'duplicate' END AS decision, refused AS reason,
    CASE WHEN refused IS NULL THEN CASE WHEN there THEN '/vault/' ELSE '/new/vault/' END || pos END AS target, coalesce(NOT there AND refused IS NULL, false) AS relocated, first_seq, media_name, dir, name FROM y)"""


@query(f"WITH {_REBIND} SELECT * EXCLUDE (media_name, dir, name) FROM plan")
def dec_08_plan_rebind(spark, d):
    return _rebind(spark, d).drop("media_name")


@query(f"WITH {_REBIND} SELECT seq % 3 AS archive_id, decision, reason, count(*) AS n, count(*) FILTER (WHERE relocated) AS relocated FROM plan GROUP BY ALL")
def agg_16_rebind_stats(spark, d):
    return _rebind(spark, d).groupBy((F.col("seq") % 3).alias("archive_id"), "decision", "reason").agg(F.count("*").alias("n"), F.count_if("relocated").alias("relocated"))


_ROUTE = "CASE WHEN error IS NOT NULL THEN 'error' WHEN regexp_matches(lower(entry_path), '(^|/)metadata\\.json$') THEN 'album_metadata' WHEN lower(entry_path) LIKE '%.json' THEN 'sidecar' WHEN NOT regexp_matches(lower(entry_path), '\\.(jpg|mp4)$') THEN 'not_media' ELSE 'media' END"


@query(f"WITH {V.ENTRIES} SELECT seq, {_ROUTE} AS route FROM entries")
def flt_04_route(spark, d):
    return V.archive_entries(spark, d).select("seq", ingest.route(F.col("entry_path"), F.col("error")).alias("route"))


@query(f"WITH {V.ENTRIES} SELECT seq, entry_path, kept_path FROM entries WHERE skip_reason IS NULL OR skip_reason NOT IN ('sidecar', 'album_metadata', 'not_media')")
def flt_05_media_entries(spark, d):
    return ingest.media_entries(V.archive_entries(spark, d)).select("seq", "entry_path", "kept_path")


@query(f"WITH {V.ENTRIES} SELECT DISTINCT archive_id, entry_path FROM entries WHERE (archive_id, entry_path) NOT IN (SELECT archive_id, entry_path FROM entries WHERE status <> 'pending' AND archive_id % 2 = 0)")
def join_02_resume(spark, d):
    e = V.archive_entries(spark, d)
    return ingest.pending_entries(e.select("archive_id", "entry_path").distinct(), e.filter("archive_id % 2 = 0"))


_DECIDE = """x AS (SELECT conv_id * 100 + turn AS seq, conv_id, turn, text, 'e' || ((conv_id * 100 + turn) % 50) || '.jpg' AS name, CASE WHEN (conv_id * 100 + turn) % 13 <> 5 THEN sha256(text) END AS digest FROM conversations),
  f AS (SELECT seq, conv_id, CASE conv_id % 3 WHEN 0 THEN '/dest/f' WHEN 1 THEN '/dest2/f' ELSE '/dest/sub/f' END || seq || '.jpg' AS path, CASE WHEN turn % 3 < 2 THEN sha256(text) ELSE sha256('gone' || seq) END AS digest FROM x),
  k AS (SELECT digest, min(seq) FILTER (WHERE seq % 4 = 2) AS there, arg_min(path, seq) FILTER (WHERE conv_id % 3 = 0) AS restore FROM f GROUP BY 1),
  o AS (SELECT name, '/dest/' || name AS path, arg_min(sha256(text), seq) AS digest, 0 AS n FROM x WHERE turn % 3 = 2 GROUP BY name
    UNION ALL SELECT name, '/dest/' || replace(name, '.jpg', '(1).jpg'), arg_max(sha256(text), seq), 1 FROM x WHERE turn % 3 = 2 GROUP BY name HAVING count(*) > 1),
  a AS (SELECT x.seq, arg_min(o.path, n) AS orphan FROM x JOIN o ON o.name = x.name AND o.digest = x.digest GROUP BY 1),
  dec AS (SELECT x.seq AS ordinal, x.digest, there IS NOT NULL OR x.digest IS NOT NULL AND row_number() OVER (PARTITION BY x.digest ORDER BY x.seq) > 1 AS skip, k.digest IS NOT NULL AS had, restore, orphan FROM x LEFT JOIN k ON k.digest = x.digest LEFT JOIN a ON a.seq = x.seq)"""


@query(f"""WITH {_DECIDE} SELECT ordinal, digest, CASE WHEN skip THEN 'skipped' ELSE 'kept' END AS status, CASE WHEN skip THEN 'duplicate' END AS skip_reason,
  CASE WHEN NOT skip THEN CASE WHEN restore IS NOT NULL THEN 'prior_copy_restored' WHEN orphan IS NOT NULL THEN 'orphan_adopted' WHEN had THEN 'prior_copy_missing' END END AS keep_reason, CASE WHEN NOT skip THEN coalesce(restore, orphan) END AS restore_path FROM dec""")
def dec_04_decide_entries(spark, d):
    """Copies in the destination, below it and beside it; some there, some gone; unrecorded files under two names; entries without a digest."""
    seq, digest = F.col("conv_id") * 100 + F.col("turn"), F.sha2("text", 256)
    x = V.table(spark, d, "conversations").select(seq.alias("seq"), "conv_id", "turn", "text", digest.alias("full"), F.concat(F.lit("e"), (seq % 50).cast("string"), F.lit(".jpg")).alias("name"))
    s = F.col("seq").cast("string")
    folder = F.when(F.col("conv_id") % 3 == 0, "/dest/f").when(F.col("conv_id") % 3 == 1, "/dest2/f").otherwise("/dest/sub/f")
    files = x.select("seq", F.concat(folder, s, F.lit(".jpg")).alias("path"), F.when(F.col("turn") % 3 < 2, F.col("full")).otherwise(F.sha2(F.concat(F.lit("gone"), s), 256)).alias("digest_full"), F.lit(None).cast("string").alias("digest_source"))
    named = x.filter("turn % 3 = 2").groupBy("name").agg(F.min_by("full", "seq").alias("first"), F.max_by("full", "seq").alias("last"), F.count("*").alias("n"))
    orphans = named.select(F.concat(F.lit("/dest/"), "name").alias("path"), F.col("first").alias("digest")).unionByName(named.filter("n > 1").select(F.concat(F.lit("/dest/"), F.regexp_replace("name", r"\.jpg", "(1).jpg")).alias("path"), F.col("last").alias("digest")))
    present = files.filter("seq % 4 = 2").select("path", F.col("digest_full").alias("digest")).unionByName(orphans)
    entries = x.select(F.col("seq").alias("ordinal"), "name", F.when(F.col("seq") % 13 != 5, F.col("full")).alias("digest"))
    return ingest.decide_entries(entries, files, present, "/dest").drop("survivor", "matched_on")


@query(f"WITH {V.ENTRIES} SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'kept') AS kept, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS errors, true AS reconciled FROM entries WHERE status <> 'pending'")
def agg_14_ingest_stats(spark, d):
    return ingest.ingest_stats(V.archive_entries(spark, d).filter("status <> 'pending'"))


@query(f"WITH {V.ENTRIES} SELECT skip_reason, count(*) AS n FROM entries WHERE skip_reason IS NOT NULL GROUP BY 1")
def agg_15_skip_reasons(spark, d):
    return ingest.skip_reasons(V.archive_entries(spark, d))


@query(
    f"""WITH {V.ENTRIES}, {V.VAULT}, {V.LOG}, c AS (SELECT archive_id, coalesce(skip_reason, status) AS outcome, count(*) AS n FROM entries GROUP BY ALL),
  k AS (SELECT archive_id, CAST(coalesce(sum(size), 0) AS BIGINT) AS kept_bytes, count(*) FILTER (WHERE size IS NULL) AS missing_kept FROM entries LEFT JOIN vault ON path = kept_path WHERE status = 'kept' GROUP BY 1),
  m AS (SELECT archive_id, count(*) AS merges FROM (SELECT DISTINCT archive_id, kept_path FROM entries WHERE kept_path IS NOT NULL) JOIN log ON target_path = kept_path WHERE source_desc LIKE 'takeout:%' AND field <> 'already_present' GROUP BY 1)
  SELECT c.archive_id, outcome, n, coalesce(kept_bytes, 0) AS kept_bytes, coalesce(missing_kept, 0) AS missing_kept, coalesce(merges, 0) AS merges FROM c LEFT JOIN k USING (archive_id) LEFT JOIN m USING (archive_id)"""
)
def agg_10_archive_detail(spark, d):
    return ingest.archive_detail(V.archive_entries(spark, d), V.vault(spark, d), V.metadata_log(spark, d))


@query(f"WITH {V.ENTRIES}, {V.VAULT} SELECT seq, kept_path FROM entries WHERE status = 'kept' AND kept_path NOT IN (SELECT path FROM vault)")
def qc_10_missing_kept(spark, d):
    return reports.missing_kept(V.archive_entries(spark, d), V.vault(spark, d)).select("seq", "kept_path")


@query(f"WITH {V.ENTRIES}, {V.VAULT} SELECT n AS duplicates, CAST(trunc(n * mean) AS BIGINT) AS bytes_saved FROM (SELECT count(*) AS n FROM entries WHERE skip_reason = 'duplicate'), (SELECT avg(size) AS mean FROM vault)")
def agg_11_avoided(spark, d):
    return reports.avoided(V.archive_entries(spark, d), V.vault(spark, d))


@query("SELECT k, path, digest FROM (SELECT c_custkey AS k, 'a' || (c_custkey % 40) AS path, 'd' || (c_custkey % 55) AS digest FROM customer) WHERE path NOT IN (SELECT 'a' || (s_suppkey % 60) FROM supplier WHERE s_suppkey % 3 = 0) AND path NOT IN (SELECT 'a' || (c_custkey % 40) FROM customer WHERE 'd' || (c_custkey % 55) IN (SELECT 'd' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey < 4))")
def join_16_open_archives(spark, d):
    c = F.col("c_custkey")
    incoming = V.table(spark, d, "customer").select(c.alias("k"), F.concat(F.lit("a"), (c % 40).cast("string")).alias("path"), F.concat(F.lit("d"), (c % 55).cast("string")).alias("digest"))
    s = F.col("s_suppkey")
    digest = F.when(s < 4, F.concat(F.lit("d"), s.cast("string")))
    done = V.table(spark, d, "supplier").select(F.concat(F.lit("a"), (s % 60).cast("string")).alias("path"), digest.alias("digest"), F.when(s % 3 == 0, "complete").otherwise("pending").alias("status"))
    return ingest.open_archives(incoming, done)


_ALLOC = """w AS (SELECT c_custkey AS ordinal, c_custkey % 37 AS family, 'img_' || (c_custkey % 37) || CASE WHEN c_custkey % 7 = 0 THEN '(1)' ELSE '' END AS stem FROM customer),
  t AS (SELECT DISTINCT s_suppkey % 50 AS family, 'img_' || (s_suppkey % 50) || CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '(01)' WHEN 2 THEN '(0)' WHEN 3 THEN '(2)' ELSE '(1)(1)' END || '.jpg' AS name FROM supplier),
  o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ordinal) AS i FROM w),
  s(family, i, used, ordinal, stem, given) AS (
    SELECT family, CAST(0 AS BIGINT), coalesce((SELECT list(name) FROM t WHERE t.family = f.family), CAST([] AS VARCHAR[])), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT family FROM w) f
    UNION ALL
    SELECT family, i, list_append(used, given), ordinal, stem, given FROM (SELECT s.family, o.i, s.used, o.ordinal, o.stem,
      [n FOR n IN [o.stem || CASE WHEN k = 0 THEN '' ELSE '(' || k || ')' END || '.jpg' FOR k IN range(len(s.used) + 1)] IF NOT list_contains(s.used, n)][1] AS given FROM s JOIN o ON o.family = s.family AND o.i = s.i + 1))"""


@query(f"WITH RECURSIVE {_ALLOC} SELECT ordinal, stem || '.jpg' AS name, given FROM s WHERE ordinal IS NOT NULL")
def win_10_allocate_names(spark, d):
    """Names asked for in order, some of them numbered ones; taken names with padded, zero and double numbers."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    wanted = V.table(spark, d, "customer").select(c.alias("ordinal"), F.concat(F.lit("img_"), (c % 37).cast("string"), F.when(c % 7 == 0, "(1)").otherwise(""), F.lit(".jpg")).alias("name"))
    number = F.when(s % 5 == 0, "").when(s % 5 == 1, "(01)").when(s % 5 == 2, "(0)").when(s % 5 == 3, "(2)").otherwise("(1)(1)")
    taken = V.table(spark, d, "supplier").select(F.concat(F.lit("img_"), (s % 50).cast("string"), number, F.lit(".jpg")).alias("name"))
    return ingest.settle(wanted, taken, lambda df: stored(df, "names"))


_AT = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%S')"
_DOCS = f"""CASE WHEN field = 'date' THEN '{{"datetime_local":"' || {_AT.format("value - CASE WHEN assumed THEN 0 ELSE 18000 END")} || '","offset":"' || CASE WHEN assumed THEN '+00:00' ELSE '-05:00' END || '","utc":"' || {_AT.format("value")} || '+00:00","utc_epoch":' || value
    || ',"tz":null,"tz_source":"' || CASE WHEN assumed THEN 'utc_fallback' ELSE 'exif' END || '"}}' ELSE '{{"lat":' || lat || ',"lon":' || lon || ',"altitude":null,"altitude_ref":null}}' END AS payload"""
_DEC = f"""{V.OFFERS}, {V.TARGETS}, o AS (SELECT *, container IN ('jpeg', 'webp') AS writable, CASE WHEN field = 'date' THEN has_date ELSE has_gps END AS had,
    {_DOCS}, row_number() OVER (PARTITION BY o.target, field ORDER BY offer_seq) AS n, coalesce(lag(value) OVER (PARTITION BY o.target, field ORDER BY offer_seq), CAST(mtime AS BIGINT)) AS held FROM offers o JOIN targets t ON t.target = o.target WHERE value IS NOT NULL),
  st AS (SELECT *, CASE WHEN writable AND NOT exif_ok THEN 'failed' WHEN writable AND (coalesce(had, false) OR n > 1) THEN 'already_present' WHEN writable THEN 'merged' WHEN field = 'gps' THEN 'deferred' WHEN value = held THEN 'already_present' ELSE 'merged_mtime_only' END AS state FROM o),
  dec AS (SELECT target, field, value, offer_seq, state, source_desc, payload, CASE WHEN state = 'already_present' THEN '{{"field":"' || field || '","offered":{{' || CASE WHEN field = 'date' THEN '"utc_epoch":' || value ELSE '"lat":' || lat || ',"lon":' || lon END
    || '}},"satisfied_by":"' || CASE WHEN writable THEN 'exif_' || field ELSE 'mtime' END || '"}}' END AS refusal, CASE WHEN state = 'failed' THEN 'failed_unparseable' WHEN state = 'merged' AND field = 'date' AND assumed THEN 'tz_unknown_assumed_utc' WHEN state IN ('deferred', 'merged_mtime_only') THEN 'unsupported_' || container END AS reason FROM st)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return offers.evaluate_offers(V.offers(spark, d), V.targets(spark, d))


def _no_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_ROWS)


def _no_pending(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PENDING_ROWS)


LOG_ROWS = "seq bigint, target_path string, source_desc string, field string, value string"
PENDING_ROWS = "file_path string, field string, value string, applied_at timestamp"


@query(f"WITH {_DEC} SELECT target, field, value, offer_seq, state, reason FROM dec")
def dec_01_evaluate_offers(spark, d):
    return _decisions(spark, d).select("target", "field", "value", "offer_seq", "state", "reason")


@query(f"WITH {_DEC} SELECT target, field, value, offer_seq, state, reason FROM dec")
def win_07_two_batches(spark, d):
    """The same offers in two batches: the second is decided on what the first logged, and nothing differs."""
    made, targets = V.offers(spark, d), V.targets(spark, d)
    half = made.agg((F.max("offer_seq") / 2).alias("half"))
    turn = made.join(F.broadcast(half), F.lit(True)).withColumn("first", F.col("offer_seq") <= F.col("half")).drop("half")  # one row
    one = offers.evaluate_offers(turn.filter("first").drop("first"), targets)
    log, _ = offers.change_sets(one, _no_log(spark), _no_pending(spark))
    two = offers.evaluate_offers(turn.filter("NOT first").drop("first"), offers.targets_now(targets, log))
    return one.unionByName(two).select("target", "field", "value", "offer_seq", "state", "reason")


@query(f"WITH {_DEC} SELECT target, field, arg_max(value, offer_seq) AS value FROM dec WHERE state IN ('merged', 'merged_mtime_only') GROUP BY ALL")
def dec_01_overlay(spark, d):
    return offers.overlay(_decisions(spark, d))


@query(f"WITH {_DEC} SELECT target, field, state, count(*) AS n, count(DISTINCT value) AS values FROM dec GROUP BY ALL")
def agg_19_outcome_cardinality(spark, d):
    return reports.outcome_cardinality(_decisions(spark, d))


@query(
    f"""WITH {_DEC}, m AS (SELECT target, field, state FROM dec UNION ALL SELECT '/vault/' || user_id, 'date', CASE event_type WHEN 'click' THEN 'failed' WHEN 'view' THEN 'deferred' ELSE 'merged' END FROM events WHERE user_id % 10 = 9),
  s AS (SELECT target, field, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM m GROUP BY ALL) SELECT * FROM s WHERE states NOT IN ('already_present', 'already_present,merged', 'merged', 'deferred', 'failed', 'merged_mtime_only', 'already_present,merged_mtime_only')"""
)
def qc_01_illegal_states(spark, d):
    """Beside what the engine decided, states made up for other targets, most of which can't go together."""
    kind = F.when(F.col("event_type") == "click", "failed").when(F.col("event_type") == "view", "deferred").otherwise("merged")
    made_up = V.table(spark, d, "events").filter("user_id % 10 = 9").select(F.concat(F.lit("/vault/"), F.col("user_id").cast("string")).alias("target"), F.lit("date").alias("field"), kind.alias("state"))
    return reports.illegal_states(_decisions(spark, d).select("target", "field", "state").unionByName(made_up))


@query(f"WITH {_DEC} SELECT target, field, value, count(*) AS n FROM dec WHERE state = 'merged_mtime_only' GROUP BY ALL HAVING count(*) > 1")
def qc_04_repeated_outcomes(spark, d):
    return reports.repeated_outcomes(_decisions(spark, d).filter("state = 'merged_mtime_only'"))


_WAITS = "w AS (SELECT target AS file_path, field, payload AS value, reason, CASE WHEN state = 'failed' THEN 'failed' ELSE 'deferred' END AS state, source_desc, offer_seq AS seq FROM dec WHERE reason IS NOT NULL)"


@query(f"WITH {_DEC}, {_WAITS} SELECT * FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY file_path, field, value ORDER BY seq) = 1) WHERE (file_path, field, value) NOT IN (SELECT file_path, field, value FROM w WHERE seq % 4 = 0)")
def snk_07_pending_once(spark, d):
    """Some of the rows wait already, others were applied before and come again."""
    decided = _decisions(spark, d)
    waits = offers.change_sets(decided, _no_log(spark), _no_pending(spark))[1]
    every = decided.filter("reason IS NOT NULL").select(F.col("target").alias("file_path"), "field", offers.payload_of().alias("value"), F.when(F.col("offer_seq") % 4 == 1, F.lit("2026-08-04 00:00:00").cast("timestamp")).alias("applied_at"), "offer_seq")
    return offers.change_sets(decided, _no_log(spark), every.filter("offer_seq % 4 < 2").drop("offer_seq"))[1].select(*waits.columns)


@query(f"WITH {_DEC}, r AS (SELECT target AS target_path, refusal AS value, offer_seq AS seq, source_desc FROM dec WHERE state = 'already_present') SELECT * FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target_path, value ORDER BY seq) = 1) WHERE (target_path, value) NOT IN (SELECT target_path, value FROM r WHERE seq % 3 = 1)")
def snk_08_refused_once(spark, d):
    """Refusals that the log doesn't hold yet; every third offer was made before."""
    decided = _decisions(spark, d)
    log = offers.change_sets(decided.filter("offer_seq % 3 = 1"), _no_log(spark), _no_pending(spark))[0].filter("field = 'already_present'")
    rows = offers.change_sets(decided, log, _no_pending(spark))[0].filter("field = 'already_present'")
    return rows.select("target_path", "value", "seq", "source_desc")


@query(f"WITH {_DEC} SELECT offer_seq AS seq, target AS target_path, source_desc, CASE WHEN state = 'merged' THEN field ELSE state END AS field, coalesce(refusal, payload) AS value FROM dec WHERE state IN ('merged', 'merged_mtime_only', 'already_present') QUALIFY row_number() OVER (PARTITION BY target, CASE WHEN state = 'already_present' THEN refusal ELSE CAST(offer_seq AS VARCHAR) END ORDER BY offer_seq) = 1")
def snk_05_log_rows(spark, d):
    return offers.change_sets(_decisions(spark, d), _no_log(spark), _no_pending(spark))[0]


@query(f"WITH {_DEC} SELECT target AS path, arg_min(value, offer_seq) AS epoch FROM dec WHERE field = 'date' AND state IN ('merged', 'merged_mtime_only', 'already_present') GROUP BY 1")
def win_05_own_log(spark, d):
    """The first epoch of each path in a log that the engine wrote."""
    log, _ = offers.change_sets(_decisions(spark, d), _no_log(spark), _no_pending(spark))
    return offers.first_usable(log, logged_epoch(F.col("value")))


@query(f"WITH {V.LOG} SELECT target_path AS path, arg_min(epoch, seq) AS epoch FROM log WHERE epoch <> 0 GROUP BY 1")
def win_05_first_epoch(spark, d):
    return offers.first_usable(V.metadata_log(spark, d), logged_epoch(F.col("value")))


@query("WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN NULL WHEN 2 THEN -1 ELSE NULL END AS a, CASE WHEN event_id % 4 IN (1, 2) THEN event_id END AS b FROM events) SELECT event_id, CASE WHEN event_id % 8 = 7 THEN NULL WHEN a > 0 THEN a WHEN b > 0 THEN b END AS utc_epoch, CASE WHEN event_id % 8 = 7 THEN NULL WHEN event_id % 3 = 0 THEN 1.5 WHEN event_id % 3 = 1 THEN 0.0 END AS lat FROM e")
def json_01_sidecar_payload(spark, d):
    i = F.col("event_id").cast("string")
    taken = F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 4 == 2, F.lit("-1"))
    stamp = lambda name, value: F.coalesce(F.concat(F.lit(f'"{name}":{{"timestamp":"'), value, F.lit('"},')), F.lit(""))
    made = F.when((F.col("event_id") % 4).isin(1, 2), i)
    geo = F.when(F.col("event_id") % 3 == 0, '"geoData":{"latitude":0.0,"longitude":0.0},"geoDataExif":{"latitude":1.5,"longitude":2}').when(F.col("event_id") % 3 == 1, '"geoData":{"latitude":0.0,"longitude":7.25}').otherwise('"geoData":{"latitude":0.0,"longitude":0.0}')
    doc = F.when(F.col("event_id") % 8 == 7, F.lit("[1, 2]")).otherwise(F.concat(F.lit("{"), stamp("photoTakenTime", taken), stamp("creationTime", made), geo, F.lit("}")))
    return V.table(spark, d, "events").select("event_id", sidecar_payload(doc).alias("p")).select("event_id", "p.utc_epoch", "p.lat")


@query("SELECT event_id, '{\"field\":\"' || event_type || '\",\"offered\":' || user_id || ',\"satisfied_by\":' || CASE WHEN event_id % 2 = 0 THEN '\"exif_date\"' ELSE 'null' END || '}' AS doc FROM events")
def json_05_sorted_document(spark, d):
    by = F.when(F.col("event_id") % 2 == 0, "exif_date")
    return V.table(spark, d, "events").select("event_id", sorted_json(satisfied_by=by, offered=F.col("user_id"), field=F.col("event_type")).alias("doc"))


@query(f"WITH {V.PENDING} SELECT state, field, reason, count(*) AS n FROM pending WHERE NOT applied GROUP BY ALL")
def agg_07_pending_summary(spark, d):
    return reports.open_counts(V.pending(spark, d))


@query(f"WITH {V.PENDING} SELECT seq, file_path, field, value FROM pending WHERE NOT applied ORDER BY seq LIMIT 100")
def flt_07_outstanding(spark, d):
    return reports.outstanding(V.pending(spark, d), limit=100).select("seq", "file_path", "field", "value")


@query(f"WITH {V.SIDECARS}, {V.MEDIA}, {PARSED}, {MATCHED} SELECT reason, count(*) AS n FROM matched WHERE media_name IS NULL AND seq % 10 <> 0 GROUP BY 1")
def agg_08_unmatched_summary(spark, d):
    """Every tenth was bound since."""
    found = match.match_sidecars(V.sidecars(spark, d), V.media(spark, d)).filter("media_name IS NULL")
    return match.unmatched_summary(found.withColumn("rebound_at", F.when(F.col("seq") % 10 == 0, F.lit("2026-08-04 00:00:00").cast("timestamp"))))


# Times: clocks, offsets and claims are made from event ids.
_OFF = "CASE event_id % 6 WHEN 0 THEN '-06:00' WHEN 1 THEN '+05:45' WHEN 2 THEN '+09:75' WHEN 3 THEN '0600' WHEN 4 THEN '+14:00' END"
_EPOCH = "1625421600 + (event_id % 700) * 3607"


def _timed(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").selectExpr("event_id", f"{_OFF} AS off", f"CAST({_EPOCH} AS BIGINT) AS epoch", "concat('dir', CAST(user_id % 20 AS STRING)) AS dir")
    clock = F.date_format(F.timestamp_seconds("epoch"), "yyyy:MM:dd HH:mm:ss")
    return e.withColumn("dto", F.when(F.col("event_id") % 10 == 9, "0000:00:00 00:00:00").otherwise(F.concat(clock, F.lit("\0"))))


_SECS = "CASE event_id % 6 WHEN 0 THEN -21600 WHEN 1 THEN 20700 WHEN 4 THEN 50400 END"


@query(f"SELECT event_id, {_SECS} AS strict_s, CASE event_id % 6 WHEN 0 THEN -21600 WHEN 1 THEN 20700 WHEN 2 THEN 36900 WHEN 4 THEN 50400 END AS loose_s, CASE event_id % 6 WHEN 0 THEN '-06:00' WHEN 1 THEN '+05:45' WHEN 4 THEN '+14:00' END AS off_text, CASE WHEN event_id % 10 <> 9 THEN CAST({_EPOCH} AS BIGINT) END AS clock FROM events")
def dt_01_clocks_and_offsets(spark, d):
    strict = offset_seconds(F.col("off"))
    return _timed(spark, d).select("event_id", strict.alias("strict_s"), offset_seconds(F.col("off"), strict=False).alias("loose_s"), offset_text(strict).alias("off_text"), clock_epoch(camera_clock(F.col("dto"))).alias("clock"))


@query("SELECT event_id, abs(v) <= 50400 AND abs(v - round_even(v / 900.0, 0) * 900) <= 60 AS legal FROM (SELECT event_id, (event_id % 400 - 200) * 317 AS v FROM events)")
def dt_09_legal_offset(spark, d):
    v = (F.col("event_id") % 400 - 200) * 317
    return V.table(spark, d, "events").select("event_id", is_legal_offset(v).alias("legal"))


_INSTANT = f"""t AS (SELECT event_id, event_id % 13 <> 12 AS readable, CASE WHEN event_id % 10 <> 9 THEN {_EPOCH} END AS clock, CASE event_id % 6 WHEN 0 THEN -21600 WHEN 1 THEN 20700 WHEN 2 THEN 36900 WHEN 4 THEN 50400 END AS off,
    CASE event_id % 4 WHEN 0 THEN {_EPOCH} + 18000 WHEN 1 THEN {_EPOCH} + 37530 WHEN 2 THEN {_EPOCH} + 900000 END AS claimed FROM events),
  i AS (SELECT *, CASE WHEN NOT readable THEN 'no_readable_exif' WHEN clock IS NULL THEN 'no_datetimeoriginal' WHEN off IS NOT NULL THEN 'exif_offset' WHEN claimed IS NULL THEN 'no_offset_and_no_google_value'
    WHEN claimed - clock = 18000 THEN 'google_corroborated' WHEN claimed - clock = 37530 THEN 'google_offset_not_quantised' ELSE 'google_contradicts_exif' END AS outcome FROM t)"""


@query(f"WITH {_INSTANT} SELECT event_id, CAST(CASE outcome WHEN 'exif_offset' THEN clock - off WHEN 'google_corroborated' THEN claimed END AS BIGINT) AS epoch, outcome FROM i")
def dt_10_resolve_instant(spark, d):
    claimed = F.when(F.col("event_id") % 4 == 0, F.col("epoch") + 18000).when(F.col("event_id") % 4 == 1, F.col("epoch") + 37530).when(F.col("event_id") % 4 == 2, F.col("epoch") + 900000)
    i = resolve_instant(F.col("event_id") % 13 != 12, camera_clock(F.col("dto")), offset_seconds(F.col("off"), strict=False), claimed)
    return _timed(spark, d).select("event_id", i.alias("i")).select("event_id", "i.epoch", "i.outcome")


_SIB = "w AS (SELECT event_id AS id, 'dir' || (user_id % 20) AS dir, 1625421600 + (event_id % 700) * 3607 AS epoch FROM events), s AS (SELECT DISTINCT 'dir' || (user_id % 20) AS dir, 1625421600 + (event_id % 700) * 3607 AS sib, CASE WHEN event_id % 700 < 350 THEN -18000 ELSE 3600 END AS off FROM events WHERE event_id % 40 = 3)"


def _siblings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _timed(spark, d)
    known = F.when(F.col("event_id") % 40 == 3, F.when(F.col("event_id") % 700 < 350, -18000).otherwise(3600))
    return t.select(F.col("event_id").alias("id"), "dir", "epoch"), t.select("dir", "epoch", known.alias("offset"))


@query(f"WITH {_SIB} SELECT id, min(off) AS sibling_offset FROM w JOIN s ON s.dir = w.dir AND abs(sib - epoch) <= 43200 GROUP BY 1 HAVING count(DISTINCT off) = 1")
def join_12_sibling_offsets(spark, d):
    return capture.sibling_offsets(*_siblings(spark, d))


_PLACE = "pl AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 41.87811 WHEN 1 THEN 27.7172 WHEN 2 THEN -33.8688 WHEN 3 THEN 70.0 END AS lat, CASE c_custkey % 5 WHEN 0 THEN -87.6298 WHEN 1 THEN 85.324 WHEN 2 THEN 151.2093 WHEN 3 THEN 10.0 END AS lon, 1625421600 + (c_custkey % 2) * 15811200 AS epoch FROM customer)"
_ZONE = "CASE id % 5 WHEN 0 THEN 'America/Chicago' WHEN 1 THEN 'Asia/Kathmandu' WHEN 2 THEN 'Australia/Sydney' WHEN 3 THEN 'UTC' END"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = F.when(k % 5 == 0, 41.87811).when(k % 5 == 1, 27.7172).when(k % 5 == 2, -33.8688).when(k % 5 == 3, 70.0)
    lon = F.when(k % 5 == 0, -87.6298).when(k % 5 == 1, 85.324).when(k % 5 == 2, 151.2093).when(k % 5 == 3, 10.0)
    places = V.table(spark, d, "customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"), (F.lit(1625421600) + (k % 2) * 15811200).alias("epoch"))
    zones = spark.createDataFrame(list(V.ZONES), "n int, zone string, lat_lo double, lat_hi double, lon_lo double, lon_hi double, priority int")
    return capture.zones_of(places, zones)


@query(f"WITH {_PLACE} SELECT id, {_ZONE} AS zone FROM pl")
def join_13_zones(spark, d):
    return _placed(spark, d).select("id", "zone")


_UTC_OFF = "CASE WHEN id % 9 = 8 THEN 7200 ELSE CASE id % 5 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN -18000 ELSE -21600 END WHEN 1 THEN 20700 WHEN 2 THEN CASE WHEN id % 2 = 0 THEN 36000 ELSE 39600 END WHEN 3 THEN 0 ELSE CASE WHEN id % 2 = 0 THEN -10800 ELSE 0 END END END"
_CAP_SRC = "CASE WHEN id % 9 = 8 THEN 'exif' WHEN id % 5 < 4 THEN 'gps' WHEN id % 2 = 0 THEN 'sibling' ELSE 'utc_fallback' END"


@query(f"WITH {_PLACE}, c AS (SELECT id, epoch, {_UTC_OFF} AS off, {_CAP_SRC} AS tz_source FROM pl) SELECT id, CAST(epoch + off AS BIGINT) AS local_epoch, CASE WHEN off < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(off) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(off) // 60 % 60 AS VARCHAR), 2, '0') AS offset, CASE WHEN tz_source = 'gps' THEN {_ZONE} END AS tz_name, tz_source, tz_source = 'utc_fallback' AS is_assumed FROM c")
def dt_08_capture_time(spark, d):
    rows = _placed(spark, d).withColumn("own_offset", F.when(F.col("id") % 9 == 8, 7200)).withColumn("sibling_offset", F.when(F.col("id") % 2 == 0, -10800))
    return capture.capture_times(rows)


_ADOPT = """a AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 1500000000 WHEN 1 THEN 1785800000 WHEN 2 THEN 100 WHEN 3 THEN NULL ELSE 1600000000 END AS src, CASE event_id % 5 WHEN 0 THEN 1785800000 WHEN 1 THEN 1500003600 ELSE 1785900000 END AS dst,
    CASE WHEN event_id % 3 = 0 THEN 1500000000 END AS src_clock, CASE WHEN event_id % 4 = 0 THEN 1500000000 END AS dst_clock FROM events),
  l AS (SELECT *, CASE WHEN src_clock IS NULL THEN NULL ELSE src = 1500000000 END AS sm, CASE WHEN dst_clock IS NULL THEN NULL ELSE dst = 1500003600 END AS dm FROM a),
  v AS (SELECT *, CASE WHEN src IS NULL THEN 'stat_failed' WHEN dm OR dm IS NULL AND NOT dst BETWEEN 1785715200 AND 1785974400 THEN 'survivor_mtime_not_clobbered' WHEN NOT (src > 631152000 AND src < 1900000000) THEN 'source_mtime_implausible'
    WHEN sm = false THEN 'source_mtime_disagrees_with_its_own_exif' WHEN sm IS NULL AND src BETWEEN 1785715200 AND 1785974400 THEN 'source_mtime_also_from_ingest_window' END AS reason FROM l)"""


@query(f"""WITH {_ADOPT} SELECT id, reason, CAST(CASE WHEN reason IS NULL THEN src END AS BIGINT) AS adopted, CASE reason WHEN 'stat_failed' THEN '' WHEN 'survivor_mtime_not_clobbered' THEN CASE WHEN dm THEN 'survivor mtime sits a legal UTC offset from its own EXIF, so it describes the capture' ELSE 'no EXIF to check against and 2017-07-14 is outside the Takeout ingest window; it may be legitimate' END
  WHEN 'source_mtime_implausible' THEN '1970-01-01T00:01:40' WHEN 'source_mtime_disagrees_with_its_own_exif' THEN 'gap is not a whole 15-minute offset' WHEN 'source_mtime_also_from_ingest_window' THEN ''
  ELSE strftime(make_timestamp(CAST(dst AS BIGINT) * 1000000), '%Y-%m-%d') || ' (ingest) -> ' || strftime(make_timestamp(CAST(src AS BIGINT) * 1000000), '%Y-%m-%d') || ' (source)' END AS detail FROM v""")
def dec_06_mtime_adoption(spark, d):
    i = F.col("event_id")
    clock = F.timestamp_seconds(F.lit(1500000000)).cast("timestamp_ntz")
    src = F.when(i % 7 == 0, 1500000000).when(i % 7 == 1, 1785800000).when(i % 7 == 2, 100).when(i % 7 > 3, 1600000000)
    dst = F.when(i % 5 == 0, 1785800000).when(i % 5 == 1, 1500003600).otherwise(1785900000)
    pairs = V.table(spark, d, "events").select(i.alias("id"), src.cast("bigint").alias("src_mtime"), dst.cast("bigint").alias("dst_mtime"), F.when(i % 3 == 0, clock).alias("src_clock"), F.when(i % 4 == 0, clock).alias("dst_clock"))
    return capture.mtime_adoption(pairs, now=1900000000)


# What is on disk is V.LISTING; a text of fifteen hundred bytes has its head for a tail. Head digests differ for some, tails for others.
_REPAIR = f"""{V.FILES}, disk AS (SELECT doc_id AS seq, CAST(strlen(text) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, CAST(({V.DOC_MTIME} + CASE WHEN doc_id % 10 = 1 THEN 5 ELSE 0 END) AS BIGINT) AS now_mtime, doc_id % 17 = 3 AS changed FROM documents WHERE doc_id % 13 <> 7),
  w AS (SELECT f.seq, f.path, CAST(f.mtime AS BIGINT) AS m, f.size, f.digest_full, d.size AS now_size, now_mtime, changed, f.seq % 9 <> 8 AS readable, f.seq % 2 = 0 AS own,
    CASE WHEN f.seq % 9 <> 7 THEN CASE WHEN f.seq % 2 = 0 THEN CAST(f.mtime AS BIGINT) + CASE WHEN f.seq % 3 = 0 THEN 0 ELSE 3600 END - 3600 ELSE CAST(f.mtime AS BIGINT) - 7200 END END AS clock, CASE f.seq % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(f.mtime AS BIGINT) - 7200 + 3637 * 7 WHEN 2 THEN 1000000000 ELSE CAST(f.mtime AS BIGINT) - 3600 END AS claimed
    FROM files f LEFT JOIN disk d ON d.seq = f.seq WHERE f.mtime BETWEEN 1785715200 AND 1785974400),
  o AS (SELECT *, claimed - clock AS gap, strftime(make_timestamp(clock * 1000000), '%Y-%m-%d %H:%M:%S') AS shown, strftime(make_timestamp(claimed * 1000000), '%Y-%m-%d %H:%M:%S') AS said FROM w),
  i AS (SELECT *, CASE WHEN NOT readable THEN 'no_readable_exif' WHEN clock IS NULL THEN 'no_datetimeoriginal' WHEN own THEN 'exif_offset' WHEN claimed IS NULL THEN 'no_offset_and_no_google_value'
    WHEN gap = 3600 THEN 'google_corroborated' WHEN gap = 25459 THEN 'google_offset_not_quantised' ELSE 'google_contradicts_exif' END AS outcome FROM o),
  g AS (SELECT *, CASE outcome WHEN 'exif_offset' THEN clock + 3600 WHEN 'google_corroborated' THEN claimed END AS epoch,
    CASE outcome WHEN 'exif_offset' THEN shown || ' offset -1 day, 23:00:00' WHEN 'no_offset_and_no_google_value' THEN shown WHEN 'google_corroborated' THEN shown || ' + offset +1.00h'
      WHEN 'google_offset_not_quantised' THEN 'exif ' || shown || ' vs google ' || said || '+00:00 — gap ' || printf('%+.3fh', gap / 3600.0) || ' is not a whole 15-minute offset'
      WHEN 'google_contradicts_exif' THEN 'exif ' || shown || ' vs google ' || said || '+00:00 — ' || CAST(round_even(abs(gap) / 86400.0, 0) AS BIGINT) || 'd apart' ELSE '' END AS words FROM i),
  h AS (SELECT *, CASE WHEN size <> now_size THEN format('size {{:,}} != db {{:,}}', now_size, size) WHEN seq % 23 <> 5 AND changed THEN 'head digest db ' || digest_full[1:16] || ' != disk ' || sha256('changed' || seq)[1:16] END AS differs FROM g),
  z AS (SELECT *, CASE WHEN now_size IS NULL THEN 'file_missing' WHEN epoch IS NULL THEN outcome WHEN differs IS NOT NULL THEN 'hash_mismatch' END AS why FROM h),
  plan AS (SELECT seq, path, CASE WHEN why IS NOT NULL THEN 'skipped' WHEN epoch = now_mtime THEN 'already_correct' ELSE 'set' END AS decision, coalesce(why, outcome) AS reason,
    CASE WHEN now_size IS NULL THEN '' WHEN epoch IS NULL THEN words ELSE coalesce(differs, words) END AS detail, CAST(now_mtime AS DOUBLE) AS old_mtime, epoch FROM z)"""


@query(f"WITH {_REPAIR} SELECT path, decision, reason, detail, CAST(CASE WHEN decision = 'set' THEN epoch END AS BIGINT) AS new_mtime, old_mtime FROM plan")
def dec_07_repair_plan(spark, d):
    """Files that are gone, have grown or have other bytes; clocks without offsets beside claims that fit, don't fit or are far off; rows without a head digest."""
    return _repair(spark, d)


def _repair(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    head = F.when(seq % 23 != 5, F.col("digest_full"))
    files = V.files(spark, d).withColumns({"digest_head": head, "digest_tail": head})
    disk = V.listing(spark, d).join(files.select("path", "seq", F.col("digest_full").alias("was")), "path")
    now = F.when(F.col("digest_full") == F.col("was"), F.col("was")).otherwise(F.sha2(F.concat(F.lit("changed"), seq.cast("string")), 256))
    disk = disk.select("path", F.col("size").alias("now_size"), now.alias("now_full"), now.alias("now_head"), now.alias("now_tail"), F.col("mtime").alias("now_mtime"))
    m = F.col("mtime").cast("bigint")
    own = F.when(seq % 2 == 0, m + F.when(seq % 3 == 0, 0).otherwise(3600) - 3600).otherwise(m - 7200)
    clock = F.when(seq % 9 != 7, F.timestamp_seconds(own).cast("timestamp_ntz"))
    clocks = files.select("path", (seq % 9 != 8).alias("readable"), clock.alias("clock"), F.when(seq % 2 == 0, -3600).alias("offset"))
    claimed = F.when(seq % 5 == 1, m - 7200 + 3637 * 7).when(seq % 5 == 2, 1000000000).otherwise(m - 3600)
    return capture.repair_plan(files, disk, clocks, files.filter("seq % 5 <> 0").select("path", claimed.alias("epoch")))


@query(f"WITH {_REPAIR} SELECT decision, reason, count(*) AS n FROM plan GROUP BY ALL")
def agg_17_repair_stats(spark, d):
    return _repair(spark, d).groupBy("decision", "reason").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT event_id, 1625421600 + event_id * 61 AS epoch, CASE event_id % 3 WHEN 0 THEN -18000 WHEN 1 THEN 0 ELSE 20700 END AS off FROM events) SELECT event_id, CAST(epoch + off AS BIGINT) AS wall FROM e")
def qc_05_wall_clock(spark, d):
    """Rows whose stored wall clock is the epoch plus the declared offset, checked through text and back."""
    i = F.col("event_id")
    off = F.when(i % 3 == 0, "-05:00").when(i % 3 == 1, "+00:00").otherwise("+05:45")
    rows = V.table(spark, d, "events").select("event_id", (F.lit(1625421600) + i * 61).alias("epoch"), offset_seconds(off).alias("off"))
    stored = F.date_format(F.timestamp_seconds(F.col("epoch") + F.col("off")), "yyyy:MM:dd HH:mm:ss")
    return rows.select("event_id", clock_epoch(camera_clock(stored)).alias("wall"), (F.col("epoch") + F.col("off")).alias("e")).filter("wall = e").drop("e")


@query(f"WITH {_DEC}, {_WAITS} SELECT count(DISTINCT (target, refusal)) + count(*) FILTER (WHERE state IN ('merged', 'merged_mtime_only')) AS log_rows, (SELECT count(DISTINCT (file_path, field, value)) FROM w) AS pending_rows, CAST(0 AS BIGINT) AS again FROM dec WHERE state IN ('merged', 'merged_mtime_only', 'already_present')".replace("count(DISTINCT (target, refusal))", "count(DISTINCT CASE WHEN state = 'already_present' THEN (target, refusal) END)"))
def qc_07_second_run_adds_nothing(spark, d):
    """What the first run of some offers adds, and what the same offers add on top of that."""
    decided = stored(_decisions(spark, d), "decided")
    log, waits = [stored(df, name) for df, name in zip(offers.change_sets(decided, _no_log(spark), _no_pending(spark)), ("log", "waits"))]
    again_log, again_waits = offers.change_sets(decided, log, waits.withColumn("applied_at", F.lit(None).cast("timestamp")))
    kinds = [(log, "log_rows"), (waits, "pending_rows"), (again_log, "again"), (again_waits, "again")]
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind")) for df, kind in kinds])
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("log_rows", "pending_rows", "again")])
