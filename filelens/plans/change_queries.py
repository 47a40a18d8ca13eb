"""Queries over changes of the catalog's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions.media import evidence, evidence_json, stored_evidence, verdict
from filelens.operators import capture, changes, ingest, match
from filelens.plans import catalog_queries as C
from filelens.plans import ingest_queries as I
from filelens.plans import views as V
from filelens.plans.registrar import Query, registrar
from filelens.storage import stored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)


def _text(prefix: str, c):
    return F.concat(F.lit(prefix), c.cast("string"))


@query(f"""WITH {V.ENTRIES}, cur AS (SELECT archive_id, entry_path, status, kept_path, skip_reason FROM entries WHERE archive_id % 3 <> 0),
  ch AS (SELECT archive_id, entry_path, CASE WHEN seq % 4 = 0 THEN 'skipped' ELSE 'kept' END AS status, CASE WHEN seq % 4 <> 0 THEN '/new/' || seq END AS kept_path, CASE WHEN seq % 4 = 0 THEN 'duplicate' END AS skip_reason, true AS hit FROM entries WHERE seq % 2 = 0)
  SELECT archive_id, entry_path, CASE WHEN hit THEN ch.status ELSE cur.status END AS status, CASE WHEN hit THEN ch.kept_path ELSE cur.kept_path END AS kept_path, CASE WHEN hit THEN ch.skip_reason ELSE cur.skip_reason END AS skip_reason FROM cur FULL JOIN ch USING (archive_id, entry_path)""")
def snk_04_log_entries(spark, d):
    e, seq = V.archive_entries(spark, d), F.col("seq")
    cur = e.filter("archive_id % 3 <> 0").select("archive_id", "entry_path", "status", "kept_path", "skip_reason")
    none = F.lit(None).cast("string")
    kept = e.filter("seq % 2 = 0").select("archive_id", "entry_path", F.lit("kept").alias("status"), _text("/new/", seq).alias("kept_path"), none.alias("skip_reason"), F.lit(1).alias("change_seq"))
    skipped = e.filter("seq % 4 = 0").select("archive_id", "entry_path", F.lit("skipped").alias("status"), none.alias("kept_path"), F.lit("duplicate").alias("skip_reason"), F.lit(2).alias("change_seq"))
    return changes.log_entries(cur, kept.unionByName(skipped))


@query("""WITH cur AS (SELECT c_custkey % 7 AS archive_id, '/e/' || c_custkey AS entry_path, CASE WHEN c_custkey % 5 > 0 THEN 'old' END AS source_root, 'A' AS adopted, 'D' AS declined, 1 AS collapsed_at FROM customer WHERE c_custkey % 10 < 8),
  ch AS (SELECT c_custkey % 7 AS archive_id, '/e/' || c_custkey AS entry_path, 'new' AS source_root, 'A2' AS adopted, NULL AS declined, 2 AS collapsed_at FROM customer WHERE c_custkey % 3 = 0)
  SELECT archive_id, entry_path, CASE WHEN cur.collapsed_at IS NULL THEN ch.source_root ELSE cur.source_root END AS source_root, CASE WHEN ch.collapsed_at IS NULL THEN cur.adopted ELSE ch.adopted END AS adopted, CASE WHEN ch.collapsed_at IS NULL THEN cur.declined ELSE ch.declined END AS declined,
  coalesce(ch.collapsed_at, cur.collapsed_at) AS collapsed_at FROM cur FULL JOIN ch USING (archive_id, entry_path)""")
def snk_14_store_collapses(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer")
    key = ((k % 7).alias("archive_id"), _text("/e/", k).alias("entry_path"))
    cur = c.filter("c_custkey % 10 < 8").select(*key, F.when(k % 5 > 0, "old").alias("source_root"), F.lit("A").alias("adopted"), F.lit("D").alias("declined"), F.lit(1).alias("collapsed_at"))
    new = c.filter("c_custkey % 3 = 0").select(*key, F.lit("new").alias("source_root"), F.lit("A2").alias("adopted"), F.lit(None).cast("string").alias("declined"), F.lit(2).alias("collapsed_at"), F.lit(1).alias("change_seq"))
    return changes.store_collapses(cur, new)


@query(f"WITH {V.FILES} SELECT seq, path, CASE WHEN seq % 4 = 0 THEN mtime + 100 ELSE mtime END AS mtime FROM files")
def snk_15_update_mtimes(spark, d):
    """Every fourth mtime changes; changes of paths that aren't there are left out."""
    files = V.files(spark, d).select("seq", "path", "mtime")
    known = files.filter("seq % 4 = 0").select("path", (F.col("mtime") + 100).alias("mtime"), F.lit(1).alias("change_seq"))
    unknown = files.filter("seq % 4 = 1").select(F.concat("path", F.lit(".gone")).alias("path"), "mtime", F.lit(1).alias("change_seq"))
    return changes.update_mtimes(files, known.unionByName(unknown))


@query("SELECT 'a' || c_custkey AS path, CASE WHEN c_custkey % 3 > 0 THEN 't' || c_custkey WHEN c_custkey % 2 = 1 THEN 'n' || c_custkey END AS title FROM customer")
def snk_16_set_titles(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer").select(k, _text("a", k).alias("path"))
    new = c.filter("c_custkey % 3 = 0").select("path", F.when(k % 2 == 0, "  ").otherwise(F.concat(F.lit(" n"), k.cast("string"), F.lit(" "))).alias("title"), F.lit(1).alias("change_seq"))
    return changes.set_titles(c.select("path", _text("t", k).alias("title")), new)


_SET = f"{I._REPAIR}, z2 AS (SELECT path, decision FROM plan)"


@query(f"WITH {I._REPAIR} SELECT path, old_mtime, CAST(epoch AS DOUBLE) AS new_mtime, reason AS source, detail FROM plan WHERE decision = 'set'")
def snk_20_mtime_audit(spark, d):
    return capture.mtime_changes(I._repair(spark, d))


@query(f"""WITH {V.FILES}, s AS (SELECT path, seq, size + 1 AS size, 'f' || seq AS digest_full, CASE WHEN seq % 4 = 0 THEN 'src' || seq END AS digest_source FROM files WHERE seq % 2 = 0 UNION ALL SELECT '/late/' || seq, NULL, size, 'f' || seq, 'src' || seq FROM files WHERE seq % 9 = 0)
  SELECT coalesce(f.path, s.path) AS path, coalesce(s.size, f.size) AS size, coalesce(s.digest_full, f.digest_full) AS digest_full, coalesce(s.digest_source, f.digest_source) AS digest_source, coalesce(CASE WHEN s.path LIKE '/late/%' THEN 'new' END, f.source) AS source FROM files f FULL JOIN s ON s.path = f.path""")
def dec_13_reindex(spark, d):
    """Half of the files were written to; some are new; the source digest is given for some alone."""
    files = V.files(spark, d)
    s, none = F.col("seq"), F.lit(None).cast("string")
    rest = (F.lit("h").alias("digest_head"), F.lit("t").alias("digest_tail"), F.lit(1.0).alias("mtime"), F.lit(False).alias("has_exif_date"), F.lit(False).alias("has_exif_gps"), F.lit(1).alias("change_seq"))
    old = files.filter("seq % 2 = 0").select("path", (F.col("size") + 1).alias("size"), _text("f", s).alias("digest_full"), F.when(s % 4 == 0, _text("src", s)).alias("digest_source"), none.alias("source"), *rest)
    new = files.filter("seq % 9 = 0").select(_text("/late/", s).alias("path"), "size", _text("f", s).alias("digest_full"), _text("src", s).alias("digest_source"), F.lit("new").alias("source"), *rest)
    catalog = files.withColumns({"digest_head": none, "digest_tail": none})
    return changes.reindex(catalog, old.unionByName(new)).select("path", "size", "digest_full", "digest_source", "source")


# Evidence and verdicts.
_EVIDENCE = ("name", "width", "height", "make", "model", "software", "exposure", "gps")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = C._signals(spark, d).withColumn("ev", evidence(*[F.col(c) for c in _EVIDENCE]))
    kind, error = F.when(F.col("doc_id") % 2 == 0, "jpeg").otherwise("png"), F.when(F.col("doc_id") % 9 == 5, "ValueError: no size")
    return rows.withColumn("evidence", evidence_json(F.col("ev"), kind, *[F.col(c) for c in ("width", "height", "make", "model", "software")], error))


_TESTED = f"""{C._SIG}, tst AS (SELECT *, CASE WHEN px IS NOT NULL THEN greatest(width, height) END AS max_dim, cam AS camera_tags, px IS NOT NULL AND (width, height) IN ((1242, 2688), (2556, 1179)) AS screen_dimensions,
  regexp_matches(stem, '^[0-9]{{15,20}}$') OR regexp_matches(lower(stem), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS generated_filename, app AS app_software, coalesce(px IS NOT NULL AND greatest(width, height) IN (1600, 2048), false) AS google_long_edge,
  coalesce(px < 500000, false) AS tiny, coalesce(px >= 500000, false) AS camera_sized, coalesce(px >= 2000000, false) AS original_sized, px IS NOT NULL AS has_pixels FROM sig)"""
_NINE = "camera_tags, screen_dimensions, generated_filename, app_software, google_long_edge, tiny, camera_sized, original_sized, has_pixels"


@query(f"WITH {_TESTED} SELECT doc_id, max_dim, {_NINE} FROM tst")
def cls_01_evidence_tests(spark, d):
    return _evidence(spark, d).select("doc_id", "ev.max_dim", "ev.tests.*")


def _json(pairs: dict[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in pairs.items()) + " || '}'"


def _quoted(c: str) -> str:
    return f"coalesce('\"' || nullif({c}, '') || '\"', 'null')"


_TEST_DOC = _json({t: t for t in sorted(_NINE.split(", "))})
_DOC = _json(
    {
        "aspect": "coalesce(CAST(CASE WHEN px IS NOT NULL THEN (width * 10000 // height + CASE WHEN 2 * (width * 10000 % height) + width * 10000 // height % 2 > height THEN 1 ELSE 0 END) / 10000.0 END AS VARCHAR), 'null')",
        "container": _quoted("CASE WHEN doc_id % 2 = 0 THEN 'jpeg' ELSE 'png' END"),
        "dims_error": _quoted("CASE WHEN doc_id % 9 = 5 THEN 'ValueError: no size' END"),
        "exposure": "exposure",
        "gps": "gps",
        "height": "height",
        "make": _quoted("make"),
        "max_dim": "coalesce(CAST(max_dim AS VARCHAR), 'null')",
        "model": "'null'",
        "px": "coalesce(CAST(px AS VARCHAR), 'null')",
        "software": _quoted("software"),
        "stem": _quoted("stem"),
        "tests": _TEST_DOC,
        "width": "width",
    }
)


@query(f"WITH {_TESTED} SELECT doc_id, {_DOC} AS evidence FROM tst")
def json_06_evidence(spark, d):
    return _evidence(spark, d).select("doc_id", "evidence")


def _by_size(ev):
    t = ev["tests"]
    return ((t["tiny"], "derivative", "small", "low"), (t["camera_sized"], "original", "large", "low"), (F.lit(True), "unknown", "unmeasured", "low"))


@query(f"WITH {_TESTED}, {C._RULES} SELECT cls.verdict AS usual, CASE WHEN tiny THEN 'small' WHEN camera_sized THEN 'large' ELSE 'unmeasured' END AS tried, count(*) AS n FROM cls JOIN tst USING (doc_id) GROUP BY ALL")
def cls_05_another_rule_set(spark, d):
    """Stored evidence judged again by the usual rules and by others."""
    ev = stored_evidence(F.col("evidence"))
    rows = _evidence(spark, d).select(verdict(ev)["verdict"].alias("usual"), verdict(ev, _by_size)["reason"].alias("tried"))
    return rows.groupBy("usual", "tried").agg(F.count("*").alias("n"))


@query(f"""WITH {V.FILES}, cur AS (SELECT path, 'v1' AS classifier, 'old' AS verdict, 'e0' AS evidence, seq + 1000000 AS file_id FROM files WHERE seq % 3 < 2), new AS (SELECT path, 'v1' AS classifier, 'n' || seq AS verdict, 'e1' AS evidence, CASE WHEN seq % 7 <> 0 THEN seq END AS file_id FROM files WHERE seq % 2 = 0
  UNION ALL SELECT path, 'v2', 'n' || seq, 'e1', CASE WHEN seq % 7 <> 0 THEN seq END FROM files)
  SELECT path, classifier, coalesce(new.verdict, cur.verdict) AS verdict, coalesce(new.evidence, cur.evidence) AS evidence, CASE WHEN cur.path IS NULL THEN new.file_id ELSE cur.file_id END AS file_id FROM cur FULL JOIN new USING (path, classifier)""")
def snk_13_store_verdicts(spark, d):
    """Verdicts of two classifiers over older ones; some paths aren't in the catalog any more."""
    f, s = V.files(spark, d), F.col("seq")
    none = F.lit(None).cast("string")
    cur = f.filter("seq % 3 < 2").select((s + 1000000).alias("file_id"), "path", F.lit("old").alias("verdict"), none.alias("reason"), none.alias("confidence"), F.lit("e0").alias("evidence"), F.lit("v1").alias("classifier"), none.alias("classified_at"))
    new = f.select("path", F.explode(F.when(s % 2 == 0, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v2")))).alias("classifier"), _text("n", s).alias("verdict"), none.alias("reason"), none.alias("confidence"), F.lit("e1").alias("evidence"), none.alias("classified_at"), F.lit(1).alias("change_seq"))
    return changes.store_verdicts(cur, new, f.filter("seq % 7 <> 0").select("path", "seq")).select("path", "classifier", "verdict", "evidence", "file_id")


# Sidecars: matching in archives, what stays unmatched, and binding later.
def _archived(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sidecars dealt to two archives, each of which has all media files."""
    path = F.concat_ws("/", "dir", "name").alias("entry_path")
    s = V.sidecars(spark, d).select("seq", (F.col("seq") % 2).alias("archive_id"), path)
    return s, V.media(spark, d).select(F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("archive_id"), path, "pos")


_ALL = f"{V.SIDECARS}, {V.MEDIA}, {I.PARSED}, {I.MATCHED}"


@query(f"WITH {_ALL} SELECT *, seq % 2 AS archive_id FROM matched")
def join_09_match_in_archives(spark, d):
    return match.match_in_archives(*_archived(spark, d))


@query(f"""WITH {_ALL} SELECT m.seq, m.seq % 2 AS archive_id, m.dir || '/' || m.name AS sidecar_path, m.dir AS archive_dir, m.name AS entry_name, p.media_name AS media_stem, p.counter, CASE WHEN m.seq % 6 = 5 THEN 'unparseable' ELSE m.reason END AS reason,
  CASE WHEN m.seq % 6 = 5 THEN 0 ELSE m.candidate_count END AS candidate_count, CASE WHEN m.seq % 6 <> 5 THEN '{{}}' END AS payload FROM matched m JOIN parsed p USING (seq) WHERE m.media_name IS NULL OR m.seq % 6 = 5""")
def snk_09_unmatched_rows(spark, d):
    s, media = _archived(spark, d)
    return match.unmatched_rows(match.match_in_archives(s, media), s.withColumn("payload", F.when(F.col("seq") % 6 != 5, "{}")))


@query("SELECT p_partkey AS seq FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 3 = 1")
def flt_08_still_unmatched(spark, d):
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(k.alias("seq"), (k % 3).alias("archive_id"), F.when(k % 10 == 0, F.lit("2026-08-04 00:00:00").cast("timestamp")).alias("rebound_at"))
    return match.still_unmatched(rows, 1).select("seq")


@query(f"WITH {_ALL}, cand2 AS (SELECT seq, dir, media_name AS candidate FROM parsed WHERE media_name IS NOT NULL UNION ALL SELECT seq, dir, other FROM parsed WHERE other IS NOT NULL) SELECT seq % 2 AS archive_id, dir, candidate, min(seq) AS ordinal FROM cand2 GROUP BY ALL")
def win_09_first_candidates(spark, d):
    from filelens.functions.names import parse_sidecar

    s = V.sidecars(spark, d).select((F.col("seq") % 2).alias("archive_id"), F.col("seq").alias("ordinal"), "dir", parse_sidecar(F.col("name"))["candidates"].alias("candidates"))
    return ingest.first_candidates(s)


_STATES = ("merged", "merged_mtime_only", "deferred", "failed", "already_present")
_HAS = {"merged": "state = 'merged'", "merged_mtime_only": "state = 'merged_mtime_only'", "deferred": "state <> 'already_present'", "failed": "false", "already_present": "state = 'already_present'"}
_OUTCOME = _json({k: f"CASE WHEN {_HAS[k]} THEN '[\"date\"]' ELSE '[]' END" for k in _STATES} | {"media_name": _quoted("media_name"), "relocated": "relocated"})
# Every fifth target was given a date before, by an offer of another source that has the number of its first sidecar here.
_APPLIED = f"""{I._REBIND}, bound AS (SELECT seq, target, media_name, relocated, 1000 + (seq % 10000000) % 3 AS value, CAST(regexp_extract(target, '([0-9]+)$', 1) AS BIGINT) AS pos FROM plan WHERE decision = 'bound'),
  st AS (SELECT *, CASE WHEN pos % 2 = 0 THEN CASE WHEN pos % 3 = 0 OR pos % 5 = 1 OR row_number() OVER (PARTITION BY target ORDER BY seq) > 1 THEN 'already_present' ELSE 'merged' END WHEN value = coalesce(lag(value) OVER (PARTITION BY target ORDER BY seq), CASE WHEN pos % 5 = 1 THEN 1001 ELSE 1000 END) THEN 'already_present' ELSE 'merged_mtime_only' END AS state FROM bound),
  doc AS (SELECT seq, target, {_OUTCOME} AS outcome FROM st)"""


def _applied(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    plan = stored(I._rebind(spark, d), "plan")  # read four times below
    pos = F.regexp_extract("target", "([0-9]+)$", 1).cast("bigint")
    bound = plan.filter("target IS NOT NULL").groupBy("target").agg((F.min(F.when(F.col("decision") == "bound", F.col("seq"))) * 2).alias("seq"))
    jpeg = pos % 2 == 0
    targets = bound.select("target", F.when(jpeg, "jpeg").otherwise("mp4").alias("container"), F.lit(True).alias("exif_ok"), (pos % 3 == 0).alias("has_date"), F.lit(False).alias("has_gps"), F.lit(1000.0).alias("mtime"))
    earlier = bound.filter(pos % 5 == 1).select("seq", F.col("target").alias("target_path"), F.lit("takeout:earlier").alias("source_desc"), F.when(jpeg, "date").otherwise("merged_mtime_only").alias("field"), F.lit('{"utc_epoch":1001}').alias("value"))
    none = F.lit(None).cast("string")
    side = I._unmatched(spark, d).withColumns({"sidecar_path": F.concat_ws("/", "archive_dir", "entry_name"), "rebound_at": F.lit(None).cast("timestamp"), "rebound_path": none, "rebound_outcome": none})
    return match.apply_rebind(plan, side, targets, earlier, I._no_pending(spark), F.lit("2026-08-04 00:00:00").cast("timestamp"))


@query(f"WITH {_APPLIED} SELECT p.seq, doc.target AS rebound_path, doc.outcome AS rebound_outcome FROM plan p LEFT JOIN doc ON doc.seq = CASE p.decision WHEN 'bound' THEN p.seq WHEN 'duplicate' THEN p.first_seq END")
def dec_08_apply_rebind(spark, d):
    """The plan applied: what each bound sidecar and its duplicates are marked with."""
    return _applied(spark, d)[0].select("seq", "rebound_path", "rebound_outcome")


_ISO = "strftime(make_timestamp(value * 1000000), '%Y-%m-%dT%H:%M:%S')"


@query(f"""WITH {_APPLIED}, l AS (SELECT st.*, un.dir || '/' || un.name AS path, CASE WHEN state = 'already_present' THEN '{{"field":"date","offered":{{"utc_epoch":' || value || '}},"satisfied_by":"' || CASE WHEN pos % 2 = 0 THEN 'exif_date' ELSE 'mtime' END || '"}}'
    ELSE '{{"datetime_local":"' || {_ISO} || '","offset":"+00:00","utc":"' || {_ISO} || '+00:00","utc_epoch":' || value || ',"tz":null,"tz_source":"utc_fallback"}}' END AS doc FROM st JOIN twice un ON un.seq = st.seq)
  SELECT seq * 2 AS seq, target AS target_path, 'takeout:' || path AS source_desc, CASE WHEN state = 'merged' THEN 'date' ELSE state END AS field, doc AS value FROM l QUALIFY row_number() OVER (PARTITION BY target, CASE WHEN state = 'already_present' THEN doc ELSE CAST(seq AS VARCHAR) END ORDER BY seq) = 1""")
def snk_05_rebind_log(spark, d):
    """A row for every merge, over a log that has rows of the same numbers from another source; refusals once."""
    return _applied(spark, d)[1].select("seq", "target_path", "source_desc", "field", "value")
