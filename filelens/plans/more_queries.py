"""Queries over further operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions.media import EXIF_READABLE, EXIF_WRITABLE, container_of
from filelens.functions.paths import basename, suffix
from filelens.operators import capture, changes, folder, offers
from filelens.plans import views as V
from filelens.plans.registrar import Query, registrar

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)


_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "52494646000000005745425000", "49492A00", "000000186674797068656963", "0000001466747970717420200000", "0000000866726565000000146674797069736F6D", "00000008776964650000006400006D646174", "6A756E6B")
_KINDS = ("jpeg", "png", "gif", "webp", "tiff", "heif", "mov", "mp4", "unknown", "unknown")


@query(f"WITH c AS (SELECT lower(regexp_extract({V.DOC_PATH}, '(\\.[^.]+)$', 1)) AS ext, {V._case(_KINDS, 'doc_id % 10')} AS container FROM documents) SELECT ext, container, container IN ('jpeg', 'webp') AS writable, container IN ('jpeg', 'webp', 'heif') AS readable, count(*) AS n FROM c GROUP BY ALL")
def agg_21_extension_vs_container(spark, d):
    head = F.unhex(V._choice(_HEADS, F.col("doc_id") % 10))
    rows = V.table(spark, d, "documents").select(F.lower(suffix(basename(V.doc_path()))).alias("ext"), container_of(head).alias("container"))
    return rows.groupBy("ext", "container", F.col("container").isin(*EXIF_WRITABLE).alias("writable"), F.col("container").isin(*EXIF_READABLE).alias("readable")).agg(F.count("*").alias("n"))


# By customer: 0 a whole date and a place that was there, 1 a date that only the mtime took, 2 a place that failed, 3 an assumed date, 4 nothing.
_TOOK = """CASE c_custkey % 5 WHEN 0 THEN '{"what":"date","from":"duplicate_exif","detail":""},' WHEN 1 THEN '{"what":"date","from":"duplicate_exif","detail":"written as mtime; container cannot hold EXIF"},' WHEN 3 THEN '{"what":"date","from":"duplicate_exif","detail":""},' ELSE '' END"""
_LEFT = """CASE c_custkey % 5 WHEN 0 THEN '{"what":"gps","reason":"survivor_already_has_it","detail":""}' WHEN 1 THEN '{"what":"date","reason":"deferred_container_cannot_hold_it","detail":""}' WHEN 2 THEN '{"what":"gps","reason":"write_failed","detail":""}' WHEN 3 THEN '{"what":"date","reason":"deferred_container_cannot_hold_it","detail":""}' END"""


@query(
    f"""SELECT c_custkey AS id, '/v/' || c_custkey AS survivor_path, CASE WHEN c_custkey % 2 = 0 THEN 'digest_full' ELSE 'digest_source' END AS matched_on,
  '[' || {_TOOK} || CASE WHEN c_custkey % 7 = 0 THEN '{{"what":"mtime","from":"source_file","detail":"2026-08-03 (ingest) -> 2020-09-13 (source)"}},' ELSE '' END || '{{"what":"provenance","from":"source_root","detail":"also present at /src/' || c_custkey || '.jpg"}}]' AS adopted,
  '[' || concat_ws(',', {_LEFT}, CASE WHEN c_custkey % 7 = 1 THEN '{{"what":"mtime","reason":"stat_failed","detail":"no such file"}}' END) || ']' AS declined FROM customer"""
)
def dec_05_collapse_records(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer")
    name = k.cast("string")
    pairs = c.select(k.alias("id"), F.concat(F.lit("/v/"), name).alias("survivor_path"), F.when(k % 2 == 0, "digest_full").otherwise("digest_source").alias("matched_on"), F.lit("/src").alias("source_root"), F.concat(name, F.lit(".jpg")).alias("rel"))
    offer = lambda of, field, state, reason=None: c.filter(k % 5 == of).select(k.alias("id"), F.lit(field).alias("field"), F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))
    offered = offer(0, "date", "merged").unionByName(offer(0, "gps", "already_present")).unionByName(offer(1, "date", "merged_mtime_only", "unsupported_mp4"))
    offered = offered.unionByName(offer(2, "gps", "failed", "failed_unparseable")).unionByName(offer(3, "date", "merged", "tz_unknown_assumed_utc"))
    stats = c.filter(k % 7 < 2).select(k.alias("id"), F.when(k % 7 == 0, 1600000000).cast("bigint").alias("src_mtime"), F.lit(1785800000).cast("bigint").alias("dst_mtime"), F.lit(None).cast("timestamp_ntz").alias("src_clock"), F.lit(None).cast("timestamp_ntz").alias("dst_clock"), F.lit("no such file").alias("error"))
    return folder.collapse_records(pairs, offered, capture.mtime_adoption(stats, now=1900000000))


@query("WITH r AS (SELECT c_custkey, c_custkey % 30 AS t FROM customer), o AS (SELECT '/t/' || t AS target, 'date' AS field, c_custkey + 5 AS value, 1 AS turn, '/s/' || c_custkey AS source FROM r WHERE c_custkey % 3 = 0 UNION ALL SELECT '/t/' || t, 'date', c_custkey + 9, 2, '/s/' || c_custkey FROM r WHERE c_custkey % 5 = 0) SELECT target, field, value, row_number() OVER (PARTITION BY target, field ORDER BY turn, source) AS offer_seq, CASE turn WHEN 1 THEN 'takeout:' ELSE 'file:' END || source AS source_desc, CASE turn WHEN 1 THEN 'utc_fallback' ELSE 'source_file' END AS tz_source, CASE turn WHEN 1 THEN '+00:00' ELSE '+02:00' END AS zone_offset FROM o")
def dec_03_donations(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer").withColumn("source", F.concat(F.lit("/s/"), k.cast("string")))
    pairs = c.select("source", F.concat(F.lit("/t/"), (k % 30).cast("string")).alias("target"))
    value = lambda rows, plus: rows.select("source", F.lit("date").alias("field"), (k + plus).alias("value"))
    made = offers.donations(pairs, value(c.filter(k % 3 == 0), 5), value(c.filter(k % 5 == 0), 9).withColumn("offset_seconds", F.lit(7200)))
    return made.select("target", "field", "value", "offer_seq", "source_desc", "capture.tz_source", F.col("capture.offset").alias("zone_offset"))


@query("SELECT 'a' || s_suppkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 99 WHEN s_suppkey % 3 = 0 THEN 7 END AS completed_at FROM supplier")
def snk_03_archive_status(spark, d):
    k = F.col("s_suppkey")
    s = V.table(spark, d, "supplier").withColumn("path", F.concat(F.lit("a"), k.cast("string")))
    cur = s.select("path", F.lit("pending").alias("status"), F.when(k % 3 == 0, 7).alias("completed_at"))
    new = s.filter(k % 4 < 2).select("path", F.when(k % 4 == 0, "complete").otherwise("failed").alias("status"), F.lit(1).alias("change_seq"))
    return changes.archive_status(cur, new, F.lit(99))


@query("SELECT p_partkey AS seq, CASE WHEN p_partkey % 100 IN (3, 7) THEN '/v/' || (p_partkey - p_partkey % 100) END AS rebound_path, CASE WHEN p_partkey % 100 IN (3, 7) THEN '{}' END AS rebound_outcome, CASE WHEN p_partkey % 100 IN (3, 7) THEN 'now' END AS rebound_at FROM part")
def snk_10_mark_rebound(spark, d):
    k = F.col("p_partkey")
    p = V.table(spark, d, "part")
    sidecars = p.select(k.alias("seq"), *[F.lit(None).cast("string").alias(c) for c in ("rebound_path", "rebound_outcome", "rebound_at")])
    binds = p.filter(k % 100 == 3).select(k.alias("seq"), F.array(k + 4).alias("duplicate_seqs"), F.concat(F.lit("/v/"), (k - 3).cast("string")).alias("target"), F.lit("{}").alias("outcome"), F.lit("now").alias("rebound_at"))
    return changes.mark_rebound(sidecars, binds)
