"""Catalog views over the driver's tables: each as a DataFrame and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions.times import capture_time

EXTENSIONS = (".jpg", ".JPG", ".png", ".heic", ".mp4", ".dng", ".txt", ".jpeg")
ZONES = ((0, "UTC", -90.0, 90.0, -180.0, 180.0, 9), (1, "America/Chicago", 25.0, 49.0, -105.0, -85.0, 1), (2, "Asia/Kathmandu", 26.0, 31.0, 80.0, 89.0, 1), (3, "Australia/Sydney", -38.0, -28.0, 140.0, 154.0, 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _case(values: tuple[str, ...], i: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


def doc_path() -> Column:
    return F.concat(F.lit("/run/media/u/"), "source", F.lit("/"), "lang", F.lit("/IMG_"), F.col("doc_id").cast("string"), _choice(EXTENSIONS, F.col("doc_id") % 8))


DOC_PATH = "'/run/media/u/' || source || '/' || lang || '/IMG_' || doc_id || " + _case(EXTENSIONS, "doc_id % 8")
DOC_MTIME = "CAST(1785600000 + (doc_id * 7919) % 500000 AS DOUBLE)"


def doc_mtime() -> Column:
    return (F.lit(1785600000) + (F.col("doc_id") * 7919) % 500000).cast("double")


def files(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        doc_path().alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.sha2("text", 256).alias("digest_full"),
        F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat(F.lit("src"), (F.col("doc_id") % 50).cast("string")), 256)).alias("digest_source"),
        doc_mtime().alias("mtime"),
        (F.col("quality") == 1).alias("has_exif_date"),
        (F.col("toxic") == 1).alias("has_exif_gps"),
        F.col("n_chars").alias("width"),
        (F.col("n_chars") % 3000).alias("height"),
        "source",
    )


FILES = f"""files AS (SELECT d.doc_id AS seq, {DOC_PATH.replace('doc_id', 'd.doc_id')} AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS digest_full,
  CASE WHEN d.doc_id % 5 = 0 THEN sha256('src' || (d.doc_id % 50)) END AS digest_source, {DOC_MTIME.replace('doc_id', 'd.doc_id')} AS mtime,
  quality = 1 AS has_exif_date, toxic = 1 AS has_exif_gps, n_chars AS width, n_chars % 3000 AS height, source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SCORES = {
    ".jpg": 40, ".png": 50, ".heic": 70, ".mp4": 75, ".dng": 90, ".jpeg": 40,
}
#: Scored members of groups of equal digest; needs files.
GROUPS = (
    """scored AS (SELECT *, CAST(least(trunc(size / 1048576.0 * 2), 100) + least(trunc(coalesce(width, 0) * coalesce(height, 0) / 1000000.0 * 10), 100)
    + CASE lower(regexp_extract(path, '(\\.[^.]+)$', 1)) """
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items())
    + """ ELSE 20 END + CASE WHEN has_exif_date THEN 25 ELSE 0 END + CASE WHEN has_exif_gps THEN 25 ELSE 0 END AS BIGINT) AS score FROM files),
  grp AS (SELECT *, row_number() OVER (PARTITION BY digest_full ORDER BY seq) AS place, row_number() OVER (PARTITION BY digest_full ORDER BY score DESC, seq) AS rank
    FROM (SELECT *, count(*) OVER (PARTITION BY digest_full) AS members FROM scored WHERE digest_full IS NOT NULL) WHERE members > 1)"""
)


def listing(spark: SparkSession, d: str) -> DataFrame:
    """What is on disk: some sizes, some mtimes and some contents changed, some files gone."""
    i = F.col("doc_id")
    return table(spark, d, "documents").filter(i % 13 != 7).select(
        doc_path().alias("path"),
        (F.octet_length("text") + F.when(i % 10 == 0, 1).otherwise(0)).cast("bigint").alias("size"),
        (doc_mtime() + F.when(i % 10 == 1, 5.0).otherwise(0.0)).alias("mtime"),
        F.when(i % 17 == 3, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("digest_full"),
    )


LISTING = f"""listing AS (SELECT {DOC_PATH} AS path, CAST(strlen(text) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size,
  {DOC_MTIME} + CASE WHEN doc_id % 10 = 1 THEN 5 ELSE 0 END AS mtime, CASE WHEN doc_id % 17 = 3 THEN sha256(text || '!') ELSE sha256(text) END AS digest_full
  FROM documents WHERE doc_id % 13 <> 7)"""


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest_full"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.expr("o_orderkey div 2").alias("doc_id"))
    return o.join(texts, "doc_id").select("seq", "digest_full", (F.col("seq") % 2 == 0).alias("auto_resolved"), F.when(F.col("seq") % 7 != 0, F.col("seq") % 5 < 4).alias("stale"))


RESOLUTIONS = """resolutions AS (SELECT o_orderkey AS seq, digest_full, o_orderkey % 2 = 0 AS auto_resolved, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 < 4 END AS stale
  FROM orders JOIN (SELECT doc_id, sha256(text) AS digest_full FROM documents) t ON t.doc_id = o_orderkey // 2)"""

# Names of media files and of sidecars that point at them, in every shape that names take.
_K = "lpad(CAST(p_partkey AS STRING), 6, '0')"
MEDIA_NAME = f"""CASE p_partkey % 7 WHEN 0 THEN concat('DSC_', {_K}, '.JPG') WHEN 1 THEN concat('DSC_', {_K}, '(1).JPG') WHEN 2 THEN concat('IMG_2021_holiday_', {_K}, '.jpeg')
  WHEN 3 THEN concat('dsc_', {_K}, '.jpg') WHEN 4 THEN concat('VID_long_name_', {_K}, '.MP4') WHEN 5 THEN concat('IMG_2021_holiday_', {_K}, 'x.mov') ELSE concat('note_', {_K}, '.txt') END"""
SIDECAR_NAME = f"""CASE p_partkey % 11 WHEN 0 THEN concat(m, '.supplemental-metadata.json') WHEN 1 THEN concat(m, '.supplemental-me.json')
  WHEN 2 THEN concat('DSC_', {_K}, '.JPG.supplemental-metadata(1).json') WHEN 3 THEN concat(m, '..json') WHEN 4 THEN concat(m, '.json') WHEN 5 THEN concat(substring(m, 1, 21), '.json')
  WHEN 6 THEN concat(upper(m), '.json') WHEN 7 THEN concat('missing_', {_K}, '.jpg.json') WHEN 8 THEN 'metadata.txt' WHEN 9 THEN concat(substring(m, 1, 16), '.json') ELSE concat(substring(m, 1, 23), '(1).json') END"""
_SQL_TEXT = lambda s: s.replace("AS STRING", "AS VARCHAR")
DIR = "concat('Takeout/', CASE WHEN p_partkey % 50 = 49 THEN 'empty' ELSE p_brand END)"


def media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("concat('Takeout/', p_brand) AS dir", f"{MEDIA_NAME} AS name", "p_partkey AS pos")


def sidecars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", f"{DIR} AS dir", f"{MEDIA_NAME} AS m").selectExpr("p_partkey AS seq", "dir", f"{SIDECAR_NAME} AS name")


MEDIA = f"media AS (SELECT concat('Takeout/', p_brand) AS dir, {_SQL_TEXT(MEDIA_NAME)} AS name, p_partkey AS pos FROM part)"
SIDECARS = f"sidecars AS (SELECT p_partkey AS seq, dir, {_SQL_TEXT(SIDECAR_NAME)} AS name FROM (SELECT p_partkey, {DIR} AS dir, {_SQL_TEXT(MEDIA_NAME)} AS m FROM part))"

_ENTRY_EXT = (".jpg", ".json", ".txt", ".MP4")
_SKIP = ("sidecar", "duplicate", "not_media", "album_metadata")


def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("turn") == 6, F.lit("metadata.json")).otherwise(F.concat(F.col("turn").cast("string"), _choice(_ENTRY_EXT, F.col("turn") % 4)))
    status = F.when(F.col("role") == "user", "kept").when(F.col("role") == "assistant", "skipped").when(F.col("turn") % 2 == 0, "error").otherwise("pending")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("archive_id"), "turn", F.concat(F.lit("Takeout/"), "role", F.lit("/"), name).alias("entry_path"), status.alias("status"), "text")
    return rows.select(
        (F.col("archive_id") * 100 + F.col("turn")).alias("seq"),
        "archive_id",
        "entry_path",
        "status",
        F.when(F.col("status") == "kept", F.concat(F.lit("/vault/"), (F.col("archive_id") % 40).cast("string"), F.lit("_"), F.col("turn").cast("string"))).alias("kept_path"),
        F.when(F.col("status") == "skipped", _choice(_SKIP, F.col("turn") % 4)).alias("skip_reason"),
        F.when((F.col("archive_id") + F.col("turn")) % 9 == 4, "corrupt").alias("error"),
        F.sha2("text", 256).alias("digest"),
    )


ENTRIES = f"""entries AS (SELECT conv_id * 100 + turn AS seq, conv_id AS archive_id, entry_path, status, CASE WHEN status = 'kept' THEN '/vault/' || (conv_id % 40) || '_' || turn END AS kept_path,
  CASE WHEN status = 'skipped' THEN {_case(_SKIP, 'turn % 4')} END AS skip_reason, CASE WHEN (conv_id + turn) % 9 = 4 THEN 'corrupt' END AS error, sha256(text) AS digest
  FROM (SELECT conv_id, turn, text, 'Takeout/' || role || '/' || CASE WHEN turn = 6 THEN 'metadata.json' ELSE turn || {_case(_ENTRY_EXT, 'turn % 4')} END AS entry_path,
    CASE WHEN role = 'user' THEN 'kept' WHEN role = 'assistant' THEN 'skipped' WHEN turn % 2 = 0 THEN 'error' ELSE 'pending' END AS status FROM conversations))"""


def vault(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows of kept entries; one in eleven is missing."""
    rows = table(spark, d, "conversations").filter("role = 'user' AND (conv_id + turn) % 11 <> 0")
    return rows.groupBy(F.concat(F.lit("/vault/"), (F.col("conv_id") % 40).cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("path")).agg(F.max(F.octet_length("text")).cast("bigint").alias("size"))


VAULT = """vault AS (SELECT '/vault/' || (conv_id % 40) || '_' || turn AS path, CAST(max(strlen(text)) AS BIGINT) AS size FROM conversations WHERE role = 'user' AND (conv_id + turn) % 11 <> 0 GROUP BY 1)"""


def offers(spark: SparkSession, d: str) -> DataFrame:
    """Dates with and without an offset of their own, and places; some offer nothing."""
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    offers_any, value = F.col("event_id") % 11 != 0, (F.lit(1600000000) + n * 3600).cast("bigint")
    own, nothing, zone = F.when(F.col("event_id") % 3 != 0, -18000), F.lit(None).cast("int"), F.lit(None).cast("string")
    field = F.when(F.col("event_type").isin("click", "view", "error"), "date").otherwise("gps")
    return table(spark, d, "events").select(
        F.concat(F.lit("/vault/"), F.col("user_id").cast("string")).alias("target"),
        field.alias("field"),
        F.when(offers_any, value).alias("value"),
        F.when(offers_any, n % 90 + 0.5).alias("lat"),
        F.when(offers_any, n % 180 + 0.25).alias("lon"),
        capture_time(value, own, zone, nothing).alias("capture"),
        F.col("event_id").alias("offer_seq"),
        F.concat(F.lit("takeout:"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("source_desc"),
    )


OFFERS = """offers AS (SELECT '/vault/' || user_id AS target, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'date' ELSE 'gps' END AS field,
  CASE WHEN event_id % 11 <> 0 THEN CAST(1600000000 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 3600 AS BIGINT) END AS value, event_id AS offer_seq, event_id % 3 = 0 AS assumed,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 90 + 0.5 AS lat, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 180 + 0.25 AS lon, 'takeout:' || event_type || '/' || event_id AS source_desc FROM events)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, d, "events").select("user_id").distinct().filter("user_id % 10 <> 9").select(
        F.concat(F.lit("/vault/"), u.cast("string")).alias("target"),
        _choice(("jpeg", "webp", "mp4", "heif"), u % 4).alias("container"),
        (u % 6 != 5).alias("exif_ok"),
        F.when(u % 5 != 0, u % 3 == 0).alias("has_date"),
        (u % 7 == 0).alias("has_gps"),
        (F.lit(1600000000) + (u % 4) * 3600).cast("double").alias("mtime"),
    )


TARGETS = f"""targets AS (SELECT '/vault/' || user_id AS target, {_case(('jpeg', 'webp', 'mp4', 'heif'), 'user_id % 4')} AS container, user_id % 6 <> 5 AS exif_ok,
  CASE WHEN user_id % 5 <> 0 THEN user_id % 3 = 0 END AS has_date, user_id % 7 = 0 AS has_gps, CAST(1600000000 + (user_id % 4) * 3600 AS DOUBLE) AS mtime
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 9))"""


def metadata_log(spark: SparkSession, d: str) -> DataFrame:
    """Log rows whose value holds the epoch at the top, below offered, zero, or is no JSON."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    doc = F.concat(F.lit('{"utc_epoch": '), k, F.lit("}"))
    value = (
        F.when(F.col("event_id") % 4 == 0, doc)
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"field": "date", "offered": '), doc, F.lit("}")))
        .when(F.col("event_id") % 4 == 2, F.lit("not json"))
        .otherwise(F.lit('{"utc_epoch": 0, "offered": null}'))
    )
    source = F.when(F.col("event_id") % 3 == 0, F.lit("file:/x")).otherwise(F.concat(F.lit("takeout:"), F.col("event_type")))
    path = F.concat(F.lit("/vault/"), (F.col("user_id") % 40).cast("string"), F.lit("_"), (F.col("event_id") % 7).cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), path.alias("target_path"), source.alias("source_desc"), F.when(F.col("event_id") % 5 == 0, "already_present").otherwise("date").alias("field"), value.alias("value"))


LOG = """log AS (SELECT event_id AS seq, '/vault/' || (user_id % 40) || '_' || (event_id % 7) AS target_path, CASE WHEN event_id % 3 = 0 THEN 'file:/x' ELSE 'takeout:' || event_type END AS source_desc,
  CASE WHEN event_id % 5 = 0 THEN 'already_present' ELSE 'date' END AS field,
  CASE event_id % 4 WHEN 0 THEN '{"utc_epoch": ' || k || '}' WHEN 1 THEN '{"field": "date", "offered": {"utc_epoch": ' || k || '}}' WHEN 2 THEN 'not json' ELSE '{"utc_epoch": 0, "offered": null}' END AS value,
  CASE WHEN event_id % 4 < 2 THEN CAST(k AS BIGINT) END AS epoch FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events))"""


def pending(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("seq"),
        F.concat(F.lit("/vault/"), F.col("o_custkey").cast("string")).alias("file_path"),
        F.when(F.col("o_orderstatus") == "F", "date").otherwise("gps").alias("field"),
        (F.col("o_custkey") % 7).cast("string").alias("value"),
        F.col("o_orderpriority").alias("reason"),
        F.when(F.startswith("o_orderpriority", F.lit("1")), "failed").otherwise("deferred").alias("state"),
        F.when(k % 3 == 0, F.lit("2026-08-04 00:00:00").cast("timestamp")).alias("applied_at"),
    )


PENDING = """pending AS (SELECT o_orderkey AS seq, '/vault/' || o_custkey AS file_path, CASE WHEN o_orderstatus = 'F' THEN 'date' ELSE 'gps' END AS field, CAST(o_custkey % 7 AS VARCHAR) AS value,
  o_orderpriority AS reason, CASE WHEN o_orderpriority LIKE '1%' THEN 'failed' ELSE 'deferred' END AS state, o_orderkey % 3 = 0 AS applied FROM orders)"""
