"""The catalog's tables. ``seq`` is the order in which rows came in."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _table(columns: str) -> T.StructType:
    """From pairs of name and type; needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FILES = _table(
    "seq bigint, path string, size bigint, digest_full string, digest_head string, digest_tail string, digest_source string, mtime double, "
    "has_exif_date boolean, has_exif_gps boolean, width int, height int, scan_time timestamp, source string"
)
ARCHIVES = _table("seq bigint, path string, title string, digest string, entries_total bigint, entries_processed bigint, status string, completed_at timestamp")
ARCHIVE_ENTRIES = _table("seq bigint, archive_id bigint, entry_path string, status string, kept_path string, skip_reason string")
METADATA_LOG = _table("seq bigint, target_path string, source_desc string, field string, value string, merge_time timestamp")
RESOLUTIONS = _table("seq bigint, digest_full string, winner_path string, action string, confidence int, resolved_at timestamp, auto_resolved boolean, stale boolean")
METADATA_PENDING = _table(
    "seq bigint, file_id bigint, file_path string, file_digest string, field string, value string, reason string, state string, source_desc string, recorded_at timestamp, applied_at timestamp"
)
SIDECARS_UNMATCHED = _table(
    "seq bigint, archive_id bigint, sidecar_path string, archive_dir string, entry_name string, media_stem string, counter string, reason string, candidate_count bigint, "
    "payload string, recorded_at timestamp, rebound_at timestamp, rebound_path string, rebound_outcome string"
)
DEDUP_COLLAPSE = _table(
    "seq bigint, archive_id bigint, entry_path string, source_root string, survivor_path string, survivor_digest string, matched_on string, adopted string, declined string, collapsed_at timestamp"
)
FILE_CLASS = _table("seq bigint, file_id bigint, path string, verdict string, reason string, confidence string, evidence string, classifier string, classified_at timestamp")

#: What a column that is added to an old snapshot holds.
DEFAULTS = {"status": "pending", "entries_processed": 0, "confidence": 100, "stale": False}
