"""JSON documents: sidecar payloads, log values, offers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filelens.functions.expressions import let
from filelens.functions.media import real_place


def _number(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def parse_object(text: Column) -> Column:
    """A JSON object as VARIANT; null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))


def sidecar_payload(text: Column) -> Column:
    """Struct utc_epoch, lat, lon of a sidecar document; null where it isn't an object.

    The document is parsed once, and each of its numbers is read once.
    """
    kinds = {"taken": ("$.photoTakenTime.timestamp", "bigint"), "made": ("$.creationTime.timestamp", "bigint")}
    kinds |= {f"{place}{i}": (f"$.{k}.{place}itude", "double") for i, k in enumerate(("geoData", "geoDataExif")) for place in ("lat", "long")}

    def payload(n: Column) -> Column:
        epoch = F.coalesce(F.when(n["taken"] > 0, n["taken"]), F.when(n["made"] > 0, n["made"]))
        real = [(real_place(n[f"lat{i}"], n[f"long{i}"]), n[f"lat{i}"], n[f"long{i}"]) for i in range(2)]
        lat, lon = F.coalesce(*[F.when(is_real, a) for is_real, a, _ in real]), F.coalesce(*[F.when(is_real, b) for is_real, _, b in real])
        return F.struct(epoch.alias("utc_epoch"), lat.alias("lat"), lon.alias("lon"))

    def numbers(v: Column) -> Column:
        return F.when(v.isNotNull(), let(F.struct(*[_number(v, path, kind).alias(k) for k, (path, kind) in kinds.items()]), payload))

    return let(parse_object(text), numbers)


def logged_epoch(text: Column) -> Column:
    """utc_epoch of a log value, at the top or below ``offered``; 0 counts as missing."""
    number = lambda v, path: F.nullif(_number(v, path, "bigint"), F.lit(0).cast("bigint"))
    return let(parse_object(text), lambda v: F.coalesce(number(v, "$.utc_epoch"), number(v, "$.offered.utc_epoch")))


def _iso(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss")


def date_payload(epoch: Column, capture: Column) -> Column:
    """What a later pass needs to apply a date again: the wall clock, the instant, and where its offset came from.

    ``capture`` is a struct of local_epoch, offset, tz_name and tz_source (``times.capture_time``).
    """
    utc = F.concat(_iso(epoch), F.lit("+00:00"))
    fields = {"datetime_local": _iso(capture["local_epoch"]), "offset": capture["offset"], "utc": utc, "utc_epoch": epoch, "tz": capture["tz_name"], "tz_source": capture["tz_source"]}
    return json_document(**fields)


def gps_payload(lat: Column, lon: Column) -> Column:
    nothing = F.lit(None).cast("double")
    return json_document(lat=lat, lon=lon, altitude=nothing, altitude_ref=nothing)


def refusal(field: Column, epoch: Column, lat: Column, lon: Column, satisfied_by: Column) -> Column:
    """What was offered, as it was offered, and what the file had instead; keys in order, as the text is its identity."""
    return F.when(field == "date", sorted_json(field=field, offered=F.struct(epoch.alias("utc_epoch")), satisfied_by=satisfied_by)).otherwise(
        sorted_json(field=field, offered=F.struct(lat.alias("lat"), lon.alias("lon")), satisfied_by=satisfied_by)
    )


def json_document(**fields: Column) -> Column:
    """A document with its keys as given and nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def sorted_json(**fields: Column) -> Column:
    """A document with its keys in order and nulls kept, fit to be compared as text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def short_digest(digest: Column, n: int = 12) -> Column:
    """The first digits, for people."""
    return F.substring(digest, 1, n)


def short_error(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def digests(content: Column, legacy_tail: bool = False) -> Column:
    """Struct full, head, tail. A file up to 64 KiB is its own head, one up to 4 KiB its own tail.

    ``legacy_tail``: the older rule, by which a file up to 64 KiB is its own tail too.
    """
    full = F.sha2(content, 256)
    return F.struct(
        full.alias("full"),
        F.when(F.length(content) <= 65536, full).otherwise(F.sha2(F.substring(content, 1, 65536), 256)).alias("head"),
        F.when(F.length(content) <= (65536 if legacy_tail else 4096), full).otherwise(F.sha2(F.substring(content, -4096, 4096), 256)).alias("tail"),
    )


def archive_fingerprint(content: Column) -> Column:
    """Of the first MiB and the size in decimal."""
    return F.sha2(F.concat(F.substring(content, 1, 1048576), F.encode(F.length(content).cast("string"), "UTF-8")), 256)
