"""Wall clocks, offsets and instants. Epochs are seconds; wall clocks are TIMESTAMP_NTZ."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from filelens.functions.expressions import let

# What a legal offset is, and when an ingest run stamped files.
MAX_OFFSET, QUANTUM, TOLERANCE = 14 * 3600, 900, 60
INGEST_WINDOW = (1785715200, 1785974400)
EARLIEST_MTIME = 631152000
SIBLING_WINDOW = 12 * 3600
#: Zones by area and place, and UTC: names that the JVM knows too.
ZONE_NAMES = tuple(sorted(z for z in available_timezones() if z == "UTC" or z.split("/")[0] in {"Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific"}))
CAMERA_FORMAT = "yyyy:MM:dd HH:mm:ss"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00 ]+|[\x00 ]+$", "")


def camera_clock(text: Column) -> Column:
    """A camera's wall clock text; null where it is none."""
    return F.try_to_timestamp(_stripped(text), F.lit(CAMERA_FORMAT)).cast("timestamp_ntz")


def first_clock(*texts: Column) -> Column:
    """The first of several tags that parses."""
    return F.coalesce(*[camera_clock(t) for t in texts])


def clock_epoch(clock: Column) -> Column:
    """A wall clock read as if it were UTC."""
    return F.unix_timestamp(clock.cast("timestamp"))


def offset_seconds(text: Column, strict: bool = True) -> Column:
    """Seconds of a text like -06:00; null where malformed. strict: minutes stay below 60, no NULs or spaces are cut."""
    t = text if strict else _stripped(text)
    minutes = "[0-5][0-9]" if strict else "[0-9]{2}"
    hours, rest = F.regexp_extract(t, r"^[+-]([0-9]{2}):", 1), F.regexp_extract(t, ":([0-9]{2})$", 1)
    value = F.try_add(hours.try_cast("int") * 3600, rest.try_cast("int") * 60)
    return F.when(t.rlike(f"^[+-][0-9]{{2}}:{minutes}$"), F.when(F.startswith(t, F.lit("-")), -value).otherwise(value))


def offset_text(seconds: Column) -> Column:
    """Signed hours and whole minutes."""
    m = F.floor(F.abs(seconds) / 60)
    sign = F.when(seconds < 0, "-").otherwise("+")
    return F.when(seconds.isNotNull(), F.concat(sign, F.lpad((F.floor(m / 60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0")))


def zone_offset(epoch: Column, zone: Column) -> Column:
    """Seconds that a zone is ahead of UTC at an instant; null for a name that is no zone."""
    at, known = F.timestamp_seconds(epoch), zone.isin(*ZONE_NAMES)
    return F.when(known, F.unix_timestamp(F.from_utc_timestamp(at, F.when(known, zone))) - epoch)


def is_legal_offset(delta: Column) -> Column:
    """Within 14 hours and a minute of a whole quarter of an hour."""
    off = F.abs(delta - F.bround(delta / QUANTUM) * QUANTUM)
    return (F.abs(delta) <= MAX_OFFSET) & (off <= TOLERANCE)


def resolve_instant(readable: Column, clock: Column, offset: Column, claimed: Column) -> Column:
    """Struct epoch, outcome, detail: an instant from a wall clock, its offset, and a claimed epoch."""

    def at(naive: Column) -> Column:
        delta = claimed - naive
        return let(
            _instant_outcome(readable, clock, offset, claimed, delta),
            lambda outcome: F.struct(
                F.when(outcome == "exif_offset", naive - offset).when(outcome == "google_corroborated", claimed).cast("long").alias("epoch"),
                outcome.alias("outcome"),
                _instant_detail(outcome, clock, offset, claimed, delta).alias("detail"),
            ),
        )

    return let(clock_epoch(clock), at)


def _instant_outcome(readable: Column, clock: Column, offset: Column, claimed: Column, delta: Column) -> Column:
    return (
        F.when(~readable, "no_readable_exif")
        .when(clock.isNull(), "no_datetimeoriginal")
        .when(offset.isNotNull(), "exif_offset")
        .when(claimed.isNull(), "no_offset_and_no_google_value")
        .when(is_legal_offset(delta), "google_corroborated")
        .when(F.abs(delta) <= MAX_OFFSET, "google_offset_not_quantised")
        .otherwise("google_contradicts_exif")
    )


def _instant_detail(outcome: Column, clock: Column, offset: Column, claimed: Column, delta: Column) -> Column:
    """What the witnesses said, for people; empty where there was no clock."""
    read = F.date_format(clock.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    both = F.concat(F.lit("exif "), read, F.lit(" vs google "), F.date_format(F.timestamp_seconds(claimed), "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00 — "), gap_text(delta))
    return (
        F.when(outcome == "exif_offset", F.concat(read, F.lit(" offset "), span_text(offset)))
        .when(outcome == "no_offset_and_no_google_value", read)
        .when(outcome == "google_corroborated", F.concat(read, F.lit(" + offset "), gap_text(delta)))
        .when(outcome.isin("google_offset_not_quantised", "google_contradicts_exif"), both)
        .otherwise("")
    )


def span_text(seconds: Column) -> Column:
    """Hours, minutes and seconds; a negative span as days back and what lies ahead of them."""
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "), clock))


def gap_text(seconds: Column) -> Column:
    """How far apart two readings of one moment are: signed hours where that is an offset that exists, with a
    third decimal and the reason where it is none, and whole days beyond any offset."""
    hours = seconds / 3600.0
    return (
        F.when(is_legal_offset(seconds), F.format_string("%+.2fh", hours))
        .when(F.abs(seconds) <= MAX_OFFSET, F.format_string("gap %+.3fh is not a whole 15-minute offset", hours))
        .otherwise(F.concat(F.bround(F.abs(seconds) / 86400.0).cast("long").cast("string"), F.lit("d apart")))
    )


def matches_own_clock(mtime: Column, clock: Column) -> Column:
    """Whether mtime sits a legal offset from the file's own wall clock; null without one."""
    return is_legal_offset(mtime - clock_epoch(clock))


def capture_time(epoch: Column, own: Column, zone: Column, sibling: Column) -> Column:
    """Struct local_epoch, offset, tz_name, tz_source: the first of own offset, zone at the place, siblings, UTC."""
    at_place = zone_offset(epoch, zone)
    seconds = F.coalesce(own, at_place, sibling, F.lit(0))
    source = F.when(own.isNotNull(), "exif").when(at_place.isNotNull(), "gps").when(sibling.isNotNull(), "sibling").otherwise("utc_fallback")
    return F.struct(
        (epoch + seconds).cast("long").alias("local_epoch"),
        offset_text(seconds).alias("offset"),
        F.when(source == "gps", zone).alias("tz_name"),
        source.alias("tz_source"),
    )
