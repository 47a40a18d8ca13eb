"""Paths and file names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, as the catalog's readers know them.
MEDIA_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".heic", ".heif", ".webp", ".raw", ".cr2", ".nef", ".arw", ".dng",
    ".mp4", ".mov", ".avi", ".mkv", ".wmv", ".m4v", ".mpg", ".mpeg", ".3gp", ".mp3", ".wav", ".flac", ".aac", ".m4a", ".ogg", ".wma", ".aiff",
)
PICTURE_EXTENSIONS = MEDIA_EXTENSIONS[:24]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """What precedes the last slash; empty for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def suffix(name: Column) -> Column:
    """The last extension with its dot; none for a leading or a trailing dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


#: The last extension of a name, if its dot isn't the first character.
EXTENSION = r"^.+?(\.[^.]*)$"


def split_extension(name: Column) -> tuple[Column, Column]:
    """Cut at the last dot unless it is the first character; a trailing dot is an extension."""
    ext = F.regexp_extract(name, EXTENSION, 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def extension_in(name: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(suffix(name)).isin(*extensions)


def is_media(path: Column) -> Column:
    return extension_in(basename(path), MEDIA_EXTENSIONS)


def is_album_metadata(name: Column) -> Column:
    return F.lower(name) == "metadata.json"


def is_sidecar(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".json")) & ~is_album_metadata(name)


#: Names that messengers and phones make, collision counters, mount points.
NUMBER, UUID, COUNTERS = r"^\d{15,20}$", "(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"(\(\d+\))+$"


def is_generated_name(stem_: Column) -> Column:
    """A messenger's number or a UUID."""
    return stem_.rlike(NUMBER) | stem_.rlike(UUID)


def without_counters(stem_: Column) -> Column:
    return F.regexp_replace(stem_, COUNTERS, "")


#: Fixed value: where removable volumes are mounted, up to and with the volume's own name.
VOLUME_PATTERN = r"^((?:/run/media/[^/]+|/media/[^/]+|/mnt|/Volumes)/[^/]+)"


def volume_root(path: Column) -> Column:
    """The removable volume a path lies on; null for other paths."""
    return F.nullif(F.regexp_extract(path, VOLUME_PATTERN, 1), F.lit(""))


def join_path(folder: Column, name: Column) -> Column:
    return F.when((folder == "") | folder.isNull(), name).otherwise(F.concat_ws("/", folder, name))
