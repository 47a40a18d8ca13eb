"""Sidecar names: which media file a JSON name points at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filelens.functions.expressions import let
from filelens.functions.paths import EXTENSION, PICTURE_EXTENSIONS

SUFFIX_WORD = "supplemental-metadata"  # fixed value: may be cut short anywhere
MIN_PREFIX = 8  # characters a stem needs before a shared prefix means anything


def parse_sidecar(name: Column) -> Column:
    """Struct media_name, counter, truncated, stem_complete, body, candidates, reason.

    ``body`` is the media name without the counter. A name that can't be parsed
    has the reason ``unparseable`` and no media_name.
    """
    none = F.lit(None).cast("string")

    def read(whole: Column) -> Column:
        counter = F.nullif(F.regexp_extract(whole, r"(\(\d+\))$", 1), F.lit(""))
        return let(counter, lambda c: let(F.substring(whole, F.lit(1), F.length(whole) - F.coalesce(F.length(c), F.lit(0))), lambda plain: worded(plain, c)))

    def worded(plain: Column, counter: Column) -> Column:
        def cut(tail: Column) -> Column:
            word = F.contains(plain, F.lit(".")) & F.startswith(F.lit(SUFFIX_WORD), tail)
            body = F.when(word, F.substring(plain, F.lit(1), F.length(plain) - F.length(tail) - 1)).otherwise(plain)
            return let(body, lambda b: let(F.regexp_extract(b, EXTENSION, 1), lambda ext: named(b, ext, counter, word & (tail != SUFFIX_WORD))))

        return let(F.substring_index(plain, ".", -1), cut)

    def named(body: Column, ext: Column, counter: Column, truncated: Column) -> Column:
        sound = F.coalesce(body != "", F.lit(False))
        base = F.substring(body, F.lit(1), F.length(body) - F.length(ext))
        media = F.when(counter.isNull(), body).otherwise(F.concat(base, counter, ext))
        other = F.when(counter.isNotNull(), F.concat(body, counter))
        return F.struct(
            F.when(sound, media).alias("media_name"),
            F.when(sound, counter).alias("counter"),
            F.coalesce(sound & truncated, F.lit(False)).alias("truncated"),
            F.coalesce(sound & F.lower(ext).isin(*PICTURE_EXTENSIONS), F.lit(False)).alias("stem_complete"),
            F.when(sound, body).alias("body"),
            F.when(sound, F.array_distinct(F.array_compact(F.array(media, other)))).otherwise(F.array().cast("array<string>")).alias("candidates"),
            F.when(~sound, F.lit("unparseable")).alias("reason"),
        )

    whole = F.when(F.endswith(F.lower(name), F.lit(".json")), F.substring(name, F.lit(1), F.length(name) - 5)).otherwise(none)
    return let(whole, read)
