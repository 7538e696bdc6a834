"""Names, tags and places as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def last_level(found: Column, levels: Sequence[str], default: str | None = None) -> Column:
    """The last tag that is a level; the default where there is none."""
    own = F.filter(found, lambda t: t.isin(*levels))
    last = F.when(F.size(own) > 0, F.element_at(own, -1))
    return F.coalesce(last, F.lit(default)) if default is not None else last


def folded(level: Column, low: Sequence[str] = ("sparser", "sparse"), into: str = "monolayer") -> Column:
    """The four-level scale: the lowest levels count as the next one."""
    own = F.lower(F.trim(level))
    return F.when(own.isin(*low), into).otherwise(own)


def slide_by_pattern(name: Column, pattern: str) -> Column:
    """First group of the pattern, the whole name where it does not match."""
    got = F.regexp_extract(name, pattern, 1)
    return F.when(got == "", name).otherwise(got)


def slide_by_prefix(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def clean(text: Column) -> Column:
    """Non-breaking spaces become spaces, the ends are trimmed; blank is null."""
    return F.nullif(F.trim(F.replace(text, F.lit("\u00a0"), F.lit(" "))), F.lit(""))


def raster(fov: Column, rows: Column, columns: Column, stride: int = 18) -> Column:
    """Struct (row, col) of a field number from 1: by the slide's own columns if that lies inside, else by the stride, else null."""
    z = fov - 1

    def at(n: Column) -> Column:
        r, c = F.floor(z / n).cast("int"), (z % n).cast("int")
        return F.when((z >= 0) & (r < rows) & (c < columns), F.struct(r.alias("row"), c.alias("col")))

    return F.coalesce(at(columns), at(F.lit(stride)))


def tile_name(place: Column) -> Column:
    return F.format_string("IMG%03dx%03d.bmp", place["row"], place["col"])


def channel_blob(box: Column, slide: Column, fov: Column, channel: str) -> Column:
    return F.format_string(f"%s/%s/{channel}-%03d-%s.png", box, slide, fov, slide)


def blob_class(name: Column) -> Column:
    """nested, a channel, or other, by the name below a slide's folder."""
    return F.when(name.contains("/"), "nested").when(name.rlike(r"^dpc-\d{3}-"), "dpc").when(name.rlike(r"^fluorescent-\d{3}-"), "fluorescent").otherwise("other")


def blob_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^[a-z]+-(\d{3})-", 1), F.lit("")).cast("int")


def uri_parts(uri: Column) -> Column:
    """Struct (bucket, blob, name, stem, suffix); bucket null for local paths."""
    name = F.regexp_extract(uri, r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    remote = uri.startswith("gs://")
    return F.struct(F.when(remote, F.regexp_extract(uri, r"^gs://([^/]+)", 1)).alias("bucket"), F.when(remote, F.regexp_extract(uri, r"^gs://[^/]+/?(.*)$", 1)).otherwise(uri).alias("blob"), name.alias("name"), F.regexp_replace(name, r"(?<=.)\.[^.]+$", "").alias("stem"), suffix.alias("suffix"))


def cache_name(blob: Column) -> Column:
    return F.regexp_replace(blob, r"[^A-Za-z0-9_.-]", "_")


def statistic_family(name: Column) -> Column:
    """What kind of statistic a name stands for."""
    return F.when(name.rlike("^p[0-9]+$"), "percentile").when(name.startswith("at_least"), "fraction").when(name.startswith("top"), "trimmed-mean").otherwise("whole-slide")


def sweep(name: Column) -> Column:
    """The number at a name's end; null where there is none."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)$", 1), F.lit("")).cast("int")
