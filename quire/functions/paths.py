"""Paths inside an archive, as Spark expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def entry_error(name: Column) -> Column:
    """Why an entry's name is unsafe, else null: absolute, a drive, or a step to the parent."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    return (
        F.when(slashed.startswith("/"), "absolute path")
        .when(F.contains(F.get(F.split(slashed, "/"), F.lit(0)), F.lit(":")), "drive prefix")
        .when(F.array_contains(F.split(slashed, "/"), ".."), "parent segment")
    )


def entry_name(name: Column) -> Column:
    """The sanitized name of an archive entry; null if it is unsafe."""
    return F.when(entry_error(name).isNull(), F.array_join(_parts(F.replace(name, F.lit("\\"), F.lit("/"))), "/"))


def join(directory: Column, href: Column) -> Column:
    """href seen from directory, resolved; null if it is absolute or climbs out of the archive."""
    none = F.lit(None).cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(none)
        return F.when(done.isNull(), none).when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    walked = F.aggregate(F.split(F.concat_ws("/", directory, href), "/"), F.array().cast("array<string>"), step)
    return F.when(~href.startswith("/"), F.array_join(walked, "/"))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)$", 1))


def relative(source: Column, target: Column) -> Column:
    """The way from the file source to the file target; "." if the target is the source's directory."""
    here, there = _parts(dirname(source)), _parts(target)
    n = F.least(F.size(here), F.size(there))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.slice(here, 1, k) == F.slice(there, 1, k))))
    way = F.concat(F.array_repeat(F.lit(".."), F.size(here) - shared), F.slice(there, shared + 1, F.greatest(F.size(there) - shared, F.lit(0))))
    return F.when(F.size(way) == 0, ".").otherwise(F.array_join(way, "/"))


def optimized_filename(name: Column) -> Column:
    """<stem>-optimized.<ext>: an existing suffix isn't doubled, the spelling of .epub is kept."""
    ext = F.regexp_extract(name, r"(?i)\.(epub)$", 1)
    stem = F.regexp_replace(F.regexp_replace(basename(name), r"(?i)\.epub$", ""), r"(?i)-optimized$", "")
    return F.concat(F.when(stem == "", "optimized").otherwise(F.concat(stem, F.lit("-optimized"))), F.lit("."), F.when(ext == "", "epub").otherwise(ext))


def normalized_path(path: Column) -> Column:
    """The path of a finding as entries spell it, or as it came if it can't be resolved."""
    flat = F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.coalesce(join(F.lit(""), flat), path)


def real(path: str, depth: int = 40) -> str:
    """A path on the driver with links and dots resolved; its tail need not exist."""
    return os.path.realpath(path)
