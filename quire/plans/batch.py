"""Batches: planning jobs, checking for clashes, running with errors kept apart, resuming a library."""

from __future__ import annotations

import argparse
import os
import posixpath
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths
from quire.plans.normalize import Options, normalize, preview
from quire.ship import ship
from quire.sources import archives


@dataclass(frozen=True)
class Job:
    source: str
    destination: str


class UsageError(ValueError):
    """Arguments that can't go together."""


def plan(sources: list[str], output: str | None = None, output_dir: str | None = None) -> list[Job]:
    """<stem>-normalized.epub beside the source, in output_dir, or as output names it; clashes are refused beforehand."""
    jobs = []
    for s in sources:
        name = f"{posixpath.splitext(posixpath.basename(s))[0]}-normalized.epub"
        jobs.append(Job(s, output or os.path.join(output_dir if output_dir is not None else os.path.dirname(s), name)))
    inputs = [paths.real(s) for s in sources]
    taken: set[str] = set()
    for j in jobs:
        target = paths.real(j.destination)
        if target in inputs or any(os.path.exists(target) and os.path.exists(i) and os.path.samefile(target, i) for i in inputs):
            raise UsageError(f"Output is an input: {j.destination}")
        if target in taken:
            raise UsageError(f"Two inputs have one output: {j.destination}")
        taken.add(target)
    return jobs


def clashes(jobs: DataFrame) -> DataFrame:
    """(destination, reason) of job tables (source, destination) too long for the driver."""
    twice = jobs.groupBy("destination").agg(F.count("*").alias("n")).where("n > 1").select("destination", F.lit("duplicate output").alias("reason"))
    alias = jobs.select("destination").join(jobs.select(F.col("source").alias("destination")), "destination", "left_semi").select("destination", F.lit("output is an input").alias("reason"))
    return twice.unionByName(alias).distinct()


def due(library: DataFrame) -> DataFrame:
    """Books of a library (id, formats) that have an archive and no kept original: what a resumed batch still has to do."""
    return library.where(F.map_contains_key("formats", F.lit("EPUB")) & ~F.map_contains_key("formats", F.lit("ORIGINAL_EPUB")))


def library(listing: DataFrame) -> DataFrame:
    """(id, title, authors, formats, directory) of a JSON listing (value): formats by upper-case extension, the last wins."""
    row = F.from_json("value", "id string, title string, authors string, formats array<string>, cover string")
    r = listing.select(row.alias("r")).select("r.*")
    fmt = F.transform(F.coalesce("formats", F.array().cast("array<string>")), lambda p: F.struct(F.upper(paths.extension(p)).alias("k"), p.alias("p")))
    # among equal extensions the last place wins
    indexed = F.transform(fmt, lambda x, i: F.struct(x["k"].alias("k"), x["p"].alias("p"), i.alias("i")))
    last = F.filter(indexed, lambda x: ~F.exists(indexed, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    formats = F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["p"])))
    directory = F.coalesce(paths.dirname(F.get("formats", F.lit(0))), paths.dirname(F.col("cover")))
    ident = F.expr("try_cast(id as bigint)")
    return r.where(ident.isNotNull() & F.col("title").isNotNull()).select(ident.alias("id"), "title", "authors", formats.alias("formats"), directory.alias("directory"))


def jobs(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """(source, destination) of what ``run`` would do, by their real paths."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    name = paths.optimized_filename(F.col("book_id"))
    return archives.listing(spark, folder).select(plain("path").alias("source"), F.concat(F.lit(paths.real(output) + "/"), name).alias("destination"))


def run(spark: SparkSession, folder: str, output: str, options: Options = Options(), dry_run: bool = False, force: bool = False) -> DataFrame:
    """Normalizes a folder of archives into another; failures stay in the rows returned. Raises UsageError before anything is written if two archives have one output or an output is an input."""
    books = archives.candidates(spark, folder)
    if dry_run:
        return preview(books, options.preserve_publisher_css)
    if clash := clashes(jobs(spark, folder, output)).first():
        raise UsageError(f"{clash.reason}: {clash.destination}")
    done = normalize(books, options).persist(StorageLevel.DISK_ONLY)
    good = done.where("error is null").select(paths.optimized_filename(F.col("book_id")).alias("name"), F.col("output").alias("content"))
    ship(spark).dataSource.register(archives.FileSink)
    good.write.format("quire_files").option("force", str(force).lower()).mode("append").save(output)
    report = done.drop("output").persist()
    report.count()
    done.unpersist()
    return report


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quire", description="Normalize a folder of book archives.")
    p.add_argument("folder")
    p.add_argument("--output-dir")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--preserve-css", action="store_true")
    p.add_argument("--max-bytes", type=int)
    a = p.parse_args(argv)
    if a.dry_run and (a.force or a.output_dir):
        p.error("--dry-run writes nothing, so it takes neither --force nor --output-dir")
    if not a.dry_run and not a.output_dir:
        p.error("--output-dir is needed")
    if a.max_bytes is not None and a.max_bytes <= 0:
        p.error("--max-bytes must be positive")
    return a


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    out = run(spark, a.folder, a.output_dir or "", Options(a.preserve_css, None, a.max_bytes), a.dry_run, a.force)
    failed = out.where("error is not null").select("book_id", "error")
    for r in failed.toLocalIterator():
        print(f"{r.book_id}: {r.error}")
    return int(not failed.isEmpty())
