"""Whole corpora: folders in and out, the library, the stream."""

import os

import pytest

from pyspark.sql import functions as F

from quire.plans import batch
from quire.plans import normalize as plan
from quire.sources import archives
from quire.streaming import intake
from tests.test_books import book


def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.epub").write_bytes(archives.pack(book({"a.x": "<p>x</p>"})))
    (d / "b.epub").write_bytes(b"broken")
    (d / "c.original.epub").write_bytes(b"kept")
    return d


def test_folder_to_folder_with_errors_apart(spark, tmp_path):
    d, out = folder(tmp_path), tmp_path / "out"
    rows = {r.book_id: r.error for r in batch.run(spark, str(d), str(out)).collect()}
    assert rows["a.epub"] is None and "ZIP" in rows["b.epub"] and len(rows) == 2
    assert os.listdir(out) == ["a-optimized.epub"]
    assert "mimetype" in archives.unpack((out / "a-optimized.epub").read_bytes())
    dry = {r.book_id: r.content_documents for r in batch.run(spark, str(d), "", dry_run=True).collect()}
    assert dry["a.epub"] == 1 and dry["b.epub"] is None


def test_sink_does_not_overwrite_unless_forced(spark, tmp_path):
    d, out = folder(tmp_path), tmp_path / "out"
    batch.run(spark, str(d), str(out))
    before = (out / "a-optimized.epub").stat().st_ino
    try:
        batch.run(spark, str(d), str(out))
        raise AssertionError("it overwrote")
    except Exception as e:
        assert "it overwrote" not in str(e)
    assert (out / "a-optimized.epub").stat().st_ino == before and len(os.listdir(out)) == 1
    batch.run(spark, str(d), str(out), force=True)
    assert (out / "a-optimized.epub").stat().st_ino != before


def test_library_listing_and_what_is_due(spark):
    rows = ['{"id": "1", "title": "A", "formats": ["/l/a/a.epub", "/l/a/b.EPUB"]}', '{"id": 2, "title": "B", "formats": ["/l/b/b.epub", "/l/b/b.original_epub"]}', '{"id": "x", "title": "C"}', '{"id": 4}']
    lib = batch.library(spark.createDataFrame([(r,) for r in rows], "value string"))
    got = {r.id: (r.formats, r.directory) for r in lib.collect()}
    assert got[1] == ({"EPUB": "/l/a/b.EPUB"}, "/l/a") and set(got) == {1, 2}
    assert [r.id for r in batch.due(lib).collect()] == [1]


def test_clashing_jobs(spark):
    jobs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "a"), ("d", "y")], "source string, destination string")
    assert {(r.destination, r.reason) for r in batch.clashes(jobs).collect()} == {("x", "duplicate output"), ("a", "output is an input")}


def test_stream_does_each_book_once(spark, tmp_path):
    d, out, mark = folder(tmp_path), str(tmp_path / "done"), str(tmp_path / "mark")
    intake.normalized(spark, str(d), out, mark).awaitTermination()
    (d / "n.epub").write_bytes(archives.pack(book({"a.x": ""})))
    intake.normalized(spark, str(d), out, mark).awaitTermination()
    got = spark.read.parquet(out).groupBy("book_id").agg(F.count("*").alias("n"), F.max("error").alias("error")).collect()
    assert {r.book_id: r.n for r in got} == {"a.epub": 1, "b.epub": 1, "n.epub": 1}


def test_validation_and_preview_rows(spark):
    made = spark.createDataFrame([("a.epub", archives.pack(book({"a.x": '<a href="no.x">x</a>'}))), ("b.epub", b"no")], "book_id string, content binary")
    assert {(r.book_id, r.code) for r in plan.validate(made).collect()} == {("a.epub", "missing-link-target"), ("b.epub", "unreadable")}
    assert [r.package_path for r in plan.preview(made).orderBy("book_id").collect()] == ["O/b.opf", None]


def program(tmp_path, body):
    p = tmp_path / "check.sh"
    p.write_text(f"#!/bin/sh\n{body}\n")
    p.chmod(0o755)
    return str(p)


def test_external_checker(tmp_path):
    from quire.plans.checker import ProgramChecker, timeout_of

    report = '{"messages": [{"ID": "E", "severity": "ERROR", "message": "m", "locations": [{"path": "a"}], "additionalLocations": 1}]}'
    found = ProgramChecker(program(tmp_path, f"echo '{report}' >&2; exit 1"))(b"x")
    assert found.available and [f.path for f in found.errors] == ["a", None]
    assert ProgramChecker(program(tmp_path, "sleep 5"), 0.2)(b"x").status == "timeout"
    assert not ProgramChecker(program(tmp_path, "exit 3"))(b"x").available and not ProgramChecker("/no/such")(b"x").available
    assert [timeout_of(x) for x in (None, "7", "-1", "inf", "x")] == [120, 7, 120, 120, 120]


def test_arrivals_by_window(spark, tmp_path):
    d = folder(tmp_path)
    q = intake.arrivals(intake.books(spark, str(d))).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.books for r in spark.table("arrivals").collect()) == 2


def test_clashing_jobs_are_refused_before_anything_is_written(spark, tmp_path):
    from quire.plans import batch
    from quire.sources import archives

    for place in ("in/x", "in/y"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "a.epub").write_bytes(b"not an archive")
    with pytest.raises(batch.UsageError):
        batch.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), force=True)
    assert not (tmp_path / "out").exists()
    (tmp_path / "in" / "x" / "B-optimized.epub").write_bytes(b"x")
    names = [r.book_id for r in archives.listing(spark, str(tmp_path / "in")).collect()]
    assert names == ["a.epub", "a.epub", "B-optimized.epub"]
    with pytest.raises(batch.UsageError):
        batch.run(spark, str(tmp_path / "in" / "x"), str(tmp_path / "in" / "x"), force=True)
