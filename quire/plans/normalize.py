"""Normalizing a corpus of books: one narrow pass, a book a row, with every failure as a column.

A book is worked on in memory by one task; nothing is shared between books, so the plan has no shuffle and
a lost executor costs the books it held.  An external checker is a plug-in: a callable from archive bytes to
a CheckResult.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import books as ops
from quire.operators import classify, findings, rewrite
from quire.operators.books import Book
from quire.operators.findings import CheckResult
from quire.plans import stylesheet
from quire.ship import ship
from quire.sources import archives

VERSION = "1"
PASSES = 3
Checker = Callable[[bytes], CheckResult]


@dataclass(frozen=True)
class Options:
    preserve_publisher_css: bool = False
    checker: Checker | None = None
    max_size_bytes: int | None = None
    progress: Callable[[str], None] | None = None
    output_filename: str | None = None


class Rejected(ValueError):
    """The book can't be normalized; the message says why."""


def unavailable(_: bytes) -> CheckResult:
    return CheckResult(False, "unavailable")


def normalize_book(name: str, content: bytes, options: Options = Options()) -> dict:
    """The columns of RESULT for one archive; raises Rejected, BookError or ValueError."""
    began, log = time.monotonic(), []

    def say(text: str) -> None:
        log.append(text)
        if options.progress:
            options.progress(text)

    if options.max_size_bytes is not None and len(content) > options.max_size_bytes:
        raise Rejected(f"Input file is larger than {options.max_size_bytes} bytes.")
    if error := archives.error_of(name, content):
        raise Rejected(error)
    check = options.checker or unavailable
    before = check(content)
    say("Checked the input.")
    book = Book.open(archives.unpack(content))
    counts = _restyle(book, options.preserve_publisher_css)
    counts["content_documents"] = _rewrite_pages(book, options.preserve_publisher_css)
    counts["ncx_documents"] = ops.normalize_ncx(book)
    counts["nav_added"] = ops.ensure_nav(book)
    _mark(book)
    _save_package(book)
    actions = ops.repair_links(book)
    say(f"Normalized {counts['content_documents']} document(s).")
    report = {"version": VERSION, "preserve_publisher_css": options.preserve_publisher_css, "actions": actions}
    book.files[ops.REPORT] = _report(report)
    found = ops.issues(book)
    warnings = [m for severity, _, m in found if severity == "warning"]
    # without a checker nobody reads the archive before its last version
    after, passes = check(archives.pack(book.files)) if options.checker else before, 0
    while after.available and after.errors and passes < PASSES and (done := ops.repair(book, after.findings)):
        actions += done
        _save_package(book)
        book.files[ops.REPORT] = _report(report)
        after, passes = check(archives.pack(book.files)), passes + 1
    if errors := [m for severity, _, m in (ops.issues(book) if options.checker else found) if severity == "error"]:
        raise Rejected("; ".join(errors))
    if before.available and not after.available:
        raise Rejected("The checker was available for the input but not for the output.")
    if not before.available and after.errors:
        raise Rejected("The output has errors and the input couldn't be checked.")
    comparison = findings.compare(before, after)
    if why := findings.rejection(comparison):
        raise Rejected(why)
    verdict = findings.outcome(comparison, after)
    book.files[ops.REPORT] = _report(report | {"outcome": verdict})
    output = archives.pack(book.files)
    final = check(output)
    if (final.available, [f.fingerprint for f in final.errors]) != (after.available, [f.fingerprint for f in after.errors]):
        raise Rejected("The checker's result changed when the report was added.")
    say(f"Finished in {time.monotonic() - began:.2f} seconds.")
    return {
        "output": output, "outcome": verdict, **counts, "repair_passes": passes, "remaining": len(after.errors), "persisting": len(comparison.persisting), "resolved": len(comparison.resolved),
        "actions": actions, "warnings": warnings, "log": log, "error": None,
    }


def _restyle(book: Book, preserve: bool) -> dict:
    """Our style sheet in, publishers' sheets and fonts out; encryption entries of what went go too."""
    book.roles = book.class_roles()  # read before the sheets go
    removable = book.removable(preserve)
    gone = {p for i in removable if (p := book.path_of(i)) in book.files}
    for i in removable:
        i.remove_with_tail()
    manifest = book.manifest
    for i in [i for i in book.items if i.get("id") == ops.SHEET_ID or i.get("href") == ops.SHEET]:
        i.remove_with_tail()
    manifest.append(manifest.like("item", id=ops.SHEET_ID, href=ops.SHEET, **{"media-type": "text/css"}))
    for p in gone:
        del book.files[p]
    book.files[rewrite.join(book.folder, ops.SHEET)] = stylesheet.text().encode()
    book.clean_encryption(gone)
    return {"removed_items": max(len(gone), len(removable)), "removed_files": len(gone)}


def _rewrite_pages(book: Book, preserve: bool) -> int:
    done, held = 0, frozenset(book.files)
    for item in [i for i in book.items if ops.is_content(i)]:
        path = book.path_of(item)
        if path not in book.files:
            continue
        role = classify.document_role(item.get("id"), item.get("href"), item.get("properties"))
        text = rewrite.normalize(book.files[path], path, role, book.roles, held, preserve, rewrite.join(book.folder, ops.SHEET))
        if text is not None:
            book.files[path] = text.encode()
            book.pages.pop(path, None)
            done += 1
    return done


def _mark(book: Book) -> None:
    meta = book.root.child("metadata")
    if meta is None:
        meta = book.root.like("metadata")
        book.root.place(meta, book.root.nodes[0]) if book.root.nodes else book.root.append(meta)
    for n in [n for n in meta.children if n.local == "meta" and n.get("name") == ops.MARKER]:
        n.remove_with_tail()
    meta.append(book.root.like("meta", name=ops.MARKER, content=VERSION))


def _save_package(book: Book) -> None:
    book.files[book.package_path] = book.package.serialize().encode()


def _report(report: dict) -> bytes:
    return (json.dumps(report, indent=2, sort_keys=True) + "\n").encode()


# Over a corpus. -------------------------------------------------------------------------------------
RESULT = "book_id string, output binary, outcome string, content_documents bigint, removed_items bigint, removed_files bigint, ncx_documents bigint, nav_added boolean, repair_passes bigint, remaining bigint, persisting bigint, resolved bigint, actions array<string>, warnings array<string>, log array<string>, error string"
PREVIEW = "book_id string, input_filename string, epub_version string, package_path string, content_documents bigint, stylesheets_and_fonts bigint, removable_files bigint, images_preserved bigint, would_write_canonical_css boolean, image_diagnostics array<string>, change_summary array<string>, warnings array<string>, error string"
ISSUES = "book_id string, ord int, severity string, code string, message string"


def _types(schema: str) -> dict[str, pa.DataType]:
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return {name: kinds[kind] for name, kind in (x.split() for x in schema.split(", "))}


def _each(books: DataFrame, one: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    types = _types(schema)

    def run(batches):
        for batch in batches:
            for book, content in zip(batch.column("book_id").to_pylist(), batch.column("content").to_pylist()):
                rows = one(book, content)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in types.items()], names=list(types))

    ship(books.sparkSession)
    # spark.sql.execution.arrow.maxBytesPerBatch bounds what a batch of archives holds
    return books.select("book_id", "content").mapInArrow(run, schema)


def normalize(books: DataFrame, options: Options = Options()) -> DataFrame:
    """One row a book; a rejected one has an error and no output."""

    def one(book: str, content: bytes) -> list[dict]:
        try:
            return [{"book_id": book} | normalize_book(book, content, options)]
        except ValueError as e:
            return [{"book_id": book, "error": str(e)}]

    return _each(books, one, RESULT)


def preview(books: DataFrame, preserve: bool = False) -> DataFrame:
    """What normalizing would do, without doing it."""

    def one(book: str, content: bytes) -> list[dict]:
        try:
            if error := archives.error_of(book, content):
                raise Rejected(error)
            return [{"book_id": book} | Book.open(archives.unpack(content)).preview(book, preserve)]
        except ValueError as e:
            return [{"book_id": book, "error": str(e)}]

    return _each(books, one, PREVIEW)


def validate(books: DataFrame) -> DataFrame:
    """Structural issues, in order."""

    def one(book: str, content: bytes) -> list[dict]:
        try:
            if error := archives.error_of(book, content):
                raise Rejected(error)
            found = ops.issues(Book.open(archives.unpack(content)))
        except ValueError as e:
            found = [("error", "unreadable", str(e))]
        return [{"book_id": book, "ord": k, "severity": s, "code": c, "message": m} for k, (s, c, m) in enumerate(found)]

    return _each(books, one, ISSUES)


def as_row(result: CheckResult) -> dict:
    return asdict(result)
