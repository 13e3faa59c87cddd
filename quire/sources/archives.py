"""Book archives: scan and validate, explode into entries, write back.

``books`` is (book_id, path, content); ``entries`` has a row for each file of a book.  An invalid book is a
row with an error, never a failed job.
"""

from __future__ import annotations

import io
import os
import unicodedata
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quire.ship import ship

MIMETYPE = "application/epub+zip"
ENTRIES = "book_id string, entry_ix int, raw_name string, path string, fold_key string, stored boolean, bytes binary"


def books(spark: SparkSession, path: str) -> DataFrame:
    """The archives below a folder: book_id (file name), path, length, modified, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("book_id"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Archives of a folder that are no kept originals. Contents are never sorted; ``listing`` has the order."""
    low = F.lower("book_id")
    return books(spark, path).where(low.endswith(".epub") & ~low.endswith(".original.epub"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The same without contents, in the order of their folded names."""
    return candidates(spark, path).drop("content").orderBy(F.lower("book_id"), "path")


def safe_name(name: str) -> str:
    """Raises ValueError with the reason if the name leaves the archive."""
    slashed = name.replace("\\", "/")
    parts = slashed.split("/")
    if slashed.startswith("/") or ":" in parts[0] or ".." in parts:
        raise ValueError(f"Unsafe archive entry: {name}")
    return "/".join(p for p in parts if p not in ("", "."))


def fold_key(path: str) -> str:
    return unicodedata.normalize("NFC", path).casefold()


def error_of(name: str, content: bytes | None) -> str | None:
    """The first failure of an archive, in a fixed order; None if there is none."""
    if content is None:
        return "Input file does not exist."
    if os.path.splitext(name)[1].lower() != ".epub":
        return "Input file must use the .epub extension."
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError):
        return "Input file is not a valid ZIP archive."
    with z:
        names = z.namelist()
        if "mimetype" not in names:
            return "EPUB archive is missing the mimetype file."
        if z.read("mimetype").decode("utf-8", "replace").strip() != MIMETYPE:
            return "EPUB mimetype is invalid."
        if "META-INF/container.xml" not in names:
            return "EPUB archive is missing META-INF/container.xml."
        for n in names:
            if not n.endswith("/"):
                try:
                    safe_name(n)
                except ValueError as e:
                    return str(e)
    return None


@F.pandas_udf(StringType())
def archive_error(name: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([error_of(n, c) for n, c in zip(name, content)], dtype=object)


def unpack(content: bytes) -> dict[str, bytes]:
    """Files by safe name. Of names that fold to one, the first spelling stays with the last content."""
    spelling: dict[str, str] = {}
    out: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if info.is_dir() or not (path := safe_name(info.filename)):
                continue
            out[spelling.setdefault(fold_key(path), path)] = z.read(info)
    return out


def pack(files: dict[str, bytes]) -> bytes:
    """Deterministic: mimetype first and stored, the rest by path, deflated, with one time stamp."""
    if "mimetype" not in files:
        raise ValueError("An archive needs its mimetype file.")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path in ["mimetype", *sorted(p for p in files if p != "mimetype")]:
            safe_name(path)
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            info.compress_type = zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, files[path], compresslevel=6)
    return buffer.getvalue()


def entries(books_: DataFrame) -> DataFrame:
    """All entries of the archives that can be opened, with their safe names; unsafe ones have a null path."""

    def explode(batches):
        for batch in batches:
            rows = []
            for book, content in zip(batch.column("book_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for k, info in enumerate(z.infolist()):
                    if info.is_dir():
                        continue
                    try:
                        path = safe_name(info.filename)
                    except ValueError:
                        path = None
                    rows.append((book, k, info.filename, path, fold_key(path) if path else None, info.compress_type == zipfile.ZIP_STORED, z.read(info)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()))], names=[x.split()[0] for x in ENTRIES.split(", ")])

    ship(books_.sparkSession)
    return books_.select("book_id", "content").mapInArrow(explode, ENTRIES)


def files(entries_: DataFrame) -> DataFrame:
    """One row a file: of entries that fold to one name the first spelling, the last content."""
    kept = entries_.where("path is not null and path <> ''")
    return kept.groupBy("book_id", "fold_key").agg(F.min_by("path", "entry_ix").alias("path"), F.max_by("bytes", "entry_ix").alias("bytes"))


def packed(files_: DataFrame) -> DataFrame:
    """(book_id, content, error) of files (book_id, path, bytes): one archive a book."""

    def build(t: pa.Table) -> pa.Table:
        book = t.column("book_id")[0].as_py()
        try:
            content, error = pack(dict(zip(t.column("path").to_pylist(), t.column("bytes").to_pylist()))), None
        except ValueError as e:
            content, error = None, str(e)
        return pa.table({"book_id": pa.array([book], pa.string()), "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})

    ship(files_.sparkSession)
    return files_.select("book_id", "path", "bytes").groupBy("book_id").applyInArrow(build, "book_id string, content binary, error string")


class _Message(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _FileWriter(DataSourceWriter):
    """Writes (name, content) rows as files: staged beside the target, synced, published when all tasks are done."""

    def __init__(self, folder: str, force: bool):
        self.folder, self.force = folder, force

    def write(self, rows):
        moves = []
        os.makedirs(self.folder, exist_ok=True)
        for row in rows:
            target = os.path.join(self.folder, safe_name(row["name"]))
            staged = f"{target}.{os.getpid()}.{len(moves)}.part"
            with open(staged, "wb") as f:
                f.write(row["content"])
                f.flush()
                os.fsync(f.fileno())
            moves.append((staged, target))
        return _Message(moves)

    def commit(self, messages):
        for staged, target in (m for x in messages if x for m in x.moves):
            if self.force:
                os.replace(staged, target)
                continue
            try:
                os.link(staged, target)  # fails if the target came to be meanwhile
            finally:
                os.unlink(staged)

    def abort(self, messages):
        for staged, _ in (m for x in messages if x for m in x.moves):
            if os.path.exists(staged):
                os.unlink(staged)


class FileSink(DataSource):
    """df(name, content).write.format("quire_files").option("force", ...).mode("append").save(folder): a folder all tasks share."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], overwrite or self.options.get("force", "false") == "true")


# Style sheets and images. ---------------------------------------------------------------------------
URL = r"""(?is)url\(\s*(?:'([^']*)'|"([^"]*)"|([^'")][^)]*))\s*\)"""


def resource_urls(css: Column) -> Column:
    """Local targets of url() in a text: no data, no scheme, no root; without query and fragment."""
    groups = [F.regexp_extract_all(css, F.lit(URL), F.lit(k)) for k in (1, 2, 3)]
    raw = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.trim(F.concat(a, b)))
    local = F.filter(raw, lambda u: (u != "") & ~u.startswith("/") & ~F.contains(F.get(F.split(u, "/"), F.lit(0)), F.lit(":")))
    return F.filter(F.transform(local, lambda u: F.trim(F.regexp_extract(u, r"(?s)^([^?#]*)", 1))), lambda u: u != "")


def class_roles(sheets: DataFrame) -> DataFrame:
    """(book_id, class, role) of sheets (book_id, sheet_ix, css): later rules and sheets win."""
    rule = r"(?s)\.([A-Za-z_][\w-]*)[^{}]*\{([^}]*)\}"
    names, bodies = F.regexp_extract_all("css", F.lit(rule), F.lit(1)), F.transform(F.regexp_extract_all("css", F.lit(rule), F.lit(2)), F.lower)
    rules = sheets.select("book_id", "sheet_ix", F.posexplode(F.zip_with(names, bodies, lambda a, b: F.struct(F.lower(a).alias("class"), b.alias("body")))).alias("pos", "r"))
    role = F.when(F.col("r.body").rlike(r"text-align\s*:\s*right"), "eo-right").when(F.col("r.body").rlike(r"text-align\s*:\s*center"), "eo-centered")
    found = rules.select("book_id", F.col("r.class").alias("class"), role.alias("role"), F.struct("sheet_ix", "pos").alias("at")).where("role is not null")
    return found.groupBy("book_id", "class").agg(F.max_by("role", "at").alias("role"))


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG or JPEG."""
    data = data[:4096]
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
    if data[:2] != b"\xff\xd8":
        return None
    at, frames = 2, {*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC)}
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if marker in frames:
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD9:
            at += 1 if marker == 0xFF else 2
            continue
        if size < 2:
            return None
        at += 2 + size
    return None


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def image_size(head: pd.Series) -> pd.DataFrame:
    found = [dimensions(bytes(h)) if h is not None else None for h in head]
    return pd.DataFrame({"width": pd.array([f[0] if f else None for f in found], "Int64"), "height": pd.array([f[1] if f else None for f in found], "Int64")})


def png_size(content: Column) -> Column:
    """The same for PNG without leaving the JVM."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    return F.when((F.hex(F.substring(content, 1, 4)) == "89504E47") & (F.octet_length(content) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))
