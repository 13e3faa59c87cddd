"""Helpers shared by the operators: staged tables, Arrow row mapping, bounded key bitmaps."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.ship import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_spaces: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master may leave it unset: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="quire-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base


class Workspace:
    """Tables staged in the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
        _spaces.append((spark, self.root))

    def stage(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes and reads again; with ``by``, a set of files for each value of that column."""
        path = f"{self.root}/{name}"
        schema = df.schema
        write = df.write.mode("overwrite")
        (write.partitionBy(by) if by else write).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _spaces:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may already be gone at exit
            return


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts holds, unless the session already sets it; workers get the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hands freed memory back to the system at the end of a task: workers are used again by other operators and would keep the most that any took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def map_batches(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow: ``fn()`` runs once a task and gives a function from a batch to a dict of columns."""
    names = [f.name for f in ship(df.sparkSession).createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn()
        for batch in batches:
            out = one(batch)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n] for n in names], names=names)
            batch = out = None
        give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def fold(c: Column) -> Column:
    """Null as empty, A-Z in lower case, everything else as it is."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def fold_of(c: Column) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5))


def bitmap(keys: DataFrame, column: str, count: int, least: int = 16, most: int = 26) -> tuple[DataFrame, int]:
    """A table of at most 2^(most-6) words of 64 bits that holds the hashed keys; what it lets through may hold others."""
    bits = min(max(least, (16 * max(count, 1)).bit_length()), most)
    h = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    words = keys.groupBy(F.shiftrightunsigned(h, 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    return words, bits


def in_bitmap(df: DataFrame, column: str, made: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose key may be among the bitmap's; the bitmap has a fixed bound, so it is broadcast."""
    words, bits = made
    at = F.shiftrightunsigned(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)), 6)
    hit = F.expr(f"(_bits & shiftleft(1L, cast({column} & 63 as int))) <> 0")
    return df.join(F.broadcast(words), at == F.col("_word")).where(hit).drop("_word", "_bits")


def without(docs: DataFrame, gone: DataFrame, count: int) -> DataFrame:
    """docs but for those whose doc_id is in gone (doc_id). Only rows that the bitmap can't clear are shuffled with their texts."""
    words, bits = bitmap(gone.select(F.xxhash64("doc_id").alias("_key")), "_key", count)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("doc_id").alias("_key"))
    at = F.shiftrightunsigned(F.col("_key").bitwiseAND(F.lit((1 << bits) - 1)), 6)
    hit = F.expr("coalesce((_bits & shiftleft(1L, cast(_key & 63 as int))) <> 0, false)")
    flagged = rows.join(F.broadcast(words), at == F.col("_word"), "left").withColumn("_hit", hit)
    left = flagged.where("_hit").select("row", F.col("row.doc_id").alias("doc_id")).join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    return flagged.where("not _hit").select("row").unionByName(left.select("row")).select("row.*")
