"""Intake: a file stream over a folder of archives, normalized book by book as they arrive.

The checkpoint remembers what was done, so a restarted stream goes on where the last one stopped: the
streaming form of a resumable batch.  ``arrivals`` counts them per window of their modification time, with
late ones dropped after the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.normalize import Options, normalize

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def books(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.epub").option("maxFilesPerTrigger", per_batch).load(folder)
    name = F.substring_index("path", "/", -1)
    return stream.where(~F.lower(name).endswith(".original.epub")).select(name.alias("book_id"), F.col("modificationTime").alias("modified"), "length", "content")


def normalized(spark: SparkSession, folder: str, output: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Starts the stream over what is there; results go to Parquet, errors included."""
    done = normalize(books(spark, folder), options)
    return done.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)


def arrivals(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Books and bytes for each window of arrival."""
    return stream.withWatermark("modified", late).groupBy(F.window("modified", window)).agg(F.count("*").alias("books"), F.sum("length").alias("bytes")).select("window.start", "window.end", "books", "bytes")
