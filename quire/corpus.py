"""The driver's tables as corpora: pages as a book of linked documents, documents as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """By keys into several tasks a core, for work that is heavy in CPU. The number is given, since Spark would join tasks by bytes until one is left over for a second round."""
    spark = frame.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return frame.repartition(n, *keys)


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, site, path (no edge slashes), query, fragment."""
    url = F.col("url")
    return pages.select(
        "page_id", F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("site"), F.trim(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/")).alias("path"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"), F.regexp_extract(url, r"#(.*)$", 1).alias("fragment"),
    )


def linked(pages: DataFrame, per_book: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, anchors, links) of books made of runs of per_book pages.

    Each page links to the next one of its book: as it is, with its folder lost, or with its name lost, by
    page_id modulo 3.
    """
    u = url_parts(pages).withColumn("book_id", F.floor(F.col("page_id") / per_book)).where("path <> ''")
    files = u.select("book_id", "path").distinct()
    anchors = u.where("fragment <> ''").select("book_id", "path", F.col("fragment").alias("anchor")).distinct()
    after = u.select("book_id", (F.col("page_id") - 1).alias("page_id"), F.col("path").alias("next"), F.col("fragment").alias("f"))
    n = u.select("book_id", "page_id", "path").join(after, ["book_id", "page_id"])
    lost = F.when(F.col("page_id") % 3 == 0, F.col("next")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("old/"), paths.basename(F.col("next")))).otherwise(F.concat(F.lit("old/x"), paths.basename(F.col("next"))))
    up = F.when(paths.dirname(F.col("path")) == "", 0).otherwise(F.size(F.split(paths.dirname(F.col("path")), "/")))
    href = F.concat(F.repeat(F.lit("../"), up), lost, F.when(F.col("f") != "", F.concat(F.lit("#"), "f")).otherwise(""))
    return files, anchors, n.select("book_id", F.col("page_id").alias("link_id"), F.col("path").alias("source"), href.alias("href"))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_ix, line: the lines of whole texts that aren't blank."""
    split = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ix", "line"))
    return split.where(F.trim("line") != "").select("doc_id", F.col("line_ix").cast("bigint").alias("line_ix"), "line")


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of anchors in the markup, by pattern."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href")).withColumn("pos", F.col("pos").cast("bigint"))
