"""Training-data pipeline: language ID, exact dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
Null doc_ids pass the filters; null and letterless texts go at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from quire.llm.common import Workspace, fold_of, table
from quire.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language, texts without a letter, and labels documents of no known language. The model learns from the same rows as op9."""
    docs = docs.select(COLUMNS)
    return langid.keep_known(docs, langid.fit(docs.where(fold_of(F.col("doc_id")) != 0)))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs.select(COLUMNS))


def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs.select(COLUMNS))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_rows(docs.select(COLUMNS), vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("minhash_near_dedup", distinct_sets),
    ("benchmark_decontamination", clean_of_benchmark),
    ("bpe_tokens", tokens),
]

#: SQL can't express the language model, the tokenizer or the alignment; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.stage(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
