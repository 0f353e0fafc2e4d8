"""The corpus pipeline: quality rules, line dedup, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run()
writes what each stage returns to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structex.llm import line_dedup, mixing, packing, quality_rules, similarity_join
from structex.llm.common import ensure_checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_HAS_WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing else was left."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("_removed") == 0) | F.col("text").rlike(_HAS_WORD)
    n_chars = F.when(F.col("_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cleaned.filter(left).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return similarity_join.keep_one(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mix(docs, repeat_rows=True).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and their place in it."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]

#: Packing and verification on word sets have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
