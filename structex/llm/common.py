"""Shared pieces of the training-data operators: tables, durable checkpoints, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structex.plans.durable import durable, ensure_checkpoint_dir

__all__ = ["SPACE_CHARS", "SPACE_CLASS", "durable", "ensure_checkpoint_dir", "in_parts", "join_counted", "let", "table", "words_of", "written"]

#: White space that separates words everywhere in this subpackage: space, tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the input folder; the path may be any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Rows as a compressed table in the shared folder, and how to remove it once nothing reads it any more."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)

    def remove() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(rows.schema).parquet(path), remove


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], most: int = 200_000) -> DataFrame:
    """rows joined with table, whose column n says how many rows have each of its keys.

    Keys that more than a most-th of these rows have, so fewer than most keys, are broadcast: no
    task gets all rows of such a key. The others meet by a shuffle.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    limit = max(1_000, total // most)
    hot = table.filter(F.col("n") > limit)
    if hot.isEmpty():
        return rows.join(table, keys)
    rare = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.filter(F.col("n") <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rare)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order.

    Byte replacements and a split at one plain character are far cheaper than a split by regex.
    """
    flat = text
    for space in SPACE_CHARS[1:]:
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")
