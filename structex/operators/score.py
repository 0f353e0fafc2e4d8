"""Scores of an extraction against what is known to be in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.01


def recall(planted: DataFrame, output: DataFrame, key: str = "sku", amount: str = "amount", tolerance: float = TOLERANCE) -> DataFrame:
    """One row: planted, recovered, recall. The first planted row of a key counts; a match has the
    key and an amount within the tolerance."""
    known = planted.groupBy(key).agg(F.min_by(amount, "ord").alias("want"))
    got = output.select(F.col(key).alias("_k"), F.col(amount).alias("_a"))
    hit = known.join(got, (F.col(key) == F.col("_k")) & (F.abs(F.col("_a") - F.col("want")) <= tolerance * F.abs(F.col("want"))), "left_semi")
    counts = known.agg(F.count("*").alias("planted")).crossJoin(hit.agg(F.count("*").alias("recovered")))  # one row each
    return counts.withColumn("recall", F.when(F.col("planted") > 0, F.col("recovered") / F.col("planted")).otherwise(F.lit(0.0)))


def duplicate_rate(output: DataFrame, key: str = "sku") -> DataFrame:
    """One row: items, distinct_items and (items - distinct) / items, 0 for no items."""
    by_key = output.groupBy(key).agg(F.count("*").alias("n"))
    out = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count("*").alias("distinct_items"))
    rate = F.when(F.col("items") > 0, (F.col("items") - F.col("distinct_items")) / F.col("items")).otherwise(F.lit(0.0))
    return out.withColumn("duplicate_rate", rate)
