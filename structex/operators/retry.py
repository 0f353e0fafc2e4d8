"""Attempts and budgets as prefixes: which attempt ends a call, which chunk a document stops at.

Recorded attempts (call_id, attempt, …) are replayed with window functions. Live calls run in
waves: wave n holds the calls that wave n-1 left open, so the driver loops over attempts (at most
max_retries + 1), never over rows; each wave is written before it is looked at, so that a reply is
paid for once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_RETRIES = 3

#: Outcomes that end a call, by precedence; "continue" asks again.
OUTCOMES = ("provider_error", "success", "other_error", "truncated", "budget_exceeded", "usage_unavailable", "exhausted", "continue")


def replay(attempts: DataFrame, max_retries: int = MAX_RETRIES, budget: int | None = None) -> DataFrame:
    """Attempts that took place, with outcome, running tokens and is_last_attempt.

    attempts: call_id, attempt (1-based), provider_error, ok, other_error, truncated (booleans),
    tokens (null: not reported).
    """
    so_far = Window.partitionBy("call_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    answered = ~F.col("provider_error")
    rows = attempts.filter(F.col("attempt") <= max_retries + 1).withColumns(
        {
            "running_tokens": F.sum(F.when(answered, F.coalesce("tokens", F.lit(0))).otherwise(0)).over(so_far),
            "usage_available": F.min(F.when(answered, F.col("tokens").isNotNull()).otherwise(True)).over(so_far),
        }
    )
    left = F.col("attempt") <= max_retries
    outcome = (
        F.when(F.col("provider_error"), F.lit("provider_error"))
        .when(F.col("ok"), F.lit("success"))
        .when(F.col("other_error"), F.lit("other_error"))
        .when(F.col("truncated"), F.lit("truncated"))
    )
    if budget is not None:
        outcome = outcome.when(left & ~F.col("usage_available"), F.lit("usage_unavailable")).when(
            left & (F.col("running_tokens") >= budget), F.lit("budget_exceeded")
        )
    outcome = outcome.when(~left, F.lit("exhausted")).otherwise(F.lit("continue"))
    ended = F.min(F.when(F.col("outcome") != "continue", F.col("attempt"))).over(Window.partitionBy("call_id"))
    known = rows.withColumn("outcome", outcome).withColumn("_end", ended)
    return (
        known.filter(F.col("_end").isNull() | (F.col("attempt") <= F.col("_end")))
        .withColumn("is_last_attempt", F.col("attempt") == F.col("_end"))
        .drop("_end")
    )


def document_budget(chunks: DataFrame, budget: int, doc_col: str = "doc_id") -> DataFrame:
    """Chunks that start before the document's budget is spent; the one that crosses it still counts.

    chunks: doc, chunk_index, tokens (null: not reported).
    """
    before = Window.partitionBy(doc_col).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce("tokens", F.lit(0))).over(before), F.lit(0))
    accounted = F.coalesce(F.min(F.col("tokens").isNotNull()).over(before), F.lit(True))
    why = F.when(~accounted, F.lit("usage-unavailable")).when(spent >= budget, F.lit("token-budget"))
    marked = chunks.withColumns({"spent_before": spent, "stop_reason": why})
    upto = Window.partitionBy(doc_col).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("stopped", F.max(F.col("stop_reason").isNotNull()).over(upto))


def stop_from(chunks: DataFrame, at: Column, reason: str, doc_col: str = "doc_id") -> DataFrame:
    """Also stop each document at its first chunk for which at holds; chunks has stopped and stop_reason."""
    upto = Window.partitionBy(doc_col).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    here = ~F.col("stopped") & at
    marked = chunks.withColumn("_here", here).withColumn("stop_reason", F.when(F.col("_here"), F.lit(reason)).otherwise(F.col("stop_reason")))
    return marked.withColumn("stopped", F.col("stopped") | F.max("_here").over(upto)).drop("_here")


def stop_after(chunks: DataFrame, at: Column, doc_col: str = "doc_id") -> DataFrame:
    """Also stop each document behind its first chunk for which at holds."""
    before = Window.partitionBy(doc_col).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    marked = chunks.withColumn("_here", ~F.col("stopped") & at)
    return marked.withColumn("stopped", F.col("stopped") | F.coalesce(F.max("_here").over(before), F.lit(False))).drop("_here")


def run_waves(
    calls: DataFrame,
    ask: Callable[[DataFrame, int], DataFrame],
    durable: Callable[[DataFrame], DataFrame],
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """Live retry loop: ask(open calls, attempt) returns them with outcome; all attempts come back."""
    done, open_ = None, calls
    for attempt in range(1, max_retries + 2):
        wave = durable(ask(open_, attempt).withColumn("attempt", F.lit(attempt)))
        done = wave if done is None else done.unionByName(wave, allowMissingColumns=True)
        open_ = wave.filter("outcome = 'continue'").drop("attempt", "outcome")
        if open_.isEmpty():
            break
    return done


def attempt_number(call: Column | str, order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(call).orderBy(order))
