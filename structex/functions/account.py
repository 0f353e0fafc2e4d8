"""Token accounting: usage of replies, truncation, budgets, and checks of the knobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from structex.functions.jsonx import number_at, text_at

# What providers write when the output was cut off.
TRUNCATED = ("length", "max_tokens", "MAX_TOKENS")
PLACES = ("$.usage", "$.message.usage", "$.usageMetadata")
INPUT, OUTPUT = ("prompt_tokens", "input_tokens", "promptTokenCount"), ("completion_tokens", "output_tokens", "candidatesTokenCount")
MAX_TIMEOUT_MS = 2**31 - 1


def usage(v: Column) -> Column:
    """STRUCT<input_tokens, output_tokens, total_tokens>; null if a reply reports neither side."""

    def side(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[number_at(v, f"{p}.{n}") for p in PLACES for n in names])

    got_in, got_out = side(INPUT), side(OUTPUT)
    a, b = (F.coalesce(x, F.lit(0.0)).cast("long") for x in (got_in, got_out))
    return F.when(
        got_in.isNotNull() | got_out.isNotNull(),
        F.struct(a.alias("input_tokens"), b.alias("output_tokens"), (a + b).alias("total_tokens")),
    )


def truncation_reason(v: Column) -> Column:
    """The marker of a reply that was cut off, else null."""
    slots = ("$.choices[0].finish_reason", "$.stop_reason", "$.candidates[0].finishReason")
    return F.coalesce(*[F.when(text_at(v, s).isin(*TRUNCATED), text_at(v, s)) for s in slots])


def budget_state(total: Column, available: Column, budget: Column) -> Column:
    """ok, exceeded, or unavailable (spending that can't be accounted for fails closed)."""
    return (
        F.when(budget.isNull(), F.lit("ok"))
        .when(~available, F.lit("unavailable"))
        .when(total >= budget, F.lit("exceeded"))
        .otherwise(F.lit("ok"))
    )


def _whole(value, name: str, least: int) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < least):
        raise ValueError(f"{name} must be an integer of at least {least}, got {value!r}")


def check_token_budget(value: int | None) -> None:
    _whole(value, "token_budget", 1)


def check_max_retries(value: int | None) -> None:
    _whole(value, "max_retries", 0)


def check_timeout(value: int | None) -> None:
    _whole(value, "timeout", 1)
    if value is not None and value > MAX_TIMEOUT_MS:
        raise ValueError(f"timeout must be at most {MAX_TIMEOUT_MS} ms")


def check_streaming(token_budget: int | None, timeout: int | None) -> None:
    """Streams can't be stopped by a budget or a timeout: both are checked, then refused."""
    check_token_budget(token_budget)
    check_timeout(timeout)
    if token_budget is not None or timeout is not None:
        raise ValueError("token_budget and timeout are not supported for streaming calls")
