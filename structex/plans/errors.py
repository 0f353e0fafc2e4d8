"""Typed errors for callers that want one value or an exception; tables keep them as status."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row


class ExtractionError(Exception):
    """status: the row's status; details: what the row knows about it."""

    def __init__(self, status: str, details: dict[str, Any] | None = None):
        super().__init__(f"{status}: {details}" if details else status)
        self.status, self.details = status, details or {}


class JsonParseError(ExtractionError):
    """The reply holds no JSON; details has the raw reply."""


class SchemaValidationError(ExtractionError):
    """JSON that doesn't fit; details has the issues."""


class RetryExhaustedError(ExtractionError):
    """No attempt is left; details has attempts, the last issues and the usage."""


class OutputTruncatedError(ExtractionError):
    """The model was cut off; details has the marker."""


class TokenBudgetError(ExtractionError):
    """The budget ended a call."""


class TokenBudgetExceededError(TokenBudgetError):
    """It is spent."""


class TokenUsageUnavailableError(TokenBudgetError):
    """Spending isn't reported, so it can't be kept."""


class ProviderError(ExtractionError):
    """The provider raised; never asked again."""


class DocumentChunkError(ExtractionError):
    """A chunk failed and the policy is abort; details has its index."""


class DocumentConflictError(ExtractionError):
    """Chunks contradict each other; details has the fields."""


class DocumentMergeError(ExtractionError):
    """The merged value doesn't fit; details has issues and the partial value."""


class DocumentNoDataError(ExtractionError):
    """empty-document or all-chunks-failed."""


class DocumentInterruptedError(ExtractionError):
    """timeout, aborted, token-budget or usage-unavailable; details has the partial value."""


BY_STATUS: dict[str, type[ExtractionError]] = {
    "JsonParseError": JsonParseError,
    "SchemaValidationError": SchemaValidationError,
    "exhausted": RetryExhaustedError,
    "truncated": OutputTruncatedError,
    "exceeded": TokenBudgetExceededError,
    "budget_exceeded": TokenBudgetExceededError,
    "unavailable": TokenUsageUnavailableError,
    "usage_unavailable": TokenUsageUnavailableError,
    "provider_error": ProviderError,
    "chunk_error": DocumentChunkError,
    "conflict": DocumentConflictError,
    "invalid": DocumentMergeError,
    "no_data": DocumentNoDataError,
    "interrupted": DocumentInterruptedError,
}


def value_of(row: Row) -> Any:
    """A row's data, or its error raised."""
    known = row.asDict(recursive=True)
    status = known.get("status") or known.get("outcome")
    if status in ("ok", "merged", "success"):
        return known.get("data")
    raise BY_STATUS.get(status, ExtractionError)(status, {k: v for k, v in known.items() if k not in ("status", "data") and v is not None})


def collect_one(df: DataFrame) -> Any:
    """The value of a result of exactly one row."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError(f"one row was expected, got {'none' if not rows else 'more'}")
    return value_of(rows[0])
