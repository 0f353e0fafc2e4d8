"""Observers of calls. They see events after the fact and can't change or break a run."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

EVENTS = ("request", "error", "parse_error", "success", "usage")
Hooks = dict[str, Callable[[dict[str, Any]], None]]


def combine(defaults: Hooks | None, call: Hooks | None) -> Hooks:
    """A call's hook replaces the default of the same name."""
    merged = {**(defaults or {}), **(call or {})}
    if unknown := set(merged) - set(EVENTS):
        raise ValueError(f"unknown hooks: {', '.join(sorted(unknown))}")
    return merged


def emit(hooks: Hooks, event: str, meta: dict[str, Any]) -> None:
    """A hook that raises is warned about and otherwise ignored."""
    hook = hooks.get(event)
    if hook is None:
        return
    try:
        hook(meta)
    except Exception as e:
        warnings.warn(f"hook {event} raised {type(e).__name__}: {e}", stacklevel=2)


def replay(hooks: Hooks, events: Iterable[dict[str, Any]]) -> None:
    for e in sorted(events, key=lambda e: (e["call_id"], e["attempt"], e["event_seq"])):
        emit(hooks, e["event"], e)


def on_batch(hooks: Hooks) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch over attempt events: rows come one part at a time."""

    def run(events: DataFrame, _epoch: int) -> None:
        for row in events.sort("call_id", "attempt", "event_seq").toLocalIterator():
            emit(hooks, row["event"], row.asDict())

    return run
