"""Streams of deltas as stateful operators: partial objects, and items of a list.

Rows are (stream_id, seq, delta, marker, input_tokens, output_tokens, eos). A stream's state is its
reader (what is open in the JSON; for snapshots also what is shown, which every snapshot repeats), a
digest of what was last shown, the parked rows that came out of order, the highest usage of each
side, and the truncation marker. A stream ends with its eos row; abandoned ones time out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from structex.functions.schema import Schema
from structex.streaming.automaton import Reader, dumps
from structex.streaming.partial import Invalid, check

IN_COLUMNS = ("stream_id", "seq", "delta", "marker", "input_tokens", "output_tokens", "eos")
OUT_SCHEMA = "stream_id long, seq long, kind string, body string, input_tokens long, output_tokens long, total_tokens long, attempts int"
STATE_SCHEMA = "state binary"
TTL_MS = 3_600_000


def fresh() -> dict[str, Any]:
    return {"reader": None, "next": 0, "last": None, "shown": 0, "stuck": False, "parked": {}, "marker": None, "in": None, "out": None}


def feed(state: dict[str, Any], rows: list[dict[str, Any]], schema: Schema, items: bool | None) -> list[dict[str, Any]]:
    """Take rows in sequence and say what a reader sees: snapshots or items, then usage and end.

    With items None only usage and end are said. Each text is read once; state["reader"] has what
    is open (and, for snapshots, what was shown) between calls.
    """
    out: list[dict[str, Any]] = []
    reader = Reader(schema, bool(items), render=items is not None)
    if state["reader"] is not None:
        reader.restore(state["reader"])
    for row in rows:
        if row["seq"] >= state["next"]:
            state["parked"].setdefault(row["seq"], row)
    while (row := state["parked"].pop(state["next"], None)) is not None:
        seq, state["next"] = state["next"], state["next"] + 1
        state["marker"] = row["marker"] or state["marker"]
        for side, name in (("in", "input_tokens"), ("out", "output_tokens")):
            if row[name] is not None:
                state[side] = max(state[side] or 0, int(row[name]))
        if row["delta"]:
            reader.feed(row["delta"])
            if items is not None:
                out += [{"seq": seq, "kind": "item" if items else "partial", "body": b} for b in _seen(state, reader, schema, items)]
        if row["eos"]:
            if items is None:
                any(_seen(state, reader, schema, False))
            if state["in"] is not None or state["out"] is not None:
                a, b = state["in"] or 0, state["out"] or 0
                out.append({"seq": seq, "kind": "usage", "body": None, "input_tokens": a, "output_tokens": b, "total_tokens": a + b, "attempts": 1})
            if not state["shown"]:
                kind = "OutputTruncatedError" if state["marker"] else "JsonParseError"
                out.append({"seq": seq, "kind": kind, "body": state["marker"]})
    state["reader"] = reader.state()
    return out


def _seen(state: dict[str, Any], reader: Reader, schema: Schema, items: bool) -> Iterator[str]:
    if not items:
        text = reader.shown()
        # a digest of what was shown last is enough to tell whether it changed
        if text is not None and (mark := blake2b(text.encode(), digest_size=16).digest()) != state["last"]:
            state["last"] = mark
            state["shown"] += 1
            yield text
        return
    for place, item in reader.take():
        # after a new beginning, places that were shown before aren't shown again
        if place < state["shown"] or (place > state["shown"] and state["stuck"]):
            continue
        try:
            checked = check(schema, item)
        except Invalid:  # an invalid item holds back those behind it
            state["stuck"] = True
            continue
        state["shown"], state["stuck"] = state["shown"] + 1, False
        yield dumps(checked)


def _rows(frame: pd.DataFrame) -> list[dict[str, Any]]:
    columns = [c.astype(object).where(c.notna(), None).tolist() if c.hasnans else c.tolist() for c in (frame[name] for name in IN_COLUMNS)]
    return [dict(zip(IN_COLUMNS, row, strict=True)) for row in zip(*columns, strict=True)]


_KINDS = {"seq": "Int64", "kind": "object", "body": "object", "input_tokens": "Int64", "output_tokens": "Int64", "total_tokens": "Int64", "attempts": "Int32"}


_ARROW_KINDS = {"seq": pa.int64(), "kind": pa.string(), "body": pa.string(), "input_tokens": pa.int64(), "output_tokens": pa.int64(), "total_tokens": pa.int64(), "attempts": pa.int32()}


def _frame(said: list[dict[str, Any]], stream_id: int) -> pd.DataFrame:
    columns = {name: pd.Series([row.get(name) for row in said], dtype=kind) for name, kind in _KINDS.items()}
    return pd.DataFrame({"stream_id": pd.Series([stream_id] * len(said), dtype="int64"), **columns})


def _stream(deltas: DataFrame, schema: Schema, items: bool, ttl_ms: int | None) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = pickle.loads(held.get[0]) if held.exists else fresh()
        rows = [row for frame in frames for row in _rows(frame)]
        said = feed(state, rows, schema, items)
        if any(r["eos"] for r in rows) and not state["parked"]:
            if held.exists:
                held.remove()
        else:
            held.update((pickle.dumps(state, protocol=5),))
            if ttl_ms is not None:
                held.setTimeoutDuration(ttl_ms)
        if said:
            yield _frame(said, key[0])

    # a run that ends when its input does (availableNow) must not wait for timers
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return deltas.groupBy("stream_id").applyInPandasWithState(step, OUT_SCHEMA, STATE_SCHEMA, "append", timeout)


def partial_objects(deltas: DataFrame, schema: Schema, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Snapshots of each stream's object, one whenever it changes."""
    return _stream(deltas, schema, False, ttl_ms)


def list_items(deltas: DataFrame, item_schema: Schema, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """The items of each stream's list, in order, each as soon as it is whole and valid."""
    return _stream(deltas, item_schema, True, ttl_ms)


def usage(deltas: DataFrame) -> DataFrame:
    """The highest usage of each stream's sides, once, without reading its text.

    Streams that report none have no row. Counts are added as those of one attempt.
    """
    sides = deltas.groupBy("stream_id").agg(F.max("input_tokens").alias("a"), F.max("output_tokens").alias("b")).filter("a is not null or b is not null")
    a, b = (F.coalesce(c, F.lit(0).cast("long")) for c in ("a", "b"))
    return sides.select("stream_id", a.alias("input_tokens"), b.alias("output_tokens"), (a + b).alias("total_tokens"), F.lit(1).alias("attempts"))


def replay(deltas: DataFrame, schema: Schema, items: bool | None) -> DataFrame:
    """The same over a finished table (items None: usage and end only); a stream's rows come
    together, as its buffer must."""

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in IN_COLUMNS]
        said = feed(fresh(), [dict(zip(IN_COLUMNS, row, strict=True)) for row in zip(*columns, strict=True)], schema, items)
        stream = pa.array([columns[0][0]] * len(said), pa.int64())
        return pa.table([stream, *(pa.array([row.get(name) for row in said], kind) for name, kind in _ARROW_KINDS.items())], ["stream_id", *_ARROW_KINDS])

    return deltas.select(*IN_COLUMNS).groupBy("stream_id").applyInArrow(run, OUT_SCHEMA)
