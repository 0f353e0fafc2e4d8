"""A document's chunks asked one after another, inside the task that has the document.

Where later chunks depend on what earlier ones cost or on whether they failed, and where a document
has a deadline, its calls can't run side by side. Chunks are dealt by document and sorted, and each
task asks its documents' chunks in order: the number of jobs doesn't depend on how many chunks there
are, nothing is asked behind the chunk that a document stops at, and a document's clock begins
with its first chunk.

Between calls the task has to know whether a reply is good, what it cost and what to say about it.
That is what the plain readers below are for; they say what the column expressions of modes,
account and validate say, which read the last reply of each chunk again for its value.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from structex.functions import account
from structex.functions.jsonx import last_span, loads
from structex.functions.schema import Check, Schema
from structex.functions.validate import BROKEN, FIX, INVALID, expected
from structex.operators import cite, modes, nested

_MISSING = object()
_BLANK = "﻿"


def decidable(schema: Schema) -> bool:
    """Whether a task can tell by itself if a value is valid: no judges, no dates, and all refinements plain."""
    return not nested.within(schema, lambda s: bool(s.judges) or s.kind == "date" or any(c.plain is None for c in s.checks))


# -- replies, plainly --------------------------------------------------------------


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key comes twice")
    return dict(pairs)


def _strict(text: Any) -> Any:
    """The one JSON value that a text is, as the column parser has it."""
    if not isinstance(text, str):
        return _MISSING
    try:
        loads(text)
        return json.loads(text, object_pairs_hook=_unique)
    except (ValueError, RecursionError):
        return _MISSING


def _at(value: Any, *path: str | int) -> Any:
    for step in path:
        if isinstance(step, int) and isinstance(value, list) and step < len(value):
            value = value[step]
        elif isinstance(step, str) and isinstance(value, dict) and step in value:
            value = value[step]
        else:
            return None
    return value


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) else None


def _filled(text: str | None) -> str | None:
    return text if text is not None and text.replace(_BLANK, "").strip() else None


_MESSAGE = ("choices", 0, "message")


def _tool_use(reply: Any) -> dict | None:
    blocks = _at(reply, "content")
    usable = [b for b in blocks if _at(b, "type") == "tool_use" and _text(_at(b, "id")) is not None and _text(_at(b, "name")) is not None] if isinstance(blocks, list) else []
    return usable[0] if usable else None


def _gemini_text(reply: Any) -> str | None:
    parts = _at(reply, "candidates", 0, "content", "parts")
    joined = "".join(_text(_at(p, "text")) or "" for p in parts) if isinstance(parts, list) else None
    return _filled(_text(_at(reply, "text"))) or _filled(joined)


def answer(mode: str, reply: Any) -> Any:
    """The value that a reply carries, or _MISSING."""
    match mode:
        case modes.TOOLS:
            return _strict(_at(reply, *_MESSAGE, "tool_calls", 0, "function", "arguments"))
        case modes.JSON_SCHEMA:
            return _strict(_filled(_text(_at(reply, *_MESSAGE, "content"))))
        case modes.MD_JSON:
            text = _filled(_text(_at(reply, *_MESSAGE, "content")))
            span = last_span(text) if text is not None else None
            value = _strict(span)
            return _strict(text) if value is _MISSING else value
        case modes.ANTHROPIC_TOOLS:
            block = _tool_use(reply)
            given = block["input"] if block is not None and "input" in block else _MISSING
            return _strict(given) if isinstance(given, str) else given
        case modes.GEMINI_JSON:
            return _strict(_gemini_text(reply))
    raise ValueError(mode)


def tokens(reply: Any) -> int | None:
    """The total that a reply reports; None if it reports neither side."""

    def side(names: tuple[str, ...]) -> float | None:
        found = (_at(reply, *place[2:].split("."), name) for place in account.PLACES for name in names)
        return next((x for x in found if isinstance(x, (int, float)) and not isinstance(x, bool)), None)

    a, b = side(account.INPUT), side(account.OUTPUT)
    return None if a is None and b is None else int(a or 0) + int(b or 0)


def truncated(reply: Any) -> bool:
    places = ((*_MESSAGE[:2], "finish_reason"), ("stop_reason",), ("candidates", 0, "finishReason"))
    return any(_at(reply, *place) in account.TRUNCATED for place in places if isinstance(_at(reply, *place), str))


def _kind(value: Any) -> str:
    if value is _MISSING:
        return "missing"
    names = {type(None): "null", str: "string", bool: "boolean", list: "array", dict: "object"}
    return names.get(type(value), "number")


def _fits(schema: Schema, value: Any, kind: str) -> bool:
    match schema.kind:
        case "string" | "number" | "boolean":
            return kind == schema.kind
        case "int":
            return kind == "number" and float(value).is_integer()
        case "enum":
            return kind == "string" and value in schema.values
        case "literal":
            return kind == _kind(schema.values[0]) and value == schema.values[0]
    raise ValueError(schema.kind)


def problems(schema: Schema, value: Any, path: str = "") -> list[tuple[str, str]]:
    """(path, message) of what is wrong with a value, in field order."""
    kind = _kind(value)
    if kind == "missing":
        return [] if schema.is_optional or schema.has_default else [(path, "Required")]
    if kind == "null" and schema.is_nullable:
        return []
    below = lambda key: f"{path}.{key}" if path else key
    wrong = [(path, f"Expected {expected(schema)}, received {kind}")]
    match schema.kind:
        case "object":
            found = [p for k, f in schema.fields for p in problems(f, value.get(k, _MISSING), below(k))] if kind == "object" else wrong
        case "array":
            found = [p for i, v in enumerate(value) for p in problems(schema.element, v, f"{path}[{i}]")] if kind == "array" else wrong
        case "record":
            found = [p for k, v in sorted(value.items()) for p in problems(schema.element, v, below(k))] if kind == "object" else wrong
        case "union":
            found = [] if any(not problems(o, value, path) for o in schema.options) else wrong
        case _:
            found = [] if _fits(schema, value, kind) else wrong
    # refinements see values of the right shape only, whatever other refinements say of their parts
    if not schema.checks or (problems(schema.shape(), value, path) if schema.refined_within() else found):
        return found
    return found + [(".".join([*filter(None, [path]), *c.path]), c.message) for c in schema.checks if not _keeps(c, value)]


def _keeps(check: Check, value: Any) -> bool:
    try:
        return bool(check.plain(value))
    except (TypeError, KeyError, ValueError, AttributeError):  # a part that isn't there
        return False


def quote_problems(schema: Schema, value: Any, source: str, path: str = "") -> list[tuple[str, str]]:
    """(path, message) of quotes that don't stand in the source, outer ones first."""
    below = lambda key: f"{path}.{key}" if path else key
    if not cite.is_cited(schema) or value is _MISSING or value is None:
        return []
    found = []
    if schema.quoted and isinstance(value, dict) and isinstance(value.get("substring_quotes"), list):
        for i, quote in enumerate(value["substring_quotes"]):
            if isinstance(quote, str) and cite.locate(quote, source) is None:
                found.append((f"{below('substring_quotes')}[{i}]", cite.not_found(quote)))
    if schema.kind == "object" and isinstance(value, dict):
        found += [p for k, f in schema.fields for p in quote_problems(f, value.get(k, _MISSING), source, below(k))]
    elif schema.kind == "array" and isinstance(value, list):
        found += [p for i, v in enumerate(value) for p in quote_problems(schema.element, v, source, f"{path}[{i}]")]
    elif schema.kind == "record" and isinstance(value, dict):
        found += [p for k, v in sorted(value.items()) for p in quote_problems(schema.element, v, source, below(k))]
    elif schema.kind == "union":
        option = next((o for o in schema.options if not problems(o, value)), None)
        found += quote_problems(option, value, source, path) if option is not None else []
    return found


def said_wrong(found: list[tuple[str, str]], unread: bool) -> str:
    if unread:
        return BROKEN
    lines = "\n".join(f"- {path or '(root)'}: {message}" for path, message in found)
    return f"{INVALID}{lines}{FIX}"


def asked_again(mode: str, body: dict, reply: Any, text: str) -> dict:
    """The body of the next attempt: what the model said, and what was wrong with it."""
    if mode == modes.GEMINI_JSON:
        turn = lambda role, said: {"role": role, "parts": [{"text": said}]}
        return body | {"contents": [*body["contents"], turn("model", _gemini_text(reply) or ""), turn("user", text)]}
    if mode == modes.ANTHROPIC_TOOLS:
        kept = []
        for block in _at(reply, "content") if isinstance(_at(reply, "content"), list) else []:
            if _at(block, "type") == "tool_use" and _text(_at(block, "id")) is not None:
                name = _text(_at(block, "name"))
                kept.append({"type": "tool_use", "id": block["id"], "name": modes.TOOL_NAME if name is None else name, "input": block.get("input")})
            elif _at(block, "type") == "text" and _text(_at(block, "text")) is not None:
                kept.append({"type": "text", "text": block["text"]})
        use = _tool_use(reply)
        result = text if use is None else [{"type": "tool_result", "tool_use_id": use["id"], "content": text, "is_error": True}]
        more = [{"role": "assistant", "content": kept or None}, {"role": "user", "content": result}]
        return body | {"messages": [*body["messages"], *more]}
    said: dict[str, Any] = {"role": "assistant", "content": _text(_at(reply, *_MESSAGE, "content"))}
    listed = _at(reply, *_MESSAGE, "tool_calls")
    calls = [
        {"id": c["id"], "type": "function", "function": {"name": c["function"]["name"], "arguments": c["function"]["arguments"]}}
        for c in (listed if isinstance(listed, list) else [])
        if all(_text(_at(c, *p)) is not None for p in (("id",), ("function", "name"), ("function", "arguments")))
    ]
    if calls:
        said["tool_calls"] = calls
    follow = {"role": "user", "content": text}
    if mode == modes.TOOLS and calls:
        follow = {"role": "tool", "content": text, "tool_call_id": calls[0]["id"]}
    return body | {"messages": [*body["messages"], said, follow]}


# -- the loop ---------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """When a chunk or its document stops."""

    max_retries: int
    token_budget: int | None = None
    chunk_token_budget: int | None = None
    abort: bool = False
    timeout_ms: int | None = None
    #: Wall-clock time after which no further call starts, whatever the document.
    deadline: float | None = None


@dataclass
class _Document:
    spent: int = 0
    stopped: bool = False
    ends: float | None = None


def _ask(body: str, context: str | None, send: Callable[[dict], tuple], read: Callable[[str], tuple], limits: Limits, doc: _Document) -> tuple:
    """(raw, error, tokens or None if some call didn't tell, attempts, good) of one chunk."""
    request, spent, known = json.loads(body), 0, True
    for attempt in range(1, limits.max_retries + 2):
        late = doc.ends is not None and time.time() >= doc.ends
        raw, error = (None, "timeout") if late else send(request)
        if error is not None:
            return raw, error, spent if known else None, attempt, False
        reply, cost, good, wrong = read(raw, context)
        spent, known = spent + (cost or 0), known and cost is not None
        over = limits.chunk_token_budget is not None and (not known or spent >= limits.chunk_token_budget)
        if good or truncated(reply) or attempt > limits.max_retries or over:
            break
        request = asked_again(read.mode, request, reply, wrong)
    return raw, None, spent if known else None, attempt, good


class _Reader:
    def __init__(self, mode: str, schema: Schema):
        self.mode, self.schema = mode, schema

    def __call__(self, raw: str | None, context: str | None) -> tuple[Any, int | None, bool, str]:
        reply = _strict(raw)
        reply = None if reply is _MISSING else reply
        value = answer(self.mode, reply)
        if value is _MISSING:
            return reply, tokens(reply), False, said_wrong([], True)
        inner = _at(value, "items")
        if self.schema.root_kind() == "array" and isinstance(inner, list):
            value = inner
        found = problems(self.schema, value)
        if context is not None:
            found += quote_problems(self.schema, value, context)
        return reply, tokens(reply), not found, said_wrong(found, False)


def run(chunks: DataFrame, schema: Schema, mode: str, make: Callable[[], Callable[[dict], tuple]], limits: Limits) -> DataFrame:
    """Chunks (doc_id, chunk_index, body, context) with raw, error, tokens, attempts and asked.

    make gives, once per task, what sends a body and returns (raw, error). Other columns come along.
    """
    names = chunks.columns
    more = [("raw", T.StringType()), ("error", T.StringType()), ("tokens", T.LongType()), ("attempts", T.IntegerType()), ("asked", T.BooleanType())]
    schema_out = T.StructType([*chunks.schema.fields, *[T.StructField(n, t) for n, t in more]])
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send, read = make(), _Reader(mode, schema)
        known, doc, started = None, _Document(), False
        for batch in batches:
            out: list[tuple] = []
            for doc_id, body, context in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "context")), strict=True):
                if not started or doc_id != known:
                    known, doc, started = doc_id, _Document(), True
                    ends = [limits.deadline, None if limits.timeout_ms is None else time.time() + limits.timeout_ms / 1000]
                    doc.ends = min((e for e in ends if e is not None), default=None)
                if doc.stopped:
                    out.append((None, None, None, 0, False))
                    continue
                raw, error, cost, attempts, good = _ask(body, context, send, read, limits, doc)
                out.append((raw, error, cost, attempts, True))
                doc.spent += cost or 0
                doc.stopped |= limits.abort and not good
                doc.stopped |= limits.token_budget is not None and (cost is None or doc.spent >= limits.token_budget)
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *[n for n, _ in more]])

    return chunks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index").mapInArrow(task, schema_out)
