"""Half-arrived JSON: what of it is final, and what may be shown."""

from __future__ import annotations

import re
from typing import Any

from structex.functions.jsonx import Incomplete, loads, loads_partial
from structex.functions.schema import Schema

_FENCE = re.compile(r"```(?:json)?\s*(.*)\Z", re.IGNORECASE | re.DOTALL)
_BRACKET = re.compile(r"[{\[]")
MISSING = object()


def json_slice(buffer: str) -> str:
    """What follows the first fence opener, else the first bracket, else everything."""
    if fence := _FENCE.search(buffer):
        return fence[1]
    start = _BRACKET.search(buffer)
    return buffer[start.start() :] if start else buffer


def parse_incomplete(buffer: str) -> Any:
    """The value so far, or MISSING."""
    text = json_slice(buffer).strip()
    try:
        return loads_partial(text) if text else MISSING
    except (ValueError, Incomplete):
        return MISSING


def _child(path: str, key: str | int) -> str:
    return f"{path}[{key}]" if isinstance(key, int) else f"{path}.{key}" if path else key


def _children(value: Any) -> list[tuple[str | int, Any]]:
    return list(enumerate(value)) if isinstance(value, list) else list(value.items()) if isinstance(value, dict) else []


def complete_paths(buffer: str) -> set[str]:
    """Paths of subtrees that can't change any more: all of a whole JSON text; else, level by level,
    every sibling but the last, into which the search goes on."""
    text = json_slice(buffer).strip()
    done: set[str] = set()
    if not text:
        return done
    try:
        pending, value = [], loads(text)
        closed = [("", value)]
    except ValueError:
        value = parse_incomplete(buffer)
        if value is MISSING:
            return done
        pending, closed = [("", value)], []
    while pending:
        path, value = pending.pop()
        children = _children(value)
        closed += [(_child(path, k), v) for k, v in children[:-1]]
        pending += [(_child(path, k), v) for k, v in children[-1:]]
    while closed:
        path, value = closed.pop()
        done.add(path)
        closed += [(_child(path, k), v) for k, v in _children(value)]
    return done


class Invalid(ValueError):
    pass


def check(schema: Schema, value: Any) -> Any:
    """The validated value in Python (unknown keys dropped, defaults filled), or Invalid.

    Refinements run in their plain form; a value with one that has none is not valid here.
    """
    value = _shaped(schema, value)
    if value is not MISSING and value is not None and not all(c.plain is not None and c.plain(value) for c in schema.checks):
        raise Invalid
    return value


def _shaped(schema: Schema, value: Any) -> Any:
    if value is MISSING:
        if schema.has_default:
            return schema.default_value
        if schema.is_optional:
            return MISSING
        raise Invalid
    if value is None:
        if schema.is_nullable:
            return None
        raise Invalid
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    match schema.kind:
        case "object" if isinstance(value, dict):
            out = {k: check(f, value.get(k, MISSING)) for k, f in schema.fields}
            return {k: v for k, v in out.items() if v is not MISSING}
        case "array" if isinstance(value, list):
            return [check(schema.element, v) for v in value]
        case "record" if isinstance(value, dict):
            return {k: check(schema.element, v) for k, v in value.items()}
        case "union":
            for option in schema.options:
                try:
                    return check(option, value)
                except Invalid:
                    continue
        case "string" if isinstance(value, str):
            return value
        case "date" if isinstance(value, str) or number:
            return value
        case "enum" | "literal" if value in schema.values and isinstance(value, bool) == isinstance(schema.values[0], bool):
            return value
        case "boolean" if isinstance(value, bool):
            return value
        case "number" if number:
            return value
        case "int" if number and float(value).is_integer():
            return int(value)
    raise Invalid


def snapshot(value: Any, schema: Schema | None, done: set[str], path: str = "") -> Any:
    """What may be shown: closed subtrees only if valid, open ones as far as they came."""
    if schema is None:
        return value
    if path in done:
        try:
            return check(schema, value)
        except Invalid:
            return MISSING
    if schema.kind == "object" and isinstance(value, dict):
        fields = dict(schema.fields)
        out = {k: snapshot(v, fields.get(k), done, _child(path, k)) for k, v in value.items()}
        return {k: v for k, v in out.items() if v is not MISSING}
    if schema.kind == "array" and isinstance(value, list):
        out = [snapshot(v, schema.element, done, _child(path, i)) for i, v in enumerate(value)]
        return [v for v in out if v is not MISSING]
    return value
