"""JSON over columns: strict parsing to VARIANT, kinds of values, and pure-Python tolerant JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text trimming understands it, the byte order mark included.
BLANK = r"(?U)[\s\x{FEFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body names it.

    A Column that stands in an expression twice is computed twice, and nested ones multiply. An array
    of one binds it.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


#: Anything else.
_SOLID = r"(?U)[^\s\x{FEFF}]"


def is_blank(text: Column) -> Column:
    return ~text.rlike(_SOLID)


def trim_text(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def strict_json(text: Column) -> Column:
    """The parsed value as VARIANT; null unless the whole text is one JSON value.

    The VARIANT parser stops after the first value, so what a JSON text may end with is checked:
    a value re-read with a closing bracket around it must still be one value.
    """
    def read(t: Column) -> Column:
        wrapped = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        one = F.size(F.try_variant_get(wrapped, "$", "array<variant>")) == 1
        return F.when(F.coalesce(one, F.lit(False)), F.try_parse_json(t))

    return let(text, read)


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path, or null if it is missing or isn't of the kind asked for."""
    return F.try_variant_get(value, path, kind)


#: What the name of a VARIANT's type begins with, and the kind it is.
_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object"}


def kind_of(value: Column) -> Column:
    """missing, null, string, boolean, number, array or object.

    The type is asked for once: this stands in most expressions, several times in some.
    """
    known = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    found = F.try_element_at(known, F.substring_index(F.schema_of_variant(value), "<", 1))
    return F.coalesce(found, F.when(value.isNull(), F.lit("missing")).otherwise(F.lit("number")))


def _of_kind(value: Column, path: str, kind: str, typed: str) -> Column:
    return let(at(value, path), lambda found: F.when(kind_of(found) == kind, F.try_variant_get(found, "$", typed)))


def text_at(value: Column, path: str) -> Column:
    """The string at a path; null if there is none or something else."""
    return _of_kind(value, path, "string", "string")


def number_at(value: Column, path: str) -> Column:
    return _of_kind(value, path, "number", "double")


def items_at(value: Column, path: str) -> Column:
    """The array at a path as ARRAY<VARIANT>; null for anything else."""
    return F.try_variant_get(value, path, "array<variant>")


# -- Python side: used inside Arrow functions and the streaming operators -----------


def _refuse(name: str) -> None:
    raise ValueError(name)


_STRICT = json.JSONDecoder(parse_constant=_refuse)


def loads(text: str) -> Any:
    """Strict JSON: no NaN or infinities, no trailing text."""
    if text.startswith("\ufeff"):
        raise ValueError("a byte order mark")
    return _STRICT.decode(text)


_CLOSER = {"{": "}", "[": "]"}
_OPENER, _MARK = re.compile(r"[{\[]"), re.compile(r'[{}\[\]"]')
#: What a JSON object or array begins with, and failures to read one after which the decoder rests.
_JSON_BEGINS, _FAILURES = re.compile(r'\{[ \t\r\n]*["}]|\[[ \t\r\n]*["{\[\]\-0-9tfn]'), 16
_REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.DOTALL)


def spans(text: str) -> list[tuple[int, int]]:
    """Bounds of balanced bracket spans, left to right; spans don't nest in the result.

    Brackets inside strings don't count. An opener that never closes is stepped over; what was
    learned of the text behind it is kept, so that no mark is read on from twice.
    """
    return [(a, b) for a, b, _ in _spans(text)]


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """spans(), each with whether it is known to be JSON.

    The decoder goes first where JSON may begin. Each failure may read on to the text's end, so after
    some the brackets alone are read.
    """
    found, at_, ends, inside, failed = [], 0, {}, {}, 0
    while (opener := _OPENER.search(text, at_)) is not None:
        start = opener.start()
        if start not in ends:
            if failed < _FAILURES and _JSON_BEGINS.match(text, start):
                try:
                    at_ = _STRICT.raw_decode(text, start)[1]
                except (ValueError, RecursionError):
                    failed += 1
                else:
                    found.append((start, at_, True))
                    continue
            _close(text, start, ends, inside)
        if ends[start] is None:
            at_ = start + 1
        else:
            found.append((start, ends[start], False))
            at_ = ends[start]
    return found


def _close(text: str, start: int, ends: dict[int, int | None], inside: dict[int, int]) -> None:
    """Where the opener at start closes, and all openers in it that aren't in strings; None if one doesn't.

    inside: the opener around each quote and opener from which the text was read on before. What is
    read from such a mark on ends where that opener does.
    """
    open_, at_ = [start], start + 1
    while (mark := _MARK.search(text, at_)) is not None:
        here, c = mark.start(), mark[0]
        at_ = here + 1
        if c in "}]":
            if _CLOSER[text[open_[-1]]] != c:
                break
            ends[open_.pop()] = at_
            if not open_:
                return
        elif here in inside:
            around = ends[inside[here]]
            if around is None:
                break
            at_ = around - 1
        else:
            inside[here] = open_[-1]
            if c == '"':
                at_ = _REST_OF_STRING.match(text, at_).end() + 1
                if at_ > len(text) or text[at_ - 1] != '"':
                    break
            elif here not in ends:
                open_.append(here)
            elif ends[here] is None:  # what is around it can't close either
                break
            else:
                at_ = ends[here]
    ends.update(dict.fromkeys(open_))


def last_span(text: str) -> str | None:
    """The last balanced span that is JSON."""
    for a, b, is_json in reversed(_spans(text)):
        try:
            if not is_json:
                loads(text[a:b])
        except ValueError:
            continue
        return text[a:b]
    return None


class Incomplete(ValueError):
    """Nothing can be read yet."""


def loads_partial(text: str) -> Any:
    """Read JSON that may break off: open strings and numbers are kept, an open key is dropped."""
    reader = _Partial(text)
    reader.space()
    return reader.value()


class _Partial:
    def __init__(self, text: str):
        self.text, self.i = text, 0

    def space(self) -> None:
        while self.i < len(self.text) and self.text[self.i] in " \t\r\n":
            self.i += 1

    @property
    def here(self) -> str:
        return self.text[self.i] if self.i < len(self.text) else ""

    def value(self) -> Any:
        c = self.here
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c == '"':
            return self.string()[0]
        rest = self.text[self.i :]
        for word, meaning in (("true", True), ("false", False), ("null", None)):
            if rest and (rest.startswith(word) or word.startswith(rest)):
                self.i += min(len(word), len(rest))
                return meaning
        return self.number()

    def number(self) -> Any:
        start = self.i
        while self.here and self.here in "+-0123456789.eE":
            self.i += 1
        token = self.text[start : self.i]
        while token:
            try:
                return loads(token)
            except ValueError:
                if self.here:
                    raise
                token = token[:-1]
        raise Incomplete

    def string(self) -> tuple[str, bool]:
        """The text, and whether its closing quote was there."""
        start = self.i
        self.i += 1
        while self.here:
            if self.here == "\\":
                self.i += 2
            elif self.here == '"':
                self.i += 1
                return loads(self.text[start : self.i]), True
            else:
                self.i += 1
        self.i = len(self.text)
        body = self.text[start:]
        for cut in range(min(7, len(body))):  # a broken escape at the end goes
            try:
                return loads(body[: len(body) - cut] + '"'), False
            except ValueError:
                continue
        return "", False

    def array(self) -> list:
        self.i += 1
        out: list = []
        while True:
            self.space()
            if not self.here:
                return out
            if self.here == "]":
                self.i += 1
                return out
            if self.here == ",":
                self.i += 1
                continue
            try:
                out.append(self.value())
            except Incomplete:
                return out

    def object(self) -> dict:
        self.i += 1
        out: dict = {}
        while True:
            self.space()
            if not self.here:
                return out
            if self.here == "}":
                self.i += 1
                return out
            if self.here == ",":
                self.i += 1
                continue
            if self.here != '"':
                raise ValueError("a key was expected")
            key, closed = self.string()
            self.space()
            if not closed or self.here != ":":
                return out
            self.i += 1
            self.space()
            if not self.here:
                return out
            try:
                out[key] = self.value()
            except Incomplete:
                return out
