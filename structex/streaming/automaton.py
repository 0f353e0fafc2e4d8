"""A JSON reader that takes a text in pieces and never reads a character twice.

Its state is the stack of open containers and the leaf being read. A child is done when a further
one of its container has come: from then on it is shown as its schema has it, and its part of the
snapshot is rendered once. What is open is shown as far as it came, and a text that is one whole
JSON value is checked as a whole. The readers in partial.py say the same of a whole buffer.

What stands around the JSON is left out as they do: reading begins anew at the first bracket and at
the first fence. In a text that isn't JSON, reading goes on as long as it can be told what was meant
(commas too many or missing, a bracket of the other kind) and stops at a key that isn't one, a number
that isn't one or a bad string. A key that comes again counts where it stands last.
"""

from __future__ import annotations

import json
import re
from typing import Any

from structex.functions.jsonx import loads
from structex.functions.schema import Schema
from structex.streaming.partial import MISSING, Invalid, check

_BRACKET = re.compile(r"[{\[]")
_IN_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.DOTALL)
_SOUND = re.compile(r'(?:[^"\\\x00-\x1f]+|\\u[0-9a-fA-F]{4}|\\["\\/bfnrt])*')
_HIGH = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}")
_NUMERIC = "+-0123456789.eE"
_NUMBER = re.compile(r"[-+0-9.eE]*")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}
_SPACE = " \t\r\n"
#: Characters at the end of an open string that may still turn out to be part of an escape.
_TAIL = 12


_ENCODER = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)
_QUOTED = json.encoder.encode_basestring


def dumps(value: Any) -> str:
    """Compact JSON; half a surrogate pair becomes a question mark, as no text can hold it."""
    text = _QUOTED(value) if value.__class__ is str else repr(value) if value.__class__ is int else _ENCODER.encode(value)
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


class _Dead(Exception):
    """The text can't be read on."""


class Node:
    """An open container, or a closed one that is still the last child of its parent."""

    def __init__(self, brace: str):
        self.brace, self.raw, self.text = brace, {} if brace == "{" else [], ""
        #: Whether the last child isn't done, its key, and the container if it is one.
        self.has_last, self.key, self.last = False, None, None
        #: What came last: first (nothing), child, comma; key and colon before a value.
        self.came, self.pending = "first", None


class String:
    """A string being read: what is decoded for good, and the tail."""

    def __init__(self, is_key: bool):
        self.is_key, self.good, self.tail = is_key, "", ""
        #: A backslash came last; something came that can't be in a string.
        self.escaped = self.bad = False

    def end(self, text: str, at: int) -> int | None:
        """Where the closing quote is in a further piece of the text."""
        begin = at + 1 if self.escaped else at
        stop = _IN_STRING.match(text, begin).end() if begin <= len(text) else begin
        self.escaped = stop < len(text) and text[stop] == "\\"
        return stop if stop < len(text) and not self.escaped else None

    def add(self, text: str) -> None:
        if self.bad:
            return
        self.tail += text
        limit = len(self.tail) - _TAIL
        if limit <= 0:
            return
        stop = _SOUND.match(self.tail, 0, limit).end()
        if stop < limit and _SOUND.match(self.tail, stop, stop + 6).end() == stop:
            # so far from the end, it can't be half an escape
            self.bad = True
            return
        stop = len(self.tail[:stop].rstrip())
        if _HIGH.match(self.tail, max(0, stop - 6), stop):
            stop -= 6
        self.good += loads('"' + self.tail[:stop] + '"')
        self.tail = self.tail[stop:]

    def so_far(self) -> str:
        if self.bad:
            return ""
        body = self.tail.rstrip()
        for cut in range(min(7, len(body) + 1)):
            try:
                return self.good + loads('"' + body[: len(body) - cut] + '"')
            except ValueError:
                continue
        return ""

    def closed(self) -> str:
        if self.bad:
            raise _Dead
        try:
            return self.good + loads('"' + self.tail + '"')
        except ValueError:
            raise _Dead from None


def _number(token: str) -> Any:
    """The number so far, or MISSING."""
    while token:
        try:
            return loads(token)
        except ValueError:
            token = token[:-1]
    return MISSING


def below(schema: Schema | None, brace: str, key: Any) -> Schema | None:
    """The schema of a child; None where there is none to hold it against."""
    if schema is None:
        return None
    if schema.kind == "object" and brace == "{":
        return next((f for k, f in schema.fields if k == key), None)
    return schema.element if schema.kind == "array" and brace == "[" else None


class Value:
    """One JSON value that arrives in pieces.

    With items its list (the root, or what the root has as items) gives its elements out as they are
    done and keeps none. render says whether done children are rendered, for shown().
    """

    def __init__(self, schema: Schema | None, items: bool = False, render: bool = True):
        self.schema, self.items, self.render = schema, items, render and not items
        self.root: Any = MISSING
        self.stack: list[Node] = []
        self.schemas: list[Schema | None] = []
        self.leaf: String | None = None
        self.token = ""
        self.dead = self.over = self.loose = self.trailing = False
        self.ready: list[Any] = []

    _KEPT = ("stack", "leaf", "token", "dead", "over", "loose", "trailing")

    def state(self) -> tuple:
        """All but the schema, for pickle; ready has been taken before."""
        return (self.root is not MISSING, None if self.root is MISSING else self.root, *(getattr(self, name) for name in self._KEPT))

    def restore(self, state: tuple) -> Value:
        self.root = state[1] if state[0] else MISSING
        for name, value in zip(self._KEPT, state[2:], strict=True):
            setattr(self, name, value)
        self.schemas = []
        for node in self.stack:
            above = self.stack[len(self.schemas) - 1] if self.schemas else None
            self.schemas.append(self.schema if above is None else below(self.schemas[-1], above.brace, above.key))
        return self

    def feed(self, text: str) -> None:
        at = 0
        try:
            while at < len(text) and not self.over and not self.dead:
                at = self._step(text, at)
        except (_Dead, RecursionError):
            self.dead, self.root, self.stack, self.leaf = True, MISSING, [], None
        if self.over and text[at:].strip():
            self.trailing = True

    def _step(self, text: str, at: int) -> int:
        """Read on from a place; the place after what was read."""
        if self.leaf is not None:
            return self._string(text, at)
        if self.token:
            return self._word(text, at) if self.token[0] in _WORDS else self._numeral(text, at)
        c = text[at]
        if not self.stack:
            if not c.isspace() and not self._begin(c):
                raise _Dead
            return at + 1
        if c in _SPACE:
            return at + 1
        node = self.stack[-1]
        if node.came == "key":
            if c != ":":
                self._leave()
                return at
            node.came = "colon"
            return at + 1
        if node.came == "colon":
            return at + 1 if self._begin(c) else self._left(at)
        if c == ",":
            self.loose |= node.came != "child"
            node.came = "comma"
            return at + 1
        if c == ("}" if node.brace == "{" else "]"):
            self.loose |= node.came == "comma"
            self._close()
            return at + 1
        self.loose |= node.came == "child"
        if node.brace == "[":
            return at + 1 if self._begin(c) else self._left(at)
        if c != '"':
            raise _Dead
        self.leaf = String(True)
        return at + 1

    def _begin(self, c: str) -> bool:
        """Begin a value, if this character can."""
        if c in "{[":
            self._came(Node(c))
        elif c == '"':
            self._came("")
            self.leaf = String(False)
        elif c in _WORDS:
            self._came(_WORDS[c][1])
            self.token = c
        elif c in _NUMERIC:
            if c in "0123456789":
                self._came(int(c))
            self.token = c
        else:
            return False
        return True

    def _came(self, value: Any) -> None:
        """A new value is there: the child before it is done."""
        inner = isinstance(value, Node)
        if not self.stack:
            self.root, schema = value, self.schema
        else:
            node = self.stack[-1]
            self._settle(len(self.stack) - 1)
            if node.brace == "{":
                node.key = node.pending
                if node.key in node.raw:
                    self._forget(node)
            schema = below(self.schemas[-1], node.brace, node.key)
            node.has_last, node.last, node.came = True, value if inner else None, "child"
            plain = value.raw if inner else value
            if node.brace == "{":
                node.raw[node.key] = plain
            else:
                node.raw.append(plain)
        if inner:
            self.stack.append(value)
            self.schemas.append(schema)

    def _forget(self, node: Node) -> None:
        """A key comes again: what it had goes."""
        del node.raw[node.key]
        node.text = ""
        for key, value in node.raw.items():
            self._show(node, self.schemas[-1], key, value)

    def _put(self, value: Any) -> None:
        """The last child (or the root), a leaf, has another value now."""
        if not self.stack:
            self.root = value
        elif (node := self.stack[-1]).brace == "{":
            node.raw[node.key] = value
        else:
            node.raw[-1] = value

    def _is_list(self, level: int) -> bool:
        """Whether this container gives its elements out."""
        node = self.stack[level]
        return node.brace == "[" and (level == 0 or (level == 1 and self.stack[0].brace == "{" and self.stack[0].key == "items"))

    def _settle(self, level: int) -> None:
        """The last child of an open container is done."""
        node = self.stack[level]
        if not node.has_last:
            return
        node.has_last = False
        if not self.items:
            self._show(node, self.schemas[level], node.key, node.raw[node.key] if node.brace == "{" else node.raw[-1])
        elif self._is_list(level):
            self._give(node)
        elif level == 0 and node.brace == "{":
            if node.key == "items" and node.last is not None and node.last.brace == "[":
                self._give(node.last)
            del node.raw[node.key]

    def _give(self, node: Node) -> None:
        self.ready += node.raw
        node.raw.clear()

    def _show(self, node: Node, schema: Schema | None, key: Any, value: Any) -> None:
        if not self.render:
            return
        own = below(schema, node.brace, key)
        if own is not None:
            try:
                value = check(own, value)
            except Invalid:
                return
            if value is MISSING:
                return
        part = dumps(value) if node.brace == "[" else f"{dumps(key)}:{dumps(value)}"
        node.text = f"{node.text},{part}" if node.text else part

    def _close(self) -> None:
        self.stack.pop()
        self.schemas.pop()
        self.over = not self.stack

    def _leave(self) -> None:
        """A container breaks off; what comes next is read in the one around it."""
        self.loose = True
        self._close()

    def _left(self, at: int) -> int:
        self._leave()
        return at

    def _string(self, text: str, at: int) -> int:
        leaf = self.leaf
        end = leaf.end(text, at)
        leaf.add(text[at:] if end is None else text[at:end])
        if end is None:
            return len(text)
        self.leaf, value = None, leaf.closed()
        if leaf.is_key:
            self.stack[-1].pending, self.stack[-1].came = value, "key"
        else:
            self._put(value)
            self.over = not self.stack
        return end + 1

    def _word(self, text: str, at: int) -> int:
        word = _WORDS[self.token[0]][0]
        more = text[at : at + len(word) - len(self.token)]
        if not word.startswith(self.token + more):
            self._no_word()
            return len(text)
        self.token += more
        if self.token == word:
            self.token, self.over = "", not self.stack
        return at + len(more)

    def _no_word(self) -> None:
        """What began like a word is none: lists around it break off, an object can't be read on."""
        if not self.stack:
            raise _Dead
        self.token, node = "", self.stack[-1]
        if node.brace == "{":
            del node.raw[node.key]
        else:
            node.raw.pop()
        node.has_last = False
        self._leave()
        while self.stack:
            if self.stack[-1].brace == "{":
                raise _Dead
            self._leave()
        self.trailing = True

    def _numeral(self, text: str, at: int) -> int:
        end = _NUMBER.match(text, at).end()
        before = _number(self.token)
        self.token += text[at:end]
        value = _number(self.token)
        if value is not MISSING:
            self._came(value) if before is MISSING else self._put(value)
        if end < len(text):
            token, self.token = self.token, ""
            try:
                loads(token)
            except ValueError:
                raise _Dead from None
            self.over = not self.stack
        return end

    def whole(self) -> bool:
        """Whether the text so far is one JSON value and nothing else."""
        if self.root is MISSING or self.stack or self.leaf is not None or self.loose or self.trailing:
            return False
        if not self.token:
            return True
        try:
            loads(self.token)
        except ValueError:
            return False
        return True

    def take(self) -> list[Any]:
        """Elements that are done and weren't taken before."""
        if self.items and isinstance(self.root, Node) and self.whole():
            node = self.root
            if node.brace == "{" and node.has_last and node.key == "items" and node.last is not None:
                node = node.last
            if node.brace == "[":
                self._give(node)
        ready, self.ready = self.ready, []
        return ready

    def shown(self) -> str | None:
        """What may be shown so far, as JSON; None if nothing may."""
        if self.root is MISSING:
            return None
        value: Any = self.root
        if self.whole():
            try:
                plain = value.raw if isinstance(value, Node) else value
                plain = plain if self.schema is None else check(self.schema, plain)
            except Invalid:
                return None
            return None if plain is MISSING else dumps(plain)
        out, closers = [], []
        while isinstance(value, Node):
            node = value
            out.append(node.brace + node.text)
            closers.append("}" if node.brace == "{" else "]")
            if not node.has_last:
                break
            if node.text:
                out.append(",")
            if node.brace == "{":
                out.append(f"{dumps(node.key)}:")
            value = node.last if node.last is not None else node.raw[node.key] if node.brace == "{" else node.raw[-1]
        else:
            out.append(dumps(self.leaf.so_far() if self.leaf is not None and not self.leaf.is_key else value))
        return "".join(out + closers[::-1])


class Reader:
    """A reply that arrives in pieces: the value in it, wherever it begins."""

    def __init__(self, schema: Schema | None, items: bool = False, render: bool = True):
        self.make = lambda: Value(schema, items, render)
        self.value = self.make()
        #: Whether a bracket came; backticks at the end; what follows a fence as long as it may be its language.
        self.bracket, self.ticks, self.fence = False, 0, None
        self.taken = 0

    def state(self) -> tuple:
        return self.bracket, self.ticks, self.fence, self.taken, self.value.state()

    def restore(self, state: tuple) -> Reader:
        self.bracket, self.ticks, self.fence, self.taken = state[:4]
        self.value.restore(state[4])
        return self

    def feed(self, text: str) -> None:
        if self.fence is None:
            text = "`" * self.ticks + text
            fence = text.find("```")
            if fence >= 0:
                self.value, self.fence, self.taken = self.make(), "", 0
                text = text[fence + 3 :]
            else:
                seen, self.ticks = self.ticks, len(text) - len(text.rstrip("`"))
                self._before_fence(text[seen:])
                return
        if self.fence != "json":
            text = self.fence + text
            start = text[:4].lower()
            if len(text) < 4 and "json".startswith(start):
                self.fence = text
                return
            text = text[4:] if start == "json" else text
            self.fence = "json"
        self.value.feed(text)

    def _before_fence(self, text: str) -> None:
        if not self.bracket and (first := _BRACKET.search(text)):
            self.bracket, self.value = True, self.make()
            text = text[first.start() :]
        self.value.feed(text)

    def shown(self) -> str | None:
        return self.value.shown()

    def take(self) -> list[tuple[int, Any]]:
        """Elements that are done, with their places."""
        ready = list(enumerate(self.value.take(), self.taken))
        self.taken += len(ready)
        return ready
