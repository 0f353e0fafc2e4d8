"""Readers of many small texts don't make a JSON decoder or encoder for each."""

import json

import pytest

from structex.functions import jsonx
from structex.functions import schema as S
from structex.streaming import streams


@pytest.fixture
def none_made(monkeypatch):
    def refuse(self, *args, **kwargs):
        raise AssertionError("a decoder or an encoder was made")

    monkeypatch.setattr(json.JSONDecoder, "__init__", refuse)
    monkeypatch.setattr(json.JSONEncoder, "__init__", refuse)


def test_last_span(none_made):
    assert jsonx.last_span('{"a":1} and [1,{"b":"}"}] {x}') == '[1,{"b":"}"}]'
    for text in ("NaN", "[1] x", "﻿[]", "[Infinity]"):
        with pytest.raises(ValueError):
            jsonx.loads(text)


def test_streams(none_made):
    schema, text = S.obj(items=S.array(S.obj(id=S.integer(), kind=S.string()))), '{"items":[{"id":1,"kind":"é\\""},{"id":23,"kind":"b"}]}'
    rows = [dict(zip(streams.IN_COLUMNS, (1, i, c, None, 7, i, i + 1 == len(text)), strict=True)) for i, c in enumerate(text)]
    said = streams.feed(streams.fresh(), rows, schema, False)
    assert [r["body"] for r in said if r["kind"] == "partial"][-1] == text and said[-1]["total_tokens"] == 6 + len(text)
