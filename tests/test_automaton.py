"""The resumable JSON reader against the readers of whole buffers."""

from __future__ import annotations

import json
import pickle
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from structex.functions import schema as S
from structex.streaming import streams
from structex.streaming.automaton import Reader, dumps
from structex.streaming.partial import MISSING, complete_paths, parse_incomplete, snapshot

SCHEMAS = [
    None,
    S.obj(a=S.integer(), b=S.string().optional(), c=S.array(S.obj(a=S.integer().default(3)))),
    S.array(S.obj(a=S.integer())),
    S.record(S.integer()),
    S.obj(items=S.array(S.union(S.integer(), S.string()))),
    S.string(),
]
LEAVES = st.one_of(
    st.none(), st.booleans(), st.integers(-(10**20), 10**20), st.floats(allow_nan=False, allow_infinity=False),
    st.text(st.sampled_from('ab "\\\n\té🙂 {}[]:,u0'), max_size=40),
)
VALUES = st.recursive(LEAVES, lambda v: st.one_of(st.lists(v, max_size=4), st.dictionaries(st.sampled_from(["a", "b", "c", "items", 'x "y\\']), v, max_size=4)), max_leaves=12)


def pieces(text, sizes):
    at, out, k = 0, [], 0
    while at < len(text):
        out.append(text[at : at + sizes[k % len(sizes)]])
        at, k = at + sizes[k % len(sizes)], k + 1
    return out


def whole_buffers(deltas, schema):
    buffer, shown = "", []
    for delta in deltas:
        buffer += delta
        value = parse_incomplete(buffer)
        value = value if value is MISSING else snapshot(value, schema, complete_paths(buffer))
        shown.append(None if value is MISSING else dumps(value))
    return shown


def piecewise(deltas, schema, keep):
    reader, shown = Reader(schema), []
    for delta in deltas:
        reader.feed(delta)
        shown.append(reader.shown())
        if keep:
            reader = Reader(schema).restore(pickle.loads(pickle.dumps(reader.state())))
    return shown


@settings(max_examples=400, deadline=None)
@given(
    VALUES, st.sampled_from(SCHEMAS), st.lists(st.integers(1, 12), min_size=1, max_size=5), st.booleans(), st.booleans(),
    st.sampled_from([("", ""), ("Here: ", ""), ("```json\n", "\n```"), ("so ```JSON ", " bye"), ("`` ", ""), (" \n", "\n ")]),
)
def test_every_snapshot_is_that_of_the_buffer(value, schema, sizes, spaced, keep, around):
    text = around[0] + json.dumps(value, ensure_ascii=spaced, indent=1 if spaced else None) + around[1]
    deltas = pieces(text, sizes)
    assert piecewise(deltas, schema, keep) == whole_buffers(deltas, schema)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from('{}[]",:\\ue0123truefalsn-.` \n'), max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=4))
def test_what_is_no_json_never_raises(text, sizes):
    for items in (False, True):
        reader = Reader(SCHEMAS[1], items)
        for delta in pieces(text, sizes):
            reader.feed(delta)
            reader.take() if items else reader.shown()
            reader = Reader(SCHEMAS[1], items).restore(pickle.loads(pickle.dumps(reader.state())))


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ('{"a":1,"a":2', '{"a":2}'),
        ('{"a":1 "b":2', '{"a":1,"b":2}'),
        ('{"b":"\\ud83d', '{"b":"?"}'),
        ('{"b":"\\ud83d\\ude00', '{"b":"😀"}'),
        ("[[[" * 3_000, None),
        ("[1,2] and ```json\n{", "{}"),
        ('{"a":"x\ny"}', None),
        ("[tru", "[true]"),
        ("[trap", "[]"),
    ],
)
def test_odd_texts(text, shown):
    reader = Reader(None)
    for delta in pieces(text, [1]):
        reader.feed(delta)
    got = reader.shown()
    assert got == shown if shown is not None else got is None or set(got) <= set("[]")


@pytest.mark.parametrize("wrapped", [False, True])
@pytest.mark.parametrize("tail", ["", "\n```", ', "more": 1'])
def test_items_come_once_and_leave_no_state(wrapped, tail):
    items = [{"id": k, "kind": "x" * (k % 7)} for k in range(300)]
    text = json.dumps({"first": [1, 2], "items": items} if wrapped else items)
    text = text[:-1] + tail + "}" if wrapped and tail.startswith(",") else "```json\n" + text + (tail if not tail.startswith(",") else "")
    said, state, sizes = [], streams.fresh(), []
    deltas = pieces(text, [7, 3, 31])
    for seq, delta in enumerate(deltas):
        rows = [{"seq": seq, "delta": delta, "marker": None, "input_tokens": None, "output_tokens": None, "eos": seq == len(deltas) - 1}]
        said += streams.feed(state, rows, S.obj(id=S.integer(), kind=S.string()), True)
        held = pickle.dumps(state)
        state, sizes = pickle.loads(held), [*sizes, len(held)]
    # the last item of a bare list is known to be whole while nothing follows it
    got = [json.loads(x["body"]) for x in said if x["kind"] == "item"]
    assert got in (items, items[:-1]) and (got == items or tail == "\n```")
    assert max(sizes) < 1_500


def test_time_is_linear_in_a_text():
    def seconds(n):
        text = json.dumps({"items": [{"id": k, "note": "some words " * 5} for k in range(n)]})
        reader, deltas = Reader(S.obj(id=S.integer(), note=S.string()), items=True), pieces(text, [9])
        began = time.process_time()
        for delta in deltas:
            reader.feed(delta)
            reader.take()
        return time.process_time() - began

    seconds(200)
    assert min(seconds(8_000) for _ in range(2)) < 16 * max(0.01, min(seconds(1_000) for _ in range(3)))


def test_one_long_string_is_read_once():
    reader, n = Reader(None), 0
    began = time.process_time()
    reader.feed('{"a":"')
    for k in range(20_000):
        reader.feed(f"word {k} \\u00e9 ")
        n += 1
    assert time.process_time() - began < 3
    reader.feed('"}')
    assert reader.shown() == dumps({"a": "".join(f"word {k} é " for k in range(20_000))})
