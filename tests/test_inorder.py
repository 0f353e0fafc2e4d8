"""Chunks asked in order in a task, against the column readers and against waves of jobs."""

from __future__ import annotations

import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from structex.functions import account
from structex.functions import schema as S
from structex.functions.validate import reask_text
from structex.operators import chunk, cite, inorder, modes
from structex.plans.pipeline import Options, extract_documents, read_replies
from structex.sources import clients

FACT = S.cited(S.obj(claim=S.string()))
SCHEMA = S.obj(
    n=S.integer(), kind=S.enum("a", "b").optional(), x=S.number().nullable(), facts=S.array(FACT).default([]), by=S.record(S.boolean()).optional(),
    one=S.union(S.literal(7), S.obj(z=S.string())).optional(), age=S.integer().refine(lambda c: c >= 18, "too young", plain=lambda v: v >= 18).optional(),
).refine(lambda c: c["n"] != 13, "unlucky", path=["n"], plain=lambda v: v["n"] != 13)
SOURCE = "The quick brown Fox\njumps over the lazy dog."
ANSWERS = [
    {"n": 1, "x": None}, {"n": 1.0, "x": 2, "kind": "b", "more": 1}, {"n": 1.5, "x": "y"}, {"x": True}, [], "text", None, {"n": 13, "x": 1},
    {"n": 1, "x": 1, "facts": [{"claim": "c", "substring_quotes": ["quick  BROWN"]}]}, {"n": 1, "x": 1, "facts": [{"claim": "c", "substring_quotes": ["cow", "dog", 3]}, {"claim": 1}]},
    {"n": 1, "x": 1, "by": {"b": True, "a.c": 1, "a": None}}, {"n": 1, "x": 1, "one": 7}, {"n": 1, "x": 1, "one": {"z": 1}}, {"n": 1, "x": 1, "age": 3}, {"n": "1", "x": 1, "age": "3"},
    {"n": True, "x": 1, "kind": 3}, {"n": None, "x": 1, "one": False, "facts": {}},
]
TEXTS = [json.dumps(a) for a in ANSWERS] + ["", " ", "{", '{"n":1,"n":2,"x":1}', '{"n":1,"x":1} and more', "NaN", "﻿"]


def _raw(mode, k, text):
    usage = [{"prompt_tokens": 3, "completion_tokens": 4}, {"input_tokens": 5}, {}, {"prompt_tokens": "x"}][k % 4]
    end = ["stop", "length", "max_tokens", None][k % 4]
    if mode == modes.TOOLS:
        calls = [[{"id": "i", "function": {"name": "extract", "arguments": text}}], [{"function": {"name": "extract", "arguments": text}}], [], None][k // 4 % 4]
        return {"choices": [{"message": {"content": [None, "said"][k % 2], "tool_calls": calls}, "finish_reason": end}], "usage": usage}
    if mode in (modes.JSON_SCHEMA, modes.MD_JSON):
        around = "" if mode == modes.JSON_SCHEMA else ["Here: [1] ", "```json\n"][k % 2]
        return {"choices": [{"message": {"content": around + text}, "finish_reason": end}], "usage": usage}
    if mode == modes.ANTHROPIC_TOOLS:
        given = {"input": json.loads(text)} if k % 2 and text.startswith(("{", "[", '"')) and text != "{" and "and more" not in text else {"input": text}
        use = {"type": "tool_use", "id": "u", "name": "extract"} | (given if k % 5 else {})
        return {"content": [{"type": "text", "text": "so"}, use, {"type": "tool_use"}][k % 3 == 2 :], "stop_reason": end, "message": {"usage": usage}}
    return {"candidates": [{"content": {"parts": [{"text": text[:3]}, {}, {"text": text[3:]}]}, "finishReason": ["MAX_TOKENS", "STOP"][k % 2]}], "usageMetadata": {"promptTokenCount": 2}}


@pytest.mark.parametrize("mode", modes.MODES)
def test_plain_readers_say_what_columns_say(spark, mode):
    raws = [(k, json.dumps(_raw(mode, k, text))) for k, text in enumerate(itertools.chain.from_iterable([t] * 4 for t in TEXTS))] + [(998, "no json"), (999, "[]")]
    messages = F.array(modes.text_message("system", F.lit("be brief")), modes.text_message("user", F.lit("go")))
    rows = spark.createDataFrame(raws, "id long, raw string").withColumns({"error": F.lit(None).cast("string"), "source": F.lit(SOURCE)})
    read = read_replies(rows, SCHEMA, mode, context=F.col("source"))
    text = reask_text(F.col("issues"), F.col("value").isNull())
    wire = SCHEMA if mode != modes.JSON_SCHEMA else S.obj(n=S.integer())
    body = lambda m: modes.encode(mode, wire, F.lit("m"), m)
    got = read.select("id", "status", "issues", "usage", text.alias("text"), body(messages).alias("body"), body(modes.reask(mode, messages, F.col("raw"), text)).alias("again")).collect()
    assert len(got) == len(raws) and inorder.decidable(SCHEMA)
    reader, by_id = inorder._Reader(mode, SCHEMA), dict(raws)
    for r in got:
        reply, cost, good, wrong = reader(by_id[r.id], SOURCE)
        value = inorder.answer(mode, reply)
        found = [] if value is inorder._MISSING else [*inorder.problems(SCHEMA, value), *inorder.quote_problems(SCHEMA, value, SOURCE)]
        assert found == [(i.path, i.message) for i in r.issues or []], by_id[r.id]
        assert good == (r.status == "ok") and cost == (r.usage and r.usage.total_tokens), by_id[r.id]
        assert inorder.truncated(reply) == (r.status == "truncated") or good or r.status == "ok"
        if not good:
            assert wrong == r.text
            assert inorder.asked_again(mode, json.loads(r.body), reply, wrong) == json.loads(r.again), by_id[r.id]


def _client(log=None, pause=0.0):
    def make():
        def send(body):
            if pause:
                time.sleep(pause)
            if log is not None:
                log.add(1)
            text, tries = body["messages"][0]["content"].split("---\n\n", 1)[1], len(body["messages"])
            n = len(text.strip("."))
            if n == 9:
                raise RuntimeError("down")
            wrong = n == 8 or (n == 7 and tries == 1)
            usage = {} if n == 6 else {"prompt_tokens": 10, "completion_tokens": 0}
            finish = "length" if n == 5 else "stop"
            return {"choices": [{"message": {"content": json.dumps({"n": ["?"] if wrong or n == 5 else [n]})}, "finish_reason": finish}], "usage": usage}

        return send

    return clients.CallClient(make, modes.JSON_SCHEMA)


class InWaves:
    """The same client, known only by its ask()."""

    def __init__(self, client):
        self.client, self.default_mode = client, client.default_mode

    def ask(self, requests):
        return self.client.ask(requests)


SHAPES = ["11111", "7777", "1181", "8111", "11911", "1161", "6", "1515", "1771", "999", "88"]


def _docs(spark):
    rows = [(i, "".join(("x" * int(c)).ljust(10, ".") for c in shape)) for i, shape in enumerate(SHAPES)] + [(99, " ")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _run(spark, client, **options):
    options = Options(chunk_size=10, overlap=0, chunker=chunk.fixed, max_retries=1, **options)
    rows = extract_documents(_docs(spark), S.obj(n=S.array(S.integer())), client, "go", options=options)
    return sorted(map(str, rows.select("doc_id", "status", "reason", "chunks", "failed", "chunk_errors", "tokens", "usage_available", F.to_json("data"), F.to_json("partial")).collect()))


def test_loop_equals_waves_and_asks_no_more(spark):
    options = {"token_budget": 40, "on_chunk_error": "abort", "chunk_token_budget": 10}
    logs = [spark.sparkContext.accumulator(0) for _ in range(2)]
    in_task = _run(spark, _client(logs[0]), **options)
    in_waves = _run(spark, InWaves(_client(logs[1])), **options)
    assert in_task == in_waves and len(in_task) == len(SHAPES) + 1
    assert logs[0].value == logs[1].value


def test_jobs_do_not_grow_with_chunks(spark):
    def jobs(n):
        docs = spark.createDataFrame([(1, "x" * 10 * n), (2, "x" * 10)], "doc_id long, text string")
        group = f"loop-{n}"
        spark.sparkContext.setJobGroup(group, group)
        options = Options(chunk_size=10, overlap=0, chunker=chunk.fixed, token_budget=10**9, on_chunk_error="abort")
        got = extract_documents(docs, S.obj(n=S.array(S.integer())), _ten(), "go", options=options).select("doc_id", "status", "chunks").collect()
        assert sorted(map(tuple, got)) == [(1, "merged", n), (2, "merged", 1)]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(400) <= jobs(2) + 2


def _ten():
    def make():
        return lambda body: {"choices": [{"message": {"content": '{"n":[1]}'}}], "usage": {"prompt_tokens": 1}}

    return clients.CallClient(make, modes.JSON_SCHEMA)


def test_each_document_has_its_own_deadline(spark):
    docs = spark.createDataFrame([(i, "x" * 10 * n) for i, n in enumerate((1, 2, 2, 40))], "doc_id long, text string").coalesce(1)
    options = Options(chunk_size=10, overlap=0, chunker=chunk.fixed, timeout=1_500)
    got = extract_documents(docs, S.obj(n=S.array(S.integer())), _client(pause=0.2), "go", options=options).collect()
    rows = {r.doc_id: r for r in got}
    # all documents together take longer than one may
    assert [rows[i].status for i in range(3)] == ["merged"] * 3
    assert (rows[3].status, rows[3].reason) == ("interrupted", "timeout") and 3 <= rows[3].chunks < 12 and rows[3].partial is not None


def test_schemas_that_a_task_cannot_decide():
    assert not inorder.decidable(S.obj(d=S.array(S.date())))
    assert not inorder.decidable(S.obj(d=S.string().judged("be good")))
    assert not inorder.decidable(S.obj(d=S.string().refine(lambda c: c != "", "empty")))
    assert inorder.decidable(S.obj(d=FACT)) and cite.is_cited(S.obj(d=FACT)) and account.TRUNCATED


def test_refinements_of_a_whole_see_values_whose_parts_break_theirs(spark):
    """Both say what is wrong, unless the shape is; so a customer can be too young and have a taken name."""
    from structex.functions.validate import issues

    adult = S.integer().refine(lambda c: c >= 18, "too young", plain=lambda v: v >= 18)
    schema = S.obj(age=adult, ages=S.array(adult).optional(), name=S.string()).refine(lambda c: c["name"] != "x", "taken", ["name"], plain=lambda v: v["name"] != "x")
    values = ['{"age":3,"name":"x"}', '{"age":3,"name":"y"}', '{"age":20,"ages":[30,5],"name":"x"}', '{"age":"3","name":"x"}', '{"age":3,"ages":["a"],"name":"x"}']
    rows = spark.createDataFrame(list(enumerate(values)), "id long, raw string").withColumn("i", issues(schema, F.parse_json("raw")))
    got = [[(i.path, i.message) for i in r.i] for r in rows.orderBy("id").collect()]
    young, taken = ("age", "too young"), ("name", "taken")
    assert got == [
        [young, taken], [young], [("ages[1]", "too young"), taken], [("age", "Expected an integer, received string")],
        [young, ("ages[0]", "Expected an integer, received string")],
    ]
    assert got == [inorder.problems(schema, json.loads(v)) for v in values]
