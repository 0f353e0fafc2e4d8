"""Schemas, JSON, validation, citations, streams, clients: values worked out by hand."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from structex.functions import account
from structex.functions import schema as S
from structex.functions.jsonx import last_span, loads_partial, spans, strict_json
from structex.functions.validate import coerce, issues, plain_json
from structex.operators import chunk, cite, modes, retry, score
from structex.sources import clients, pdf, synth
from structex.streaming import partial, streams


def test_unsupported_kinds_raise():
    with pytest.raises(S.SchemaError, match="Unsupported"):
        S.obj(a=S.unsupported("tuple")).json_schema()


def test_description_and_default_on_the_wire():
    schema = S.obj(a=S.integer().default(3).describe("n"), b=S.string().optional())
    assert schema.json_schema()["required"] == ["a"]
    assert schema.json_schema()["properties"]["a"] == {"type": "integer", "description": "n"}
    assert schema.spark_type()["a"].metadata == {"comment": "n"}


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ('a {"x": 1} b {"y": 2}', '{"y": 2}'),
        ("```json\n[1, 2]\n``` and {not json}", "[1, 2]"),
        ('{"s": "a } b"} tail {', '{"s": "a } b"}'),
        ("nothing here", None),
        ("{ open [1]", "[1]"),
    ],
)
def test_last_span(text, span):
    assert last_span(text) == span


@pytest.mark.parametrize(
    ("text", "value"),
    [('{"a": 1, "b', {"a": 1}), ('{"a": "x', {"a": "x"}), ('{"a": 12', {"a": 12}), ('[1, {"b": tr', [1, {"b": True}]), ('{"a":', {}), ('{"a": "x\\', {"a": "x"})],
)
def test_partial_json(text, value):
    assert loads_partial(text) == value


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-999, 999) | st.text(max_size=6),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=4), v, max_size=3),
    max_leaves=8,
)


@settings(max_examples=150, deadline=None)
@given(json_values.filter(lambda v: isinstance(v, (dict, list))), st.integers(0, 400))
def test_partial_json_never_fails_on_prefixes(value, n):
    text = json.dumps(value, ensure_ascii=False)
    assert loads_partial(text) == value
    prefix = text[: 1 + n % len(text)]
    loads_partial(prefix)
    assert partial.complete_paths(prefix) is not None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n,;", max_size=300), st.integers(1, 40))
def test_recursive_chunks_are_whole(text, size):
    bounds = chunk.split_recursive(text, size)
    assert "".join(text[a:b] for a, b in bounds) == text
    assert all(0 < b - a <= size for a, b in bounds)
    assert all(x[1] == y[0] for x, y in zip(bounds, bounds[1:]))


def test_strict_json(spark):
    cases = {"1": "1", "1 2": None, "1,2": None, '{"a":1} x': None, "[1,]": None, "": None, "NaN": None, ' {"b":[1]} ': '{"b":[1]}'}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.to_json(strict_json(F.col("t"))).alias("v")).collect()
    assert {r.t: r.v for r in rows} == cases


def test_three_null_states(spark):
    schema = S.obj(a=S.string().nullable(), b=S.integer().optional(), c=S.integer().default(4))
    texts = ['{"a":null}', '{"a":"x","b":null}', '{"b":2}', '{"a":"x","c":null,"z":1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.parse_json("t"))
    out = df.select(issues(schema, F.col("v")).alias("i"), coerce(schema, F.col("v")).alias("d"), plain_json(schema, F.col("v")).alias("p")).collect()
    assert [[i.path for i in r.i] for r in out] == [[], ["b"], ["a"], ["c"]]
    assert out[0].d.c == 4 and out[0].p == '{"a":null,"c":4}'


@pytest.mark.parametrize(
    ("quote", "source", "span"),
    [("b c", "a b c d", (2, 5)), ("B  C", "a b\n c d", (2, 6)), ("zz", "a", None), ("  ", "a", None), ("x y", "x  y", (0, 4))],
)
def test_locate(quote, source, span):
    assert cite.locate(quote, source) == span


def _spans_plainly(text):
    """Each opener tried by itself, one character at a time."""

    def close(start):
        stack, quoted, i = [], False, start
        while i < len(text):
            c = text[i]
            if quoted:
                i += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append({"{": "}", "[": "]"}[c])
            elif c in "}]":
                if stack.pop() != c:
                    return None
                if not stack:
                    return i + 1
            i += 1
        return None

    found, at = [], 0
    while at < len(text):
        end = close(at) if text[at] in "{[" else None
        found += [] if end is None else [(at, end)]
        at = end or at + 1
    return found


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from('{}[]"\\a\n'), max_size=40))
def test_spans_equal_each_opener_tried(text):
    assert spans(text) == _spans_plainly(text)


@pytest.mark.parametrize("text", ["[" * 1_000_000, '{"' * 500_000, '["\\"' * 200_000, "[{" * 300_000 + "}]" * 299_999, '{"a": [' * 100_000 + '"\\' * 100_000])
def test_spans_take_linear_time(text):
    import time

    began = time.process_time()
    spans(text)
    assert time.process_time() - began < 4


def feed(pieces, schema, items=False, marker=None):
    rows = [dict(seq=i, delta=p, marker=None, input_tokens=3, output_tokens=i, eos=False) for i, p in enumerate(pieces)]
    rows.append(dict(seq=len(pieces), delta=None, marker=marker, input_tokens=None, output_tokens=None, eos=True))
    return streams.feed(streams.fresh(), rows[::-1], schema, items)  # out of order on purpose


def test_partial_stream():
    schema = S.obj(name=S.string(), age=S.integer())
    said = feed(['{"name": "Al', 'ice", "age": ', '"x"', "}"], schema)
    assert [s["body"] for s in said if s["kind"] == "partial"][:2] == ['{"name":"Al"}', '{"name":"Alice"}']
    assert said[-1]["kind"] == "usage" and said[-1]["total_tokens"] == 3 + 3


def test_invalid_item_blocks():
    said = feed(['[{"id": 1}, {"id": "x"}, {"id": 3}, ', "4]"], S.obj(id=S.integer()), items=True)
    assert [s["body"] for s in said if s["kind"] == "item"] == ['{"id":1}']


def test_stream_that_shows_nothing():
    assert feed(["no json"], S.obj(a=S.string()), marker="length")[-1]["kind"] == "OutputTruncatedError"
    assert feed(["no json"], S.obj(a=S.string()))[-1]["kind"] == "JsonParseError"


def test_knobs():
    for check, bad in ((account.check_token_budget, 0), (account.check_max_retries, -1), (account.check_timeout, 2**31), (account.check_timeout, 1.5)):
        with pytest.raises(ValueError):
            check(bad)
    with pytest.raises(ValueError, match="not supported"):
        account.check_streaming(5, None)


def test_waves_stop(spark):
    calls = spark.range(6).withColumnRenamed("id", "call_id")
    ask = lambda df, n: df.withColumn("outcome", F.when(F.col("call_id") < 2 * n, F.lit("success")).otherwise(F.lit("continue" if n < 4 else "exhausted")))
    got = retry.run_waves(calls, ask, lambda d: d.cache()).groupBy("call_id").agg(F.max("attempt").alias("n")).collect()
    assert {r.call_id: r.n for r in got} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}


def test_clients():
    class Chat:
        class chat:
            class completions:
                @staticmethod
                def create(**kwargs):
                    return {"said": kwargs["model"]}

    client = clients.to_client(Chat())
    assert client.default_mode == modes.TOOLS
    assert client.make()({"model": "m"}) == {"said": "m"}
    assert clients.from_provider("anthropic/x").default_mode == modes.ANTHROPIC_TOOLS
    with pytest.raises(ValueError, match="unknown provider"):
        clients.route("nowhere/x")
    with pytest.raises(TypeError):
        clients.to_client(object())


def test_deadline_stops_calls(spark):
    client = clients.with_timeout(clients.CallClient(lambda: lambda body: {"said": body["x"]}), None, signal_at=1.0)
    got = client.ask(spark.createDataFrame([(1, '{"x": 2}')], "call_id long, body string")).first()
    assert (got.raw, got.error) == (None, "timeout")
    live = clients.with_timeout(client, 60_000)
    assert live.ask(spark.createDataFrame([(1, '{"x": 2}')], "call_id long, body string")).first().raw == '{"said": 2}'


def test_errors_and_hooks(spark):
    from structex.plans import errors, hooks

    one = lambda status: spark.createDataFrame([(status, 5)], "status string, data int")
    assert errors.collect_one(one("merged")) == 5
    for status, kind in (("conflict", errors.DocumentConflictError), ("exceeded", errors.TokenBudgetError), ("truncated", errors.OutputTruncatedError)):
        with pytest.raises(kind):
            errors.collect_one(one(status))
    seen = []

    def broken(_):
        raise RuntimeError("no")

    both = hooks.combine({"request": broken, "usage": broken}, {"usage": seen.append})
    with pytest.warns(UserWarning, match="no"):
        hooks.replay(both, [{"call_id": 1, "attempt": 1, "event_seq": i, "event": e} for i, e in enumerate(("request", "usage"))])
    assert len(seen) == 1


def test_live_loop_asks_again(spark):
    from structex.plans.pipeline import extract

    schema = S.obj(n=S.integer())

    class Fake:
        default_mode = modes.JSON_SCHEMA

        def ask(self, requests):
            good = F.size("messages") > 1
            text = F.when(good, F.lit('{"n":1}')).otherwise(F.lit('{"n":"x"}'))
            raw = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
            return requests.withColumns({"raw": raw, "error": F.lit(None).cast("string")})

    calls = spark.range(2).select(F.col("id").alias("call_id"), F.lit("m").alias("model"), F.array(modes.text_message("user", F.lit("go"))).alias("messages"))
    got = extract(calls, schema, Fake()).groupBy("call_id").agg(F.max("attempt").alias("n"), F.max("data.n").alias("v")).collect()
    assert {(r.n, r.v) for r in got} == {(2, 1)}


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|")
    (tmp_path / "b.pdf").write_bytes(b"\xff\xfe")
    got = pdf.read_pages(spark, str(tmp_path), lambda b: b.decode().split("|")).orderBy("path", "page_number").collect()
    assert [(r.page_number, r.text) for r in got if r.error is None] == [(1, "one"), (2, "two"), (3, "")]
    assert sum(r.error is not None for r in got) == 1
    with pytest.raises(ValueError, match="empty"):
        pdf.extract_pages(b"", list)


def test_long_document_scores(spark):
    """Planted facts are all found and none twice, by chunks, a rule client and the entity merge."""
    from structex.plans.pipeline import Options, extract_documents
    from structex.sources.clients import RuleClient

    doc = synth.generate(seed=42, pages=20, planted_count=20)
    assert synth.generate(seed=42, pages=20, planted_count=20) == doc
    line = r"Transaction (SKU.[0-9]+): [^\n]*?([0-9][0-9,]*\.[0-9]{2})"

    def raw(_):
        keys, amounts = (F.regexp_extract_all("chunk_text", F.lit(line), F.lit(i)) for i in (1, 2))
        item = lambda k, a: F.struct(F.translate(k, " ", "-").alias("sku"), F.regexp_replace(a, ",", "").cast("double").alias("amount"))
        args = F.to_json(F.struct(F.zip_with(keys, amounts, item).alias("items")))
        call = F.struct(F.struct(args.alias("arguments")).alias("function"))
        return F.to_json(F.struct(F.array(F.struct(F.struct(F.array(call).alias("tool_calls")).alias("message"))).alias("choices")))

    schema = S.obj(items=S.array(S.obj(sku=S.string(), amount=S.number())))
    docs = spark.createDataFrame([(1, doc.text)], "doc_id long, text string")
    options = Options(chunk_size=4000, overlap=100, chunker=chunk.fixed, dedupe_by="sku")
    items = extract_documents(docs, schema, RuleClient(raw), "List transactions.", options=options).select(F.inline("data.items"))
    planted = spark.createDataFrame([(i, p.sku, p.amount) for i, p in enumerate(doc.planted)], "ord int, sku string, amount double")
    assert score.recall(planted, items).first().recall == 1.0
    assert score.duplicate_rate(items).first().duplicate_rate < 0.05


def _reply(text):
    """A content reply of 10 tokens that says text."""
    message = F.array(F.struct(F.struct(text.alias("content")).alias("message")))
    usage = F.struct(F.lit(6).alias("prompt_tokens"), F.lit(4).alias("completion_tokens"))
    return F.to_json(F.struct(message.alias("choices"), usage.alias("usage")))


def _documents(spark, options, text, client_fails=None):
    """A run over 3 documents of 5 chunks and a blank one; what was asked, and the rows."""
    from structex.plans.pipeline import extract_documents

    asked = spark.sparkContext.accumulator(0)

    class Counting:
        default_mode = modes.JSON_SCHEMA

        def ask(self, requests):
            nonlocal asked
            asked += requests.count()
            bad = F.lit(False) if client_fails is None else client_fails
            error = F.when(bad, F.lit("down"))
            return requests.withColumns({"raw": F.when(~bad, _reply(text)), "error": error})

    docs = spark.createDataFrame([(i, "x" * 50) for i in range(3)] + [(9, " \n")], "doc_id long, text string")
    schema = S.obj(n=S.array(S.integer()))
    rows = {r.doc_id: r for r in extract_documents(docs, schema, Counting(), "go", options=options).collect()}
    return asked.value, rows


def test_a_budget_stops_calls(spark):
    from structex.plans.pipeline import Options

    base = {"chunk_size": 10, "overlap": 0, "chunker": chunk.fixed}
    asked, rows = _documents(spark, Options(**base), F.lit('{"n":[1]}'))
    assert asked == 15 and rows[0].status == "merged" and rows[0].chunks == 5
    assert (rows[9].status, rows[9].reason, rows[9].chunks) == ("no_data", "empty-document", 0)
    asked, rows = _documents(spark, Options(**base, token_budget=20), F.lit('{"n":[1]}'))
    assert asked == 6 and (rows[1].status, rows[1].reason, rows[1].chunks, rows[1].tokens) == ("interrupted", "token-budget", 2, 20)


def test_abort_stops_calls_and_tells_what_failed(spark):
    from structex.plans.pipeline import Options

    options = Options(chunk_size=10, overlap=0, chunker=chunk.fixed, on_chunk_error="abort")
    asked, rows = _documents(spark, options, F.lit('{"n":[1]}'), client_fails=(F.col("doc_id") == 1) & (F.col("chunk_index") == 2))
    assert asked == 5 + 3 + 5 and rows[0].status == "merged"
    assert (rows[1].status, rows[1].chunks, rows[1].failed) == ("chunk_error", 3, 1)
    (error,) = rows[1].chunk_errors
    assert (error.chunk_index, error.start_index, error.end_index, error.cause) == (2, 20, 30, "provider_error")


def test_chunks_retry_and_have_budgets_of_their_own(spark):
    from structex.plans.pipeline import Options

    base = {"chunk_size": 25, "overlap": 0, "chunker": chunk.fixed}
    asked, rows = _documents(spark, Options(**base, max_retries=2), F.lit('{"n":["x"]}'))
    assert asked == 6 * 3 and (rows[0].status, rows[0].reason) == ("no_data", "all-chunks-failed") and rows[0].tokens == 2 * 3 * 10
    asked, rows = _documents(spark, Options(**base, max_retries=2, chunk_token_budget=20), F.lit('{"n":["x"]}'))
    assert asked == 6 * 2 and rows[0].tokens == 2 * 2 * 10


def test_citations_are_part_of_validation(spark):
    from structex.plans.pipeline import read_replies

    schema = S.cited(S.obj(statement=S.string()))
    said = [
        (1, '{"statement":"s","substring_quotes":["THE  sky"]}'),
        (2, '{"statement":"s","substring_quotes":["the sea"]}'),
        (3, '{"statement":1,"substring_quotes":["the sea"]}'),
        (4, '{"statement":"s"}'),
    ]
    rows = spark.createDataFrame(said, "id long, text string").withColumns({"raw": _reply(F.col("text")), "error": F.lit(None).cast("string"), "source": F.lit("Above was the sky.")})
    got = {r.id: r for r in read_replies(rows, schema, modes.JSON_SCHEMA, context=F.col("source")).collect()}
    assert got[1].status == "ok" and got[1].data.substring_quotes == ["the sky"]
    assert got[2].status == "SchemaValidationError" and [i.path for i in got[2].issues] == ["substring_quotes[0]"]
    assert [i.path for i in got[3].issues] == ["statement", "substring_quotes[0]"] and got[4].status == "SchemaValidationError"


def _read_cited(spark, schema, said, source="Above was the sky, and below the deep sea."):
    from structex.plans.pipeline import read_replies

    rows = spark.createDataFrame(list(enumerate(said)), "id long, text string").withColumns(
        {"raw": _reply(F.col("text")), "error": F.lit(None).cast("string"), "source": F.lit(source)}
    )
    return {r.id: r for r in read_replies(rows, schema, modes.JSON_SCHEMA, context=F.col("source")).withColumn("plain", F.to_json("value")).collect()}


def test_citations_at_any_depth(spark):
    fact = S.cited(S.obj(claim=S.string()))
    schema = S.obj(
        facts=S.array(fact), named=S.record(fact).optional(), either=S.union(S.integer(), fact).optional(), maybe=S.cited(S.obj(inner=fact)).nullable()
    )
    quoted = lambda *q: {"claim": "c", "substring_quotes": list(q)}
    said = [
        {"facts": [quoted("THE  sky"), quoted("the deep", "Sea.")], "maybe": None, "more": 1},
        {"facts": [quoted(), quoted("the sky", "the moon")], "maybe": {"inner": quoted("a sun"), "substring_quotes": ["was", "is"]}},
        {"facts": [], "named": {"a.b": quoted("BELOW"), "a": quoted("nowhere")}, "maybe": None},
        {"facts": [], "named": {"a.b": quoted("BELOW")}, "either": quoted("above WAS"), "maybe": None},
        {"facts": [], "either": quoted("no such"), "maybe": None},
        {"facts": [{"claim": "c", "substring_quotes": ["the sky", 7]}], "either": 3, "maybe": None},
        {"facts": [{"claim": "c"}], "maybe": None},
    ]
    got = _read_cited(spark, schema, [json.dumps(x) for x in said])
    paths = {k: [i.path for i in r.issues] for k, r in got.items()}
    assert got[0].status == "ok" and [list(f.substring_quotes) for f in got[0].data.facts] == [["the sky"], ["the deep", "sea."]]
    assert paths[1] == ["facts[1].substring_quotes[1]", "maybe.substring_quotes[1]", "maybe.inner.substring_quotes[0]"]
    assert paths[2] == ["named.a.substring_quotes[0]"]
    assert got[3].status == "ok" and got[3].data.named["a.b"].substring_quotes == ["below"]
    assert json.loads(got[3].plain)["either"]["substring_quotes"] == ["Above was"]
    assert paths[4] == ["either.substring_quotes[0]"]
    assert paths[5] == ["facts[0].substring_quotes[1]"] and paths[6] == ["facts[0].substring_quotes"]
    assert all(r.status == ("ok" if k in (0, 3) else "SchemaValidationError") and (r.data is None) == (r.status != "ok") for k, r in got.items())


def test_long_quotes_are_cut_in_issues(spark):
    got = _read_cited(spark, S.array(S.cited(S.obj())), [json.dumps([{"substring_quotes": ["x" * 121, "y" * 120]}])])
    assert [i.message for i in got[0].issues] == [f'Quote not found in source: "{"x" * 120}…"', f'Quote not found in source: "{"y" * 120}"']
    assert [i.path for i in got[0].issues] == ["[0].substring_quotes[0]", "[0].substring_quotes[1]"]


def test_judged_rules_lead_to_another_attempt(spark):
    from structex.plans.pipeline import extract

    def make():
        """Rules say what they look for; what has it breaks them. Asked about lost, the judge fails."""

        def send(body):
            asked = json.loads(body["messages"][1]["content"])
            if "lost" in asked["candidate_value"]:
                raise RuntimeError("no verdict")
            broken = asked["validation_rule"].split()[-1] in asked["candidate_value"]
            verdict = {"is_valid": not broken, "reason": f"{body['model']} found it" if "m2" in body["model"] else None, "fixed_value": None}
            return {"choices": [{"message": {"content": json.dumps(verdict)}}]}

        return send

    judge = clients.CallClient(make, modes.JSON_SCHEMA)
    item = S.obj(word=S.string().judged("no bad", client=judge)).judged("no worse", model="m2", client=judge)
    schema = S.obj(items=S.array(item), note=S.string().optional().judged("no bad", client=judge))
    texts = {
        1: ["good", "good"], 2: ["bad", "good"], 3: ["worse", "worse"], 4: ["lost", "good"], 5: [None, "bad"], 6: ["bad", "bad"],
    }
    rows = [(str(k), "m1", *v) for k, v in texts.items()]
    calls = spark.createDataFrame(rows, "call_id string, model string, first string, second string")
    calls = calls.withColumn("messages", F.array(modes.text_message("user", F.lit("?"))))
    word = lambda asked: F.when(asked["attempt"] == 1, F.col("first")).otherwise(F.col("second"))
    answer = lambda asked: _reply(F.to_json(F.struct(F.array(F.struct(word(asked).alias("word"))).alias("items"))))
    got = extract(calls, schema, clients.RuleClient(answer, modes.MD_JSON), max_retries=1, carry=("first", "second")).withColumn("again", F.to_json(F.col("messages")[F.size("messages") - 1])).collect()
    seen = {(r.call_id, r.attempt): (r.outcome, [(i.path, i.message) for i in r.issues or []]) for r in got}
    broken = ("items[0].word", "Value failed validation: no bad")
    assert seen["1", 1] == ("success", []) and ("1", 2) not in seen
    assert seen["2", 1] == ("continue", [broken]) and seen["2", 2] == ("success", [])
    assert seen["3", 1] == ("continue", [("items[0]", "m2 found it")]) and seen["3", 2][0] == "exhausted"
    assert seen["4", 1][0] == "judge_error" and ("4", 2) not in seen
    assert seen["5", 1][1] == [("items[0].word", "Required")] and seen["5", 2] == ("exhausted", [broken])
    assert seen["6", 2] == ("exhausted", [broken])
    asked_again = next(r for r in got if (r.call_id, r.attempt) == ("2", 1)).again
    assert "items[0].word: Value failed validation: no bad" in asked_again


def test_a_lost_verdict_is_no_consent(spark):
    from structex.operators import judge

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "lost"), (4, "failed")], "id long, v string")

    def verdicts(calls):
        said = F.try_variant_get(F.parse_json(F.try_variant_get(calls["messages"][1]["content"], "$", "string")), "$.candidate_value", "string")
        kept = calls.withColumn("said", said).filter("said <> 'lost'")
        valid = F.when(F.col("said") != "failed", F.col("said") == "good")
        return kept.select("k", valid.alias("is_valid"), F.lit(None).cast("string").alias("reason"), F.lit("better").alias("fixed_value"))

    got = {r.id: r for r in judge.judge(rows, "k", F.col("v"), "be good", verdicts).collect()}
    assert got[1].issue is None and "be good" in got[2].issue and got[2].suggestion == "better"
    assert "No verdict" in got[3].issue and "No verdict" in got[4].issue


def test_streams_run_refinements_or_show_nothing():
    adult = lambda plain: S.obj(name=S.string(), age=S.integer()).refine(lambda c: c["age"] >= 18, "too young", plain=plain)
    text = ['[{"name":"a","age":20},', '{"name":"b","age":3},', '{"name":"c","age":40}]']
    bodies = lambda plain: [s["body"] for s in feed(text, adult(plain), items=True) if s["kind"] == "item"]
    assert bodies(lambda v: v["age"] >= 18) == ['{"name":"a","age":20}'] and bodies(None) == []


def test_windows_equal_the_plain_form(spark):
    """Chunks cut in one pass, against cutting each from its document; code points beyond the BMP too."""
    texts = [(1, "ab🙂\ncd" * 40), (2, "x" * 10), (3, "x" * 20), (4, "one two. three\n\nfour " * 9), (5, " "), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for chunker in (chunk.fixed, chunk.recursive):
        for size, overlap in ((10, 0), (10, 3), (10, 10), (10, 25), (300, 50)):
            got = chunk.chunk_documents(docs, size, overlap, chunker)
            plain = chunk.widen(chunker(chunk.not_blank(docs), size), overlap).drop("text")
            assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    explained = chunk.chunk_documents(docs, 10, 3, lambda d, n: chunk.fixed(d, n)).count()
    assert explained == chunk.chunk_documents(docs, 10, 3, chunk.fixed).count()


def test_reask_in_every_mode(spark):
    """What the next attempt is told, message by message."""
    choice = lambda message: json.dumps({"choices": [{"message": message}]})
    call = {"id": "c1", "type": "function", "function": {"name": "extract", "arguments": '{"n":"x"}'}}
    use = {"type": "tool_use", "id": "u1", "name": "extract", "input": {"n": "x"}}
    said = {"role": "assistant"}
    cases = [
        (modes.TOOLS, choice({"content": None, "tool_calls": [call]}), [said | {"content": None, "tool_calls": [call]}, {"role": "tool", "content": "wrong", "tool_call_id": "c1"}]),
        (modes.TOOLS, choice({"content": "hm"}), [said | {"content": "hm"}, {"role": "user", "content": "wrong"}]),
        (modes.JSON_SCHEMA, choice({"content": '{"n":"x"}'}), [said | {"content": '{"n":"x"}'}, {"role": "user", "content": "wrong"}]),
        (modes.MD_JSON, choice({"content": "```json\n1\n```"}), [said | {"content": "```json\n1\n```"}, {"role": "user", "content": "wrong"}]),
        (
            modes.ANTHROPIC_TOOLS,
            json.dumps({"content": [{"type": "text", "text": "so"}, use, {"type": "thinking"}]}),
            [said | {"content": [{"type": "text", "text": "so"}, use]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u1", "content": "wrong", "is_error": True}]}],
        ),
        (modes.ANTHROPIC_TOOLS, json.dumps({"content": [{"type": "text", "text": "so"}]}), [said | {"content": [{"type": "text", "text": "so"}]}, {"role": "user", "content": "wrong"}]),
        (modes.GEMINI_JSON, json.dumps({"candidates": [{"content": {"parts": [{"text": "{}"}]}}]}), [said | {"content": "{}"}, {"role": "user", "content": "wrong"}]),
    ]
    first = F.array(modes.text_message("user", F.lit("go")))
    for mode, raw, expected in cases:
        (row,) = spark.range(1).select(F.transform(modes.reask(mode, first, F.lit(raw), F.lit("wrong")), lambda m: F.to_json(m)).alias("m")).collect()
        got = [{k: v for k, v in json.loads(m).items() if v is not None or k == "content"} for m in row.m]
        assert got[0] == {"role": "user", "content": "go"} and got[1:] == expected, (mode, got)


def test_dates_do_not_follow_the_session_zone(spark):
    texts = ["2024-03-01", "2024-03-01T12:30:00", "2024-03-01 12:30:00.5", "2024-03-01T12:30:00Z", "2024-03-01T12:30:00+02:00", "no date"]
    rows = spark.createDataFrame([(json.dumps(t),) for t in texts], "j string")

    def micros():
        return [r.m for r in rows.select(F.unix_micros(coerce(S.date(), F.parse_json("j"))).alias("m")).collect()]

    day, half = 1_709_251_200_000_000, 45_000_000_000
    expected = [day, day + half, day + half + 500_000, day + half, day + half - 7_200_000_000, None]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert micros() == expected, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_clients_build_their_sdk_once_and_google_gets_its_shape():
    class Sdk:
        built = 0

        def __init__(self):
            Sdk.built += 1
            self.messages = self.models = self
            self.create = self.generate_content = lambda **body: body

    for adapter in (clients.from_anthropic, clients.from_gemini):
        Sdk.built = 0
        send = adapter(Sdk).make()
        assert [send({"a": i}) for i in range(3)] == [{"a": i} for i in range(3)] and Sdk.built == 1
    body = {"model": "m", "contents": [1], "config": {"max_output_tokens": 5, "responseMimeType": "application/json"}, "systemInstruction": {"parts": []}}
    shaped = clients.gemini_rest(body)
    assert shaped == {"contents": [1], "systemInstruction": {"parts": []}, "generationConfig": {"maxOutputTokens": 5, "responseMimeType": "application/json"}}
    assert clients.from_provider("google/g").make.shape is clients.gemini_rest


def test_a_reply_is_parsed_once_a_mode(spark):
    """What an expression names several times is bound, not computed anew."""
    rows = spark.createDataFrame([("TOOLS", "{}")], "mode string, raw string")
    plan = lambda c: rows.select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(modes.parse_by(F.col("mode"), F.col("raw"))).count("raw#") <= 2 * len(modes.MODES)
    for mode in modes.MODES:
        assert plan(modes.reask(mode, F.array(modes.text_message("user", F.lit("go"))), F.col("raw"), F.lit("no"))).count("raw#") <= 3


def test_md_json_content_is_made_once(spark):
    """The content of a reply goes through the Python step and isn't made again behind it."""
    rows = spark.createDataFrame(
        [
            (1, json.dumps({"choices": [{"message": {"content": c}}]}))
            for c in ('a {"x": 1} b [2]', ' "{}" ', "7", '{"x": 1, "x": 2}', "{x}", "\ufeff\u00a0\n", '{"' * 40 + '{"y": 3}', '["\\"]", {"b": 1}] {')
        ],
        "k int, raw string",
    )
    got = rows.withColumn("p", modes.parse(modes.MD_JSON, F.col("raw")))
    assert got.select("p.value", "p.error")._jdf.queryExecution().executedPlan().toString().count("message.content") == 1
    none, bad = "Response has no JSON content", "Message content is not valid JSON"
    expected = [("[2]", None), ("{}", None), ("7", None), (None, bad), (None, bad), (None, none), ('{"y":3}', None), ('["\\"]",{"b":1}]', None)]
    assert [tuple(r) for r in got.select(F.to_json("p.value"), "p.error").collect()] == expected


def test_overlap_dedupe_is_linear_in_a_key(spark):
    """A key at 20,000 places of windows that meet beyond their neighbours, in one pass; numbers written in two ways are one key."""
    import time

    from structex.operators import merge

    rows = spark.range(20_000).select(
        F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), (F.col("id") * 10).alias("start_index"), (F.col("id") * 10 + 25).alias("end_index"),
        F.parse_json(F.when(F.col("id") % 2 == 0, F.lit('{"items":[7,7]}')).otherwise(F.lit('{"items":[7.0]}'))).alias("value"),
    )
    schema, begin = S.obj(items=S.array(S.number())), time.monotonic()
    got = merge.merge_documents(rows, schema).select(F.size(F.try_variant_get("value", "$.items", "array<variant>"))).collect()
    open_, kept = [], 0
    for chunk_ in range(20_000):
        for _ in range(2 - chunk_ % 2):
            found = next((o for o in open_ if o != chunk_ and chunk_ - o <= 2), None)
            kept += found is None
            if found is not None:
                open_.remove(found)
            open_.append(chunk_)
        open_ = [o for o in open_ if chunk_ - o <= 3]
    assert got == [(kept,)] and time.monotonic() - begin < 60
