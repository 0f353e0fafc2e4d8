"""Merges read their values once, and tasks tell items apart as struct_key does."""

import json

from pyspark.sql import functions as F

from structex.functions import schema as S
from structex.operators import merge

WINDOW = "doc_id long, chunk_index int, start_index int, end_index int, text string"


def values(spark, rows):
    return spark.createDataFrame(rows, WINDOW).select("doc_id", "chunk_index", "start_index", "end_index", F.parse_json("text").alias("value"))


def merged(df, schema, **options):
    rows = merge.merge_documents(df, schema, **options).select("doc_id", F.to_json("value").alias("v"), "conflicts").collect()
    return {r.doc_id: (json.loads(r.v), r.conflicts) for r in rows}


def test_values_are_read_once(spark):
    df = values(spark, [(1, 0, 0, 9, '{"a":1,"items":[{"k":1,"n":null}]}'), (1, 1, 5, 14, '{"a":2,"items":[{"k":1.0,"n":3}]}')])
    schema = S.obj(a=S.integer(), items=S.array(S.obj(k=S.number(), n=S.integer().nullable())))
    for options in ({"dedupe_by": "k"}, {"dedupe": "none"}, {"on_conflict": "error"}):
        plan = merge.merge_documents(df, schema, **options)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Expand" not in plan, options
    assert merged(df, schema, dedupe_by="k", on_conflict="error") == {1: ({"a": 1, "items": [{"k": 1, "n": 3}]}, ["a"])}


def test_mixed_fields(spark):
    """A field that is an array in some chunks only has its first value; null and missing stay apart."""
    schema = S.obj(x=S.array(S.string()), y=S.string().nullable().optional())
    rows = [
        (1, 1, 5, 14, '{"x":"late"}'), (1, 0, 0, 9, '{"x":["a","b,\\"["],"y":null}'),
        (2, 0, 0, 9, '{"x":"first"}'), (2, 1, 5, 14, '{"x":["a"]}'),
        (3, 0, 0, 9, '{"x":null}'), (4, 0, 0, 9, '{"x":[]}'), (4, 1, 5, 14, '{"x":["\\\\","é\\n"]}'),
        (5, 0, 0, 9, None), (5, 1, 5, 14, "7"),
    ]
    want = {1: {"x": ["a", 'b,"['], "y": None}, 2: {"x": "first"}, 3: {"x": None}, 4: {"x": ["\\", "é\n"]}, 5: {}}
    for dedupe in ("overlap", "none"):
        assert {d: v for d, (v, _) in merged(values(spark, rows), schema, dedupe=dedupe).items()} == want
    got = merged(values(spark, [(1, 0, 0, 9, '["a",null]'), (1, 1, 5, 14, '["a",null,"b"]'), (2, 0, 0, 9, "null"), (3, 0, 0, 9, '"x"')]), S.array(S.string()))
    assert {d: v for d, (v, _) in got.items()} == {1: ["a", None, "b"], 2: [], 3: []}


def test_keys_of_tasks_equal_struct_keys(spark):
    inner = S.obj(n=S.number(), t=S.array(S.string()), u=S.union(S.string(), S.number()))
    items = ["1", "1.0", "-0", "0", '"1"', "null", "[]", "{}", '{"n":1}', '{"n":1.0,"t":null}', '{"n":1,"t":null}', '{"n":"1","t":["a","b"]}', '{"n":"1","t":["a,b"]}',
             '{"t":"a"}', '{"t":["a","b"],"n":"1"}', '{"u":[1]}', '{"u":[1.0]}', '{"u":10}', '{"u":1e1}', '{"n":{"b":1,"a":2}}', '{"n":{"a":2,"b":1}}', '{"n":true}', "true"]
    for element in (inner, S.number(), S.string(), S.array(S.number())):
        for by in ([], ["n"], ["n", "t"]):
            if by and element is not inner:
                continue
            df = spark.createDataFrame([("[" + ",".join(items) + "]",)], "t string").select(F.parse_json("t").alias("v"))
            key = (lambda v: merge.entity_key(v, by, element)) if by else (lambda v: merge.struct_key(v, element))  # noqa: B023
            row = df.select(F.transform(F.try_variant_get("v", "$", "array<variant>"), key).alias("k"), F.to_json("v").alias("j")).first()
            keys, _ = merge._reader(element, by)([row.j])[0]
            pairs = [(a, b) for a in range(len(items)) for b in range(a)]
            assert [(items[a], items[b]) for a, b in pairs if (row.k[a] == row.k[b]) != (keys[a] == keys[b])] == [], (element.kind, by)


def test_dates_are_one_by_instant(spark):
    df = values(spark, [(1, 0, 0, 9, '{"x":["2020-01-01T00:00:00Z","2021-01-01"]}'), (1, 1, 5, 14, '{"x":["2020-01-01T01:00:00+01:00"]}')])
    assert merged(df, S.obj(x=S.array(S.date()))) == {1: ({"x": ["2020-01-01T00:00:00Z", "2021-01-01"]}, [])}
