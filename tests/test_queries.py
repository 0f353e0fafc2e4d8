"""Every registered query of the extraction engine against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from structex.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if isinstance(value, decimal.Decimal) else value


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = db.execute(SQL[name])
    there = [d[0] for d in found.description]
    assert sorted(there) == columns
    expected = [tuple(plain(r[there.index(c)]) for c in columns) for r in found.fetchall()]
    assert in_order([tuple(plain(r[c]) for c in columns) for r in got.collect()]) == in_order(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_fold_equals_a_plain_matching(spark):
    """dedupe_fold has no SQL: the greedy matching, written out, on windows that overlap widely."""
    import re

    from structex.operators import chunk

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 30").select("doc_id", "text")
    wide = chunk.widen(chunk.fixed(chunk.not_blank(docs), 150), 200).collect()
    by_doc = {}
    for r in sorted(wide, key=lambda r: (r.doc_id, r.chunk_index)):
        state = by_doc.setdefault(r.doc_id, {"open": {}, "kept": []})
        for word in re.findall("[A-Za-z]{6,}", r.chunk_text):
            pool = state["open"].setdefault(word, [])
            hit = next((o for o in pool if o[0] != r.chunk_index and o[1] < r.end_index and r.start_index < o[2]), None)
            if hit:
                pool.remove(hit)
            else:
                state["kept"].append(word)
            pool.append((r.chunk_index, r.start_index, r.end_index))
    got = {r.doc_id: r.n_items for r in QUERIES["dedupe_fold"](spark, DATA).collect()}
    assert {d: len(s["kept"]) for d, s in by_doc.items()} == {d: got[d] for d in by_doc}


def test_streams_carry_all_events(spark):
    """Every item adds at least one snapshot, the last one has them all, and usage is of the whole text."""
    from pyspark.sql import functions as F

    from structex.functions import schema as S
    from structex.plans import queries_streams as q
    from structex.streaming import streams

    sources = {r.stream_id: r["items"] for r in q._sources(spark, DATA).collect()}
    shown = {r.stream_id: r.snapshots for r in QUERIES["stream_complete"](spark, DATA).collect()}
    assert shown.keys() == sources.keys() and all(shown[s] >= len(items) for s, items in sources.items())
    texts = q._sources(spark, DATA).select("stream_id", F.to_json(F.struct("items")).alias("text")).cache()
    whole = {r.stream_id: r.text for r in texts.collect()}
    said = streams.replay(q._deltas(texts, F.col("text")), S.obj(items=S.array(S.obj(id=S.integer(), kind=S.string()))), items=False).cache()
    last = said.filter("kind = 'partial'").groupBy("stream_id").agg(F.max_by("body", "seq").alias("body")).collect()
    assert {r.stream_id: r.body for r in last} == whole
    usage = {r.stream_id: r.output_tokens for r in said.filter("kind = 'usage'").collect()}
    assert usage == {s: -(-len(t) // q.PIECE) for s, t in whole.items()}


@pytest.mark.parametrize(
    "odd",
    [
        pytest.param([(100, ""), (101, " \n\t"), (102, None)], id="blank texts"),
        pytest.param([(1, "a"), (11, "b" * 5000), (11, "b" * 5000), (5, "")], id="ids that repeat"),
        pytest.param([(-i - 1, "a" * 2500) for i in range(20)], id="ids of other rows' blank documents"),
        pytest.param([(None, "a"), (None, "a"), (None, "")], id="no ids"),
    ],
)
def test_no_data_equals_sql_on_odd_documents(spark, tmp_path, odd):
    docs = [(i, "a" * (1 + 700 * (i % 9))) for i in range(60)] + odd
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["no_data"](spark, str(tmp_path)).select("doc_id", "reason").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert in_order(map(tuple, got)) == in_order(con.execute(f"SELECT doc_id, reason FROM ({SQL['no_data']})").fetchall())
