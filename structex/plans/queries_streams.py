"""Registered queries over streams of deltas, made from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structex.functions import schema as S
from structex.operators import modes
from structex.streaming import streams

PIECE = 9


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per user: the JSON text of its events, in order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    items = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))))
    return e.groupBy(F.col("user_id").alias("stream_id")).agg(items.alias("items"))


def _deltas(texts: DataFrame, text: Column) -> DataFrame:
    """(stream_id, text) cut into pieces; usage grows from delta to delta; the last row ends the stream."""
    n = F.length("t")
    cut = texts.withColumn("t", text).select("stream_id", "t", F.posexplode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PIECE))).alias("seq", "at"))
    rows = cut.select(
        "stream_id",
        F.col("seq").cast("long").alias("seq"),
        F.substring("t", F.col("at") + 1, PIECE).alias("delta"),
        F.lit(None).cast("string").alias("marker"),
        F.lit(7).cast("long").alias("input_tokens"),
        (F.col("seq") + 1).cast("long").alias("output_tokens"),
        (F.col("at") + PIECE >= F.length("t")).alias("eos"),
    )
    return rows.withColumn("marker", F.when(F.col("eos") & (F.col("stream_id") % 4 == 0), F.lit("length")))


def _streamed(spark: SparkSession, deltas: DataFrame, make) -> DataFrame:
    """Run a streaming operator to the end over files of deltas and read back what it wrote."""
    import uuid

    from structex.plans.durable import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    deltas.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(deltas.schema).parquet(f"{folder}/in")
    writer = make(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
    writer.option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streams.OUT_SCHEMA).parquet(f"{folder}/out")


SHOWN = S.obj(items=S.array(S.obj(id=S.integer(), kind=S.string())))


def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot of each stream's object, through Structured Streaming."""
    texts = _sources(spark, sf_dir).select("stream_id", F.to_json(F.struct("items")).alias("text"))
    said = _streamed(spark, _deltas(texts, F.col("text")), lambda s: streams.partial_objects(s, SHOWN, None))
    return said.filter("kind = 'partial'").select("stream_id", "seq", F.length("body").cast("long").alias("length"), F.md5("body").alias("body_md5"))


_STREAM_SQL = """s AS (SELECT user_id AS stream_id, list(event_id ORDER BY event_id) AS ids, list(event_type ORDER BY event_id) AS kinds FROM events GROUP BY user_id),
i AS (SELECT stream_id, unnest(ids) AS id, unnest(kinds) AS kind, unnest(generate_series(1, len(ids))) AS ord, len(ids) AS n FROM s)"""
# what came is closed: an open text gets its quote, a key without a value goes, brackets are closed
_SNAPSHOT_SQL = f"""{_STREAM_SQL},
t AS (SELECT stream_id, '{{"items":[' || string_agg('{{"id":' || id || ',"kind":"' || kind || '"}}', ',' ORDER BY ord) || ']}}' AS body FROM i GROUP BY stream_id),
p AS (SELECT stream_id, k AS seq, left(body, CAST((k + 1) * {PIECE} AS INT)) AS p, (k + 1) * {PIECE} >= length(body) AS whole
  FROM (SELECT *, unnest(generate_series(0, CAST(ceil(length(body) / {PIECE}) AS BIGINT) - 1)) AS k FROM t)),
c AS (SELECT stream_id, seq, whole, CASE WHEN regexp_matches(p, '"kind":"[a-z]*$') THEN p || '"'
  WHEN regexp_matches(p, '"kind":"[a-z]+"$') THEN p ELSE regexp_replace(regexp_replace(p, ',?"[a-z]*"?:?$', ''), ',$', '') END AS p FROM p),
d AS (SELECT stream_id, seq, CASE WHEN whole THEN p WHEN contains(p, '[') THEN p || CASE WHEN regexp_matches(p, '\\{{[^}}]*$') AND NOT regexp_matches(p, '\\[$')
  THEN '}}' ELSE '' END || CASE WHEN contains(p, ']') THEN '}}' ELSE ']}}' END ELSE p || '}}' END AS body FROM c),
shown AS (SELECT * FROM d QUALIFY body IS DISTINCT FROM lag(body) OVER (PARTITION BY stream_id ORDER BY seq))"""
STREAM_SNAPSHOTS_SQL = f"WITH {_SNAPSHOT_SQL} SELECT stream_id, seq, CAST(length(body) AS BIGINT) AS length, md5(body) AS body_md5 FROM shown"


def stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items until the first invalid one: the fourth of every third stream has a text as id."""
    bad = (F.col("stream_id") % 3 == 0) & (F.size("items") > 3)
    one = lambda x: F.concat(F.lit('{"id":'), x["id"].cast("string"), F.lit(',"kind":"'), x["kind"], F.lit('"}'))
    body = F.transform("items", lambda x, i: F.when(bad & (i == 3), F.lit('{"id":"x","kind":"view"}')).otherwise(one(x)))
    texts = _sources(spark, sf_dir).select("stream_id", F.concat(F.lit("Here:\n```json\n["), F.array_join(body, ", "), F.lit("]")).alias("text"))
    said = _streamed(spark, _deltas(texts, F.col("text")), lambda s: streams.list_items(s, S.obj(id=S.integer(), kind=S.string()), None))
    return said.filter("kind = 'item'").select("stream_id", F.try_variant_get(F.parse_json("body"), "$.id", "long").alias("id"))


STREAM_ITEMS_SQL = f"WITH {_STREAM_SQL} SELECT stream_id, id FROM i WHERE NOT (stream_id % 3 = 0 AND n > 3) OR ord <= 3"


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest usage of each side, once at the end."""
    texts = _sources(spark, sf_dir).select("stream_id", F.to_json(F.struct("items")).alias("text"))
    return streams.usage(_deltas(texts, F.col("text")))


STREAM_USAGE_SQL = f"""WITH {_STREAM_SQL}, t AS (SELECT stream_id, '{{"items":[' || string_agg('{{"id":' || id || ',"kind":"' || kind || '"}}', ',' ORDER BY ord) || ']}}' AS body
FROM i GROUP BY stream_id)
SELECT stream_id, 7::BIGINT AS input_tokens, CAST(ceil(length(body) / {PIECE}) AS BIGINT) AS output_tokens, CAST(7 + ceil(length(body) / {PIECE}) AS BIGINT) AS total_tokens, 1 AS attempts FROM t"""


def stream_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that never show anything end with an error: cut off, or no JSON. Of three streams one
    sends its kinds as prose, one a list whose first item is no item, one a list of items."""
    k = F.col("stream_id") % 3
    prose, listed = F.array_join("items.kind", " "), F.to_json("items")
    text = F.when(k == 0, prose).when(k == 1, F.concat(F.lit("[0, "), F.substring(listed, 2, 1 << 30))).otherwise(listed)
    texts = _sources(spark, sf_dir).select("stream_id", text.alias("text"))
    said = streams.replay(_deltas(texts, F.col("text")), S.obj(id=S.integer(), kind=S.string()), items=True)
    return said.filter("kind like '%Error'").select("stream_id", "seq", "kind", F.col("body").alias("marker"))


STREAM_END_SQL = f"""WITH {_STREAM_SQL}, t AS (SELECT stream_id, CASE WHEN stream_id % 3 = 0 THEN string_agg(kind, ' ')
  ELSE '[0, ' || string_agg('{{"id":' || id || ',"kind":"' || kind || '"}}', ',') || ']' END AS text FROM i WHERE stream_id % 3 < 2 GROUP BY stream_id)
SELECT stream_id, CAST(ceil(length(text) / {PIECE}) AS BIGINT) - 1 AS seq, CASE WHEN stream_id % 4 = 0 THEN 'OutputTruncatedError' ELSE 'JsonParseError' END AS kind,
  CASE WHEN stream_id % 4 = 0 THEN 'length' END AS marker FROM t"""


def stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many snapshots each stream shows, and how long they are together, by the batch form."""
    texts = _sources(spark, sf_dir).select("stream_id", F.to_json(F.struct("items")).alias("text"))
    said = streams.replay(_deltas(texts, F.col("text")), SHOWN, items=False).filter("kind = 'partial'")
    return said.groupBy("stream_id").agg(F.count("*").alias("snapshots"), F.sum(F.length("body")).alias("characters"))


STREAM_COMPLETE_SQL = f"WITH {_SNAPSHOT_SQL} SELECT stream_id, count(*) AS snapshots, CAST(sum(length(body)) AS BIGINT) AS characters FROM shown GROUP BY stream_id"


def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that one provider chunk adds, in each wire format."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    text, k = F.col("event_type"), F.col("event_id") % 6
    wrap = lambda a, b: F.concat(F.lit(a), F.to_json(text.cast("variant")), F.lit(b))
    raws = {
        modes.TOOLS: wrap('{"choices":[{"delta":{"tool_calls":[{"function":{"arguments":', "}}]}}]}"),
        modes.JSON_SCHEMA: wrap('{"choices":[{"delta":{"content":', "}}]}"),
        modes.MD_JSON: wrap('{"choices":[{"index":0,"delta":{"role":"assistant","content":', "}}]}"),
        modes.ANTHROPIC_TOOLS: wrap('{"delta":{"partial_json":', "}}"),
        modes.GEMINI_JSON: wrap('{"candidates":[{"content":{"parts":[{"text":', "}]}}]}"),
    }
    got = None
    for i, (mode, raw) in enumerate(raws.items()):
        got = F.when(k == i, modes.delta(mode, raw)) if got is None else got.when(k == i, modes.delta(mode, raw))
    return e.select("event_id", got.otherwise(modes.delta(modes.TOOLS, F.lit('{"choices":[]}'))).alias("delta"))


STREAM_DELTA_SQL = "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN event_type ELSE '' END AS delta FROM events"


def stream_running_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest usage so far after each delta, as a batch window."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.max(F.col("event_id") % 50).over(w).alias("output_tokens"))


STREAM_RUNNING_SQL = "SELECT event_id, max(event_id % 50) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS output_tokens FROM events"

QUERIES = {f.__name__: f for f in (stream_snapshots, stream_items, stream_usage, stream_end, stream_complete, stream_delta, stream_running_usage)}
SQL = {
    "stream_snapshots": STREAM_SNAPSHOTS_SQL,
    "stream_items": STREAM_ITEMS_SQL,
    "stream_usage": STREAM_USAGE_SQL,
    "stream_end": STREAM_END_SQL,
    "stream_complete": STREAM_COMPLETE_SQL,
    "stream_delta": STREAM_DELTA_SQL,
    "stream_running_usage": STREAM_RUNNING_SQL,
}
