"""Registered queries over replies, requests and attempts, synthesised from the relational tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structex.functions import account
from structex.functions import schema as S
from structex.functions.jsonx import kind_of
from structex.functions.validate import coerce, issues, reask_text, union_option, unwrap_items
from structex.operators import judge, merge, modes, retry, score
from structex.plans import pipeline
from structex.sources.clients import COMPATIBLE, VENDORS, CallClient, RuleClient, route_column

ORDER = S.obj(id=S.integer(), status=S.string(), total=S.number())


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")


def _answer() -> Column:
    """The JSON text of an order; every 10th breaks off, every 13th has text behind it."""
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")))
    k = F.col("o_orderkey")
    return F.when(k % 10 == 0, F.substring(whole, 1, 12)).when(k % 13 == 0, F.concat(whole, F.lit(" ok"))).otherwise(whole)


def _raw(mode: str) -> Column:
    answer = _answer()
    none = F.col("o_orderkey") % 17 == 0
    if mode == modes.TOOLS:
        call = F.struct(F.lit("c1").alias("id"), F.struct(F.lit("extract").alias("name"), F.when(~none, answer).alias("arguments")).alias("function"))
        return F.to_json(F.struct(F.array(F.struct(F.struct(F.array(call).alias("tool_calls")).alias("message"))).alias("choices")))
    if mode in (modes.JSON_SCHEMA, modes.MD_JSON):
        text = answer
        if mode == modes.MD_JSON:
            decoy = F.lit('Look at {"id": 0} and [1, 2]; {broken: yes}. Then "a { in quotes".\n```json\n')
            text = F.concat(decoy, answer, F.lit("\n```\nDone."))
        content = F.when(none, F.lit(" \n")).otherwise(text)
        return F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    if mode == modes.ANTHROPIC_TOOLS:
        use = F.struct(F.when(none, F.lit("text")).otherwise(F.lit("tool_use")).alias("type"), F.lit("t1").alias("id"), F.lit("extract").alias("name"), answer.alias("input"))
        return F.to_json(F.struct(F.array(use).alias("content"), F.lit("end_turn").alias("stop_reason")))
    parts = F.array(F.struct(F.substring(answer, 1, 5).alias("text")), F.struct(F.expr("substring(a, 6)").alias("text")))
    content = F.struct(F.struct(F.when(~none, parts).alias("parts")).alias("content"))
    return F.to_json(F.struct(F.array(content).alias("candidates")))


def _parsed(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _orders(spark, sf_dir).withColumn("a", _answer())
        rows = rows.withColumn("p", modes.parse(mode, _raw(mode)))
        typed = rows.withColumn("d", coerce(ORDER, F.col("p.value")))
        return typed.select("o_orderkey", F.col("d.id").alias("id"), F.col("d.status").alias("status"), F.col("d.total").alias("total"), F.col("p.error").alias("error"))

    query.__name__ = f"parse_{mode.lower()}"
    return query


def _parsed_sql(missing: str, broken: str, trailing: bool = False, decoy: bool = False) -> str:
    """What stands in the source columns, where a reply can be read; else the error."""
    bad = "o_orderkey % 10 = 0" if trailing else "(o_orderkey % 10 = 0 OR o_orderkey % 13 = 0)"
    if decoy:  # a reply that breaks off leaves the last whole span before it
        return f"""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN {bad} THEN NULL ELSE o_orderkey END AS BIGINT) AS id,
  CASE WHEN o_orderkey % 17 <> 0 AND NOT {bad} THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 17 <> 0 AND NOT {bad} THEN o_totalprice END AS total,
  CASE WHEN o_orderkey % 17 = 0 THEN '{missing}' END AS error FROM orders"""
    return f"""SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 AND NOT {bad} THEN o_orderkey END AS id,
  CASE WHEN o_orderkey % 17 <> 0 AND NOT {bad} THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 17 <> 0 AND NOT {bad} THEN o_totalprice END AS total,
  CASE WHEN o_orderkey % 17 = 0 THEN '{missing}' WHEN {bad} THEN '{broken}' END AS error FROM orders"""


_PARSE_SQL = {
    modes.TOOLS: _parsed_sql("Response has no tool call arguments", "Tool call arguments are not valid JSON"),
    modes.JSON_SCHEMA: _parsed_sql("Response has no JSON content", "Message content is not valid JSON"),
    modes.MD_JSON: _parsed_sql("Response has no JSON content", "", trailing=True, decoy=True),
    modes.ANTHROPIC_TOOLS: _parsed_sql("Response has no tool_use block", "tool_use input is not valid JSON"),
    modes.GEMINI_JSON: _parsed_sql("Gemini response has no JSON text", "Message content is not valid JSON"),
}


def parse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode is a column: the same plan serves a table of mixed calls."""
    rows = _orders(spark, sf_dir).withColumn("a", _answer())
    kinds = [modes.TOOLS, modes.JSON_SCHEMA, modes.ANTHROPIC_TOOLS, modes.GEMINI_JSON]
    number = F.col("o_orderkey") % len(kinds)
    mode, raw = F.when(number == 0, F.lit(kinds[0])), F.when(number == 0, _raw(kinds[0]))
    for i, k in enumerate(kinds[1:], 1):
        mode, raw = mode.when(number == i, F.lit(k)), raw.when(number == i, _raw(k))
    rows = rows.withColumns({"mode": mode, "raw": raw})
    rows = rows.withColumn("p", modes.parse_by(F.col("mode"), F.col("raw")))
    return rows.select("o_orderkey", "mode", coerce(ORDER, F.col("p.value"))["status"].alias("status"), F.col("p.error").isNotNull().alias("failed"))


PARSE_MIXED_SQL = """SELECT o_orderkey, ['TOOLS', 'JSON_SCHEMA', 'ANTHROPIC_TOOLS', 'GEMINI_JSON'][o_orderkey % 4 + 1] AS mode,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 13 <> 0 THEN o_orderstatus END AS status,
  o_orderkey % 17 = 0 OR o_orderkey % 10 = 0 OR o_orderkey % 13 = 0 AS failed FROM orders"""


# -- validation -----------------------------------------------------------------

USER = S.obj(name=S.string(), age=S.integer(), nickname=S.string().optional(), segment=S.enum("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE").nullable())


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON with planted faults: a number as name, a text as age, 25.5, missing, null."""
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    name = F.when(k % 5 == 1, F.lit("7")).otherwise(F.to_json(F.col("c_name").cast("variant")))
    age = F.when(k % 7 == 1, F.lit('"25"')).when(k % 7 == 2, F.lit("25.5")).when(k % 7 == 3, F.lit("25.0")).otherwise(F.col("c_nationkey").cast("string"))
    nick = F.when(k % 3 == 0, F.lit(',"nickname":null')).when(k % 3 == 1, F.lit(',"nickname":"n"')).otherwise(F.lit(""))
    segment = F.when(k % 11 == 0, F.lit("")).when(k % 11 == 1, F.lit(',"segment":null')).otherwise(F.concat(F.lit(',"segment":"'), F.col("c_mktsegment"), F.lit('"')))
    body = F.concat(F.lit('{"name":'), name, F.lit(',"age":'), age, nick, segment, F.lit("}"))
    return c.withColumn("v", F.parse_json(body))


def _issue_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda i: F.concat(i["path"], F.lit(": "), i["message"])), "; ")


def validate_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir).withColumn("i", issues(USER, F.col("v")))
    data = coerce(USER, F.col("v"))
    return rows.select("c_custkey", _issue_text(F.col("i")).alias("issues"), F.when(F.size("i") == 0, data["age"]).alias("age"), F.when(F.size("i") == 0, data["name"]).alias("name"))


_USER_SQL = """u AS (SELECT *, CASE WHEN c_custkey % 5 = 1 THEN 'name: Expected a string, received number' END AS i1,
  CASE c_custkey % 7 WHEN 1 THEN 'age: Expected an integer, received string' WHEN 2 THEN 'age: Expected an integer, received number' END AS i2,
  CASE WHEN c_custkey % 3 = 0 THEN 'nickname: Expected a string, received null' END AS i3,
  CASE WHEN c_custkey % 11 = 0 THEN 'segment: Required'
    WHEN c_custkey % 11 <> 1 AND c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')
    THEN 'segment: Expected one of BUILDING, AUTOMOBILE, MACHINERY, HOUSEHOLD, FURNITURE, received string' END AS i4,
  CASE WHEN c_custkey % 7 = 3 THEN 25 ELSE c_nationkey END AS age_ FROM customer),
w AS (SELECT *, concat_ws('; ', i1, i2, i3, i4) AS issues FROM u)"""
VALIDATE_USER_SQL = f"""WITH {_USER_SQL} SELECT c_custkey, issues, CAST(CASE WHEN issues = '' THEN age_ END AS BIGINT) AS age, CASE WHEN issues = '' THEN c_name END AS name FROM w"""


def reask_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues(USER, F.col("v"))
    rows = _customers(spark, sf_dir).withColumn("i", found).filter(F.size("i") > 0)
    return rows.select("c_custkey", reask_text(F.col("i"), F.lit(False)).alias("text"))


REASK_TEXT_SQL = f"""WITH {_USER_SQL} SELECT c_custkey, E'The previous output failed schema validation:\\n- ' || replace(issues, '; ', E'\\n- ') || E'\\nFix the JSON and try again.' AS text
FROM w WHERE issues <> ''"""


def refine_adult(spark: SparkSession, sf_dir: str) -> DataFrame:
    adult = S.obj(age=S.integer().refine(lambda c: c >= 18, "must be an adult"), name=S.string()).refine(
        lambda c: c["name"] != "Customer#000000001", "name is taken", ["name"]
    )
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    v = F.to_variant_object(F.struct(F.col("c_nationkey").alias("age"), F.col("c_name").alias("name")))
    return c.withColumn("v", v).select("c_custkey", _issue_text(issues(adult, F.col("v"))).alias("issues"))


REFINE_ADULT_SQL = """SELECT c_custkey, concat_ws('; ', CASE WHEN c_nationkey < 18 THEN 'age: must be an adult' END,
  CASE WHEN c_name = 'Customer#000000001' THEN 'name: name is taken' END) AS issues FROM customer"""


def maybe_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = S.maybe(S.obj(name=S.string()))
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    hit = F.to_json(F.struct(F.struct(F.col("c_name").alias("name")).alias("result"), F.lit(False).alias("error"), F.lit(None).cast("string").alias("message")), {"ignoreNullFields": "false"})
    miss = F.lit('{"result":null,"error":true,"message":"no customer"}')
    rows = c.withColumn("v", F.parse_json(F.when(F.col("c_acctbal") < 0, miss).otherwise(hit)))
    d = coerce(wrapped, F.col("v"))
    return rows.select("c_custkey", F.size(issues(wrapped, F.col("v"))).alias("n_issues"), d["result"]["name"].alias("name"), d["error"].alias("error"), d["message"].alias("message"))


MAYBE_MISS_SQL = """SELECT c_custkey, CAST(0 AS INT) AS n_issues, CASE WHEN c_acctbal >= 0 THEN c_name END AS name, c_acctbal < 0 AS error,
  CASE WHEN c_acctbal < 0 THEN 'no customer' END AS message FROM customer"""


def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = S.obj(at=S.date())
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    millis = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long")
    given = F.when(k % 3 == 0, millis.cast("string")).when(k % 3 == 1, F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))).otherwise(F.lit('"someday"'))
    rows = o.withColumn("v", F.parse_json(F.concat(F.lit('{"at":'), given, F.lit("}"))))
    return rows.select("o_orderkey", F.unix_seconds(coerce(event, F.col("v"))["at"]).alias("seconds"), F.size(issues(event, F.col("v"))).alias("n_issues"))


COERCE_DATE_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS seconds,
  CAST(CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS INT) AS n_issues FROM orders"""


def coerce_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root array arrives bare from even orders and as {items} from odd ones."""
    items = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    bare = F.to_variant_object("p")
    wrapped = F.to_variant_object(F.struct(F.col("p").alias("items")))
    rows = items.withColumn("v", F.when(F.col("l_orderkey") % 2 == 0, bare).otherwise(wrapped))
    value = unwrap_items(F.col("v"))
    schema = S.array(S.integer())
    return rows.select("l_orderkey", F.array_join(coerce(schema, value), ",").alias("parts"), F.size(issues(schema, value)).alias("n_issues"))


COERCE_ITEMS_SQL = "SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_partkey) AS parts, CAST(0 AS INT) AS n_issues FROM lineitem GROUP BY l_orderkey"


def coerce_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pet = S.union(S.obj(kind=S.literal("dog"), bark=S.boolean()), S.obj(kind=S.literal("cat"), lives=S.number()))
    o = _read(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.lit('{"kind":"dog","bark":true}')).when(k % 3 == 1, F.concat(F.lit('{"kind":"cat","lives":'), (k % 10).cast("string"), F.lit("}"))).otherwise(F.lit('{"kind":"dog","lives":9}'))
    rows = o.withColumn("v", F.parse_json(body))
    return rows.select("o_orderkey", union_option(pet, F.col("v")).alias("option"), F.size(issues(pet, F.col("v"))).alias("n_issues"), F.try_variant_get("v", "$.lives", "double").alias("lives"))


COERCE_UNION_SQL = """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS INT) AS "option", CAST(CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS INT) AS n_issues,
  CAST(CASE o_orderkey % 3 WHEN 1 THEN o_orderkey % 10 WHEN 2 THEN 9 END AS DOUBLE) AS lives FROM orders"""


def struct_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal flat objects have equal keys, in whatever order their fields come."""
    e = _read(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    a = F.to_variant_object(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")))
    b = F.to_variant_object(F.struct(F.col("event_type").alias("t"), F.col("user_id").cast("double").alias("u")))
    schema = S.obj(u=S.number(), t=S.string())
    rows = e.withColumns({"a": a, "b": b})
    rows = rows.withColumns({"ka": merge.struct_key(F.col("a"), schema), "kb": merge.struct_key(F.col("b"), schema)})
    return rows.groupBy("ka").agg(F.min("user_id").alias("user_id"), F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.bool_and(F.col("ka") == F.col("kb")).alias("same")).drop("ka")


STRUCT_KEY_SQL = "SELECT user_id, event_type, count(*) AS n, true AS same FROM events GROUP BY ALL"


# -- merging of rows that play chunks -------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunk values of their order: windows overlap their neighbours."""
    cols = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_discount", *cols)
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols)) - 1
    rows = rows.withColumn("chunk_index", rank)
    return rows.withColumns({"doc_id": F.col("l_orderkey"), "start_index": F.col("chunk_index") * 50, "end_index": F.col("chunk_index") * 50 + 100})


_LINES_SQL = """l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS chunk_index FROM lineitem)"""


def _json(**fields: Column) -> Column:
    return F.to_variant_object(F.struct(*[v.alias(k) for k, v in fields.items()]))


HEADER = S.obj(flag=S.string().nullable(), status=S.string())


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag is null in the first row of an order and in every row of orders divisible by 5."""
    flag = F.when((F.col("chunk_index") > 0) & (F.col("l_orderkey") % 5 != 0), F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('"'))).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"flag":'), flag, F.lit(',"status":"'), F.col("l_linestatus"), F.lit('"}'))
    return _lines(spark, sf_dir).select("doc_id", "chunk_index", "start_index", "end_index", F.parse_json(body).alias("value"))


def merge_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge.merge_documents(_headers(spark, sf_dir), HEADER)
    return m.select("doc_id", F.try_variant_get("value", "$.flag", "string").alias("flag"), F.try_variant_get("value", "$.status", "string").alias("status"))


MERGE_OBJECT_SQL = f"""WITH {_LINES_SQL} SELECT l_orderkey AS doc_id, min_by(l_returnflag, chunk_index) FILTER (chunk_index > 0 AND l_orderkey % 5 <> 0) AS flag,
  min_by(l_linestatus, chunk_index) AS status FROM l GROUP BY l_orderkey"""


def merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.try_variant_get(F.parse_json(merge.first_value(_json(p=F.col("l_partkey")))), "$.p", "long").alias("first_part"))


MERGE_FIRST_SQL = f"WITH {_LINES_SQL} SELECT l_orderkey AS doc_id, min_by(l_partkey, chunk_index) AS first_part FROM l GROUP BY l_orderkey"


def merge_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit null survives where no chunk has a value; a key that no chunk had stays away."""
    m = merge.merge_documents(_headers(spark, sf_dir), S.obj(flag=S.string().nullable(), absent=S.string().optional()))
    return m.select("doc_id", kind_of(F.try_variant_get("value", "$.flag", "variant")).alias("flag"), kind_of(F.try_variant_get("value", "$.absent", "variant")).alias("absent"))


MERGE_NULLS_SQL = f"""WITH {_LINES_SQL} SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 5 = 0 OR count(*) = 1 THEN 'null' ELSE 'string' END AS flag, 'missing' AS absent FROM l GROUP BY l_orderkey"""


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge.merge_documents(_headers(spark, sf_dir), HEADER, on_conflict="error")
    return m.select("doc_id", F.array_join("conflicts", ",").alias("conflicts"))


CONFLICTS_SQL = f"""WITH {_LINES_SQL} SELECT l_orderkey AS doc_id, concat_ws(',',
  CASE WHEN count(DISTINCT l_returnflag) FILTER (chunk_index > 0 AND l_orderkey % 5 <> 0) > 1 THEN 'flag' END,
  CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'status' END) AS conflicts FROM l GROUP BY l_orderkey"""


def conflict_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = merge.conflict_details(_headers(spark, sf_dir), HEADER)
    values = F.transform("values", lambda x: F.concat(x["value"], F.lit("@"), x["start_index"].cast("string")))
    return d.select("doc_id", "field", F.array_join(values, ",").alias("values"))


CONFLICT_DETAILS_SQL = f"""WITH {_LINES_SQL}, v AS (
  SELECT l_orderkey AS doc_id, 'flag' AS field, l_returnflag AS v, min(chunk_index) AS c FROM l WHERE chunk_index > 0 AND l_orderkey % 5 <> 0 GROUP BY ALL
  UNION ALL SELECT l_orderkey, 'status', l_linestatus, min(chunk_index) FROM l GROUP BY ALL)
SELECT doc_id, field, string_agg('"' || v || '"@' || (c * 50), ',' ORDER BY c) AS "values" FROM v GROUP BY doc_id, field HAVING count(*) > 1"""

LINE = S.obj(part=S.integer(), supp=S.integer().nullable(), price=S.number().nullable())


def _line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per chunk, part numbers folded to 3 so that they recur; the supplier is sometimes null."""
    supp = F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 2).cast("string")).otherwise(F.lit("null"))
    price = F.when(F.col("chunk_index") % 2 == 1, F.col("l_extendedprice").cast("string")).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"items":[{"part":'), (F.col("l_partkey") % 3).cast("string"), F.lit(',"supp":'), supp, F.lit(',"price":'), price, F.lit("}]}"))
    return _lines(spark, sf_dir).select("doc_id", "chunk_index", "start_index", "end_index", F.parse_json(body).alias("value"))


_LINE_ITEMS_SQL = f"""{_LINES_SQL}, i AS (SELECT l_orderkey AS doc_id, chunk_index, l_partkey % 3 AS part, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 2 END AS supp,
  CASE WHEN chunk_index % 2 = 1 THEN l_extendedprice END AS price FROM l)"""


def _entities(by: tuple[str, ...]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = merge.merge_documents(_line_values(spark, sf_dir), S.obj(items=S.array(LINE)), dedupe_by=by)
        items = F.try_variant_get("value", "$.items", "array<struct<part:int,supp:int,price:double>>")
        rows = m.select("doc_id", F.posexplode(items).alias("ord", "x"))
        return rows.select("doc_id", "ord", "x.part", "x.supp", F.round("x.price", 2).alias("price"))

    query.__name__ = "dedupe_by" if len(by) == 1 else "dedupe_by_composite"
    return query


def _entities_sql(key: str) -> str:
    """One item a chunk: a chunk's item goes if the chunk before has the same key; what goes lends
    its values to the first item of the key that stays."""
    return f"""WITH {_LINE_ITEMS_SQL}, k AS (SELECT *, {key} AS key FROM i),
m AS (SELECT a.*, b.doc_id IS NULL AS kept FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND a.key = b.key AND b.chunk_index = a.chunk_index - 1),
f AS (SELECT doc_id, key, min(chunk_index) FILTER (kept) AS first, min_by(supp, chunk_index) FILTER (supp IS NOT NULL AND (NOT kept OR chunk_index = fk)) AS supp_,
  min_by(price, chunk_index) FILTER (price IS NOT NULL AND (NOT kept OR chunk_index = fk)) AS price_
  FROM (SELECT *, min(CASE WHEN kept THEN chunk_index END) OVER (PARTITION BY doc_id, key) AS fk FROM m) GROUP BY doc_id, key)
SELECT m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY chunk_index) - 1 AS INT) AS ord, CAST(part AS INT) AS part,
  CAST(CASE WHEN chunk_index = first AND m.key LIKE 'e%' THEN supp_ ELSE supp END AS INT) AS supp,
  round(CASE WHEN chunk_index = first AND m.key LIKE 'e%' THEN price_ ELSE price END, 2) AS price
FROM m JOIN f ON m.doc_id = f.doc_id AND m.key = f.key WHERE kept"""


DEDUPE_BY_SQL = _entities_sql("'e' || part")
DEDUPE_BY_COMPOSITE_SQL = _entities_sql("CASE WHEN supp IS NOT NULL THEN 'e' || part || ',' || supp ELSE 'v' || part || ',' || coalesce(price, -1) END")


def root_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _line_values(spark, sf_dir).withColumn("value", F.try_variant_get("value", "$.items", "variant"))
    m = merge.merge_documents(values, S.array(LINE), dedupe="none")
    parts = F.transform(F.try_variant_get("value", "$", "array<struct<part:int>>"), lambda x: x["part"])
    return m.select("doc_id", F.array_join(parts, ",").alias("parts"))


ROOT_ARRAY_SQL = f"WITH {_LINE_ITEMS_SQL} SELECT doc_id, string_agg(part, ',' ORDER BY chunk_index) AS parts FROM i GROUP BY doc_id"


def root_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _lines(spark, sf_dir).withColumn("value", F.when(F.col("chunk_index") == 0, F.parse_json(F.lit("null"))).otherwise(F.col("l_partkey").cast("variant")))
    m = merge.merge_documents(values.select("doc_id", "chunk_index", "start_index", "end_index", "value"), S.integer().nullable(), on_conflict="error")
    return m.select("doc_id", F.try_variant_get("value", "$", "long").alias("part"), F.array_join("conflicts", ",").alias("conflicts"))


ROOT_SCALAR_SQL = f"""WITH {_LINES_SQL} SELECT l_orderkey AS doc_id, min_by(l_partkey, chunk_index) FILTER (chunk_index > 0) AS part,
  CASE WHEN count(DISTINCT l_partkey) FILTER (chunk_index > 0) > 1 THEN '(root)' ELSE '' END AS conflicts FROM l GROUP BY l_orderkey"""


def merge_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts come before validation; an invalid merge keeps its issues."""
    m = merge.merge_into(_headers(spark, sf_dir), S.obj(flag=S.string(), status=S.string()), on_conflict="error")
    return m.select("doc_id", "status", F.col("data.flag").alias("flag"), _issue_text(F.col("issues")).alias("issues"))


MERGE_VALIDATE_SQL = f"""WITH {_LINES_SQL}, g AS (SELECT l_orderkey AS doc_id, min_by(l_returnflag, chunk_index) FILTER (chunk_index > 0 AND l_orderkey % 5 <> 0) AS flag,
  count(DISTINCT l_returnflag) FILTER (chunk_index > 0 AND l_orderkey % 5 <> 0) > 1 OR count(DISTINCT l_linestatus) > 1 AS bad FROM l GROUP BY l_orderkey)
SELECT doc_id, CASE WHEN bad THEN 'conflict' WHEN flag IS NULL THEN 'invalid' ELSE 'merged' END AS status, CASE WHEN NOT bad THEN flag END AS flag,
  CASE WHEN flag IS NULL THEN 'flag: Expected a string, received null' ELSE '' END AS issues FROM g"""


# -- attempts, usage, budgets -----------------------------------------------------------


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of their user's call: type and number say how each one ended."""
    e = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    k = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("ts")
    return e.select(
        F.col("user_id").alias("call_id"),
        F.row_number().over(w).alias("attempt"),
        (k % 19 == 0).alias("provider_error"),
        (k % 5 == 0).alias("ok"),
        (k % 23 == 0).alias("other_error"),
        (k % 7 == 0).alias("truncated"),
        F.when(k % 31 != 0, (k % 100).cast("long")).alias("tokens"),
    )


def _replay_sql(budget: int | None) -> str:
    stop = (
        f"WHEN attempt <= 3 AND NOT known THEN 'usage_unavailable' WHEN attempt <= 3 AND run >= {budget} THEN 'budget_exceeded' " if budget else ""
    )
    return f"""WITH a AS (SELECT user_id AS call_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS attempt, event_id AS k FROM events),
b AS (SELECT *, CAST(sum(CASE WHEN k % 19 <> 0 AND k % 31 <> 0 THEN k % 100 ELSE 0 END) OVER w AS BIGINT) AS run, bool_and(k % 19 = 0 OR k % 31 <> 0) OVER w AS known
  FROM a WHERE attempt <= 4 WINDOW w AS (PARTITION BY call_id ORDER BY attempt)),
c AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'provider_error' WHEN k % 5 = 0 THEN 'success' WHEN k % 23 = 0 THEN 'other_error' WHEN k % 7 = 0 THEN 'truncated' {stop}
  WHEN attempt > 3 THEN 'exhausted' ELSE 'continue' END AS outcome FROM b),
d AS (SELECT *, min(attempt) FILTER (outcome <> 'continue') OVER (PARTITION BY call_id) AS e FROM c)
SELECT call_id, attempt, outcome, run AS running_tokens, coalesce(attempt = e, false) AS is_last FROM d WHERE e IS NULL OR attempt <= e"""


def _replayed(name: str, budget: int | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = retry.replay(_attempts(spark, sf_dir), budget=budget)
        return rows.select("call_id", "attempt", "outcome", F.col("running_tokens").cast("long").alias("running_tokens"), F.coalesce("is_last_attempt", F.lit(False)).alias("is_last"))

    query.__name__ = name
    return query


def attempt_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each call in order; usage is reported once, with the last attempt."""
    rows = pipeline.attempt_events(retry.replay(_attempts(spark, sf_dir)))
    return rows.groupBy("call_id").agg(F.count("*").alias("events"), F.count(F.when(F.col("event") == "usage", 1)).alias("usages"), F.max("attempt").alias("attempts"))


ATTEMPT_META_SQL = f"""WITH r AS ({_replay_sql(None)})
SELECT call_id, sum(CASE WHEN outcome = 'provider_error' THEN 2 WHEN is_last THEN 3 ELSE 2 END)::BIGINT AS events,
  count(*) FILTER (is_last AND outcome <> 'provider_error') AS usages, max(attempt) AS attempts FROM r GROUP BY call_id"""


def _usage_raw() -> Column:
    k = F.col("event_id")
    a, b = (k % 50).cast("string"), (k % 7).cast("string")
    return (
        F.when(k % 5 == 0, F.concat(F.lit('{"usage":{"prompt_tokens":'), a, F.lit(',"completion_tokens":'), b, F.lit('},"choices":[{"finish_reason":"length"}]}')))
        .when(k % 5 == 1, F.concat(F.lit('{"usage":{"input_tokens":'), a, F.lit('},"stop_reason":"max_tokens"}')))
        .when(k % 5 == 2, F.concat(F.lit('{"usageMetadata":{"promptTokenCount":'), a, F.lit(',"candidatesTokenCount":'), b, F.lit('},"candidates":[{"finishReason":"MAX_TOKENS"}]}')))
        .when(k % 5 == 3, F.concat(F.lit('{"message":{"usage":{"output_tokens":'), b, F.lit("}}}")))
        .otherwise(F.lit('{"usage":{"prompt_tokens":"7"},"stop_reason":"end_turn"}'))
    )


_USAGE_SQL = """u AS (SELECT event_id, user_id, CAST(CASE WHEN event_id % 5 IN (0, 1, 2) THEN event_id % 50 WHEN event_id % 5 = 3 THEN 0 END AS BIGINT) AS input_tokens,
  CAST(CASE WHEN event_id % 5 IN (0, 2, 3) THEN event_id % 7 WHEN event_id % 5 = 1 THEN 0 END AS BIGINT) AS output_tokens FROM events)"""


def _usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", "event_id", "user_id").withColumn("u", account.usage(F.parse_json(_usage_raw())))


def usage_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usages(spark, sf_dir).select("event_id", "u.input_tokens", "u.output_tokens", "u.total_tokens", F.col("u").isNotNull().alias("available"))


USAGE_READ_SQL = f"WITH {_USAGE_SQL} SELECT event_id, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, input_tokens IS NOT NULL AS available FROM u"


def usage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all attempts of a call; an attempt counts even if it reports nothing."""
    return _usages(spark, sf_dir).groupBy("user_id").agg(F.coalesce(F.sum("u.total_tokens"), F.lit(0)).alias("total_tokens"), F.count("*").alias("attempts"))


USAGE_SUM_SQL = f"WITH {_USAGE_SQL} SELECT user_id, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens, count(*) AS attempts FROM u GROUP BY user_id"


def usage_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all calls of a document; available only if each of them was."""
    rows = _usages(spark, sf_dir).withColumn("doc_id", F.col("user_id") % 100)
    return rows.groupBy("doc_id").agg(F.sum(F.coalesce("u.input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("u.output_tokens", F.lit(0))).alias("output_tokens"), F.bool_and(F.col("u").isNotNull()).alias("available"))


USAGE_DOC_SQL = f"""WITH {_USAGE_SQL} SELECT user_id % 100 AS doc_id, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
  bool_and(input_tokens IS NOT NULL) AS available FROM u GROUP BY ALL"""


def truncation_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", "event_id").select("event_id", account.truncation_reason(F.parse_json(_usage_raw())).alias("reason"))


TRUNCATION_SQL = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'length' WHEN 1 THEN 'max_tokens' WHEN 2 THEN 'MAX_TOKENS' END AS reason FROM events"


# -- judging and scoring ------------------------------------------------------------------


def judge_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule client as judge: a turn must not be longer than 300 characters."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")

    def verdicts(calls: DataFrame) -> DataFrame:
        asked = F.parse_json(F.try_variant_get(calls["messages"][1]["content"], "$", "string"))
        n = F.length(F.try_variant_get(asked, "$.candidate_value", "string"))
        return calls.select("call_id", (n <= 300).alias("is_valid"), F.when(n > 600, F.concat(F.lit("too long: "), n.cast("string"))).alias("reason"))

    out = judge.judge(rows, "call_id", F.col("text"), "at most 300 characters", verdicts)
    return out.select("conv_id", "turn", "issue")


JUDGE_SQL = """SELECT conv_id, turn, CASE WHEN length(text) > 600 THEN 'too long: ' || length(text) WHEN length(text) > 300 THEN 'Value failed validation: at most 300 characters' END AS issue FROM conversations"""


def _length_judge():
    """A judge in the place of a live one: a candidate may have 300 characters."""

    def send(body: dict) -> dict:
        n = len(json.loads(body["messages"][1]["content"])["candidate_value"])
        verdict = {"is_valid": n <= 300, "reason": f"it has {n} characters", "fixed_value": None}
        return {"choices": [{"message": {"content": json.dumps(verdict)}}]}

    return send


def judged_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judged rule in a schema: a turn that is quoted at more than 300 characters breaks it and is
    asked for again, at most once; the second answer has the first 250 characters, or 400 in the third turns."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    message = F.array(modes.text_message("user", F.lit("Quote the turn.")))
    calls = rows.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select(
        F.concat_ws(":", "conv_id", "turn").alias("call_id"), F.lit("m").alias("model"), message.alias("messages"), "conv_id", "turn", "text"
    )
    answer = lambda text: F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))

    def reply(asked: DataFrame) -> Column:
        again = F.when(F.col("turn") == 2, F.substring("text", 1, 400)).otherwise(F.substring("text", 1, 250))
        said = F.when(asked["attempt"] == 1, F.col("text")).otherwise(again)
        return answer(F.to_json(F.struct(F.array(F.struct(said.alias("quote"))).alias("quotes"))))

    judge_client = CallClient(_length_judge, modes.JSON_SCHEMA)
    schema = S.obj(quotes=S.array(S.obj(quote=S.string().judged("at most 300 characters", client=judge_client))))
    attempts = pipeline.extract(calls, schema, RuleClient(reply, modes.JSON_SCHEMA), max_retries=1, carry=("conv_id", "turn", "text"))
    length = F.length(F.element_at("data.quotes.quote", 1))
    return attempts.select("conv_id", "turn", "attempt", "outcome", length.alias("length"), F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(": "), i["message"])), ";").alias("issues"))


JUDGED_SQL = """WITH t AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL),
a AS (SELECT conv_id, turn, 1 AS attempt, length(text) AS n, length(text) AS whole FROM t
  UNION ALL SELECT conv_id, turn, 2, least(length(text), CASE WHEN turn = 2 THEN 400 ELSE 250 END), length(text) FROM t WHERE length(text) > 300)
SELECT conv_id, turn, attempt, CASE WHEN n <= 300 THEN 'success' WHEN attempt = 2 THEN 'exhausted' ELSE 'continue' END AS outcome,
  CAST(CASE WHEN n <= 300 THEN n END AS INT) AS length, CASE WHEN n > 300 THEN 'quotes[0].quote: it has ' || n || ' characters' ELSE '' END AS issues FROM a"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as planted facts; the output lost some, changed some by half or two percent, doubled some."""
    rows = _lines(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "chunk_index").alias("sku"), F.col("l_extendedprice").alias("amount"), F.col("l_orderkey").alias("k"), F.col("chunk_index").alias("ord"))
    factor = F.when(F.col("k") % 5 == 0, F.lit(1.005)).when(F.col("k") % 5 == 1, F.lit(1.02)).otherwise(F.lit(1.0))
    output = rows.filter(F.col("k") % 7 != 0).select("sku", (F.col("amount") * factor).alias("amount"), "k")
    return rows, output.union(output.filter(F.col("k") % 3 == 0)).select("sku", "amount")


def score_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted, output = _scored(spark, sf_dir)
    return score.recall(planted, output).select("planted", "recovered", F.round("recall", 6).alias("recall"))


SCORE_RECALL_SQL = """SELECT count(*) AS planted, count(*) FILTER (l_orderkey % 7 <> 0 AND l_orderkey % 5 <> 1) AS recovered,
  round(count(*) FILTER (l_orderkey % 7 <> 0 AND l_orderkey % 5 <> 1) / count(*), 6) AS recall FROM lineitem"""


def score_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, output = _scored(spark, sf_dir)
    return score.duplicate_rate(output).select(F.col("items").cast("long").alias("items"), "distinct_items", F.round("duplicate_rate", 6).alias("duplicate_rate"))


SCORE_DUPS_SQL = """WITH n AS (SELECT count(*) FILTER (l_orderkey % 7 <> 0) AS a, count(*) FILTER (l_orderkey % 7 <> 0 AND l_orderkey % 3 = 0) AS b FROM lineitem)
SELECT a + b AS items, a AS distinct_items, round(b / (a + b), 6) AS duplicate_rate FROM n"""


# -- requests -----------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).withColumn(
        "messages", F.transform("t", lambda m: modes.text_message(m["role"], m["text"]))
    )


def _encoded(mode: str):
    paths = {
        modes.TOOLS: ("$.tools[0].function.name", "$.messages[0].content"),
        modes.JSON_SCHEMA: ("$.response_format.json_schema.name", "$.messages[0].content"),
        modes.MD_JSON: ("$.messages[0].role", "$.messages[1].content"),
        modes.ANTHROPIC_TOOLS: ("$.tool_choice.name", "$.messages[0].content"),
        modes.GEMINI_JSON: ("$.config.responseMimeType", "$.contents[0].parts[0].text"),
    }[mode]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sampling = {"temperature": F.when(F.col("conv_id") % 2 == 0, F.lit(0.5)), "max_tokens": F.when(F.col("conv_id") % 3 == 0, F.lit(99))}
        body = F.parse_json(modes.encode(mode, ORDER, F.lit("m"), F.col("messages"), sampling))
        rows = _messages(spark, sf_dir).withColumn("b", body)
        config = "$.config." if mode == modes.GEMINI_JSON else "$."
        count = F.size(F.try_variant_get("b", "$.contents" if mode == modes.GEMINI_JSON else "$.messages", "array<variant>"))
        return rows.select(
            "conv_id",
            F.try_variant_get("b", paths[0], "string").alias("mark"),
            F.md5(F.try_variant_get("b", paths[1], "string").cast("binary")).alias("first"),
            count.alias("n_messages"),
            F.try_variant_get("b", config + "temperature", "double").alias("temperature"),
            F.try_variant_get("b", config + ("maxOutputTokens" if mode == modes.GEMINI_JSON else "max_tokens"), "int").alias("max_tokens"),
        )

    query.__name__ = f"encode_{mode.lower()}"
    return query


def _encoded_sql(mark: str, lifted: bool, more: int, default: str) -> str:
    keep = "role <> 'system'" if lifted else "true"
    return f"""SELECT conv_id, '{mark}' AS mark, md5(min_by(text, turn) FILTER ({keep})) AS first, CAST(count(*) FILTER ({keep}) + {more} AS INT) AS n_messages,
  CASE WHEN conv_id % 2 = 0 THEN 0.5::DOUBLE END AS temperature, CAST(CASE WHEN conv_id % 3 = 0 THEN 99 ELSE {default} END AS INT) AS max_tokens FROM conversations GROUP BY conv_id"""


_ENCODE_SQL = {
    modes.TOOLS: _encoded_sql("extract", False, 0, "NULL"),
    modes.JSON_SCHEMA: _encoded_sql("extract", False, 0, "NULL"),
    modes.MD_JSON: _encoded_sql("system", False, 1, "NULL"),
    modes.ANTHROPIC_TOOLS: _encoded_sql("extract", True, 0, "1024"),
    modes.GEMINI_JSON: _encoded_sql("application/json", True, 0, "NULL"),
}


def _reasked(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _orders(spark, sf_dir).withColumn("a", _answer())
        start = F.array(modes.text_message("user", F.lit("Read the order.")))
        grown = modes.reask(mode, start, _raw(mode), reask_text(F.array().cast("array<struct<path:string,message:string>>"), F.lit(True)))
        rows = rows.withColumn("m", grown)
        last = F.element_at("m", -1)
        return rows.select("o_orderkey", F.size("m").alias("n"), last["role"].alias("role"), last["tool_call_id"].alias("tool_call_id"), F.to_json(F.element_at("m", 2)["content"]).alias("said"))

    query.__name__ = f"reask_{mode.lower()}"
    return query


def sampling_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-call values over defaults; what neither sets stays away."""
    k = F.col("o_orderkey")
    call = {"temperature": F.when(k % 2 == 0, F.lit(0.1)), "top_p": F.when(k % 3 == 0, F.lit(0.9))}
    merged = modes.merge_sampling(call, {"temperature": F.lit(0.7), "max_tokens": F.when(k % 5 == 0, F.lit(256))})
    return _orders(spark, sf_dir).select("o_orderkey", F.to_json(F.struct(*[v.alias(n) for n, v in merged.items()])).alias("sampling"))


SAMPLING_SQL = """SELECT o_orderkey, '{"temperature":' || CASE WHEN o_orderkey % 2 = 0 THEN '0.1' ELSE '0.7' END || CASE WHEN o_orderkey % 5 = 0 THEN ',"max_tokens":256' ELSE '' END ||
  CASE WHEN o_orderkey % 3 = 0 THEN ',"top_p":0.9' ELSE '' END || '}' AS sampling FROM orders"""


def image_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("o_orderstatus").cast("binary")))).otherwise(F.concat(F.lit("https://example.org/"), k.cast("string")))
    block = modes.anthropic_block(modes.image_url(url))
    rows = _orders(spark, sf_dir).withColumn("b", block)
    get = lambda p: F.try_variant_get("b", p, "string")
    return rows.select("o_orderkey", get("$.type").alias("type"), get("$.source.type").alias("kind"), get("$.source.media_type").alias("media_type"), F.coalesce(get("$.source.data"), get("$.source.url")).alias("content"))


IMAGE_SQL = """SELECT o_orderkey, 'image' AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'base64' ELSE 'url' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'image/png' END AS media_type,
  CASE WHEN o_orderkey % 2 = 0 THEN to_base64(o_orderstatus::BLOB) ELSE 'https://example.org/' || o_orderkey END AS content FROM orders"""


def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = {
        "object": S.obj(name=S.string().describe("who"), age=S.integer().optional()),
        "array": S.array(S.number()),
        "nullable": S.obj(x=S.boolean().nullable()),
        "union": S.union(S.string(), S.literal(3)),
        "record": S.record(S.date()),
    }
    return spark.createDataFrame([(k, S.dumps(v.wire_schema())) for k, v in shapes.items()], "shape string, json string")


JSON_SCHEMA_SQL = """SELECT * FROM (VALUES
  ('object', '{"type":"object","properties":{"name":{"type":"string","description":"who"},"age":{"type":"integer"}},"additionalProperties":false,"required":["name"]}'),
  ('array', '{"type":"object","properties":{"items":{"type":"array","items":{"type":"number"}}},"additionalProperties":false,"required":["items"]}'),
  ('nullable', '{"type":"object","properties":{"x":{"anyOf":[{"type":"boolean"},{"type":"null"}]}},"additionalProperties":false,"required":["x"]}'),
  ('union', '{"anyOf":[{"type":"string"},{"type":"number","enum":[3]}]}'),
  ('record', '{"type":"object","additionalProperties":{"type":"string","format":"date-time"}}')) t(shape, json)"""


def strict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def verdict(schema: S.Schema) -> str:
        wire = schema.json_schema()
        try:
            S.strict_check(wire)
            return "ok"
        except S.SchemaError:
            return ",".join(path for path, _ in S.strict_problems(wire))

    shapes = {
        "fine": ORDER,
        "nullable": S.obj(a=S.string().nullable()),
        "union": S.obj(a=S.union(S.string(), S.number())),
        "record": S.obj(a=S.array(S.record(S.string()))),
        "optional": S.obj(a=S.string().optional()),
        "two": S.obj(a=S.obj(b=S.string().optional()).nullable(), c=S.record(S.string())),
    }
    return spark.createDataFrame([(k, verdict(v)) for k, v in shapes.items()], "shape string, verdict string")


STRICT_SQL = """SELECT * FROM (VALUES ('fine', 'ok'), ('nullable', 'ok'), ('union', '$.a'), ('record', '$.a[]'), ('optional', '$'), ('two', '$.c,$.a')) t(shape, verdict)"""


def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*VENDORS, *COMPATIBLE, "nowhere"]
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names)).cast("int") + 1)
    vendor, base, mode = route_column(F.col("n"))
    return _orders(spark, sf_dir).withColumn("n", F.concat(pick, F.lit(" / some-model"))).select("o_orderkey", vendor.alias("vendor"), base.alias("base_url"), mode.alias("mode"))


PROVIDER_SQL = "WITH v AS (SELECT * FROM (VALUES {rows}) t(i, vendor, base_url, mode)) SELECT o_orderkey, vendor, base_url, mode FROM orders JOIN v ON o_orderkey % {n} = i".format(
    rows=", ".join(
        [f"({i}, '{k}', '{v['base_url']}', '{v['mode']}')" for i, (k, v) in enumerate({**VENDORS, **COMPATIBLE}.items())] + [f"({len(VENDORS) + len(COMPATIBLE)}, 'nowhere', NULL, NULL)"]
    ),
    n=len(VENDORS) + len(COMPATIBLE) + 1,
)


_PARSES = {m: _parsed(m) for m in modes.MODES}
_ENCODES = {m: _encoded(m) for m in modes.MODES}
_NAMED = {modes.TOOLS: "tools", modes.JSON_SCHEMA: "json_schema", modes.MD_JSON: "md_json", modes.ANTHROPIC_TOOLS: "anthropic", modes.GEMINI_JSON: "gemini"}
QUERIES = {
    **{f"parse_{_NAMED[m]}": q for m, q in _PARSES.items()},
    **{f"encode_{_NAMED[m]}": q for m, q in _ENCODES.items()},
    **{f"reask_{n}": _reasked(m) for m, n in ((modes.TOOLS, "tools"), (modes.MD_JSON, "content"), (modes.ANTHROPIC_TOOLS, "anthropic"), (modes.GEMINI_JSON, "gemini"))},
    "parse_mixed": parse_mixed,
    "validate_user": validate_user,
    "reask_text": reask_text_query,
    "refine_adult": refine_adult,
    "maybe_miss": maybe_miss,
    "coerce_date": coerce_date,
    "coerce_items": coerce_items,
    "coerce_union": coerce_union,
    "struct_key": struct_key,
    "merge_object": merge_object,
    "merge_first": merge_first,
    "merge_nulls": merge_nulls,
    "conflicts": conflicts,
    "conflict_details": conflict_details,
    "dedupe_by": _entities(("part",)),
    "dedupe_by_composite": _entities(("part", "supp")),
    "root_array": root_array,
    "root_scalar": root_scalar,
    "merge_validate": merge_validate,
    "retry_loop": _replayed("retry_loop", None),
    "budget_stop": _replayed("budget_stop", 60),
    "attempt_meta": attempt_meta,
    "usage_read": usage_read,
    "usage_sum": usage_sum,
    "usage_doc": usage_doc,
    "truncation_reason": truncation_reason,
    "judge_refine": judge_refine,
    "judged_rule": judged_rule,
    "score_recall": score_recall,
    "score_dups": score_dups,
    "sampling_merge": sampling_merge,
    "image_map": image_map,
    "json_schema": json_schema,
    "strict_check": strict_check,
    "provider_route": provider_route,
}
SQL = {
    **{f"parse_{_NAMED[m]}": q for m, q in _PARSE_SQL.items()},
    **{f"encode_{_NAMED[m]}": q for m, q in _ENCODE_SQL.items()},
    "parse_mixed": PARSE_MIXED_SQL,
    "validate_user": VALIDATE_USER_SQL,
    "reask_text": REASK_TEXT_SQL,
    "refine_adult": REFINE_ADULT_SQL,
    "maybe_miss": MAYBE_MISS_SQL,
    "coerce_date": COERCE_DATE_SQL,
    "coerce_items": COERCE_ITEMS_SQL,
    "coerce_union": COERCE_UNION_SQL,
    "struct_key": STRUCT_KEY_SQL,
    "merge_object": MERGE_OBJECT_SQL,
    "merge_first": MERGE_FIRST_SQL,
    "merge_nulls": MERGE_NULLS_SQL,
    "conflicts": CONFLICTS_SQL,
    "conflict_details": CONFLICT_DETAILS_SQL,
    "dedupe_by": DEDUPE_BY_SQL,
    "dedupe_by_composite": DEDUPE_BY_COMPOSITE_SQL,
    "root_array": ROOT_ARRAY_SQL,
    "root_scalar": ROOT_SCALAR_SQL,
    "merge_validate": MERGE_VALIDATE_SQL,
    "retry_loop": _replay_sql(None),
    "budget_stop": _replay_sql(60),
    "attempt_meta": ATTEMPT_META_SQL,
    "usage_read": USAGE_READ_SQL,
    "usage_sum": USAGE_SUM_SQL,
    "usage_doc": USAGE_DOC_SQL,
    "truncation_reason": TRUNCATION_SQL,
    "judge_refine": JUDGE_SQL,
    "judged_rule": JUDGED_SQL,
    "score_recall": SCORE_RECALL_SQL,
    "score_dups": SCORE_DUPS_SQL,
    "sampling_merge": SAMPLING_SQL,
    "image_map": IMAGE_SQL,
    "json_schema": JSON_SCHEMA_SQL,
    "strict_check": STRICT_SQL,
    "provider_route": PROVIDER_SQL,
}
