"""Deterministic merge of per-chunk values into one value per document.

Rows are (doc_id, chunk_index, start_index, end_index, value VARIANT). Scalars take the first
value in chunk order, arrays are joined in chunk order, and items that two overlapping chunks both
saw are kept once. Only ids and values are shuffled, never document texts.

Overlap dedupe is a greedy matching: an item is absorbed by the first open earlier occurrence of
the same key in another chunk whose window meets its own; the absorber is used up and the item
becomes open. Spark gathers a document's arrays in order, as JSON; a task walks over them once.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict, deque
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structex.functions.jsonx import at, items_at, kind_of, let
from structex.functions.schema import Schema
from structex.functions.validate import coerce, issues, scalar
from structex.operators import nested

ROOT = "(root)"


# -- equality -----------------------------------------------------------------


def struct_key(value: Column, schema: Schema | None = None) -> Column:
    """A text that is equal exactly for structurally equal values.

    Types are tagged and texts carry their length; object keys are sorted; -0 and 0 differ;
    numbers compare as doubles, dates by instant, where the schema says what is what.
    """
    return let(kind_of(value), lambda kind: _struct_key(value, kind, schema))


def _struct_key(value: Column, kind: Column, schema: Schema | None) -> Column:
    if schema is None:
        number = F.try_variant_get(value, "$", "double").cast("string")
        plain = F.concat(F.lit("j"), F.to_json(value))
        return F.when(kind == "missing", F.lit("u")).when(kind == "number", F.concat(F.lit("n"), number)).otherwise(plain)
    match schema.kind:
        case "object":
            parts = [F.concat(F.lit(f"{len(k)}:{k}="), let(at(value, f"$.{k}"), lambda v, f=f: struct_key(v, f))) for k, f in sorted(schema.fields)]
            body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        case "array":
            body = F.concat(
                F.lit("["), F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: struct_key(v, schema.element)), ","), F.lit("]")
            )
        case "date":
            body = F.concat(F.lit("d"), F.unix_micros(scalar(schema, value)).cast("string"))
        case _:
            text = F.try_variant_get(value, "$", "string")
            body = (
                F.when(kind == "string", F.concat(F.lit("s"), F.length(text).cast("string"), F.lit(":"), text))
                .when(kind == "number", F.concat(F.lit("n"), F.try_variant_get(value, "$", "double").cast("string")))
                .when(kind == "boolean", F.concat(F.lit("b"), text))
            )
    other = F.concat(F.lit("j"), F.to_json(value))
    return F.when(kind == "missing", F.lit("u")).when(kind == "null", F.lit("z")).otherwise(F.coalesce(body, other))


def entity_key(value: Column, names: Sequence[str], schema: Schema | None = None) -> Column:
    """The key fields if all are there and not null, else the structural key; never equal to it."""
    fields = dict(schema.fields) if schema is not None and schema.kind == "object" else {}
    structural = F.concat(F.lit("value:"), struct_key(value, schema))
    if not names:
        return structural

    def part(n: str) -> Column:
        there = lambda p: p.isNotNull() & ~F.coalesce(F.is_variant_null(p), F.lit(True))
        return let(at(value, f"$.{n}"), lambda p: F.when(there(p), struct_key(p, fields.get(n))))

    # null where a part is
    keyed = F.array(*[part(n) for n in names])
    return let(keyed, lambda k: F.when(F.forall(k, lambda p: p.isNotNull()), F.concat(F.lit("entity:"), F.array_join(k, ","))).otherwise(structural))


# -- arrays -------------------------------------------------------------------


class _Number(str):
    """A number as its JSON says it."""


class _GONE:
    """What a field that isn't there has."""


_QUOTED = json.encoder.encode_basestring
_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"|[^,"]+')
_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number)


def _load(text: str) -> Any:
    return _DECODER.decode(text)


def _text(value: Any) -> str:
    """Compact JSON of a value read by _load."""
    if type(value) is _Number:
        return value
    if isinstance(value, str):
        return _QUOTED(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_QUOTED(k)}:{_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_text, value)) + "]"
    return "null" if value is None else "true" if value else "false"


def _scalar_key(text: str) -> str:
    """The JSON of a scalar tells its type and value, but for numbers written in two ways."""
    return repr(float(text)) if text[0] in "-0123456789" else text


def _plain_key(schema: Schema) -> Callable[[Any], Any]:
    """struct_key of values read by _load; dates have none."""

    def of_scalar(value: Any) -> Any:
        return value if value is None or value is _GONE else _scalar_key(_text(value))

    if schema.kind == "object":
        fields = [(k, _plain_key(f)) for k, f in sorted(schema.fields)]

        def of_object(value: Any) -> Any:
            if value is None or value is _GONE:
                return value
            known = value if isinstance(value, dict) else {}
            return ("{", *[key(known.get(k, _GONE)) for k, key in fields])

        return of_object
    if schema.kind == "array":
        inner = _plain_key(schema.element)
        return lambda value: ("[", *map(inner, value)) if isinstance(value, list) else of_scalar(value)

    return of_scalar


def _loaded(arrays: list[str]) -> list[list]:
    return _load("[" + ",".join(arrays) + "]")


def _undescribed(value: Any) -> str:
    """The key of a field that no schema describes."""
    return _text(value)


def _reader(element: Schema, by: Sequence[str]) -> Callable[[list[str]], list[tuple[list, list]]]:
    """The JSON of arrays to the keys of each one's items and the items: texts, or with entity keys
    lists of the texts of declared fields. Entity keys are ("entity", ...)."""
    key = None if nested.within(element, lambda s: s.kind == "date") else _plain_key(element)
    if element.kind != "object" or not by:
        flat = element.kind in ("string", "enum", "boolean", "number", "int", "literal")

        def plain(array: str) -> tuple[list, list]:
            if flat and "{" not in array and "[" not in array[1:]:
                texts = _SCALAR.findall(array, 1, len(array) - 1)
                return [t if t[0] == '"' else _scalar_key(t) for t in texts], texts
            items = _load(array)
            return [] if key is None else list(map(key, items)), list(map(_text, items))

        return lambda arrays: list(map(plain, arrays))
    names = [k for k, _ in element.fields]
    fields = dict(element.fields)
    parts = [] if key is None else [(n, _plain_key(fields[n]) if n in fields else _undescribed) for n in by]
    one = parts[0] if len(parts) == 1 else None

    def entities(array: list) -> tuple[list, list]:
        keys, items = [], []
        for item in array:
            known = item if isinstance(item, dict) else {}
            values = [known.get(n, _GONE) for n in names]
            items.append([v if v.__class__ is _Number else "null" if v is None else None if v is _GONE else _text(v) for v in values])
            if one is not None:
                v = known.get(one[0])
                keys.append(key(item) if v is None else ("entity", one[1](v)))
            elif parts:
                said = [known.get(n) for n, _ in parts]
                keys.append(key(item) if None in said else ("entity", *[part(v) for v, (_, part) in zip(said, parts, strict=True)]))
        return keys, items

    return lambda arrays: list(map(entities, _loaded(arrays)))


def _swept(element: Schema, by: Sequence[str], dedupe: str):
    """A document's arrays, as (start, end, JSON, keys) in chunk order, to the JSON of one array.

    An item is absorbed by the first open earlier occurrence of its key in another chunk whose window
    meets its own. Occurrences that one chunk leaves open stand as one entry with their number, and
    entries that no later window can meet go; so the time is linear, and the state is one document's.
    """
    entities = bool(by) and element.kind == "object"
    read = _reader(element, by)
    heads = [f"{_QUOTED(k)}:" for k, _ in element.fields] if entities else []

    def absorbed(pool: deque, chunk: int, start: int, end: int, ordered: bool) -> bool:
        while ordered and pool and pool[0][2] <= start:
            pool.popleft()
        found = None
        for o in pool:
            if o[0] != chunk and o[1] < end and start < o[2]:
                found = o
                o[3] -= 1
                break
        if found is not None and not found[3]:
            pool.remove(found)
        if pool and pool[-1][0] == chunk:
            pool[-1][3] += 1
        else:
            pool.append([chunk, start, end, 1])
        return found is not None

    def said(fields: list[str | None]) -> str:
        return "{" + ",".join([h + t for h, t in zip(heads, fields) if t is not None]) + "}"  # noqa: B905

    def is_entity(key: Any) -> bool:
        return key[0] == "entity" if isinstance(key, tuple) else isinstance(key, str) and key.startswith("entity:")

    def of(starts: list[int], ends: list[int], arrays: list[str], given: list[list[str]] | None) -> str:
        chunks = read(arrays)
        if len(arrays) == 1:
            items = chunks[0][1]
            return "[" + ",".join(map(said, items) if entities else items) + "]"
        out, open_, first = [], defaultdict(deque), {}
        ordered = starts == sorted(starts)
        for chunk, (start, end, (keys, items)) in enumerate(zip(starts, ends, chunks, strict=True)):
            for key, item in zip(keys if given is None else given[chunk], items, strict=True):
                kept = dedupe == "none" or not absorbed(open_[key], chunk, start, end, ordered)
                if kept:
                    out.append(item)
                if entities and is_entity(key):
                    if key not in first:  # the first occurrence of a key is always kept
                        first[key] = item
                    elif not kept:
                        for n, (mine, other) in enumerate(zip(first[key], item, strict=True)):
                            if mine in (None, "null") and other not in (None, "null"):
                                first[key][n] = other
        return "[" + ",".join(map(said, out) if entities else out) + "]"

    @F.arrow_udf(T.StringType())
    def run(chunks: pa.Array) -> pa.Array:
        flat = chunks.flatten()
        starts, ends, texts = (flat.field(n).to_pylist() for n in ("start", "end", "j"))
        keys = flat.field("keys").to_pylist() if flat.type.get_field_index("keys") >= 0 else None
        out, at_ = [], 0
        for n in pc.list_value_length(chunks).to_pylist():
            upto = at_ + (n or 0)
            out.append(of(starts[at_:upto], ends[at_:upto], texts[at_:upto], None if keys is None else keys[at_:upto]) if n else None)
            at_ = upto
        return pa.array(out, pa.string())

    # evaluated once, in a step of its own
    return run.asNondeterministic()


# -- objects ------------------------------------------------------------------


def first_value(value: Column, order: Column | str = "chunk_index") -> Column:
    """The first value in chunk order that is there and not null (as JSON text, which aggregates)."""
    order = F.col(order) if isinstance(order, str) else order
    there = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
    return F.min_by(F.to_json(value), F.when(there, order))


def merge_documents(
    values: DataFrame,
    schema: Schema,
    dedupe: str = "overlap",
    dedupe_by: Sequence[str] | str = (),
    on_conflict: str = "first",
    doc_col: str = "doc_id",
) -> DataFrame:
    """(doc, value VARIANT, conflicts ARRAY<STRING>): one row per document with a value.

    Object roots merge field by field, array roots join, any other root takes the first value.
    With on_conflict='error' conflicts names the fields with different values; 'first' skips
    looking for them.

    Values are read once: each row's fields become JSON texts, one grouping gathers them, arrays as
    lists in chunk order, and what needs a walk over a document's items gets its list only.
    """
    if on_conflict not in ("first", "error"):
        raise ValueError("on_conflict is 'first' or 'error'")
    if dedupe not in ("overlap", "none"):
        raise ValueError("dedupe is 'overlap' or 'none'")
    by = [dedupe_by] if isinstance(dedupe_by, str) else list(dedupe_by)
    whole = schema.root_kind() == "array" or schema.kind != "object"
    fields = ((ROOT, schema),) if whole else schema.fields
    at_field = lambda k: F.col("value") if k == ROOT else at(F.col("value"), f"$.{k}")
    texts, aggregates = [], []
    for i, (k, f) in enumerate(fields):
        t = F.col(f"_t{i}")
        there = t.isNotNull() & (t != "null")
        texts.append(F.to_json(at_field(k)).alias(f"_t{i}"))
        aggregates.append(F.coalesce(F.bool_or(t == "null"), F.lit(False)).alias(f"_n{i}"))
        if f.root_kind() == "array":
            gathered, more = _gathered(t, at_field(k), f, dedupe, by, i)
            texts += more
            aggregates.append(F.sort_array(F.collect_list(F.when(there, gathered))).alias(f"_c{i}"))
            aggregates.append(F.coalesce(F.bool_and(F.when(there, t.startswith("["))), F.lit(False)).alias(f"_a{i}"))
        else:
            aggregates.append(F.min_by(t, F.when(there, F.col("chunk_index"))).alias(f"_v{i}"))
        if on_conflict == "error":
            texts.append(_different(at_field(k), f).alias(f"_k{i}"))
            aggregates.append((F.min(f"_k{i}") != F.max(f"_k{i}")).alias(f"_d{i}"))
    places = [c for c in ("chunk_index", "start_index", "end_index") if c in values.columns]
    out = values.select(doc_col, *places, *texts).groupBy(doc_col).agg(*aggregates)
    if schema.root_kind() == "array":
        arrays = F.filter("_c0", lambda c: c["other"].isNull())
        text = F.coalesce(_joined(F.when(F.size(arrays) > 0, arrays), schema, dedupe, by), F.lit("[]"))
        return out.select(doc_col, F.parse_json(text).alias("value"), F.array().cast("array<string>").alias("conflicts"))
    parts, conflicts = [], []
    for i, (k, f) in enumerate(fields):
        found, is_array = F.col(f"_v{i}"), F.lit(False)
        if f.root_kind() == "array":
            is_array, of = F.col(f"_a{i}"), F.col(f"_c{i}")
            out = out.withColumn(f"_j{i}", _joined(F.when(is_array, of), f, dedupe, by))
            first = F.get(of, F.lit(0))
            said = F.concat(F.lit("["), F.coalesce(first["j"], F.lit("")), F.lit("]")) if _is_plain(f, dedupe, by) else first["j"]
            found = F.coalesce(F.col(f"_j{i}"), first["other"], F.when(F.size(of) > 0, said))
        parts.append((k, F.coalesce(found, F.when(F.col(f"_n{i}"), F.lit("null")))))
        if on_conflict == "error":
            conflicts.append(F.when(~is_array & F.col(f"_d{i}"), F.lit(k)))
    if schema.kind == "object":
        body = F.concat_ws(",", *[F.concat(F.to_json(F.lit(k).cast("variant")), F.lit(":"), t) for k, t in parts])
        value = F.parse_json(F.concat(F.lit("{"), body, F.lit("}")))
    else:
        value = F.parse_json(parts[0][1])
    differ = F.filter(F.array(*conflicts), lambda c: c.isNotNull()) if conflicts else F.array().cast("array<string>")
    return out.select(doc_col, value.alias("value"), differ.alias("conflicts"))


def _is_plain(schema: Schema, dedupe: str, by: Sequence[str]) -> bool:
    """Whether arrays are only joined."""
    return dedupe == "none" and not (by and schema.element.kind == "object")


def _different(value: Column, schema: Schema) -> Column:
    """The structural key of a value that is there; null if none is."""
    return F.when(value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False)), struct_key(value, schema))


def _gathered(t: Column, value: Column, schema: Schema, dedupe: str, by: Sequence[str], i: int) -> tuple[Column, list[Column]]:
    """What of a chunk's array goes to its document (other: what isn't an array), and columns that this needs."""
    other = F.when(~t.startswith("["), t).alias("other")
    if _is_plain(schema, dedupe, by):
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        return F.struct("chunk_index", other, F.when(t.startswith("[") & (inner != ""), inner).alias("j")), []
    parts = [F.col("chunk_index"), F.col("start_index").cast("long").alias("start"), F.col("end_index").cast("long").alias("end"), other]
    parts.append(F.when(t.startswith("["), t).alias("j"))
    if not nested.within(schema.element, lambda s: s.kind == "date"):
        return F.struct(*parts), []
    # dates are equal by instant, which columns tell
    items = items_at(value, "$")
    key = (lambda v: entity_key(v, by, schema.element)) if by else (lambda v: F.concat(F.lit("value:"), struct_key(v, schema.element)))
    return F.struct(*parts, F.col(f"_keys{i}").alias("keys")), [F.transform(items, key).alias(f"_keys{i}")]


def _joined(gathered: Column, schema: Schema, dedupe: str, by: Sequence[str]) -> Column:
    """The JSON of a document's array: its chunks' arrays joined, without what two chunks saw."""
    if _is_plain(schema, dedupe, by):
        return F.when(gathered.isNotNull(), F.concat(F.lit("["), F.array_join(gathered["j"], ","), F.lit("]")))
    return _swept(schema.element, by, dedupe)(gathered)


def merge_into(values: DataFrame, schema: Schema, **options) -> DataFrame:
    """Merge, look for conflicts, then validate: status is merged, conflict or invalid."""
    doc_col = options.get("doc_col", "doc_id")
    merged = merge_documents(values, schema, **options).withColumn("issues", issues(schema, F.col("value")))
    status = F.when(F.size("conflicts") > 0, F.lit("conflict")).when(F.size("issues") > 0, F.lit("invalid")).otherwise(F.lit("merged"))
    data = F.when(status == "merged", coerce(schema, F.col("value")))
    return merged.select(doc_col, status.alias("status"), data.alias("data"), F.col("value").alias("partial"), "issues", "conflicts")


def conflict_details(values: DataFrame, schema: Schema, doc_col: str = "doc_id") -> DataFrame:
    """(doc, field, values): each differing value with its window, in chunk order."""
    parts = None
    for k, f in schema.fields if schema.kind == "object" else ((ROOT, schema),):
        if f.root_kind() == "array":
            continue
        v = F.col("value") if k == ROOT else at(F.col("value"), f"$.{k}")
        there = values.filter(v.isNotNull() & ~F.is_variant_null(v))
        seen = there.groupBy(doc_col, struct_key(v, f).alias("k")).agg(
            F.min(F.struct("chunk_index", "start_index", "end_index", F.to_json(v).alias("value"))).alias("x")
        )
        part = seen.groupBy(doc_col).agg(F.sort_array(F.collect_list("x")).alias("values")).filter(F.size("values") > 1)
        part = part.select(doc_col, F.lit(k).alias("field"), "values")
        parts = part if parts is None else parts.unionByName(part)
    return parts
