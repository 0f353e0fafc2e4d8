"""Schemas compiled to column expressions over VARIANT.

issues(schema, value) gives an array of (path, message), empty exactly for valid values;
coerce(schema, value) gives the typed Spark value of a valid one. Both are native expressions.
Missing, null and present are told apart: a missing field is SQL null, a JSON null is a VARIANT.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from structex.functions.jsonx import at, kind_of, let
from structex.functions.schema import Schema

ISSUES = "array<struct<path:string,message:string>>"


def _none() -> Column:
    return F.array().cast(ISSUES)


def _issue(path: Column, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(path.alias("path"), message.alias("message"))).cast(ISSUES)


def _join(path: Column, key: str) -> Column:
    return F.when(path == "", F.lit(key)).otherwise(F.concat(path, F.lit("." + key)))


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _date(value: Column) -> Column:
    """The instant of a text or of milliseconds; a text without a zone is of UTC, whatever the session's."""
    text = F.trim(F.try_variant_get(value, "$", "string"))
    number = F.try_variant_get(value, "$", "double")
    in_utc = F.coalesce(F.try_to_timestamp(F.concat(text, F.when(text.contains(":"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))), F.try_to_timestamp(text))
    zoned = text.contains(":") & text.rlike(r"(?i)(z|utc|gmt|[+-]\d{1,2}(:?\d{2})?)$")
    parsed = F.when(zoned, F.try_to_timestamp(text)).otherwise(in_utc)
    return F.when(kind_of(value) == "string", parsed).when(
        kind_of(value) == "number", F.timestamp_millis(number.cast("long"))
    )


def scalar(schema: Schema, value: Column) -> Column:
    """The typed value of a scalar of the right kind, else null."""
    kind = kind_of(value)
    match schema.kind:
        case "string":
            return F.when(kind == "string", F.try_variant_get(value, "$", "string"))
        case "enum":
            text = F.try_variant_get(value, "$", "string")
            return F.when((kind == "string") & text.isin(*schema.values), text)
        case "number":
            return F.when(kind == "number", F.try_variant_get(value, "$", "double"))
        case "int":
            number = F.try_variant_get(value, "$", "double")
            return F.when((kind == "number") & (number == F.floor(number)), number.cast("long"))
        case "boolean":
            return F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean"))
        case "date":
            return _date(value)
        case "literal":
            want = schema.values[0]
            name, spark = ("boolean", "boolean") if isinstance(want, bool) else ("string", "string") if isinstance(want, str) else ("number", "double")
            got = F.try_variant_get(value, "$", spark)
            return F.when((kind == name) & (got == F.lit(want)), got)
    raise ValueError(schema.kind)


def expected(schema: Schema) -> str:
    return {
        "enum": "one of " + ", ".join(map(str, schema.values)),
        "int": "an integer",
        "array": "an array",
        "object": "an object",
        "record": "an object",
        "date": "a date",
        "literal": f"the value {schema.values[0] if schema.values else ''}",
        "union": "a value of one of the options",
    }.get(schema.kind, f"a {schema.kind}")


def issues(schema: Schema, value: Column, path: Column | None = None) -> Column:
    """What is wrong with a value, in field order."""
    path = F.lit("") if path is None else path
    kind = kind_of(value)
    wrong = F.concat(F.lit(f"Expected {expected(schema)}, received "), kind)
    match schema.kind:
        case "object":
            fields = [let(at(value, f"$.{k}"), lambda v, k=k, f=f: issues(f, v, _join(path, k))) for k, f in schema.fields]
            body = F.when(kind == "object", _all(fields)).otherwise(_issue(path, wrong))
            checked = F.when(kind == "object", coerce(schema, value)) if schema.checks else None
        case "array":
            items = F.try_variant_get(value, "$", "array<variant>")
            each = F.flatten(
                F.transform(items, lambda v, i: issues(schema.element, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            )
            body = F.when(kind == "array", each).otherwise(_issue(path, wrong))
            checked = F.when(kind == "array", coerce(schema, value)) if schema.checks else None
        case "record":
            entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
            each = F.flatten(
                F.transform(
                    entries,
                    lambda e: issues(schema.element, e["value"], F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"]))),
                )
            )
            body = F.when(kind == "object", each).otherwise(_issue(path, wrong))
            checked = None
        case "union":
            fits = reduce(lambda a, b: a | b, [F.size(issues(o, value, path)) == 0 for o in schema.options])
            body = F.when(fits, _none()).otherwise(_issue(path, wrong))
            checked = None
        case _:
            checked = scalar(schema, value)
            body = F.when(checked.isNull(), _issue(path, wrong)).otherwise(_none())
    if schema.checks:
        # refinements see values of the right shape only, whatever other refinements say of their parts
        failed = lambda c: checked.isNotNull() & ~F.coalesce(c.predicate(checked), F.lit(False))
        broken = _all([F.when(failed(c), _issue(reduce(_join, c.path, path), c.message)).otherwise(_none()) for c in schema.checks])
        misshapen = issues(schema.shape(), value, path) if schema.refined_within() else body
        body = F.concat(body, F.when(F.size(misshapen) == 0, broken).otherwise(_none()))
    absent = _none() if schema.is_optional or schema.has_default else _issue(path, "Required")
    body = F.when(kind == "missing", absent).otherwise(body)
    return F.when(kind == "null", _none()).otherwise(body) if schema.is_nullable else body


def coerce(schema: Schema, value: Column) -> Column:
    """The typed value: undeclared keys go, defaults fill what is missing (never what is null)."""
    match schema.kind:
        case "object":
            typed = F.struct(*[let(at(value, f"$.{k}"), lambda v, f=f: coerce(f, v)).alias(k) for k, f in schema.fields])
            out = F.when(kind_of(value) == "object", typed)
        case "array":
            items = F.try_variant_get(value, "$", "array<variant>")
            out = F.when(kind_of(value) == "array", F.transform(items, lambda v: coerce(schema.element, v)))
        case "record":
            entries = F.try_variant_get(value, "$", "map<string,variant>")
            out = F.when(kind_of(value) == "object", F.transform_values(entries, lambda _, v: coerce(schema.element, v)))
        case "union":
            out = value
        case _:
            out = scalar(schema, value)
    if schema.has_default:
        default = _literal(schema.default_value).cast(schema.spark_type())
        out = F.when(value.isNull(), default).otherwise(out)
    return out


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def union_option(schema: Schema, value: Column) -> Column:
    """The number of the first option that a value fits; null if none does."""
    out = None
    for i, option in enumerate(schema.options):
        fits = F.size(issues(option, value)) == 0
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return out


def unwrap_items(value: Column) -> Column:
    """A root array arrives bare or as {items}; the bare form either way, else the value itself."""
    inner = at(value, "$.items")
    wrapped = (kind_of(value) == "object") & (kind_of(inner) == "array")
    return F.when(wrapped, inner).otherwise(value)


# Fixed wording.
INVALID, FIX = "The previous output failed schema validation:\n", "\nFix the JSON and try again."
BROKEN = "The previous output was not valid JSON.\nReturn a single JSON object that matches the schema."


def reask_text(issues_col: Column, parse_failed: Column) -> Column:
    """What a model is told about its last answer."""
    lines = F.transform(
        issues_col,
        lambda i: F.concat(F.lit("- "), F.when(i["path"] == "", F.lit("(root)")).otherwise(i["path"]), F.lit(": "), i["message"]),
    )
    invalid = F.concat(
        F.lit(INVALID),
        F.array_join(lines, "\n"),
        F.lit(FIX),
    )
    return F.when(parse_failed, F.lit(BROKEN)).otherwise(invalid)


def plain_json(schema: Schema, value: Column, own: Column | None = None, place: Column | None = None) -> Column:
    """A valid value as JSON text: undeclared keys gone, defaults filled in, null and missing kept apart.

    own: a map from places of quotes to the texts that stand there instead.
    """
    place = F.lit("") if place is None else place
    match schema.kind:
        case "object":
            fields = []
            for k, f in schema.fields:
                inner = _join(place, k)
                if schema.quoted and k == "substring_quotes" and own is not None:
                    text = _quotes_json(at(value, f"$.{k}"), own, inner)
                else:
                    text = plain_json(f, at(value, f"$.{k}"), own, inner)
                fields.append(F.concat(F.to_json(F.lit(k).cast("variant")), F.lit(":"), text))
            out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
        case "array":
            items = F.try_variant_get(value, "$", "array<variant>")
            each = F.transform(items, lambda v, i: plain_json(schema.element, v, own, F.concat(place, F.lit("["), i.cast("string"), F.lit("]"))))
            out = F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))
        case "record" if own is not None:
            entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

            def entry(e: Column) -> Column:
                key = F.to_json(e["key"].cast("variant"))
                inner = F.when(place == "", key).otherwise(F.concat(place, F.lit("."), key))
                return F.concat(key, F.lit(":"), plain_json(schema.element, e["value"], own, inner))

            out = F.concat(F.lit("{"), F.array_join(F.transform(entries, entry), ","), F.lit("}"))
        case "union" if own is not None:
            option, out = union_option(schema, value), F.to_json(value)
            for k, one in enumerate(schema.options):
                out = F.when(option == k, plain_json(one, value, own, place)).otherwise(out)
        case _:
            out = F.to_json(value)
    if schema.is_nullable:
        out = F.when(F.is_variant_null(value), F.lit("null")).otherwise(out)
    default = F.lit(json.dumps(schema.default_value)) if schema.has_default else F.lit(None).cast("string")
    return F.when(value.isNull(), default).otherwise(out)


def _quotes_json(value: Column, own: Column, place: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<string>")
    text = lambda q, i: F.coalesce(F.try_element_at(own, F.concat(place, F.lit("["), i.cast("string"), F.lit("]"))), q)
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda q, i: F.to_json(text(q, i).cast("variant"))), ","), F.lit("]"))
