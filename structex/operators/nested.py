"""Walks a schema over a value and gathers what some of its nodes have, wherever they lie.

The walk happens on the driver, once; what it makes is one native expression over a VARIANT. Only
branches in which a wanted node lies are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from structex.functions.jsonx import at, kind_of
from structex.functions.schema import Schema
from structex.functions.validate import union_option


def nodes(schema: Schema) -> Iterator[Schema]:
    """The schema and all below it, parents first."""
    yield schema
    for _, field in schema.fields:
        yield from nodes(field)
    if schema.element is not None:
        yield from nodes(schema.element)
    for option in schema.options:
        yield from nodes(option)


def within(schema: Schema, wanted: Callable[[Schema], bool]) -> bool:
    return any(map(wanted, nodes(schema)))


def gather(
    schema: Schema,
    value: Column,
    wanted: Callable[[Schema], bool],
    found: Callable[[Schema, Column, Column, Column], Column],
    kind: str,
    path: Column | None = None,
    place: Column | None = None,
) -> Column:
    """All that found(node, value, path, place) gives, as one array of the kind given, in the order of the value.

    path is what people read; place is the same with keys of records quoted, so that two places
    never have one name. A union is read by the first option that the value fits.
    """
    path, place = F.lit("") if path is None else path, F.lit("") if place is None else place
    nothing = F.array().cast(kind)
    parts = []
    if wanted(schema):
        parts.append(found(schema, value, path, place))

    def down(inner: Schema, inner_value: Column, step: Column, quoted: Column | None = None) -> Column:
        quoted = step if quoted is None else quoted
        joined = lambda a, b: F.when((a == "") & F.startswith(b, F.lit(".")), F.substring(b, 2, 1 << 30)).otherwise(F.concat(a, b))
        return gather(inner, inner_value, wanted, found, kind, joined(path, step), joined(place, quoted))

    match schema.kind:
        case "object":
            parts += [down(f, at(value, f"$.{k}"), F.lit(f".{k}")) for k, f in schema.fields if within(f, wanted)]
        case "array" if within(schema.element, wanted):
            items = F.try_variant_get(value, "$", "array<variant>")
            step = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
            parts.append(F.flatten(F.transform(items, lambda v, i: down(schema.element, v, step(i)))))
        case "record" if within(schema.element, wanted):
            entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
            quoted = lambda e: F.concat(F.lit("."), F.to_json(e["key"].cast("variant")))
            each = lambda e: down(schema.element, e["value"], F.concat(F.lit("."), e["key"]), quoted(e))
            parts.append(F.flatten(F.transform(entries, each)))
        case "union":
            option = union_option(schema, value)
            for k, one in enumerate(schema.options):
                if within(one, wanted):
                    parts.append(F.when(option == k, gather(one, value, wanted, found, kind, path, place)))
    parts = [F.coalesce(p, nothing) for p in parts]
    out = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else nothing
    return F.when(kind_of(value).isin("missing", "null"), nothing).otherwise(out)
