"""Verified citations: quotes must stand in the source; good ones become the exact source text."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structex.functions.jsonx import items_at, kind_of, trim_text
from structex.functions.schema import Schema
from structex.operators import nested

QUOTE_LENGTH = 120
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPACE = re.compile(r"[\s﻿]+")


@lru_cache(maxsize=1)
def _normal(text: str) -> str:
    """Lower case, character by character, with single spaces."""
    flat = _SPACE.sub(" ", text)
    # a capital sigma is the only letter whose lower case depends on what stands around it
    return "".join(map(str.lower, flat)) if "Σ" in flat else flat.lower()


def _place(text: str, wanted: int) -> int:
    """The original place of a character of _normal(text)."""
    grows = "İ" in text  # the only letter whose lower case is longer
    seen = at = 0
    for m in _SPACE.finditer(text):
        size = m.start() - at
        if grows:
            size = len(text[at : m.start()].lower())
        if wanted < seen + size:
            break
        if wanted == seen + size:
            return m.start()
        seen, at = seen + size + 1, m.end()
    if not grows:
        return at + wanted - seen
    while (seen := seen + len(text[at].lower())) <= wanted:
        at += 1
    return at


def locate(quote: str, source: str) -> tuple[int, int] | None:
    """(start, end) of a quote: the exact text first, then case and white space aside."""
    wanted = quote.strip("﻿ \t\r\n\f\v ") if quote else ""
    if not wanted:
        return None
    if (at := source.find(wanted)) >= 0:
        return at, at + len(wanted)
    plain = _SPACE.sub(" ", wanted).lower()
    if (at := _normal(source).find(plain)) < 0:
        return None
    return _place(source, at), _place(source, at + len(plain) - 1) + 1


@F.arrow_udf(SPANS)
def _spans(quotes: pa.Array, sources: pa.Array) -> pa.Array:
    """One text at a time: a batch is held once, as Arrow has it."""

    def one(qs: list[str], source: str) -> list[dict | None]:
        found = [locate(q, source) for q in qs]
        return [{"start": f[0], "end": f[1]} if f else None for f in found]

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.array((one(q.as_py(), s.as_py()) if q.is_valid and s.is_valid else None for q, s in zip(quotes, sources, strict=True)), kind)


# evaluated once, in a step of its own
_spans = _spans.asNondeterministic()


def exact_spans(quotes: Column, source: Column) -> Column:
    """Spans of quotes that stand word for word in the source, else null; native."""

    def one(q: Column) -> Column:
        trimmed = trim_text(q)
        at = F.instr(source, trimmed)
        return F.when(
            (F.length(trimmed) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(trimmed)).alias("end"))
        )

    return F.transform(quotes, one)


def spans(quotes: Column, source: Column) -> Column:
    """Spans of all quotes; only rows with a quote that isn't word for word go through Python."""
    exact = exact_spans(quotes, source)
    inexact = F.exists(exact, lambda s: s.isNull())
    other = _spans(F.when(inexact, quotes), F.when(inexact, source))
    return F.when(inexact, other).otherwise(exact)


def rewritten(spans_col: Column, source: Column) -> Column:
    """The source's own words for each span."""
    return F.transform(spans_col, lambda s: F.substring(source, s["start"] + 1, s["end"] - s["start"]))


def _not_found(quote: Column) -> Column:
    short = F.when(F.length(quote) > QUOTE_LENGTH, F.concat(F.substring(quote, 1, QUOTE_LENGTH), F.lit("…"))).otherwise(quote)
    return F.concat(F.lit('Quote not found in source: "'), short, F.lit('"'))


def not_found(quote: str) -> str:
    """The same of a Python text."""
    return f'Quote not found in source: "{quote[:QUOTE_LENGTH]}{"…" if len(quote) > QUOTE_LENGTH else ""}"'


def citation_issues(quotes: Column, spans_col: Column, field: str = "substring_quotes") -> Column:
    """An issue for each quote that isn't in the source; without a source nothing is checked."""

    def one(s: Column, i: Column) -> Column:
        quote = F.element_at(quotes, i + 1)
        path = F.concat(F.lit(f"{field}["), i.cast("string"), F.lit("]"))
        return F.when(s.isNull(), F.struct(path.alias("path"), _not_found(quote).alias("message")))

    return F.filter(F.transform(spans_col, one), lambda x: x.isNotNull())


QUOTES = "array<struct<path:string,place:string,quote:string>>"


def is_cited(schema: Schema) -> bool:
    """Whether an object with quotes lies anywhere in a schema."""
    return nested.within(schema, lambda s: s.quoted)


def quotes(schema: Schema, value: Column, field: str = "substring_quotes") -> Column:
    """All quotes of a value, at any depth, with where they stand; what isn't a text is no quote."""

    def own(_: Schema, node: Column, path: Column, place: Column) -> Column:
        named = lambda p, i: F.concat(F.when(p == "", F.lit(field)).otherwise(F.concat(p, F.lit(f".{field}"))), F.lit("["), i.cast("string"), F.lit("]"))
        text = lambda q: F.when(kind_of(q) == "string", F.try_variant_get(q, "$", "string"))
        listed = F.transform(items_at(node, f"$.{field}"), lambda q, i: F.struct(named(path, i).alias("path"), named(place, i).alias("place"), text(q).alias("quote")))
        return F.filter(listed, lambda q: q["quote"].isNotNull())

    return nested.gather(schema, value, lambda s: s.quoted, own, QUOTES)


def quote_issues(quotes_col: Column, spans_col: Column) -> Column:
    """An issue at its path for each of the quotes that has no span."""
    each = F.zip_with(quotes_col, spans_col, lambda q, s: F.when(s.isNull(), F.struct(q["path"].alias("path"), _not_found(q["quote"]).alias("message"))))
    return F.filter(each, lambda x: x.isNotNull())


def own_words(quotes_col: Column, spans_col: Column, source: Column) -> Column:
    """Place of each quote that was found to the source's own words."""
    text = lambda s: F.substring(source, s["start"] + 1, s["end"] - s["start"])
    entries = F.zip_with(quotes_col, spans_col, lambda q, s: F.when(s.isNotNull(), F.struct(q["place"], text(s))))
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
