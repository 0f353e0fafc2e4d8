"""Wire formats: requests out, replies in, follow-ups after a bad reply, stream deltas.

Everything here is a column expression, so a table of calls is encoded or parsed in one narrow
stage. Messages are ARRAY<STRUCT<role, content VARIANT, tool_call_id, tool_calls>>.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structex.functions.jsonx import at, is_blank, items_at, kind_of, last_span, let, strict_json, text_at
from structex.functions.schema import Schema, dumps, strict_check

# Fixed values of the wire formats.
TOOL_NAME = "extract"
TOOL_DESCRIPTION = "Return data that matches the schema."
DEFAULT_MAX_TOKENS = 1024
DATA_URL = r"^data:([^;]+);base64,(.+)$"

TOOLS, JSON_SCHEMA, MD_JSON, ANTHROPIC_TOOLS, GEMINI_JSON = MODES = (
    "TOOLS",
    "JSON_SCHEMA",
    "MD_JSON",
    "ANTHROPIC_TOOLS",
    "GEMINI_JSON",
)
MESSAGE = (
    "struct<role:string,content:variant,tool_call_id:string,"
    "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>"
)
_CHOICE = "$.choices[0].message"


def variant(value: Column) -> Column:
    return value.cast("variant")


def message(role: str | Column, content: Column, tool_call_id: Column | None = None, tool_calls: Column | None = None) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    none = F.lit(None)
    return F.struct(
        role.cast("string").alias("role"),
        content.alias("content"),
        (none if tool_call_id is None else tool_call_id).cast("string").alias("tool_call_id"),
        (none if tool_calls is None else tool_calls)
        .cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")
        .alias("tool_calls"),
    )


def text_message(role: str | Column, text: Column) -> Column:
    return message(role, variant(text))


# -- requests ---------------------------------------------------------------


def merge_sampling(call: dict[str, Column], defaults: dict[str, Column]) -> dict[str, Column]:
    """Sampling fields by name: the call's over the defaults; unset ones stay away."""
    return {
        k: F.coalesce(*[d[k] for d in (call, defaults) if k in d])
        for k in ("temperature", "max_tokens", "top_p")
        if k in call or k in defaults
    }


def _json(value: dict) -> Column:
    return F.parse_json(F.lit(dumps(value)))


def _body(parts: dict[str, Column], sampling: dict[str, Column]) -> Column:
    """The request as JSON text; sampling comes last and overrides; nulls stay away."""
    merged = dict(parts)
    for name, value in sampling.items():
        merged[name] = F.coalesce(value, parts[name]) if name in parts else value
    return F.to_json(F.struct(*[v.alias(k) for k, v in merged.items()]))


def md_json_instruction(schema: Schema) -> str:
    # Fixed wording.
    lines = ["Reply with only JSON inside a markdown fence:", "", "```json", "...", "```", "", "The JSON must match this schema:"]
    return "\n".join([*lines, dumps(schema.json_schema(), pretty=True)])


def _system_text(messages: Column) -> Column:
    """String system messages joined by a blank line; null if there are none."""
    lifted = F.filter(messages, lambda m: (m["role"] == "system") & (kind_of(m["content"]) == "string"))
    texts = F.transform(lifted, lambda m: F.try_variant_get(m["content"], "$", "string"))
    return F.when(F.size(lifted) > 0, F.array_join(texts, "\n\n"))


def _others(messages: Column) -> Column:
    return F.filter(messages, lambda m: ~F.coalesce((m["role"] == "system") & (kind_of(m["content"]) == "string"), F.lit(False)))


def image_url(url: Column, detail: Column | None = None) -> Column:
    inner = F.struct(url.alias("url"), *([] if detail is None else [detail.alias("detail")]))
    return F.to_variant_object(F.struct(F.lit("image_url").alias("type"), inner.alias("image_url")))


def anthropic_image(url: Column) -> Column:
    source = F.struct(F.lit("url").alias("type"), url.alias("url"))
    return F.to_variant_object(F.struct(F.lit("image").alias("type"), source.alias("source")))


def anthropic_image_base64(data: Column, media_type: Column) -> Column:
    source = F.struct(F.lit("base64").alias("type"), media_type.alias("media_type"), data.alias("data"))
    return F.to_variant_object(F.struct(F.lit("image").alias("type"), source.alias("source")))


def anthropic_block(block: Column) -> Column:
    """image_url blocks become image blocks, inline data or a link; others stay as they are."""
    url = text_at(block, "$.image_url.url")
    media = F.regexp_extract(url, DATA_URL, 1)
    inline = anthropic_image_base64(F.regexp_extract(url, DATA_URL, 2), media)
    image = F.when(url.rlike(DATA_URL), inline).otherwise(anthropic_image(url))
    return F.when(text_at(block, "$.type") == "image_url", image).otherwise(block)


def _anthropic_message(m: Column) -> Column:
    blocks = F.try_variant_get(m["content"], "$", "array<variant>")
    mapped = F.to_variant_object(F.transform(blocks, anthropic_block))
    return F.struct(
        m["role"].alias("role"),
        F.when(kind_of(m["content"]) == "array", mapped).otherwise(m["content"]).alias("content"),
        m["tool_call_id"].alias("tool_call_id"),
        m["tool_calls"].alias("tool_calls"),
    )


def _gemini_part(block: Column) -> Column:
    text = F.to_variant_object(F.struct(text_at(block, "$.text").alias("text")))
    file = F.struct(F.struct(text_at(block, "$.image_url.url").alias("fileUri")).alias("fileData"))
    return F.when(text_at(block, "$.type") == "text", text).when(
        text_at(block, "$.type") == "image_url", F.to_variant_object(file)
    )


def gemini_contents(messages: Column) -> Column:
    def content(m: Column) -> Column:
        plain = F.array(F.to_variant_object(F.struct(F.coalesce(F.try_variant_get(m["content"], "$", "string"), F.lit("")).alias("text"))))
        blocks = F.try_variant_get(m["content"], "$", "array<variant>")
        parts = F.filter(F.transform(blocks, _gemini_part), lambda p: p.isNotNull())
        parts = F.when((kind_of(m["content"]) == "array") & (F.size(parts) > 0), parts).otherwise(plain)
        role = F.when(m["role"] == "assistant", F.lit("model")).otherwise(F.lit("user"))
        return F.struct(role.alias("role"), parts.alias("parts"))

    return F.transform(_others(messages), content)


def _gemini_system(messages: Column) -> Column:
    text = _system_text(messages)
    return F.when(text.isNotNull(), F.struct(F.array(F.struct(text.alias("text"))).alias("parts")))


def gemini_config(schema: Schema, sampling: dict[str, Column]) -> Column:
    """Gemini-shaped clients take sampling inside config, under their own names."""
    names = {"temperature": "temperature", "max_tokens": "maxOutputTokens", "top_p": "topP"}
    return F.struct(
        F.lit("application/json").alias("responseMimeType"),
        _json(schema.wire_schema()).alias("responseJsonSchema"),
        *[sampling[k].alias(v) for k, v in names.items() if k in sampling],
    )


def encode(mode: str, schema: Schema, model: Column, messages: Column, sampling: dict[str, Column] | None = None) -> Column:
    """The request body of a call as JSON text."""
    sampling = sampling or {}
    head = {"model": model, "messages": messages}
    if mode == TOOLS:
        function = {"name": TOOL_NAME, "description": TOOL_DESCRIPTION, "parameters": schema.wire_schema()}
        head |= {
            "tools": _json([{"type": "function", "function": function}]),
            "tool_choice": _json({"type": "function", "function": {"name": TOOL_NAME}}),
        }
    elif mode == JSON_SCHEMA:
        wire = schema.wire_schema()
        strict_check(wire)
        head["response_format"] = _json(
            {"type": "json_schema", "json_schema": {"name": TOOL_NAME, "strict": True, "schema": wire}}
        )
    elif mode == MD_JSON:
        head["messages"] = F.concat(F.array(text_message("system", F.lit(md_json_instruction(schema)))), messages)
    elif mode == ANTHROPIC_TOOLS:
        head |= {
            "messages": F.transform(_others(messages), _anthropic_message),
            "max_tokens": F.lit(DEFAULT_MAX_TOKENS),
            "tools": _json([{"name": TOOL_NAME, "description": TOOL_DESCRIPTION, "input_schema": schema.wire_schema()}]),
            "tool_choice": _json({"type": "tool", "name": TOOL_NAME, "disable_parallel_tool_use": True}),
            "system": _system_text(messages),
        }
    elif mode == GEMINI_JSON:
        return _body(
            {
                "model": model,
                "contents": gemini_contents(messages),
                "config": gemini_config(schema, sampling),
                "systemInstruction": _gemini_system(messages),
            },
            {},
        )
    else:
        raise ValueError(f"unknown mode {mode}: one of {', '.join(MODES)}")
    return _body(head, sampling)


def chunk_prompt(instruction: str, text: Column) -> Column:
    return F.concat(F.lit(instruction), F.lit("\n\n---\n\n"), text)


# -- replies ----------------------------------------------------------------


def _parsed(value: Column, error: Column) -> Column:
    """STRUCT<value VARIANT, error STRING>: the error is null exactly if there is a value."""
    return let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), error).alias("error")))


def _parse_tools(v: Column) -> Column:
    args = text_at(v, f"{_CHOICE}.tool_calls[0].function.arguments")
    missing = F.lit("Response has no tool call arguments")
    return let(args, lambda a: _parsed(strict_json(a), F.when(a.isNull(), missing).otherwise(F.lit("Tool call arguments are not valid JSON"))))


def _content(v: Column) -> Column:
    return let(text_at(v, f"{_CHOICE}.content"), lambda text: F.when(~is_blank(text), text))


_NO_CONTENT, _NOT_JSON = "Response has no JSON content", "Message content is not valid JSON"


def _parse_json_schema(v: Column) -> Column:
    return let(_content(v), lambda text: _parsed(strict_json(text), F.when(text.isNull(), F.lit(_NO_CONTENT)).otherwise(F.lit(_NOT_JSON))))


@F.arrow_udf(T.StructType().add("text", "string").add("span", "string"))
def _last_json_span(texts: pa.Array) -> pa.Array:
    """A bracket stack isn't regular, so this one scan is Python; batches come through Arrow.

    The text comes back beside its span, or else the plan makes it again behind this step.
    """
    found = pa.array([None if text is None else last_span(text) for text in texts.to_pylist()], pa.string())
    return pa.StructArray.from_arrays([texts, found], names=["text", "span"])


# so that plans evaluate it once, in a step of its own, and don't copy it into every expression that uses the value
_last_json_span = _last_json_span.asNondeterministic()


def _parse_md_json(v: Column) -> Column:
    def read(x: Column) -> Column:
        value = F.coalesce(F.try_parse_json(x["span"]), strict_json(x["text"]))
        return _parsed(value, F.when(x["text"].isNull(), F.lit(_NO_CONTENT)).otherwise(F.lit(_NOT_JSON)))

    return let(_last_json_span(_content(v)), read)


def _tool_use(v: Column) -> Column:
    """The first tool_use block with a string id and name."""
    usable = F.filter(
        items_at(v, "$.content"),
        lambda b: (text_at(b, "$.type") == "tool_use") & text_at(b, "$.id").isNotNull() & text_at(b, "$.name").isNotNull(),
    )
    return F.get(usable, 0)


def _parse_anthropic(v: Column) -> Column:
    def read(block: Column, text: Column) -> Column:
        given = at(block, "$.input")
        value = F.when(text.isNotNull(), strict_json(text)).otherwise(given)
        error = (
            F.when(block.isNull(), F.lit("Response has no tool_use block"))
            .when(given.isNull(), F.lit("tool_use input is missing"))
            .otherwise(F.lit("tool_use input is not valid JSON"))
        )
        return _parsed(value, error)

    return let(_tool_use(v), lambda block: let(text_at(block, "$.input"), lambda text: read(block, text)))


def gemini_text(v: Column) -> Column:
    direct = text_at(v, "$.text")
    parts = F.transform(items_at(v, "$.candidates[0].content.parts"), lambda p: F.coalesce(text_at(p, "$.text"), F.lit("")))
    solid = lambda text: let(text, lambda t: F.when(~is_blank(t), t))
    return F.coalesce(solid(direct), solid(F.array_join(parts, "")))


def _parse_gemini(v: Column) -> Column:
    missing = F.lit("Gemini response has no JSON text")
    return let(gemini_text(v), lambda text: _parsed(strict_json(text), F.when(text.isNull(), missing).otherwise(F.lit(_NOT_JSON))))


_PARSERS: dict[str, Callable[[Column], Column]] = {
    TOOLS: _parse_tools,
    JSON_SCHEMA: _parse_json_schema,
    MD_JSON: _parse_md_json,
    ANTHROPIC_TOOLS: _parse_anthropic,
    GEMINI_JSON: _parse_gemini,
}


def parse(mode: str, raw: Column) -> Column:
    """A raw reply (JSON text) to STRUCT<value VARIANT, error STRING>."""
    if mode == MD_JSON:  # Python functions can't stand in a lambda
        return _parse_md_json(F.try_parse_json(raw))
    return let(F.try_parse_json(raw), _PARSERS[mode])


def parse_by(mode: Column, raw: Column) -> Column:
    """The same where the mode is a column."""
    out = None
    for name in _PARSERS:
        out = F.when(mode == name, parse(name, raw)) if out is None else out.when(mode == name, parse(name, raw))
    return out


def tool_calls(v: Column) -> Column:
    """Calls with string id, name and arguments; null if there is none."""
    found = F.transform(
        items_at(v, f"{_CHOICE}.tool_calls"),
        lambda c: F.struct(
            text_at(c, "$.id").alias("id"),
            F.lit("function").alias("type"),
            F.struct(text_at(c, "$.function.name").alias("name"), text_at(c, "$.function.arguments").alias("arguments")).alias("function"),
        ),
    )
    whole = F.filter(found, lambda c: c["id"].isNotNull() & c["function"]["name"].isNotNull() & c["function"]["arguments"].isNotNull())
    return let(whole, lambda calls: F.when(F.size(calls) > 0, calls))


def _assistant(v: Column) -> Column:
    text = text_at(v, f"{_CHOICE}.content")
    null = F.parse_json(F.lit("null"))
    return message("assistant", F.coalesce(variant(text), null), tool_calls=tool_calls(v))


def reask(mode: str, messages: Column, raw: Column, error_text: Column) -> Column:
    """The messages of the next attempt: what the model said, and what was wrong with it."""
    return F.concat(messages, let(F.try_parse_json(raw), lambda v: _follow_up(mode, v, error_text)))


def _follow_up(mode: str, v: Column, error_text: Column) -> Column:
    if mode == TOOLS:

        def answered(call_id: Column) -> Column:
            as_tool = message("tool", variant(error_text), tool_call_id=call_id)
            return F.when(call_id.isNotNull(), as_tool).otherwise(text_message("user", error_text))

        return F.array(_assistant(v), let(F.get(tool_calls(v), 0)["id"], answered))
    if mode in (JSON_SCHEMA, MD_JSON):
        return F.array(_assistant(v), text_message("user", error_text))
    if mode == ANTHROPIC_TOOLS:
        keep = F.filter(
            items_at(v, "$.content"),
            lambda b: ((text_at(b, "$.type") == "tool_use") & text_at(b, "$.id").isNotNull())
            | ((text_at(b, "$.type") == "text") & text_at(b, "$.text").isNotNull()),
        )
        said = F.transform(
            keep,
            lambda b: F.when(
                text_at(b, "$.type") == "tool_use",
                F.to_variant_object(
                    F.struct(
                        F.lit("tool_use").alias("type"),
                        text_at(b, "$.id").alias("id"),
                        F.coalesce(text_at(b, "$.name"), F.lit(TOOL_NAME)).alias("name"),
                        at(b, "$.input").alias("input"),
                    )
                ),
            ).otherwise(F.to_variant_object(F.struct(F.lit("text").alias("type"), text_at(b, "$.text").alias("text")))),
        )
        content = let(said, lambda s: F.when(F.size(s) > 0, F.to_variant_object(s)).otherwise(F.parse_json(F.lit("null"))))

        def result(use_id: Column) -> Column:
            block = F.struct(
                F.lit("tool_result").alias("type"),
                use_id.alias("tool_use_id"),
                error_text.alias("content"),
                F.lit(True).alias("is_error"),
            )
            return F.when(use_id.isNotNull(), F.to_variant_object(F.array(block))).otherwise(variant(error_text))

        return F.array(message("assistant", content), message("user", let(text_at(_tool_use(v), "$.id"), result)))
    if mode == GEMINI_JSON:
        said = F.coalesce(gemini_text(v), F.lit(""))
        return F.array(text_message("assistant", said), text_message("user", error_text))
    raise ValueError(mode)


def delta(mode: str, raw: Column) -> Column:
    """The text that one stream chunk adds."""
    found = {
        TOOLS: lambda v: text_at(v, "$.choices[0].delta.tool_calls[0].function.arguments"),
        JSON_SCHEMA: lambda v: text_at(v, "$.choices[0].delta.content"),
        MD_JSON: lambda v: text_at(v, "$.choices[0].delta.content"),
        ANTHROPIC_TOOLS: lambda v: text_at(v, "$.delta.partial_json"),
        GEMINI_JSON: lambda v: gemini_text(v),
    }[mode]
    return F.coalesce(let(F.try_parse_json(raw), found), F.lit(""))
