"""extract(): calls to validated values. extract_documents(): documents to merged values.

Batch functions never raise for a row: each row has a status and what went wrong.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structex.functions import account
from structex.functions.jsonx import at
from structex.functions.schema import VERDICT, Judged, Schema
from structex.functions.validate import coerce, issues, plain_json, reask_text, unwrap_items
from structex.operators import chunk, cite, inorder, judge, merge, modes, retry
from structex.plans.durable import durable
from structex.sources.clients import CallClient, ModelClient, ReplayClient, RuleClient, with_timeout


@dataclass(frozen=True)
class Options:
    """Knobs of a document run; documented defaults."""

    chunk_size: int = chunk.CHUNK_SIZE
    overlap: int = chunk.OVERLAP
    chunker: chunk.Chunker | None = None
    mode: str | None = None
    max_retries: int = retry.MAX_RETRIES
    on_chunk_error: str = "skip"
    dedupe: str = "overlap"
    dedupe_by: Sequence[str] | str = ()
    on_conflict: str = "first"
    token_budget: int | None = None
    chunk_token_budget: int | None = None
    timeout: int | None = None

    def check(self) -> None:
        account.check_max_retries(self.max_retries)
        account.check_token_budget(self.token_budget)
        account.check_token_budget(self.chunk_token_budget)
        account.check_timeout(self.timeout)
        if self.on_chunk_error not in ("skip", "abort"):
            raise ValueError("on_chunk_error is 'skip' or 'abort'")
        if self.dedupe not in ("overlap", "none") or self.on_conflict not in ("first", "error"):
            raise ValueError("dedupe is 'overlap' or 'none', on_conflict 'first' or 'error'")


def read_replies(replies: DataFrame, schema: Schema, mode: str, raw: str = "raw", error: str = "error", context: Column | None = None) -> DataFrame:
    """Add value, issues, parse_error, usage, truncated, status and data to replies.

    status: ok, provider_error, truncated, JsonParseError or SchemaValidationError. context is the
    source text: quotes, at any depth of the schema, that don't stand in it are issues, and those
    that do become the source's own words, in value and data.
    """
    v = F.try_parse_json(F.col(raw))
    parsed = replies.withColumn("_p", modes.parse(mode, F.col(raw)))
    value = unwrap_items(F.col("_p.value")) if schema.root_kind() == "array" else F.col("_p.value")
    rows = parsed.withColumns({"value": value, "parse_error": F.col("_p.error"), "usage": account.usage(v), "truncated": account.truncation_reason(v)}).drop("_p")
    rows = rows.withColumn("issues", F.when(F.col("value").isNotNull(), issues(schema, F.col("value"))))
    quoted = context is not None and cite.is_cited(schema)
    if quoted:
        rows = rows.withColumn("_quotes", cite.quotes(schema, F.col("value")))
        rows = rows.withColumn("_spans", cite.spans(F.transform("_quotes", lambda q: q["quote"]), context))
        rows = rows.withColumn("issues", F.concat("issues", cite.quote_issues(F.col("_quotes"), F.col("_spans"))))
    status = (
        F.when(F.col(error).isNotNull(), F.lit("provider_error"))
        .when(F.size("issues") == 0, F.lit("ok"))
        .when(F.col("truncated").isNotNull(), F.lit("truncated"))
        .when(F.col("parse_error").isNotNull(), F.lit("JsonParseError"))
        .otherwise(F.lit("SchemaValidationError"))
    )
    rows = rows.withColumn("status", status)
    if quoted:
        own = F.parse_json(plain_json(schema, F.col("value"), cite.own_words(F.col("_quotes"), F.col("_spans"), context)))
        rows = rows.withColumn("value", F.when(F.col("status") == "ok", own).otherwise(F.col("value"))).drop("_quotes", "_spans")
    return rows.withColumn("data", F.when(F.col("status") == "ok", coerce(schema, F.col("value"))))


def extract(
    calls: DataFrame,
    schema: Schema,
    client: ModelClient,
    mode: str | None = None,
    max_retries: int = retry.MAX_RETRIES,
    token_budget: int | None = None,
    sampling: dict[str, Column] | None = None,
    context: Column | None = None,
    timeout: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Live retry loop over calls (call_id, model, messages): every attempt, with outcome.

    outcome is success, provider_error, truncated, judge_error, exhausted, exceeded or unavailable
    (the budget), or continue, where another attempt follows; is_last_attempt says which one a call ended with.
    carry: other columns of calls that come along.
    """
    account.check_max_retries(max_retries)
    account.check_token_budget(token_budget)
    account.check_timeout(timeout)
    mode = mode or client.default_mode
    if timeout is not None and isinstance(client, CallClient):
        client = with_timeout(client, timeout, client.deadline)

    def verdicts(rule: Judged, asked: DataFrame) -> DataFrame:
        judged = extract(asked, VERDICT, rule.client or client, max_retries=rule.max_retries).filter("is_last_attempt")
        return judged.select("call_id", "data.is_valid", "data.reason")

    def ask(open_: DataFrame, attempt: int) -> DataFrame:
        body = modes.encode(mode, schema, F.col("model"), F.col("messages"), sampling)
        had = F.col("spent") if "spent" in open_.columns else F.lit(0)
        known = F.col("accounted") if "accounted" in open_.columns else F.lit(True)
        requests = open_.select("call_id", "model", "messages", *carry, had.cast("long").alias("spent"), known.alias("accounted")).withColumn("body", body)
        read = read_replies(client.ask(requests.withColumn("attempt", F.lit(attempt))).drop("attempt"), schema, mode, context=context)
        if judge.rules(schema):
            # what was answered is paid for: it is written before its values are judged
            read = judge.judge_values(durable(read), schema, verdicts)
        read = read.withColumns(
            {
                "spent": F.col("spent") + F.coalesce("usage.total_tokens", F.lit(0)),
                "accounted": F.col("accounted") & (F.col("usage").isNotNull() | F.col("error").isNotNull()),
            }
        )
        left = F.lit(attempt <= max_retries)
        state = account.budget_state(F.col("spent"), F.col("accounted"), F.lit(token_budget).cast("long"))
        outcome = (
            F.when(F.col("status") == "ok", F.lit("success"))
            .when(F.col("status").isin("provider_error", "truncated", "judge_error"), F.col("status"))
            .when(~left, F.lit("exhausted"))
            .when(state != "ok", state)
            .otherwise(F.lit("continue"))
        )
        text = reask_text(F.col("issues"), F.col("value").isNull())
        grown = modes.reask(mode, F.col("messages"), F.col("raw"), text)
        read = read.withColumn("outcome", outcome).withColumn("is_last_attempt", F.col("outcome") != "continue")
        return read.withColumn("messages", F.when(F.col("outcome") == "continue", grown).otherwise(F.col("messages")))

    return retry.run_waves(calls.select("call_id", "model", "messages", *carry), ask, durable, max_retries)


def document_chunks(docs: DataFrame, options: Options) -> DataFrame:
    return chunk.chunk_documents(docs, options.chunk_size, options.overlap, options.chunker)


def merge_outcomes(outcomes: DataFrame, schema: Schema, options: Options, doc_col: str = "doc_id", docs: DataFrame | None = None) -> DataFrame:
    """Chunk outcomes (doc, chunk_index, start_index, end_index, value, status, tokens and, if there
    is one, error) to one row per document: status, reason, data, partial, issues, conflicts, chunks,
    failed, chunk_errors, tokens, usage_available. With docs, documents without chunks have a row too.

    status: merged, conflict, invalid, no_data (reason empty-document or all-chunks-failed),
    interrupted (reason token-budget, usage-unavailable or timeout), chunk_error (a chunk failed and
    the policy is abort). Chunks behind the one that a document stopped at count for nothing.
    """
    rows = outcomes
    if options.token_budget is not None:
        rows = retry.document_budget(rows, options.token_budget, doc_col)
    else:
        rows = rows.withColumns({"stopped": F.lit(False), "stop_reason": F.lit(None).cast("string")})
    if "error" in outcomes.columns:
        rows = retry.stop_from(rows, F.col("error").eqNullSafe("timeout"), "timeout", doc_col)
    if options.on_chunk_error == "abort":
        rows = retry.stop_after(rows, F.col("status") != "ok", doc_col)
    ran = ~F.col("stopped")
    failed = ran & (F.col("status") != "ok")
    error = F.struct("chunk_index", "start_index", "end_index", F.col("status").alias("cause"), "tokens")
    totals = rows.groupBy(doc_col).agg(
        F.count(F.when(ran, 1)).alias("chunks"),
        F.count(F.when(failed, 1)).alias("failed"),
        F.sort_array(F.collect_list(F.when(failed, error))).alias("chunk_errors"),
        F.min(F.when(failed, F.col("chunk_index"))).alias("first_failed"),
        F.coalesce(F.sum(F.when(ran, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.bool_and(F.when(ran, F.col("tokens").isNotNull())), F.lit(True)).alias("usage_available"),
        F.min_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), F.col("chunk_index"))).alias("stop_reason"),
    )
    good = rows.filter(ran & (F.col("status") == "ok")).select(doc_col, "chunk_index", "start_index", "end_index", "value")
    merged = merge.merge_into(good, schema, dedupe=options.dedupe, dedupe_by=options.dedupe_by, on_conflict=options.on_conflict, doc_col=doc_col)
    out = totals.join(merged.withColumnRenamed("status", "_merged"), doc_col, "left")
    if docs is not None:
        out = docs.select(doc_col).distinct().join(out, doc_col, "left").withColumns(
            {
                "chunks": F.coalesce("chunks", F.lit(0)),
                "failed": F.coalesce("failed", F.lit(0)),
                "tokens": F.coalesce("tokens", F.lit(0)),
                "usage_available": F.coalesce("usage_available", F.lit(True)),
            }
        )
    status = F.when(F.col("stop_reason").isNotNull(), F.lit("interrupted"))
    if options.on_chunk_error == "abort":
        status = F.when(F.col("failed") > 0, F.lit("chunk_error")).when(F.col("stop_reason").isNotNull(), F.lit("interrupted"))
    status = status.when(F.col("_merged").isNull(), F.lit("no_data")).otherwise(F.col("_merged"))
    reason = F.when(F.col("status") == "interrupted", F.col("stop_reason")).when(
        F.col("status") == "no_data", F.when(F.col("chunks") == 0, F.lit("empty-document")).otherwise(F.lit("all-chunks-failed"))
    )
    data = F.when(F.col("status") == "merged", F.col("data"))
    return out.withColumn("status", status).withColumn("reason", reason).withColumn("data", data).drop("_merged", "stop_reason")


OUTCOME_COLUMNS = ("doc_id", "chunk_index", "start_index", "end_index", "value", "status", "tokens", "error")


def run_chunks(
    chunks: DataFrame, schema: Schema, client: ModelClient, instruction: str, options: Options, model: str = "", sampling: dict[str, Column] | None = None
) -> DataFrame:
    """The outcome of each chunk, OUTCOME_COLUMNS; every chunk is a call with its own retries and budget.

    Chunks run side by side, unless their document may have to stop (a token budget, abort on a
    failed chunk, a timeout, which is each document's own). Then a live client's calls go one after
    another in the task that has the document; replies that cost nothing (of rules or records)
    are all read; other clients, and schemas that a task can't decide by itself (see
    inorder.decidable), go in waves of the n-th chunks of all open documents. Chunks that were never
    asked come back as not_asked.
    """
    mode = options.mode or client.default_mode
    stops = options.token_budget is not None or options.on_chunk_error == "abort"
    if isinstance(client, CallClient) and (stops or options.timeout is not None) and inorder.decidable(schema):
        return _run_in_order(chunks, schema, client, instruction, options, mode, model, sampling)
    if options.timeout is not None and isinstance(client, CallClient):
        client = with_timeout(client, options.timeout, client.deadline)
    windows = ("doc_id", "chunk_index", "start_index", "end_index", "chunk_text")

    def ask(part: DataFrame) -> DataFrame:
        prompt = modes.chunk_prompt(instruction, F.col("chunk_text"))
        calls = part.select(
            F.concat_ws(":", "doc_id", "chunk_index").alias("call_id"), F.lit(model).alias("model"), F.array(modes.text_message("user", prompt)).alias("messages"), *windows
        )
        attempts = extract(
            calls, schema, client, mode, options.max_retries, options.chunk_token_budget, sampling, F.col("chunk_text") if cite.is_cited(schema) else None, carry=windows
        )
        # what the merge sees is the validated value: defaults filled, undeclared keys gone
        plain = F.parse_json(plain_json(schema, F.col("value")))
        last = attempts.filter("is_last_attempt").withColumn("tokens", F.when(F.col("accounted"), F.col("spent")))
        return last.withColumn("value", F.when(F.col("status") == "ok", plain)).select(*OUTCOME_COLUMNS)

    if not stops or isinstance(client, (RuleClient, ReplayClient)):
        return ask(chunks)
    chunks = durable(chunks.select(*windows))
    open_ = chunks.select("doc_id").distinct()
    last = chunks.agg(F.max("chunk_index")).first()[0]
    done: DataFrame | None = None
    for number in range(0 if last is None else last + 1):
        wave = durable(ask(chunks.filter(F.col("chunk_index") == number).join(open_, "doc_id")))
        done = wave if done is None else done.unionByName(wave)
        ends = F.lit(False)
        if options.on_chunk_error == "abort":
            ends |= F.bool_or(F.col("status") != "ok")
        if options.token_budget is not None:
            ends |= (F.coalesce(F.sum("tokens"), F.lit(0)) >= options.token_budget) | ~F.bool_and(F.col("tokens").isNotNull())
        open_ = durable(done.groupBy("doc_id").agg(ends.alias("stops"), F.max("chunk_index").alias("at")).filter(~F.col("stops") & (F.col("at") == number)).select("doc_id"))
        if open_.isEmpty():
            break
    if done is None:
        return ask(chunks)
    rest = chunks.join(done.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")
    kinds = {f.name: f.dataType for f in done.schema.fields}
    missing = {"value": None, "status": "not_asked", "tokens": None, "error": None}
    return done.unionByName(rest.select(*windows[:4], *[F.lit(v).cast(kinds[c]).alias(c) for c, v in missing.items()]))


def _run_in_order(
    chunks: DataFrame, schema: Schema, client: CallClient, instruction: str, options: Options, mode: str, model: str, sampling: dict[str, Column] | None
) -> DataFrame:
    """run_chunks by one pass over documents: each chunk is asked in its task, and its last reply read by columns."""
    messages = F.array(modes.text_message("user", modes.chunk_prompt(instruction, F.col("chunk_text"))))
    context = F.col("chunk_text") if cite.is_cited(schema) else F.lit(None).cast("string")
    body = modes.encode(mode, schema, F.lit(model), messages, sampling)
    asked = chunks.select("doc_id", "chunk_index", "start_index", "end_index", body.alias("body"), context.alias("context"))
    limits = inorder.Limits(options.max_retries, options.token_budget, options.chunk_token_budget, options.on_chunk_error == "abort", options.timeout, client.deadline)
    # replies are paid for once: they are written before they are read
    rows = durable(inorder.run(asked, schema, mode, client.sender, limits).drop("body"))
    read = read_replies(rows, schema, mode, context=F.col("context") if cite.is_cited(schema) else None)
    status = F.when(F.col("asked"), F.col("status")).otherwise(F.lit("not_asked"))
    plain = F.parse_json(plain_json(schema, F.col("value")))
    return read.withColumns({"status": status, "value": F.when(F.col("asked") & (F.col("status") == "ok"), plain)}).select(*OUTCOME_COLUMNS)


def extract_documents(
    docs: DataFrame,
    schema: Schema,
    client: ModelClient,
    instruction: str,
    chunk_schema: Schema | None = None,
    options: Options = Options(),
    model: str = "",
    sampling: dict[str, Column] | None = None,
) -> DataFrame:
    """Chunk, ask, validate each chunk tolerantly, merge, validate strictly: one row per document."""
    options.check()
    outcomes = run_chunks(document_chunks(docs, options), chunk_schema or schema, client, instruction, options, model, sampling)
    # replies are paid for once, and the merge reads the outcomes several times
    return merge_outcomes(durable(outcomes), schema, options, docs=docs)


def attempt_events(attempts: DataFrame) -> DataFrame:
    """The events of each attempt in the order in which observers see them."""
    failed = F.col("outcome") != "success"
    events = F.array(F.lit("request"), F.when(F.col("outcome") == "provider_error", F.lit("error")).when(failed, F.lit("parse_error")), F.when(F.col("is_last_attempt") & (F.col("outcome") != "provider_error"), F.lit("usage")), F.when(~failed, F.lit("success")))
    named = F.posexplode(F.filter(events, lambda e: e.isNotNull())).alias("event_seq", "event")
    return attempts.select("call_id", "attempt", "is_last_attempt", named)


def value_at(path: str) -> Column:
    return at(F.col("value"), path)
