"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed up by membership pattern (the set of sources they belong to). A flow network
routes the patterns' words to the sources' quotas. A pattern gives its words once at cost 0 a
word, a second time at cost 1, a third time at cost 2: costs are convex in repetition, so nothing
is repeated while fresh words could serve. From each pattern the words that the flow takes are
whole repetitions of all its documents and a part of them in seeded order.

The network has a node for each pattern and source, not for documents. Patterns, sources, targets
and quotas stay distributed tables; the flow is solved apart in each connected component of the
network (without overlap: each pattern with its source), so a task holds the patterns of a
component, never its documents. The seeded order needs no sort of a source: two levels of 4,096
hash buckets find the place where the words suffice, and only the documents of one bucket of the
second level (a 16-millionth of a source), equal ones counted first, are ordered.

Defined cases: a null source is a source of its own, after all others; a null or empty text has
size 0, is never counted and keeps taken 0; an empty table gives no rows; rows with equal ids are
documents of their own and come in the order of their sizes; rows that repeat both share one
place in the order, and as many of them are taken as the words there are for; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structex.llm.common import SPACE_CLASS, durable
from structex.llm.components import components

MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
#: The most patterns whose plan is broadcast (about 200 bytes each); more are joined by shuffles.
MAX_BROADCAST = 200_000
SEED = 7
BITS = 12


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_CLASS.replace("[", "[^") + "+")).cast("long")


def targets(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources (source, size, weight) with goal: all words shared by weight; what is above
    max_repeat times a source's size is shared anew.

    A source is at its limit if its share would be above it. Shares of the others only grow, so
    the pair (words, weight) of the open sources says which those are.
    """
    exact = "decimal(38,0)"
    limit = (F.col("size") * max_repeat).cast(exact)
    everything = sources.agg(F.sum("size").alias("words"), F.sum("weight").alias("weight")).first()
    words = rest = everything["words"] or 0
    total = everything["weight"] or 1
    while True:
        above = F.lit(rest).cast(exact) * F.col("weight").cast(exact) > limit * F.lit(total).cast(exact)
        r = sources.agg(
            F.sum(F.when(above, limit)).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("weight")
        ).first()
        left = words - int(r["given"] or 0)
        if (left, r["weight"] or total) == (rest, total):
            share = F.lit(rest).cast("double") * F.col("weight") / F.lit(total)
            return sources.withColumn("goal", F.when(above, limit.cast("double")).otherwise(share))
        rest, total = left, r["weight"]


def route(patterns: dict[tuple, int], quotas: dict, max_repeat: int = MAX_REPEAT) -> dict[tuple[tuple, object], int]:
    """Words by (pattern, source) of a min-cost flow.

    Costs lie on the patterns' supply alone, so shortest augmenting paths come in the order of
    the repetition levels: each level adds its supply and is filled to the maximum before the
    next one opens. Flow already routed may move between sources but is never taken back.
    """
    flow: dict = defaultdict(int)
    need = dict(quotas)
    members: dict = defaultdict(list)
    for p in sorted(patterns, key=str):
        for s in p:
            members[s].append(p)
    for _ in range(max_repeat):
        for p in sorted(patterns, key=str):
            supply = patterns[p]
            while supply > 0:
                back: dict = {("p", p): None}
                queue, end = deque([("p", p)]), None
                while queue and end is None:
                    kind, node = at = queue.popleft()
                    if kind == "p":
                        for s in node:
                            if ("s", s) not in back:
                                back["s", s] = at
                                queue.append(("s", s))
                    elif need[node] > 0:
                        end = at
                    else:
                        for q in members[node]:
                            if flow[q, node] > 0 and ("p", q) not in back:
                                back["p", q] = at
                                queue.append(("p", q))
                if end is None:
                    break
                path = [end]
                while back[path[-1]] is not None:
                    path.append(back[path[-1]])
                path.reverse()
                step = min([supply, need[end[1]], *(flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s")])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1], b[1]] += step
                    else:
                        flow[b[1], a[1]] -= step
                need[end[1]] -= step
                supply -= step
    return {k: v for k, v in flow.items() if v}


def _flows(max_repeat: int):
    """Rows of components (label, pattern, words, source, quota), sorted by label, to taken words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        out: tuple[list, list] = ([], [])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=["pattern", "taken"])

        for _, component in groupby(rows, key=lambda r: r[0]):
            members, words, quotas = defaultdict(list), {}, {}
            for _, pattern, n, source, quota in component:
                members[pattern].append(source)
                words[pattern], quotas[source] = n, quota
            names = {tuple(sorted(m)): p for p, m in members.items()}  # a pattern is its set of sources
            taken = dict.fromkeys(words, 0)
            for (sources, _), n in route({m: words[p] for m, p in names.items()}, quotas, max_repeat).items():
                taken[names[sources]] += n
            out[0].extend(taken)
            out[1].extend(taken.values())
            if len(out[0]) > 50_000:
                yield flush()
                out[0].clear()
                out[1].clear()
        yield flush()

    return run


def _numbered(names: DataFrame) -> DataFrame:
    """names (source, size) with their number, from 0, in code point order."""
    ordered = durable(names.repartitionByRange("source").sortWithinPartitions("source"))
    ordered = ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33))
    counts = ordered.groupBy("task").count()
    upto = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    offsets = counts.select("task", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("offset"))
    return ordered.join(F.broadcast(offsets), "task").select("source", "size", (F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"))


def _plan_words(patterns: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """patterns (pattern, members, words) with whole and want, source_size and target.

    The flow gives each pattern whole repetitions and, of one more, the words wanted.
    """
    members = patterns.select("pattern", "words", F.explode("members").alias("source"))
    sizes = members.groupBy("source").agg(F.sum("words").alias("size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = durable(_numbered(sizes).withColumn("weight", weight.cast("long")))
    goals = targets(sources.select("source", "size", "weight"), max_repeat)
    r = patterns.agg(F.sum("words").alias("words"), F.max(F.size("members")).alias("most")).first()
    overlap = (r["most"] or 0) > 1
    if overlap:  # quotas share the words that there are, however many sources claim them
        claimed = sources.agg(F.sum("size")).first()[0] or 1
        goals = goals.withColumn("goal", F.col("goal") * (r["words"] or 0) / claimed)
    goals = durable(goals.withColumn("quota", F.round("goal").cast("long")))
    claims = members.join(goals, "source")
    if overlap:
        edges = members.select(F.xxhash64(F.lit("p"), "pattern").alias("u"), F.xxhash64(F.lit("s"), "source").alias("v"))
        labels = components(edges)
        named = claims.withColumn("node", F.xxhash64(F.lit("p"), "pattern")).join(labels, "node").withColumn("label", F.col("label").cast("string"))
    else:
        named = claims.withColumn("label", F.col("pattern"))
    named = named.select("label", "pattern", "words", "source", "quota").repartition("label").sortWithinPartitions("label", "pattern")
    taken = named.mapInArrow(_flows(max_repeat), "pattern string, taken long")
    sums = claims.groupBy("pattern").agg(F.sum("size").alias("source_size"), F.sum("goal").alias("target"))
    of_words = F.greatest("words", F.lit(1))
    return durable(
        patterns.join(taken, "pattern", "left")
        .join(sums, "pattern", "left")
        .select(
            "pattern",
            F.coalesce(F.floor(F.col("taken") / of_words), F.lit(0)).cast("long").alias("whole"),
            F.coalesce(F.col("taken") % of_words, F.lit(0)).cast("long").alias("want"),
            F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
            F.coalesce("target", F.lit(0.0)).cast("double").alias("target"),
        )
    )


def _bucket(level: int, h: str = "h") -> Column:
    return F.shiftrightunsigned(F.shiftleft(F.col(h), BITS * level), 64 - BITS)


def _upto(h: str, key: Column) -> Column:
    """Whether a place is not after its pattern's mark; null where there is no mark."""
    b1, b2 = _bucket(0, h), _bucket(1, h)
    return (
        (b1 < F.col("b1"))
        | ((b1 == F.col("b1")) & (b2 < F.col("b2")))
        | ((b1 == F.col("b1")) & (b2 == F.col("b2")) & (key <= F.col("mark")))
    )


def _boundary(sums: DataFrame, wanted: DataFrame) -> DataFrame:
    """By pattern: the bucket in which the words wanted are reached, and the words before it."""
    w = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    return (
        before.join(wanted, "pattern")
        .filter((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("words")))
        .select("pattern", "b", (F.col("want") - F.col("before")).alias("want"))
    )


def _placed(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: int, extra: list[Column]) -> DataFrame:
    """extra, and each row's id, size, pattern and seeded place h."""
    # a null source becomes a mark of its own, so that patterns can be joined
    marked = F.transform(members, lambda m: F.when(m.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), m)))
    return docs.select(
        *extra,
        F.col(f"`{id_col}`").alias("_id"),
        n_words(F.col(f"`{text_col}`")).alias("_size"),
        F.to_json(F.array_sort(F.array_distinct(marked))).alias("_pattern"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_size")))


_KEY = ("h", "doc_id", "size")


def plan_mix(rows: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """By pattern: what decides how often each of its documents is taken, source_size and target.

    All rows up to mark are taken once more than whole says; of the rows that share the place of
    an entry of some, n in all, k are.
    """
    rows = durable(rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_pattern").alias("pattern"), F.col("_h").alias("h")))
    patterns = rows.groupBy("pattern").agg(F.sum("size").alias("words"))
    patterns = durable(patterns.select("pattern", F.from_json("pattern", "array<string>").alias("members"), "words"))
    plan = _plan_words(patterns, weights, max_repeat)
    small = plan.count() <= MAX_BROADCAST
    few = F.broadcast if small else lambda df: df  # the broadcast has a checked bound

    wanted = plan.filter("want > 0").select("pattern", "want")
    first = rows.groupBy("pattern", _bucket(0).alias("b")).agg(F.sum("size").alias("words"))
    edge1 = durable(_boundary(first, wanted).select("pattern", F.col("b").alias("b1"), "want"))
    within = rows.withColumn("b1", _bucket(0)).join(few(edge1), ["pattern", "b1"]).drop("want")
    second = within.groupBy("pattern", _bucket(1).alias("b")).agg(F.sum("size").alias("words"))
    edge2 = durable(_boundary(second, edge1.select("pattern", "want")).select("pattern", F.col("b").alias("b2"), "want"))
    order = Window.partitionBy("pattern").orderBy(*_KEY)
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = durable(
        within.withColumn("b2", _bucket(1))
        .join(few(edge2), ["pattern", "b2"])
        .groupBy("pattern", "want", *_KEY)
        .agg(F.count("*").alias("n"))  # equal rows first, so that they are one
        .withColumn("left", F.col("want") - before)
        .filter("left >= 0")
        # of the place that the words wanted end in, as many rows as fit
        .withColumn("k", F.when(F.col("size") == 0, F.col("n")).otherwise(F.least("n", F.floor(F.col("left") / F.greatest("size", F.lit(1))))))
        .groupBy("pattern")
        .agg(
            F.max(F.when(F.col("k") == F.col("n"), F.struct(*_KEY))).alias("mark"),
            F.max(F.when((F.col("k") < F.col("n")) & (F.col("k") > 0), F.struct(F.struct(*_KEY).alias("key"), "k", "n"))).alias("part"),
            F.min(F.col("left") - F.col("k") * F.col("size")).alias("gap"),
        )
    )
    marks = (
        plan.join(edge1.select("pattern", "b1"), "pattern", "left")
        .join(edge2.select("pattern", "b2"), "pattern", "left")
        .join(last, "pattern", "left")
    )
    key = F.struct(*_KEY)
    dealt = rows.join(few(marks), "pattern").withColumn("upto", F.coalesce(_upto("h", key), F.lit(False)))
    # of the documents left out, the one that comes nearest to filling the gap
    miss = F.abs(F.col("gap") - F.col("size"))
    filler = (
        dealt.filter(~F.col("upto") & (miss < F.col("gap")))
        .groupBy("pattern", *_KEY, miss.alias("miss"))
        .agg(F.count("*").alias("n"))
        .groupBy("pattern")
        .agg(F.min(F.struct("miss", F.struct(*_KEY).alias("key"), "n")).alias("x"))
        .select("pattern", F.struct("x.key", F.lit(1).cast("long").alias("k"), "x.n").alias("filler"))
    )
    same = F.col("part.key") == F.col("filler.key")
    more = F.struct(F.col("part.key").alias("key"), (F.col("part.k") + 1).alias("k"), F.col("part.n").alias("n"))
    some = F.when(same, F.array(more)).otherwise(F.array_compact(F.array("part", "filler")))
    out = marks.join(filler, "pattern", "left").withColumn("some", F.coalesce(some, F.array_compact(F.array("part", "filler")))).drop("part", "filler", "gap", "want")
    return durable(out).withColumnsRenamed({"pattern": "_pattern", "source_size": "_source_size", "target": "_target"})


def _with_copies(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """placed with _copies, how often each row is taken, and what the plan says of its pattern."""
    key = F.struct(F.col("_h").alias("h"), F.col("_id").alias("doc_id"), F.col("_size").alias("size"))
    small = plan.count() <= MAX_BROADCAST
    joined = placed.join(F.broadcast(plan) if small else plan, "_pattern")
    upto = F.coalesce(_upto("_h", key), F.lit(False))
    joined = joined.withColumn("_own", F.when(~upto, F.try_element_at(F.filter("some", lambda x: x["key"].eqNullSafe(key)), F.lit(1))))
    all_ = upto | (F.col("_own.k") == F.col("_own.n"))
    result = joined.withColumn("_copies", F.col("whole") + F.coalesce(all_, F.lit(False)).cast("long"))
    if plan.filter(F.exists("some", lambda x: x["k"] < x["n"])).isEmpty():
        return result
    # rows that repeat: k of the n that share a place, counted task by task
    divided = F.coalesce(F.col("_own.k") < F.col("_own.n"), F.lit(False))
    apart = durable(result.filter(divided)).withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    group = ["_pattern", "_h", "_id", "_size"]
    counts = apart.groupBy(*group, "_task").count()
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    counts = durable(counts.select(*group, "_task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_earlier")))
    counts = counts.select(*[F.col(c).alias(f"{c}2") for c in group], F.col("_task").alias("_task2"), "_earlier")
    same = F.col("_task") == F.col("_task2")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"{c}2"))
    ranked = apart.join(counts, same).withColumn("_rank", F.col("_earlier") + F.row_number().over(Window.partitionBy(*group, "_task").orderBy("_at")))
    ranked = ranked.withColumn("_copies", F.col("whole") + (F.col("_rank") <= F.col("_own.k")).cast("long"))
    return result.filter(~divided).unionByName(ranked.select(*result.columns))


def mix(
    docs: DataFrame,
    members: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    repeat_rows: bool = False,
) -> DataFrame:
    """Per document: id, size, source_size, target, copies and taken; or the documents themselves.

    members gives the array of a document's sources; by default its column source alone. Weights
    repeat over the sources in code point order, null last. With repeat_rows the result is the
    documents' own rows, each as often as it is taken.
    """
    members = F.array(F.col("source").cast("string")) if members is None else members
    plan = plan_mix(_placed(docs, members, id_col, text_col, seed, []), weights, max_repeat)
    if repeat_rows:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
        taken = _with_copies(_placed(docs, members, id_col, text_col, seed, [row]), plan)
        once = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
        return taken.select("_row", once.alias("_n")).select("_row.*")
    return (
        _with_copies(_placed(docs, members, id_col, text_col, seed, []), plan)
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            F.col("_copies").alias("copies"),
        )
        .withColumn("taken", F.col("size") * F.col("copies"))
    )
