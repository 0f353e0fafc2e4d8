"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a predicate that says "reject". On a sample of about SAMPLE_ROWS rows, drawn from
files all over the input, each rule is evaluated alone; its share of rejected rows (selectivity)
and its run time beyond that of reading the sample (cost) order the cascade by rejections per
second. The cascade is one CASE expression, so for each row evaluation stops at the first rule
that rejects. Order changes the cost only: the verdict is the same for any order, since a document
is kept exactly if no rule rejects it.

Defined cases: a null text is an empty text (no words; the length rule rejects it); equal texts
get equal verdicts; an empty table gives an empty result and keeps the declared order; columns
besides the text are passed through untouched, whatever their names.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structex.llm.common import SPACE_CHARS, durable, let, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 40
MAX_UPPER_PERCENT = 40
MAX_ADJACENT_PERCENT = 25
MAX_EXCLAIM_PERCENT = 25
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 14
SEED = 5
#: Rows of the sample that orders the rules, the files that it is drawn from, and how often a rule
#: runs over each of its rows, so that the rule shows and not the job around it.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_RUNS = 512, 8, 3


#: Up to so many distinct repeated windows are looked up one by one; more are found by sorting.
FEW_REPEATED = 64


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[" + SYMBOLS + "]"))


def word_chars(words: Column) -> Column:
    """Code points inside words."""
    return F.length(F.array_join(words, ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the same text."""
    return let(
        F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0),
        lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
    )


def _covered(positions: Column) -> Column:
    """Words that 3-word windows at these ascending starts cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
    return F.aggregate(
        positions,
        start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes. Texts without any repeated
    window, most of them, stop after one distinct count. For the others the repeated hashes are
    found by a sort; where these are many, (hash, place) pairs are sorted, so the time is
    n log n at any length.
    """

    def by_lookup(hashes: Column, repeated: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - 1)
        return F.filter(places, lambda i: F.array_contains(repeated, F.get(hashes, i)))

    def by_sort(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def slow(hashes: Column) -> Column:
        repeated = F.array_distinct(
            let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False))))
        )
        return let(
            repeated,
            lambda d: _covered(F.when(F.size(d) <= FEW_REPEATED, by_lookup(hashes, d)).otherwise(by_sort(hashes))),
        )

    def of(word_hashes: Column) -> Column:
        windows = F.transform(
            F.slice(word_hashes, 1, F.size(word_hashes) - 2),
            lambda x, i: F.xxhash64(x, F.get(word_hashes, i + 1), F.get(word_hashes, i + 2)),
        )
        return F.when(F.size(word_hashes) < 3, F.lit(0)).otherwise(
            let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h)))
        )

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def n_adjacent(words: Column) -> Column:
    """Words that equal the word before them."""
    return let(words, lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))))


def n_upper(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}"))


@dataclass(frozen=True)
class Rule:
    """name, and reject: a function of the column getter that gives the predicate."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


@dataclass
class Plan:
    """The order found and, by rule, (share rejected, seconds, rejections per second)."""

    rules: list[Rule]
    measured: dict[str, tuple[float, float, float]] = field(default_factory=dict)


#: Features by name: how each is computed from the text (t) and its words (w).
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: word_chars(w),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
    "n_lines": lambda t, w: F.size(F.split(t, "\n")),
    "n_adjacent": lambda t, w: n_adjacent(w),
    "n_upper": lambda t, w: n_upper(t),
    "n_exclaim": lambda t, w: F.octet_length(t) - F.octet_length(F.replace(t, F.lit("!"), F.lit(""))),
}

BASE_RULES = [
    Rule("too_few_words", lambda f: f("n_words") < MIN_WORDS),
    Rule("repeated_windows", lambda f: 100 * f("n_repeat_words") > MAX_REPEAT_PERCENT * f("n_words")),
]
METHOD_RULES = [
    Rule("symbols", lambda f: 100 * f("n_symbols") > MAX_SYMBOL_PERCENT * f("n_words")),
    Rule(
        "mean_word",
        lambda f: (f("word_chars") < MIN_MEAN_WORD * f("n_words"))
        | (f("word_chars") > MAX_MEAN_WORD * f("n_words")),
    ),
    Rule("repeated_lines", lambda f: 100 * f("n_dup_lines") > MAX_DUP_LINE_PERCENT * f("n_lines")),
    Rule("capitals", lambda f: 100 * f("n_upper") > MAX_UPPER_PERCENT * f("word_chars")),
    Rule("exclamations", lambda f: 100 * f("n_exclaim") > MAX_EXCLAIM_PERCENT * f("n_words")),
    Rule("doubled_words", lambda f: 100 * f("n_adjacent") > MAX_ADJACENT_PERCENT * f("n_words")),
]
DEFAULT_RULES = [*BASE_RULES, *METHOD_RULES]


def _getter(text: Column, words: Column, have: dict[str, Column] | None = None) -> Callable[[str], Column]:
    have = have or {}
    return lambda name: have[name] if name in have else FEATURES[name](text, words)


def sample_of(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(t): the texts of about sample_rows rows, each row as likely as any other of the files read.

    Of an input of many files a few are read, chosen by a hash of their names, so that neither the
    first files nor all of them decide the order.
    """
    some, files = docs, {f.rsplit("/", 1)[-1] for f in docs.inputFiles()}
    if len(files) > SAMPLE_FILES and "_metadata" not in docs.columns:
        chosen = sorted(files, key=lambda f: (zlib.crc32(f.encode()), f))[:SAMPLE_FILES]
        try:
            some = docs.filter(F.col("_metadata.file_name").isin(chosen))
        except AnalysisException:  # not a plain table of files
            some = docs
    rows = some.count()
    if not rows:  # names that the table writes in another way
        some, rows = docs, docs.count()
    share = min(1.0, 1.2 * sample_rows / max(1, rows))
    return durable(some.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).filter(F.rand(SEED) < share))


def plan_cascade(
    docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, known: Sequence[str] = ()
) -> Plan:
    """Order the rules by rejections per second, measured on a sample; known: features that are at hand.

    The sample only orders the rules, so its bound never changes a verdict.
    """
    sample = sample_of(docs, text_col, sample_rows)
    if known:
        sample = durable(sample.select("t", *[FEATURES[n](F.col("t"), words_of(F.col("t"))).alias(n) for n in known]))
    rows = max(1, sample.count())
    many = sample.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_RUNS))))
    f = _getter(F.col("t"), words_of(F.col("t")), {n: F.col(n) for n in known})

    def timed(reject: Column) -> tuple[int, float]:
        query = many.agg(F.sum(reject.cast("int")).alias("r"))
        least = rejected = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            rejected = query.first()["r"] or 0
            seconds = time.perf_counter() - began
            least = seconds if least is None else min(least, seconds)
        return rejected, least

    _, reading = timed(F.octet_length("t") < 0)
    measured = {}
    for rule in rules:
        rejected, seconds = timed(rule.reject(f))
        share, cost = rejected / rows / SAMPLE_RUNS, max(seconds - reading, 1e-4)
        measured[rule.name] = (share, cost, share / cost)
    # a rule that rejected nothing still has to run: the cheaper such rules come first
    order = sorted(rules, key=lambda r: (-measured[r.name][2], measured[r.name][1]))
    return Plan(order, measured)


def cascade(rules: list[Rule], f: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, else null; later rules aren't evaluated."""
    verdict = F.when(rules[0].reject(f), F.lit(rules[0].name))
    for rule in rules[1:]:
        verdict = verdict.when(rule.reject(f), F.lit(rule.name))
    return verdict


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their columns as they were; one narrow pass."""
    plan = plan_cascade(docs, rules or DEFAULT_RULES, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = let(text, lambda t: let(words_of(t), lambda w: F.isnull(cascade(plan.rules, _getter(t, w)))))
    return docs.filter(kept)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts, base_failed and the verdict of each document.

    The counts are a part of the result and so computed for every row; the cascade is of all rules.
    Those on the counts read them, so they cost next to nothing and come as early as they reject;
    what else the rules need is evaluated only for rows that are still undecided.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    plan = plan_cascade(docs, DEFAULT_RULES, text_col, known=names)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    base = base.withColumn("w", words_of(F.col("t")))
    counted = base.select(id_col, "t", "w", *[FEATURES[n](F.col("t"), F.col("w")).cast("long").alias(n) for n in names])
    f = _getter(F.col("t"), F.col("w"), {n: F.col(n) for n in names})
    failed = BASE_RULES[0].reject(f) | BASE_RULES[1].reject(f)
    return counted.select(id_col, *names, failed.alias("base_failed"), F.isnull(cascade(plan.rules, f)).alias("kept"))
