"""URL filter: rules by host and path, and a character language-model ratio for all other URLs.

URLs that a rule allows or blocks are the examples. Of each of the two classes a variable-order
Markov model is counted: every byte of a URL (and its end) after the 0 to ORDER bytes before it. A
longer context counts as far as it has been seen: the probability by k bytes is
(count + weight * probability by k - 1 bytes) / (context's count + weight). Counters are found by
hashes in tables of fixed size, so the model has the same size whatever the input, and every example
is counted; tasks count in tables of their own, whose sums Spark makes.

A URL's score is the difference of its log-likelihoods by both models over its length. One in FOLDS
of the examples, by a hash of the URL, isn't counted but calibrates: the weight and the threshold
that best part the accepted ones from the rejected ones (mean of both rates) are chosen.
URLs without a rule are allowed if their score reaches the threshold.

Scores are sums of whole millionths, so equal URLs have equal scores wherever they lie.

Defined cases: a null URL and one without `://` have an empty host and path, fit no rule, and are
scored as they are (null as empty); where either class has no examples to count, URLs without a rule
are allowed and have score 0; where it has none to calibrate with, the threshold is 0; repeated rows
count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structex.llm.common import in_parts
from structex.llm.ngrams import mix

#: Fixed values: (verdict, rule) of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
ORDER, SLOTS = 5, 1 << 17
#: Examples in FOLDS parts, one of which calibrates; the weights that are tried; the scale of scores.
FOLDS, WEIGHTS, UNIT = 5, (0.5, 2.0, 8.0, 32.0), 1_000_000
#: Scores are calibrated by bins of so many units, and beyond so many bins either way by the last one.
BIN, BINS = 1_000, 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first :// and the next /, ? or #, and from there to ? or #."""
    known = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(known, parts, 1), _UPPER, _LOWER), F.regexp_extract(known, parts, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and how the path begins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def places(urls: list[bytes], order: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By order and symbol: slots of the context with and without the symbol; and symbols by URL.

    The symbols of a URL are its bytes and an end. Contexts begin with ends, as before a URL.
    """
    blob = np.frombuffer(b"".join(b"\0" * order + url + b"\0" for url in urls), np.uint8).astype(np.uint64)
    numbers = np.fromiter(map(len, urls), np.int64, len(urls)) + 1
    begins = np.cumsum(numbers + order) - numbers
    at = np.repeat(begins - (np.cumsum(numbers) - numbers), numbers) + np.arange(int(numbers.sum()))
    with_, without = np.empty((order + 1, len(at)), np.int64), np.empty((order + 1, len(at)), np.int64)
    context = np.zeros(len(at), np.uint64)
    for k in range(order + 1):
        if k:
            context = (context << np.uint64(8)) | blob[at - k]
        level = mix(mix(context + np.uint64(k)) + np.uint64(k << 8))
        without[k] = (level % np.uint64(slots)).astype(np.int64)
        with_[k] = (mix(level + blob[at] + np.uint64(1)) % np.uint64(slots)).astype(np.int64)
    return with_, without, numbers


class Model:
    """Counters of both classes: [class, with or without the symbol, order, slot]."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.order, self.slots = counts, counts.shape[2] - 1, counts.shape[3]

    def ratios(self, urls: list[bytes], weight: float) -> np.ndarray:
        """Log-likelihood by the first class less that by the second one, by symbol, in units."""
        with_, without, numbers = places(urls, self.order, self.slots)
        total = np.zeros(with_.shape[1], np.int64)
        for sign, (pairs, contexts) in zip((1, -1), self.counts, strict=True):
            p = np.full(with_.shape[1], 1 / 256)
            for k in range(self.order + 1):
                p = (pairs[k][with_[k]] + weight * p) / (contexts[k][without[k]] + weight)
            total += sign * np.rint(UNIT * np.log(p)).astype(np.int64)
        sums = np.add.reduceat(total, np.cumsum(numbers) - numbers) if len(urls) else total
        return sums // numbers


def _count(order: int, slots: int):
    """Counters of a task as rows (place in all tables, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, order + 1, slots), np.int64)
        for batch in in_parts(batches):
            for side, verdict in enumerate(("allow", "block")):
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                urls = [url.encode() for url, known in rows if known == verdict]
                if urls:
                    with_, without, _ = places(urls, order, slots)
                    for k in range(order + 1):
                        counts[side, 0, k] += np.bincount(with_[k], minlength=slots)
                        counts[side, 1, k] += np.bincount(without[k], minlength=slots)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["place", "n"])

    return run


def _calibrate(model, weights: Sequence[float]):
    """Examples by weight, class and bin of the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            urls = [url.encode() for url in batch.column(0).to_pylist()]
            for number, weight in enumerate(weights):
                bins = np.clip(model.value.ratios(urls, weight) // BIN, -BINS, BINS)
                columns = [pa.array([number] * len(urls), pa.int32()), batch.column(1), pa.array(bins, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["weight", "verdict", "bin"])

    return run


def best_cut(accepted: np.ndarray, rejected: np.ndarray) -> tuple[float, int]:
    """The mean of the rates of accepted from a bin on and of rejected below it, and that bin (the nearest to 0)."""
    kept = np.cumsum(accepted[::-1])[::-1] / max(1, accepted.sum())
    left = (np.cumsum(rejected) - rejected) / max(1, rejected.sum())
    rates = (kept + left) / 2
    best = np.flatnonzero(rates >= rates.max() - 1e-12) - BINS
    return float(rates.max()), int(best[np.argmin(np.abs(best))])


def train(
    examples: DataFrame, order: int = ORDER, slots: int = SLOTS, folds: int = FOLDS, weights: Sequence[float] = WEIGHTS
) -> tuple[Model, float, int] | None:
    """The model, its weight and its threshold from rows (url, verdict); None where a class has no examples.

    The driver gets at most the places of the model's tables and the bins of the calibration.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(folds))
    rows = examples.select("url", "verdict", fold.alias("fold"))
    learned = rows.filter("fold <> 0").select("url", "verdict")
    found = learned.mapInArrow(_count(order, slots), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, 2, order + 1, slots), np.int64)
    counts.reshape(-1)[found.column("place").to_numpy()] = found.column("n").to_numpy()
    if not counts[0].any() or not counts[1].any():
        return None
    model = Model(counts)
    shared = examples.sparkSession.sparkContext.broadcast(model)
    calibrating = rows.filter("fold = 0").select("url", "verdict").mapInArrow(_calibrate(shared, weights), "weight int, verdict string, bin long")
    bins = np.zeros((len(weights), 2, 2 * BINS + 1), np.int64)
    for row in calibrating.groupBy("weight", "verdict", "bin").count().collect():
        bins[row["weight"], int(row["verdict"] == "block"), row["bin"] + BINS] = row["count"]
    if not bins.any(axis=(0, 2)).all():
        return model, weights[0], 0
    cuts = [best_cut(*sides) for sides in bins]
    best = max(range(len(weights)), key=lambda k: (cuts[k][0], -k))
    return model, weights[best], cuts[best][1] * BIN


def _score(model, weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            urls = [(url or "").encode() for url in batch.column(1).to_pylist()]
            scores = pa.array(model.value.ratios(urls, weight), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "units"])

    return run


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    order: int = ORDER,
    slots: int = SLOTS,
    folds: int = FOLDS,
    weights: Sequence[float] = WEIGHTS,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every row."""
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    source = source.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    source = source.select("*", rule.alias("rule"), verdict.alias("known"))
    trained = train(source.filter("known is not null").select("url", F.col("known").alias("verdict")), order, slots, folds, weights)
    if trained is None:
        nothing = F.lit(0.0)
        return source.select("page_id", "host", "path", "rule", F.coalesce("known", F.lit("allow")).alias("verdict"), nothing.alias("score"), nothing.alias("threshold"))
    model, weight, threshold = trained
    schema = f"page_id {dict(source.dtypes)['page_id']}, url string, host string, path string, rule string, known string, units long"
    scored = source.mapInArrow(_score(source.sparkSession.sparkContext.broadcast(model), weight), schema)
    says = F.when(F.col("units") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("known", says).alias("verdict"), (F.col("units") / UNIT).alias("score"), F.lit(threshold / UNIT).alias("threshold")
    )
