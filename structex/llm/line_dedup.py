"""Line dedup by winnowing over line hashes.

A run of consecutive lines with min_words words or more that equals a run at an earlier place is
deleted. Places are ordered by doc_id, then by line. The steps:

1. Winnowing. From every line the shortest window on that reaches min_words words is looked at,
   and to every line the shortest one back. The line with the least hash in a window (the first of
   equals) is its fingerprint. Neighbouring windows mostly share theirs, so fewer places than lines
   are selected. Windows depend on their own lines only, so two equal runs of min_words words
   contain equal windows and share their fingerprints: that is the guarantee.
2. Positions of fingerprints are joined: those whose hash was selected once only are done with.
3. Matches extend both ways: around each position that is left, the lines of the windows that
   selected it are compared outward, by a 128-bit hash of all lines from one end of a window to
   the other, with the first place that has the same. A run that a third of all documents has
   costs a few rows per position, never pairs of positions; keys that many rows have meet their
   first place by a broadcast. Windows that equal earlier ones are joined to maximal runs. That
   covers exactly the lines that any equal earlier run covers: inside a repeated run a line lies in
   the forward window of the run's first line or else ends a backward window within the run.
4. Later runs are cut out of the texts.

Defined cases: null texts stay null and have no lines; lines without a word are in no run by
themselves and go with a run around them; line equality ignores white space at both ends; rows
that repeat both id and text are one document and all get the same result; an empty table gives
an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structex.llm.common import SPACE_CHARS, durable, in_parts, join_counted

MIN_WORDS = 50
_SPACE = SPACE_CHARS.encode()
#: A selected place: its hash, its number among the lines around it, and those lines (hash, words, place).
PLACE_SCHEMA = "id long, th long, fp long, at int, around binary"
WINDOW_SCHEMA = "id long, th long, w1 long, w2 long, a int, b int"
LINE = "<QII"


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest windows on from each line and back to each line, as inclusive bounds."""
    total = [0, *accumulate(words)]
    found, last = set(), len(words)
    end = 0
    for start in range(last):
        end = max(end, start)
        while end < last and total[end + 1] - total[start] < min_words:
            end += 1
        if end == last:
            break
        found.add((start, end))
    start = 0
    for end in range(last):
        while total[end + 1] - total[start + 1] >= min_words if start < end else False:
            start += 1
        if total[end + 1] - total[start] >= min_words:
            found.add((start, end))
    return sorted(found)


def winnow(hashes: list[int], words: list[int], min_words: int) -> dict[int, tuple[int, int]]:
    """By selected line: the bounds of all windows that select it, together."""
    found: dict[int, tuple[int, int]] = {}
    for a, b in windows(words, min_words):
        at = min(range(a, b + 1), key=hashes.__getitem__)
        low, high = found.get(at, (a, b))
        found[at] = (min(a, low), max(b, high))
    return found


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Hash, words and place of each line that has words."""
    import xxhash

    hashes, words, places = [], [], []
    for place, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        line = line.strip(_SPACE)
        if line:
            hashes.append(xxhash.xxh3_64_intdigest(line))
            words.append(len(line.split()))
            places.append(place)
    return hashes, words, places


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _fingerprints(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows: list[tuple] = []
            ids, texts_hashes, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, th, text in zip(ids, texts_hashes, texts, strict=True):
                if not text:
                    continue
                hashes, words, places = lines_of(text)
                if sum(words) < min_words:
                    continue
                packed = [struct.pack(LINE, *line) for line in zip(hashes, words, places, strict=True)]
                for at, (a, b) in winnow(hashes, words, min_words).items():
                    rows.append((doc_id, th, hashes[at] - (1 << 63), at - a, b"".join(packed[a : b + 1])))
                if len(rows) > 20_000:
                    yield _batch(rows, PLACE_SCHEMA)
                    rows = []
            yield _batch(rows, PLACE_SCHEMA)

    return run


def _extend(min_words: int):
    """The windows around each place that select it."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows: list[tuple] = []
            for doc_id, th, at, around in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                hashes, words, places = zip(*struct.iter_unpack(LINE, around), strict=True)
                for a, b in windows(list(words), min_words):
                    if a <= at <= b and min(range(a, b + 1), key=hashes.__getitem__) == at:
                        whole = xxhash.xxh3_128_digest(struct.pack(f">{b + 1 - a}Q", *hashes[a : b + 1]))
                        rows.append((doc_id, th, *struct.unpack(">qq", whole), places[a], places[b]))
            yield _batch(rows, WINDOW_SCHEMA)

    return run


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, spans): the maximal later runs of each document, as inclusive line numbers from 0."""
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("t")
    )
    found = durable(source.mapInArrow(_fingerprints(min_words), PLACE_SCHEMA))
    shared = durable(found.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1"))
    matched = join_counted(found, shared, ["fp"]).select("id", "th", "at", "around")
    extended = durable(matched.mapInArrow(_extend(min_words), WINDOW_SCHEMA))
    key, place = ["w1", "w2"], F.struct("id", "th", "a")
    first = extended.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = durable(first.filter("first < last").select(*key, "first", "n"))
    later = join_counted(extended, first, key).filter(place > F.col("first")).select("id", "th", "a", "b")
    before = Window.partitionBy("id", "th").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        later.distinct()
        .withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(before), F.lit(-2)) + 1).cast("int"))
        .withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "th", "run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
    )
    return runs.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later runs cut out; _lines, _removed (lines) and _spans say what went.

    Where docs has columns of these names, they stay, and more underscores precede the new ones.
    """
    spans = repeated_runs(docs, id_col, text_col, min_words)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("own_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("own_th"),
        F.col(f"`{text_col}`").alias("text"),
    )
    joined = rows.join(spans, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists("spans", lambda s: (i >= s["a"]) & (i <= s["b"])))
    cleaned = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"] + 1)
    ahead = "_"
    while any(c in {ahead + "lines", ahead + "removed", ahead + "spans"} for c in docs.columns):
        ahead += "_"
    return joined.select(
        *[(cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias(ahead + "lines"),
        F.coalesce(removed, F.lit(0)).alias(ahead + "removed"),
        F.coalesce(F.col("spans"), F.array().cast("array<struct<a:int,b:int>>")).alias(ahead + "spans"),
    )
