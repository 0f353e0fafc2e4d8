"""Phrase collocations by level-wise mining with hashed buckets.

Pass m reads the texts, counts exactly the phrases of m words that can still be frequent, and adds
the phrases of one word more to a table of buckets of fixed size. A phrase of m words can be
frequent if its two parts of m - 1 words are (Apriori) and so is its bucket (PCY; only phrases
whose parts got that far are added to buckets, as DHP has it). What passes is kept as bits: one
table for buckets and one for frequent phrases, both of slots bits, so what is broadcast has the
same size whatever the input, and a bit too many costs a count and never changes a result.

Tasks count in their own tables first and send each phrase once for many occurrences. Bucket
counts go by stretches of the table, which are added up one row after another. Counts, cuts and
scores are joins and aggregates of Spark; the products are decimals.

A phrase is told from others of one slice (about a megabyte of text) by a 64-bit hash, and by its
text everywhere else.

Defined cases: a null or empty text has no words; a null lang is `und`, together with a lang of that
name; repeated rows count each; a phrase with equal scores at several cuts has the smallest; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structex.llm.common import durable, in_parts, written
from structex.llm.ngrams import mix, slices, word_places

MAX_WORDS, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Bits of a table and counters of a task, and the counters of one row.
SLOTS, STRETCH = 1 << 26, 1 << 16
#: Phrases that a task holds before it sends their counts on.
HELD = 400_000
#: Bytes after which a text is cut at the next end of a piece.
PIECES = 1 << 20
#: Parts of a language that are ranked apart before its best are ranked together.
RANK_PARTS = 32

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_BREAK = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_PARTS = BREAKS.copy()
_PARTS[[0x20, 0x09]] = True
_PLACES = (np.random.Generator(np.random.PCG64(4)).integers(1, 2**63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_COUNT_SCHEMA = "lang string, phrase string, n long, stretch int, counts binary"


class Slice:
    """The words of some texts of one language: hashes, places, and where phrases may run."""

    def __init__(self, texts: list[bytes], lang: str):
        self.blob = b"".join(texts)
        self.words, counts, self.starts, self.ends = word_places(texts, spaces=_PARTS)
        breaks = np.cumsum(BREAKS[np.frombuffer(self.blob, np.uint8)])
        text = np.repeat(np.arange(len(texts)), counts)
        piece = breaks[self.starts] if len(self.words) else np.empty(0, np.int64)
        self.runs_on = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
        self.lang = word_places([lang.encode()], spaces=np.zeros(256, bool))[0][:1]

    def hashes(self, m: int) -> np.ndarray:
        """One hash per place where m words stand in a row, whether or not a piece ends between."""
        n = max(0, len(self.words) - m + 1)
        mixed = np.zeros(n, np.uint64) + np.append(self.lang, np.uint64(0))[:1] * np.uint64(2 * m + 1)
        for k in range(m):
            mixed += self.words[k : k + n] * _PLACES[k]
        return mix(mixed)

    def whole(self, m: int) -> np.ndarray:
        """Where the m words lie in one piece."""
        n = max(0, len(self.words) - m + 1)
        inside = np.ones(n, bool)
        for k in range(m - 1):
            inside &= self.runs_on[k : k + n]
        return inside

    def phrase(self, at: int, m: int) -> str:
        return b" ".join(self.blob[self.starts[k] : self.ends[k]] for k in range(at, at + m)).decode()


def in_pieces(text: bytes, size: int = PIECES) -> list[bytes]:
    """A long text in parts that end where phrases end; a stretch without such an end stays whole."""
    parts, begin = [], 0
    while len(text) - begin > size:
        stop = _BREAK.search(text, begin + size)
        if stop is None:
            break
        parts.append(text[begin : stop.end()])
        begin = stop.end()
    return [*parts, text[begin:]]


def slots_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def _bits(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


class Buckets:
    """Counters that stop at least, and the rows that carry them."""

    def __init__(self, slots: int, least: int):
        self.least, self.table = least, np.zeros(slots, np.uint8 if least < 256 else np.uint32)

    def add(self, slots: np.ndarray) -> None:
        found, counts = np.unique(slots, return_counts=True)
        self.table[found] = np.minimum(self.table[found] + np.minimum(counts, self.least), self.least)

    def rows(self) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for at in range(0, len(self.table), STRETCH):
            part = self.table[at : at + STRETCH]
            if part.any():
                yield _rows([None], [None], [None], [at // STRETCH], [pack(part.tobytes())])


def _rows(*columns: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "phrase", "n", "stretch", "counts"]
    )


def _pass(m: int, last: bool, least: int, slots: int, held: int, frequent, buckets):
    """Counts of phrases of m words that may be frequent, and buckets of those one word longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, str], int] = defaultdict(int)
        deeper = Buckets(slots, least)

        def flush() -> pa.RecordBatch:
            n, keys = len(tally), list(zip(*tally, strict=True))
            rows = _rows(list(keys[0]), list(keys[1]), list(tally.values()), [None] * n, [None] * n)
            tally.clear()
            return rows

        for batch in in_parts(batches):
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang] += in_pieces(text.encode().lower())
            for lang, texts in by_lang.items():
                for begin, end in slices(texts):
                    part = Slice(texts[begin:end], lang)
                    hashes, may = part.hashes(m), part.whole(m)
                    if m > 1:
                        shorter = _bits(frequent.value, slots_of(part.hashes(m - 1), slots))
                        may &= shorter[:-1] & shorter[1:] & _bits(buckets.value, slots_of(hashes, slots))
                    at = np.flatnonzero(may)
                    _, first, counts = np.unique(hashes[at], return_index=True, return_counts=True)
                    for place, count in zip(at[first].tolist(), counts.tolist(), strict=True):
                        tally[lang, part.phrase(place, m)] += count
                    if not last:
                        on = may[:-1] & may[1:] & part.whole(m + 1)
                        deeper.add(slots_of(part.hashes(m + 1)[on], slots))
                    if len(tally) > held:
                        yield flush()
        if tally:
            yield flush()
        yield from deeper.rows()

    return run


def _mark(m: int, least: int, slots: int):
    """Frequent phrases as buckets that are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = Buckets(slots, least)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang].append(phrase.encode())
            for lang, phrases in by_lang.items():
                own = slots_of(Slice(phrases, lang).hashes(m)[::m], slots)
                full.table[own] = least
        yield from full.rows()

    return run


def _fold(least: int, slots: int):
    """Rows in the order of stretches: their counters added up, as bits of those that are full."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        size = min(STRETCH, slots)

        def done(stretch: int, table: np.ndarray) -> pa.RecordBatch:
            return _rows([None], [None], [None], [stretch], [np.packbits(table >= least, bitorder="little").tobytes()])

        now, table = None, np.zeros(size, np.uint32)
        for batch in batches:
            for stretch, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stretch != now:
                    if now is not None:
                        yield done(now, table)
                    now, table = stretch, np.zeros(size, np.uint32)
                table += np.frombuffer(unpack(counts), kind)
                np.minimum(table, least, out=table)
        if now is not None:
            yield done(now, table)

    return run


def _table(rows: DataFrame, least: int, slots: int):
    """Broadcast bits of the full counters: slots / 8 bytes, whatever the input."""
    sorted_ = rows.filter("stretch is not null").select("stretch", "counts").repartition("stretch").sortWithinPartitions("stretch")
    bits = np.zeros(slots // 8, np.uint8)
    size = min(STRETCH, slots) // 8
    for row in sorted_.mapInArrow(_fold(least, slots), _COUNT_SCHEMA).select("stretch", "counts").collect():
        bits[row["stretch"] * size : (row["stretch"] + 1) * size] = np.frombuffer(row["counts"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def frequent_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    slots: int = SLOTS,
    held: int = HELD,
) -> tuple[list[DataFrame], DataFrame]:
    """By number of words, (lang, phrase, f) of all phrases found least times; and (lang, n)."""
    source = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).filter("text <> ''")
    levels, totals, frequent, buckets = [], None, None, None
    for m in range(1, max_words + 1):
        counted, remove = written(source.mapInArrow(_pass(m, m == max_words, least, slots, held, frequent, buckets), _COUNT_SCHEMA))
        phrases = counted.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        levels.append(durable(phrases.filter(F.col("f") >= least)))
        if m == 1:
            totals = durable(counted.filter("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")))
        if m < max_words:
            frequent = _table(levels[-1].select("lang", "phrase").mapInArrow(_mark(m, least, slots), _COUNT_SCHEMA), least, slots)
            buckets = _table(counted, least, slots)
        remove()
    return levels, totals


def _words(begin: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", begin, size), " ")


def _scored(levels: list[DataFrame]) -> DataFrame:
    """Every candidate at its lowest-scoring cut: lang, phrase, a, l, r, score."""
    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    candidates = levels[1].withColumn("m", F.lit(2))
    for m, level in enumerate(levels[2:], 3):
        candidates = candidates.unionByName(level.withColumn("m", F.lit(m)))
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), "m", F.split("phrase", " ").alias("words"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    joined = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    )
    a, l, r = (f"cast({x} as decimal(16,0))" for x in "alr")
    scored = joined.withColumn("score", F.expr(f"cast(({a} * {a} * 1000000) div ({l} * {r}) as long)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def _held_inside(levels: list[DataFrame], inside: int) -> DataFrame:
    """(lang, phrase, longer) of the shorter candidates in each longer one, with its greatest count."""
    found = None
    for m, level in enumerate(levels[2:], 3):
        words = level.select("lang", "f", F.split("phrase", " ").alias("words"))
        for size in range(2, m):
            part = words.select("lang", "f", F.explode(F.sequence(F.lit(1), F.lit(m - size + 1))).alias("at"), "words")
            part = part.select("lang", _words(F.col("at"), F.lit(size)).alias("phrase"), "f")
            found = part if found is None else found.unionByName(part)
    return found.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    inside: int = INSIDE,
    top: int = TOP,
    slots: int = SLOTS,
    held: int = HELD,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to max_words words."""
    levels, totals = frequent_phrases(docs, text_col, lang_col, max_words, least, slots, held)
    kept = _scored(levels)
    if max_words > 2:
        kept = kept.join(_held_inside(levels, inside), ["lang", "phrase"], "left")
        kept = kept.filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: its parts are ranked first, and the best of each together
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
