"""Chunks of documents with positions, overlap windows, and pages.

Offsets are code points, half open, absolute in the original text. Everything but the recursive
splitter is native: documents explode into chunk rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from structex.functions.jsonx import is_blank

CHUNK_SIZE, OVERLAP = 2000, 100
#: Where the recursive splitter cuts, coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
Chunker = Callable[[DataFrame, int], DataFrame]


def not_blank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Blank documents have no chunks."""
    return docs.filter(F.col(text_col).isNotNull() & ~is_blank(F.col(text_col)))


def fixed(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of size code points; the last one may be shorter."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    cut = docs.select(*docs.columns, F.posexplode(starts).alias("chunk_index", "start_index"))
    end = F.least(F.col("start_index") + size, n)
    return cut.withColumn("end_index", end)


def split_recursive(text: str, size: int) -> list[tuple[int, int]]:
    """Contiguous bounds that cover the text, each at most size long.

    A piece that is too long is cut after the coarsest separator it contains; neighbours are
    joined again while they fit.
    """

    def cut(start: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        if end - start <= size:
            yield start, end
            return
        if level == len(SEPARATORS):
            for a in range(start, end, size):
                yield a, min(a + size, end)
            return
        mark, parts, at = SEPARATORS[level], [], start
        while (found := text.find(mark, at, end)) >= 0:
            parts.append((at, found + len(mark)))
            at = found + len(mark)
        if at < end:
            parts.append((at, end))
        for a, b in parts:
            yield from cut(a, b, level + 1)

    out: list[tuple[int, int]] = []
    for a, b in cut(0, len(text), 0) if text else ():
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def recursive(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks along paragraphs, sentences and words. Which place fits best depends on the places
    before it, so this splitter is Python, in Arrow batches."""

    @F.pandas_udf("array<struct<start_index:int,end_index:int>>")
    def bounds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start_index": a, "end_index": b} for a, b in split_recursive(t or "", size)])

    cut = docs.select(*docs.columns, F.posexplode(bounds("text")).alias("chunk_index", "b"))
    return cut.select(*docs.columns, "chunk_index", "b.start_index", "b.end_index")


def fixed_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """widen(fixed(docs, size), overlap) without the text on every row.

    A text is cut once, from its beginning to its end; a chunk's margins come from the pieces
    beside it. So the time is linear in the text's length, and rows carry their own chunk only.
    """
    near = -(-overlap // size)

    def window(pieces: Column, i: Column) -> Column:
        first = F.greatest(i - near, F.lit(0))
        start = F.greatest(i * size - overlap, F.lit(0))
        last = F.size(pieces) - 1
        whole = last * size + F.length(F.element_at(pieces, -1))
        end = F.least(F.least((i + 1) * size, whole) + overlap, whole)
        text = F.array_join(F.slice(pieces, first + 1, i - first + 1 + near), "")
        return F.struct(
            i.alias("chunk_index"),
            start.alias("start_index"),
            end.alias("end_index"),
            F.substring(text, start - first * size + 1, end - start).alias("chunk_text"),
        )

    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    # an array of one, so that the pieces are made once for all windows
    windows = F.flatten(F.transform(F.array(cut), lambda pieces: F.transform(pieces, lambda _, i: window(pieces, i))))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(*others, F.inline(windows))


def recursive_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """widen(recursive(docs, size), overlap) without the text on every row."""

    @F.pandas_udf("array<struct<chunk_index:int,start_index:int,end_index:int,chunk_text:string>>")
    def windows(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[dict]:
            text = text or ""
            found = [(max(0, a - overlap), min(len(text), b + overlap)) for a, b in split_recursive(text, size)]
            return [{"chunk_index": i, "start_index": a, "end_index": b, "chunk_text": text[a:b]} for i, (a, b) in enumerate(found)]

        return texts.map(of)

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(*others, F.inline(windows("text")))


def widen(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Extend each chunk by overlap on both sides and take its text from the original."""
    start, end = F.col("start_index"), F.col("end_index")
    if overlap > 0:
        start = F.greatest(F.lit(0), start - overlap)
        end = F.least(F.length("text"), end + overlap)
    wide = chunks.withColumns({"start_index": start, "end_index": end})
    return wide.withColumn("chunk_text", F.substring("text", F.col("start_index") + 1, F.col("end_index") - F.col("start_index")))


def chunk_documents(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP, chunker: Chunker | None = None) -> DataFrame:
    """(…, chunk_index, start_index, end_index, chunk_text) of all documents that aren't blank."""
    own = {None: recursive_windows, recursive: recursive_windows, fixed: fixed_windows}.get(chunker)
    if own is not None:
        return own(not_blank(docs), chunk_size, overlap)
    return widen(chunker(not_blank(docs), chunk_size), overlap).drop("text")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open windows share a place."""
    return (a_start < b_end) & (b_start < a_end)


def overlapping_pairs(chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Pairs of chunks of a document whose windows meet. The equality on the document keeps this
    a hash or merge join with a residual."""
    cols = [doc_col, "chunk_index", "start_index", "end_index"]
    a = chunks.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = chunks.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    on = (
        (F.col(f"a_{doc_col}") == F.col(f"b_{doc_col}"))
        & (F.col("a_chunk_index") < F.col("b_chunk_index"))
        & overlaps(F.col("a_start_index"), F.col("a_end_index"), F.col("b_start_index"), F.col("b_end_index"))
    )
    return a.join(b, on).select(F.col(f"a_{doc_col}").alias(doc_col), F.col("a_chunk_index").alias("chunk_a"), F.col("b_chunk_index").alias("chunk_b"))


def page_spans(pages: DataFrame, separator: str = "\n\n", doc_col: str = "doc_id") -> DataFrame:
    """Each page's place in the joined text; the separator belongs to no page."""
    before = Window.partitionBy(doc_col).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(separator)).over(before), F.lit(0))
    spans = pages.withColumn("start_offset", start.cast("long"))
    return spans.withColumn("end_offset", F.col("start_offset") + F.length("text"))


def join_pages(pages: DataFrame, separator: str = "\n\n", doc_col: str = "doc_id") -> DataFrame:
    """One text per document. Pages of a document come together, as its text must."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy(doc_col).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), separator).alias("text"))


def page_of(offsets: DataFrame, spans: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """offsets (doc, offset) with the page that holds each; null on a separator."""
    s = spans.select(F.col(doc_col).alias("_doc"), "page_number", "start_offset", "end_offset")
    on = (
        (F.col(doc_col) == F.col("_doc"))
        & (F.col("offset") >= F.col("start_offset"))
        & (F.col("offset") < F.col("end_offset"))
    )
    return offsets.join(s, on, "left").drop("_doc", "start_offset", "end_offset")
