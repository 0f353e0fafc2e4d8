"""Hierarchical residual packing of token sequences.

Texts become ids and a closing id; sequences longer than the capacity are cut from their end into
full pieces, so only the first piece may be shorter. Full pieces are bins of their own. The others
are dealt evenly over tasks and packed best fit, longest first. Bins that are nearly full are
emitted, and so are bins that even the smallest open one doesn't fit; what is underfull goes on as
one item of its total length to the next round, until one task holds all that is left or a round
hardly joins anything any more. Rows carry lengths and checksums, never ids, so a row has a few
dozen bytes, and in every round, the last one too, a task's share is bounded by items_per_task.

An added token's string in a text is that token, as the tokenizer's file has it.

Defined cases: a null or empty text is one piece with the closing id alone; repeated rows and
equal ids are packed each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structex.llm.common import durable, in_parts

CAPACITY = 2048
#: A bin with at most so many free places is emitted before the last round.
SLACK = 8
#: Items of one task; and the share of a round's items that are left behind it at which rounds end.
ITEMS_PER_TASK, STALE = 100_000, 0.95
CLOSING_ID = b"\0\0\0\0"

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]
BIN_SCHEMA = (
    "bin long, total long, doc_id array<long>, piece array<int>, start array<long>, "
    "length array<long>, ids_crc32 array<long>, offset array<long>"
)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def _tokenise(capacity: int, rank_file: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from structex.llm.tokens import encoder

        packed = encoder(rank_file).packed
        for batch in in_parts(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = packed(text or "") + CLOSING_ID
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(rows, (doc_id, piece, start, length, crc), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places of the items by bin: each item, in the given order, in the fullest bin it fits.

    Free places of open bins are bits of one integer, so the tightest fit is its lowest bit from
    the item's length on.
    """
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for place, length in enumerate(lengths):
        rest = mask >> length
        if rest:
            free = length + (rest & -rest).bit_length() - 1
            which = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[which].append(place)
        else:
            free, which = capacity, len(bins)
            bins.append([place])
        left = free - length
        if left:
            by_free[left].append(which)
            mask |= 1 << left
    return bins


def _pack(capacity: int, level: int):
    """Bins (or, at first, pieces as bins of one) to bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items: list[tuple] = []
        for batch in batches:
            items += zip(*[batch.column(i).to_pylist() for i in range(len(batch.schema))], strict=True)
        if not items:
            return
        items.sort(key=lambda x: (-x[0], [(d is None, d or 0) for d in x[1]], x[2]))
        base = (level << 56) | (TaskContext.get().partitionId() << 28)
        out: list[list] = [[] for _ in range(8)]
        for number, places in enumerate(best_fit([x[0] for x in items], capacity)):
            total, columns = 0, [[] for _ in BIN_FIELDS]
            for place in places:
                item = items[place]
                for column, values in zip(columns[:5], item[1:6], strict=True):
                    column += values
                columns[5] += [total + o for o in item[6]]
                total += item[0]
            for column, value in zip(out, (base | number, total, *columns), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), *(pa.list_(k) for k in (pa.int64(), pa.int32(), *[pa.int64()] * 4))]
        names = ["bin", "total", *BIN_FIELDS]
        for at in range(0, len(out[0]), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[at : at + 10_000], k) for c, k in zip(out, kinds, strict=True)], names=names
            )

    return run


def pieces_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rank_file: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids."""
    source = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return source.mapInArrow(_tokenise(capacity, rank_file), PIECE_SCHEMA)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    rank_file: str | None = None,
    slack: int = SLACK,
    items_per_task: int = ITEMS_PER_TASK,
    rounds: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """One row per piece with sequence_id and offset; rounds, if given, gets (items, tasks) of each."""
    pieces = durable(pieces_of(docs, id_col, text_col, capacity, rank_file))
    full = pieces.filter(F.col("length") == capacity).select(
        "*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    single = [F.array(F.col(c)).alias(c) for c in BIN_FIELDS[:5]]
    items = pieces.filter(F.col("length") < capacity).select(
        F.col("length").alias("total"), *single, F.array(F.lit(0).cast("long")).alias("offset")
    )
    level, done, n = 0, [full], items.count()
    while n:
        tasks = math.ceil(n / items_per_task)
        if rounds is not None:
            rounds.append((n, tasks))
        bins = durable(items.repartition(tasks).mapInArrow(_pack(capacity, level), BIN_SCHEMA))
        free = capacity - slack
        open_ = F.col("total") < free
        if tasks > 1:
            # a bin that the smallest open one doesn't fit can't be joined with any
            least = bins.filter(open_).agg(F.min("total")).first()[0]
            open_ &= F.col("total") <= capacity - (least or 0)
        left = bins.filter(open_).count() if tasks > 1 else 0
        if left > STALE * n or not left:
            open_, left = F.lit(False), 0
        done.append(
            bins.filter(~open_)
            .select("bin", F.inline(F.arrays_zip(*BIN_FIELDS)))
            .select(*BIN_FIELDS[:5], F.col("bin").alias("sequence_id"), "offset")
        )
        items, n = bins.filter(open_).select("total", *BIN_FIELDS), left
        level += 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
