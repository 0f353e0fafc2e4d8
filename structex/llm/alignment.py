"""Cross-tokenizer alignment by a sweep over the ends of tokens.

Each text is encoded twice: with a space before it by the byte-level BPE (side A), and as it is by
the piece BPE (side B), which adds that space. Every token is an event at the byte where it ends.
Events travel in rows of one document, one side and one window of bytes; both sides' rows are
united, dealt by document, sorted by window within partitions and swept in one pass. Where an event
lies, exactly one token of each side reaches: the pair is a link, and an event of both sides closes
a group. The sweep keeps the events past the other side's last one (fewer than the longest token has
bytes) from window to window and nothing else.

aligned() has the links in packed rows, whatever is asked of them later: groups() and links()
unpack them, counted() tells in how many documents each pair of ids is linked, and digest() sums up
each document. Ids' pairs of a document are kept distinct; those of the corpus are counted by
partial sums and one shuffle. Pairs' counts are broadcast while there are at most MAX_BROADCAST of
them, and beyond that joined by a shuffle.

Defined cases: a null or empty text, and one that either tokenizer doesn't give back byte by byte,
has no tokens (zeros, and an empty digest); rows that repeat a doc_id with another text are
documents of their own, and equal rows count and come out as often as they are there; an empty
table gives no rows; other columns are ignored. Special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structex.llm.common import durable, in_parts
from structex.llm.tokens import encoder

#: Bytes of text whose events make one row of a side.
WINDOW = 1 << 16
#: Pairs of ids whose counts are broadcast, 16 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 1 << 21
#: Pairs that a task holds before it sends their counts on.
HELD = 1 << 21
#: A pair of ids as one number: A's id times this, and B's id.
PAIR = 1 << 17

_EVENT_KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
_EVENT_NAMES = ["doc_id", "key", "copies", "side", "window", "whole", "events"]
_EVENT_SCHEMA = "doc_id long, key binary, copies long, side int, window int, whole boolean, events binary"
_LINK_KINDS = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_LINK_NAMES = ["doc_id", "key", "copies", "part", "last", "base", "lengths", "a_ids", "b_ids", "ends"]
LINK_SCHEMA = "doc_id long, key binary, copies long, part int, last boolean, base long, lengths binary, a_ids binary, b_ids binary, ends binary"
_GROUP_SCHEMA = "doc_id long, key binary, copies long, start long, stop long, a_ids array<int>, b_ids array<int>"
_PAIRS_SCHEMA = (
    "doc_id long, key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
)


@lru_cache(maxsize=2)
def _pieces(model_file: str | None):
    """Side B's tokenizer and each of its ids' bytes."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file or public_tokenizers.path("piece_bpe_32k.model"))
    strings = []
    for piece in map(model.id_to_piece, range(model.get_piece_size())):
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        strings.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return model, strings


class Side:
    """How a side encodes texts behind a space, and its ids' lengths."""

    def __init__(self, side: int, file: str | None):
        if side:
            model, self.strings = _pieces(file)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            own = encoder(file)
            self.strings = own.strings()
            self.encode = lambda texts: [own.encode(f" {text}") for text in texts]
        self.lengths = np.fromiter(map(len, self.strings), np.int64, len(self.strings))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Ids of each text, which isn't empty; None if their bytes aren't those of a space and the text."""
        for text, ids in zip(texts, self.encode(texts), strict=True):
            same = b"".join(map(self.strings.__getitem__, ids)) == b" " + text.encode()
            yield np.array(ids, np.int64) if same else None


@lru_cache(maxsize=4)
def _side(side: int, file: str | None) -> Side:
    return Side(side, file)


def _batch(columns: tuple[list, ...], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _events(side: int, file: str | None, window: int):
    """Rows of end events: offsets as steps from the window's begin on, and ids, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        own = _side(side, file)
        for batch in in_parts(batches, 256):
            copies: dict[tuple, int] = {}
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copies[row] = copies.get(row, 0) + 1
            out: tuple[list, ...] = tuple([] for _ in _EVENT_NAMES)
            held = 0
            found = own.ids([text for _, text in copies if text])
            for (doc_id, text), n in copies.items():
                key = xxhash.xxh3_128_digest(b"" if text is None else b"x" + text.encode())
                ids = next(found) if text else None
                whole = ids is not None
                ids = ids if whole else np.empty(0, np.int64)
                ends = np.cumsum(own.lengths[ids])
                windows = (ends - 1) // window
                cuts = np.flatnonzero(np.diff(windows, prepend=-1, append=-1)).tolist() if len(ids) else []
                parts = [(int(windows[begin]), begin, end) for begin, end in itertools.pairwise(cuts)]
                if not parts or parts[0][0]:
                    # the first window has a row even where no token ends in it
                    parts.insert(0, (0, 0, 0))
                for number, begin, end in parts:
                    steps = np.diff(ends[begin:end], prepend=number * window)
                    events = np.concatenate((steps, ids[begin:end])).astype("<u4")
                    # steps from end to end, and bytes of equal weight together, compress best
                    packed = pack(events.view(np.uint8).reshape(-1, 4).T.tobytes())
                    for column, value in zip(out, (doc_id, key, n, side, number, whole, packed), strict=True):
                        column.append(value)
                    held += len(packed)
                if held > 1 << 21:
                    yield _batch(out, _EVENT_KINDS, _EVENT_NAMES)
                    out, held = tuple([] for _ in _EVENT_NAMES), 0
            yield _batch(out, _EVENT_KINDS, _EVENT_NAMES)

    return run


def events(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_file: str | None = None,
    model_file: str | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """Both sides' end events, in rows of a document, a side and a window."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    a, b = (source.mapInArrow(_events(side, file, window), _EVENT_SCHEMA) for side, file in enumerate((rank_file, model_file)))
    return a.unionByName(b)


class Sweep:
    """One document: events of both sides in, links out."""

    def __init__(self, window: int):
        self.window, self.base = window, 0
        self.waiting = [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in range(2)]

    def add(self, side: int, number: int, steps: np.ndarray, ids: np.ndarray) -> None:
        kept = self.waiting[side]
        ends = np.cumsum(steps) + number * self.window
        kept[0], kept[1] = np.concatenate((kept[0], ends)), np.concatenate((kept[1], ids))

    def links(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Base, and each new link's end, A id, B id and sides that end there (1 A, 2 B, 3 both)."""
        (a_ends, a_ids), (b_ends, b_ids) = self.waiting
        base = self.base
        if not len(a_ends) or not len(b_ends):
            return base, *[np.empty(0, np.int64)] * 4
        until = min(a_ends[-1], b_ends[-1])
        # a mark at each byte where a token of A (1), B (2) or both end; all waiting ends are beyond base
        marks = np.zeros(until - base, np.uint8)
        for side, ends in enumerate((a_ends, b_ends)):
            marks[ends[: np.searchsorted(ends, until, "right")] - base - 1] |= 1 << side
        at = np.flatnonzero(marks)
        sides = marks[at]
        # the token that reaches a place is the first one that doesn't end before it
        a, b = np.cumsum(sides & 1, dtype=np.int64) - (sides & 1), np.cumsum(sides >> 1, dtype=np.int64) - (sides >> 1)
        at += base + 1
        for kept in self.waiting:
            gone = np.searchsorted(kept[0], until, "right")
            kept[0], kept[1] = kept[0][gone:], kept[1][gone:]
        self.base = int(until)
        return base, at, a_ids[a], b_ids[b], sides


def _sweep(window: int):
    """Rows sorted by document, window and side to rows of links, one or more of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        doc, copies, whole, part, sweep = None, 0, True, 0, Sweep(window)
        before, out, held = None, tuple([] for _ in _LINK_NAMES), 0

        def emit(last: bool) -> None:
            nonlocal part, held
            base, at, a, b, sides = sweep.links() if whole else (0, *[np.empty(0, np.int64)] * 4)
            if not len(at) and not last:
                return
            lengths = np.diff(at, prepend=base).astype("<u4").tobytes()
            packed = (lengths, a.astype("<u4").tobytes(), b.astype("<u4").tobytes(), sides.astype(np.uint8).tobytes())
            for column, value in zip(out, (*doc, copies, part, last, base, *packed), strict=True):
                column.append(value)
            part, held = part + 1, held + 13 * len(at)

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(len(_EVENT_NAMES))), strict=True)
            for doc_id, key, n, side, number, all_, packed in rows:
                if (doc_id, key) != doc:
                    if doc is not None:
                        emit(True)
                    doc, copies, whole, part, sweep, before = (doc_id, key), 0, True, 0, Sweep(window), None
                if (number, side) != before and before is not None and number != before[0]:
                    # copies are known when the first window has been read
                    emit(False)
                if side == 0 and number == 0:
                    copies += n
                if (number, side) != before:
                    before, whole = (number, side), whole and all_
                    if not whole:
                        continue
                    values = np.frombuffer(unpack(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
                    sweep.add(side, number, *np.split(values, 2))
                if held > 1 << 21:
                    yield _batch(out, _LINK_KINDS, _LINK_NAMES)
                    out, held = tuple([] for _ in _LINK_NAMES), 0
            if out[0]:
                yield _batch(out, _LINK_KINDS, _LINK_NAMES)
                out, held = tuple([] for _ in _LINK_NAMES), 0
        if doc is not None:
            emit(True)
            yield _batch(out, _LINK_KINDS, _LINK_NAMES)

    return run


def aligned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_file: str | None = None,
    model_file: str | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """All links in packed rows (LINK_SCHEMA): each different row of docs in consecutive parts, the last one marked.

    A link reaches from the end of the one before it (from base, the first of a part) over its
    length in bytes; ends says whose token ends with it.
    """
    rows = events(docs, id_col, text_col, rank_file, model_file, window)
    return rows.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key", "window", "side").mapInArrow(_sweep(window), LINK_SCHEMA)


def _unpacked(batches: Iterator[pa.RecordBatch]):
    """(doc_id, key, copies, part, last, base, lengths, A ids, B ids, ends) of each packed row."""
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(len(_LINK_NAMES))), strict=True):
            values = [np.frombuffer(x, "<u4").astype(np.int64) for x in row[6:9]]
            yield (*row[:6], *values, np.frombuffer(row[9], np.uint8))


def _as_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, key, copies, _, _, base, lengths, a, b, _ in _unpacked(batches):
        stops = base + np.cumsum(lengths)
        n = len(stops)
        columns = ([doc_id] * n, [key] * n, [copies] * n, stops - lengths, stops, a, b)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield _batch(columns, kinds, ["doc_id", "key", "copies", "start", "stop", "a_id", "b_id"])


def links(rows: DataFrame) -> DataFrame:
    """One row per link of aligned()'s rows, with the bytes it covers (of the text with its space)."""
    return rows.mapInArrow(_as_links, "doc_id long, key binary, copies long, start long, stop long, a_id int, b_id int")


def _as_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a_open, b_open, start = [], [], 0
    for doc_id, key, copies, part, _, base, lengths, a, b, ends in _unpacked(batches):
        if part == 0:
            a_open, b_open, start = [], [], 0
        columns: tuple[list, ...] = ([], [], [], [])
        stops = base + np.cumsum(lengths)
        for stop, a_id, b_id, end in zip(stops.tolist(), a.tolist(), b.tolist(), ends.tolist(), strict=True):
            if end & 1:
                a_open.append(a_id)
            if end & 2:
                b_open.append(b_id)
            if end == 3:
                for column, value in zip(columns, (start, stop, a_open, b_open), strict=True):
                    column.append(value)
                a_open, b_open, start = [], [], stop
        n = len(columns[0])
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield _batch(([doc_id] * n, [key] * n, [copies] * n, *columns), kinds, ["doc_id", "key", "copies", "start", "stop", "a_ids", "b_ids"])


def groups(rows: DataFrame) -> DataFrame:
    """One row per group of aligned()'s rows, taken in their order: bytes covered, and the ids of both sides."""
    return rows.mapInArrow(_as_groups, _GROUP_SCHEMA)


@lru_cache(maxsize=1)
def _numerals(n: int = PAIR) -> list[str]:
    """Each id's numeral before each of , | and ; in turn."""
    return [f"{k}{mark}" for mark in ",|;" for k in range(n)]


class Digest:
    """Figures of one document out of its parts."""

    def __init__(self):
        self.sha, self.lead, self.sums = hashlib.sha256(), "", np.zeros(4, np.int64)
        self.open_a = self.open_b = np.empty(0, np.int64)
        self.pairs = self.times = np.empty(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> None:
        closes = ends == 3
        self.sums += np.array([(ends & 1).sum(), (ends >> 1).sum(), closes.sum(), len(ends)], np.int64)
        found, times = np.unique(a * PAIR + b, return_counts=True)
        self.pairs, place = np.unique(np.concatenate((self.pairs, found)), return_inverse=True)
        self.times = np.bincount(place, np.concatenate((self.times, times))).astype(np.int64)
        if not len(ends):
            return
        # the group of each token: closed groups before it
        group = np.cumsum(closes) - closes
        n_groups = int(closes.sum())
        a_at, b_at = np.flatnonzero(ends & 1), np.flatnonzero(ends & 2)
        a_ids = np.concatenate((self.open_a, a[a_at]))
        b_ids = np.concatenate((self.open_b, b[b_at]))
        a_group = np.concatenate((np.zeros(len(self.open_a), np.int64), group[a_at]))
        b_group = np.concatenate((np.zeros(len(self.open_b), np.int64), group[b_at]))
        a_done, b_done = np.searchsorted(a_group, n_groups), np.searchsorted(b_group, n_groups)
        self.open_a, self.open_b = a_ids[a_done:], b_ids[b_done:]
        a_ids, a_group, b_ids, b_group = a_ids[:a_done], a_group[:a_done], b_ids[:b_done], b_group[:b_done]
        if not n_groups:
            return
        # numerals in the order of groups, A before B; a side's last one of a group has another mark
        a_last, b_last = np.diff(a_group, append=n_groups) > 0, np.diff(b_group, append=n_groups) > 0
        order = np.empty(a_done + b_done, np.int64)
        a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=n_groups)) for g in (a_group, b_group))
        order[np.arange(a_done) + (b_upto[a_group] - np.bincount(b_group, minlength=n_groups)[a_group])] = a_ids + PAIR * a_last
        order[np.arange(b_done) + a_upto[b_group]] = b_ids + 2 * PAIR * b_last
        text = self.lead + "".join(map(_numerals().__getitem__, order.tolist()))
        self.sha.update(text[:-1].encode())
        self.lead = ";"

    def row(self) -> tuple:
        figures = [int(x) for x in self.sums]
        return (*figures, self.sha.hexdigest() if figures[3] else "")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    names = [x.split()[0] for x in _PAIRS_SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.binary(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
    now, out, held = Digest(), tuple([] for _ in names), 0
    for doc_id, key, copies, part, last, _, _, a, b, ends in _unpacked(batches):
        if part == 0:
            now = Digest()
        now.add(a, b, ends)
        if last:
            packed = pack(np.diff(now.pairs, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()), pack(now.times.astype("<u4").tobytes())
            for column, value in zip(out, (doc_id, key, copies, *now.row(), *packed), strict=True):
                column.append(value)
            held += len(packed[0]) + len(packed[1])
        if held > 1 << 20 or len(out[0]) > 1000:
            yield _batch(out, kinds, names)
            out, held = tuple([] for _ in names), 0
    yield _batch(out, kinds, names)


def _pairs_of(pairs: bytes, times: bytes, unpack) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(unpack(pairs), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum(steps), np.frombuffer(unpack(times), "<u4").astype(np.int64)


def _held_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of documents by pair."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting, size = [], 0

    def merge() -> None:
        nonlocal pairs, n, waiting, size
        found, place = np.unique(np.concatenate((pairs, *[x for x, _ in waiting])), return_inverse=True)
        n = np.bincount(place, np.concatenate((n, *[c for _, c in waiting]))).astype(np.int64)
        pairs, waiting, size = found, [], 0

    for batch in batches:
        for copies, packed, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own, _ = _pairs_of(packed, times, unpack)
            waiting.append((own, np.full(len(own), copies, np.int64)))
            size += len(own)
        if size > HELD:
            merge()
            if len(pairs) > HELD:
                yield _batch((pairs, n), (pa.int64(), pa.int64()), ["pair", "n"])
                pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
    if waiting:
        merge()
    yield _batch((pairs, n), (pa.int64(), pa.int64()), ["pair", "n"])


def counted(digests: DataFrame) -> DataFrame:
    """pair, n (documents that have it linked) and best (n is the highest of its A id)."""
    n = digests.select("copies", "pairs", "times").mapInArrow(_held_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = durable(n)
    a_id = F.floor(F.col("pair") / PAIR)
    highest = n.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return n.withColumn("a_id", a_id).join(highest, "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _look_up(table):
    """Sums over each document's links by a table of all pairs."""
    kept = ["doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        pairs, n, best = table.value
        for batch in batches:
            sums: tuple[list, list] = ([], [])
            for packed, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                own, often = _pairs_of(packed, times, unpack)
                at = np.searchsorted(pairs, own)
                sums[0].append(int((often * best[at]).sum()))
                sums[1].append(int((often * n[at]).sum()))
            columns = [batch.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in sums]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum"])

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc_id, key, packed, times in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            pairs, often = _pairs_of(packed, times, unpack)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield _batch(([doc_id] * len(pairs), [key] * len(pairs), pairs, often), kinds, ["doc_id", "key", "pair", "times"])


def digest(rows: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    documents = durable(rows.mapInArrow(_digests, _PAIRS_SCHEMA))
    counts = durable(counted(documents))
    if counts.count() <= max_broadcast:
        found = counts.orderBy("pair").toArrow()
        table = [found.column(c).to_numpy() for c in ("pair", "n", "best")]
        broadcast = rows.sparkSession.sparkContext.broadcast(table)
        schema = "doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
        result = documents.mapInArrow(_look_up(broadcast), schema)
    else:
        each = documents.select("doc_id", "key", "pairs", "times").mapInArrow(_explode, "doc_id long, key binary, pair long, times long")
        sums = (
            each.join(counts, "pair")
            .groupBy("doc_id", "key")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        )
        same = documents["key"].eqNullSafe(sums["key"]) & documents["doc_id"].eqNullSafe(sums["doc_id"])
        result = documents.join(sums, same, "left").select(
            documents["doc_id"], "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
        )
    result = result.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
