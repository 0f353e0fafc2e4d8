"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: its distinct words hashed into buckets (weighted so that they have
length one together), structure statistics and the metadata of its size, each sorted into levels.
The score is the logistic of  b + w.x + 1/2 sum_f [(V_f.x)^2 - (V_f^2).(x^2)],  the pairwise
interactions of all features in time linear in their number. It is trained by Adagrad on the
driver over at most max_train labelled rows, taken in the order of a hash of doc_id; the model has
a fixed size. Everything else is one pass over the documents without a shuffle.

Never an input: labels (beyond training), lang, source, doc_id.

Defined cases: a null text is an empty text, which has a score like any other; several labels of
a document count as their mean, and of rows that repeat a labelled id one is learned from; without labelled rows the score is 0.5; equal texts get equal
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structex.llm.common import in_parts
from structex.llm.ngrams import slices, word_hashes

#: The bound on labelled rows that the model is fitted on.
MAX_TRAIN = 8_000
WORD_BUCKETS, FACTORS, LEVELS = 1 << 14, 8, 12
EPOCHS, RATE, BATCH, PENALTY = 8, 0.15, 64, 1e-5
CUT = 0.7
#: Upper bounds of the levels of a share; sizes are sorted by powers of two instead.
SHARES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
_KINDS = np.zeros((256, 6), np.int64)
for _k, _set in enumerate((b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b"!", b".,;:?\"'()-", b"\n")):
    _KINDS[list(_set), _k] = 1
N_STATS = 12
SIZE = WORD_BUCKETS + N_STATS * LEVELS


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, number by text) of all texts in a row."""
    hashes, counts = word_hashes(texts, lower=True)
    ends = np.cumsum(counts)
    index, value, numbers = [], [], []
    for text, begin, end in zip(texts, ends - counts, ends, strict=True):
        own = hashes[begin:end]
        words = np.unique((own >> np.uint64(40)).astype(np.int64) & (WORD_BUCKETS - 1))
        n, size = len(own), max(1, len(text))
        kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS
        lines = [line for line in text.split(b"\n") if line.strip()]
        same = int((own[1:] == own[:-1]).sum()) if n else 0
        shares = (
            kinds[0] / max(1, n) / 3,
            kinds[1] / size,
            kinds[2] / size,
            kinds[3] / max(1, n) / 2,
            kinds[4] / size,
            1 - len(set(lines)) / max(1, len(lines)),
            1 - len(np.unique(own)) / max(1, n),
            same / max(1, n),
            (size - n) / max(1, n) / 16,
        )
        levels = [*np.searchsorted(SHARES, shares)]
        levels += [min(LEVELS - 1, int(x).bit_length()) for x in (n, len(lines), len(text) >> 4)]
        stats = WORD_BUCKETS + np.arange(N_STATS) * LEVELS + np.array(levels, np.int64)
        index += [words, stats]
        value += [np.full(len(words), max(1, len(words)) ** -0.5), np.ones(N_STATS)]
        numbers.append(len(words) + N_STATS)
    return np.concatenate(index), np.concatenate(value).astype(np.float32), np.array(numbers, np.int64)


class Machine:
    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.b = np.float32(0)
        self.w = np.zeros(SIZE, np.float32)
        self.v = (0.02 * rng.standard_normal((SIZE, FACTORS))).astype(np.float32)

    def margin(self, index, value, numbers, parts: dict | None = None) -> np.ndarray:
        starts = np.cumsum(numbers) - numbers
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        if parts is not None:
            parts |= {"vx": vx, "total": total}
        return self.b + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((total * total).sum(axis=1) - squares)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
        gw, gv, gb = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32), 1e-3
        rng = np.random.Generator(np.random.PCG64(17))
        if len(y):
            share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
            self.b = np.float32(np.log(share / (1 - share)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                rows = order[a : a + BATCH]
                index = np.concatenate([docs[r][0] for r in rows])
                value = np.concatenate([docs[r][1] for r in rows])
                numbers = np.array([len(docs[r][0]) for r in rows])
                parts: dict = {}
                p = 1 / (1 + np.exp(-self.margin(index, value, numbers, parts)))
                slope = ((p - y[rows]) / len(rows)).astype(np.float32)
                each = np.repeat(slope, numbers)
                used, back = np.unique(index, return_inverse=True)
                dw = np.bincount(back, each * value, len(used)).astype(np.float32) + PENALTY * self.w[used]
                pull = each[:, None] * value[:, None] * (np.repeat(parts["total"], numbers, axis=0) - parts["vx"])
                dv = np.zeros((len(used), FACTORS), np.float32)
                np.add.at(dv, back, pull)
                dv += PENALTY * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= 0.2 * RATE * dv / np.sqrt(gv[used])
                db = float(slope.sum())
                gb += db * db
                self.b -= np.float32(RATE * db / np.sqrt(gb))
        return self


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
        for a, b in slices(texts):
            index, value, numbers = features(texts[a:b])
            cuts = np.cumsum(numbers)[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.array([x.astype("<i4").tobytes() for x in np.split(index, cuts)], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for x in np.split(value, cuts)], pa.binary()),
                ],
                names=["order", "y", "index", "value"],
            )


def _apply(model: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for a, b in slices(texts):
                score = 1 / (1 + np.exp(-model.margin(*features(texts[a:b])).astype(np.float64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def is_held_out(id_col: str = "doc_id") -> Column:
    crc = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on labelled documents that aren't held out; labels has doc_id and quality."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~is_held_out())
    chosen = (
        known.groupBy("doc_id")
        .agg(F.avg("quality").alias("y"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(max_train)
    )
    # at most max_train rows of three numbers, so the broadcast has a proven bound
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "order", "y")
    # rows that repeat an id: the text of the least hash, so that the bound holds for documents too
    place = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    once = joined.groupBy("doc_id", "order", "y").agg(F.min(place).alias("p")).select("p.text", "order", "y")
    rows = once.mapInArrow(_extract, "order long, y double, index binary, value binary").collect()
    rows.sort(key=lambda r: (r["order"], r["index"]))
    vectors = [(np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4")) for r in rows]
    return Machine().fit(vectors, np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, max_train)
    rows = docs.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(_apply(model), "doc_id long, held_out boolean, score double, predicted int")
