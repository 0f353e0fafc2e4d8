"""Jaccard self-join of texts on word n-grams by MinHash banding.

1. Texts are reduced to distinct ones; a copy counts as a link of weight one and is never paired.
2. Each distinct text gets a MinHash signature. Band and row counts are chosen so that a pair at
   the threshold shares a band with the target recall. Texts meet by a shuffle on band hashes.
3. In each band bucket a breadth-first search over estimated similarity (from the signatures)
   connects what may be similar, at a margin of six deviations below the threshold. A bucket of
   alike texts takes linear time; only tree edges leave it. Buckets above block_size are dealt as
   pairs of blocks. The components of these edges are the clusters inside which links can lie.
4. Full n-gram sets are sent to their cluster once (clusters above block_size: once for each
   block they meet), and every pair of the cluster is verified exactly by counting common n-grams
   in matrix products. What leaves a task is a count of links per text and tree edges, never the
   pairs.
5. The components of verified links are the classes.

Texts are told apart, and n-grams compared, by 64-bit hashes.

Defined cases: a text with fewer words than n has one n-gram, all its words; null texts and texts
without a word have none and link with nothing (each is its own class); repeated rows are copies;
the class id is the least id in a class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structex.llm.common import durable, in_parts
from structex.llm.components import components
from structex.llm.ngrams import MinHash, mix, shingles, slices

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
MAX_HASHES = 160
#: Hashes of a signature that buckets compare, and deviations of the estimate that they allow for.
SKETCH, DEVIATIONS = 64, 6
BLOCK_SIZE = 2048
#: Columns of one matrix product, and up to how many sets an n-gram is counted pair by pair.
WIDTH, FEW = 2048, 6


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false meetings, that reach the recall."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def _sign(ngram: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(max(bands * rows, SKETCH))
        place = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for batch in in_parts(batches):
            nodes = batch.column(0)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                hashes, numbers = shingles(texts[a:b], ngram)
                signed = hasher.signatures(hashes, numbers)
                weighed = signed[:, : bands * rows].astype(np.uint64) * place
                keys = mix(weighed.reshape(b - a, bands, rows).sum(axis=2, dtype=np.uint64)).view(np.int64)
                sketch = signed[:, :SKETCH].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        nodes.slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel())),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    names=["node", "keys", "sketch"],
                )

    return run


def _tree(nodes: np.ndarray, sketches: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Tree edges of the graph of sketches that agree in at least least places."""
    rest, us, vs = np.arange(len(nodes)), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = (sketches[rest] == sketches[at]).sum(axis=1) >= least
            found, rest = rest[near], rest[~near]
            us += [int(nodes[at])] * len(found)
            vs += nodes[found].tolist()
            queue += found.tolist()
    return us, vs


def _trees(least: int):
    """Rows sorted by bucket (key, lo, hi) to the tree edges of each bucket.

    Most buckets have two texts: those of a batch are compared at once. A bucket is at most
    2 * block_size rows, and only the last one of a batch waits for the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def edges(groups: np.ndarray, nodes: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]).any(axis=1)))) if len(groups) else np.empty(0, int)
            sizes = np.diff(np.append(start, len(groups)))
            two = start[sizes == 2]
            near = two[(sketches[two] == sketches[two + 1]).sum(axis=1) >= least]
            us, vs = nodes[near].tolist(), nodes[near + 1].tolist()
            for a, n in zip(start[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                u, v = _tree(nodes[a : a + n], sketches[a : a + n], least)
                us += u
                vs += v
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [
                np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "lo", "hi")], axis=1),
                batch.column("node").to_numpy(),
                np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(batch.num_rows, -1),
            ]
            if held is not None:
                new = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            groups = new[0]
            # the last bucket may go on in the next batch
            last = int(np.flatnonzero((groups != groups[-1]).any(axis=1))[-1]) + 1 if (groups != groups[-1]).any() else 0
            held = [x[last:] for x in new]
            yield edges(*[x[:last] for x in new])
        if held is not None:
            yield edges(*held)

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common n-grams of all pairs of sets."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    size = np.diff(np.concatenate((start, [len(every)])))
    shared = size > 1  # an n-gram of one set alone is common to no pair
    # n-grams of few sets are counted pair by pair, which is cheaper than a column of the product
    pairs = np.zeros((n, n), np.float32)
    for k in np.unique(size[shared & (size <= FEW)]):
        members = owner[start[size == k][:, None] + np.arange(k)[None, :]]
        for i in range(k):
            for j in range(i):
                np.add.at(pairs, (members[:, i], members[:, j]), 1)
    pairs += pairs.T
    shared &= size > FEW
    column = np.repeat(np.cumsum(shared) - 1, size)
    keep = np.repeat(shared, size)
    owner, column = owner[keep], column[keep]
    out = pairs
    columns = int(shared.sum())
    for first in range(0, columns, WIDTH):
        width = min(WIDTH, columns - first)
        a, b = np.searchsorted(column, (first, first + width))
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        out += block @ block.T
    return out


def _verify(threshold: Fraction):
    """By text: weighted links, and tree edges, of one cluster or of two of its blocks."""
    p, q = threshold.numerator, threshold.denominator

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in frame["grams"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        common = _common(sets).astype(np.int64)
        linked = q * common >= p * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        rest, parent = np.arange(len(nodes)), nodes.copy()
        while len(rest):  # a forest of the links, whichever block they are in
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                near = linked[at, rest]
                found, rest = rest[near], rest[~near]
                parent[found] = nodes[at]
                queue += found.tolist()
        if frame["lo"].iloc[0] != frame["hi"].iloc[0]:  # links inside a block are counted with the block alone
            block = frame["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        return pd.DataFrame({"node": nodes, "links": linked @ copies, "parent": parent})

    return run


def _gather(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            rest = batch.drop_columns(["text"])
            for a, b in slices(texts):
                hashes, numbers = shingles(texts[a:b], ngram)
                parts = np.split(hashes, np.cumsum(numbers)[:-1])
                grams = pa.array([np.unique(x).astype("<u8").tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, grams], names=[*rest.schema.names, "grams"])

    return run


def _blocks(df: DataFrame, key: str, count: str, size: int) -> DataFrame:
    """Deal groups of more than size rows as pairs of blocks (lo <= hi) of at most about size / 2."""
    n = F.when(F.col(count) <= size, F.lit(1)).otherwise(F.ceil(F.col(count) / (size // 2))).cast("int")
    dealt = df.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return dealt.withColumn("other", other).select(
        *[c for c in df.columns if c != count], "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    max_hashes: int = MAX_HASHES,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """Per document: id, class_id, n_links (other documents at the threshold or above), th and label.

    label names the class even where ids repeat or are null; it is null for texts without words.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    share = Fraction(threshold).limit_denominator(10_000)
    sd = math.sqrt(threshold * (1 - threshold) / SKETCH)
    least = max(1, math.floor(SKETCH * (threshold - DEVIATIONS * sd)))

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    with_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    known = source.withColumn("node", F.when(with_word, F.xxhash64("text")))
    ids = durable(known.select("id", "node"))
    texts = durable(ids.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least")))

    # one row per distinct text: the row of its least id (rows that repeat id and text are merged below)
    signed = known.filter(with_word).select("node", "text").mapInArrow(_sign(ngram, bands, rows), "node long, keys array<long>, sketch binary")
    signed = durable(signed.dropDuplicates(["node"]))
    exploded = signed.select(F.explode("keys").alias("key"), "node")
    met = exploded.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1")
    members = exploded.join(met, "key").join(signed.select("node", "sketch"), "node")
    bucket = ["key", "lo", "hi"]
    dealt = _blocks(members, "key", "count", 2 * block_size).select(*bucket, "node", "sketch")
    # sorted by node, so that the buckets of a group of near copies mostly begin their trees at the same node
    trees = dealt.repartition(*bucket).sortWithinPartitions(*bucket, "node").mapInArrow(_trees(least), "u long, v long")
    clusters = components(trees)

    sized = clusters.join(clusters.groupBy("label").agg(F.count("*").alias("count")), "label")
    dealt = sized.join(texts.select("node", "copies"), "node")
    chosen = known.filter(with_word).select("node", "text").join(dealt, "node").dropDuplicates(["node"])
    sets = chosen.select("node", "label", "copies", "count", "text").mapInArrow(
        _gather(ngram), "node long, label long, copies long, count long, grams binary"
    )
    verified = durable(
        _blocks(sets, "label", "count", block_size)
        .groupBy("label", "lo", "hi")
        .applyInPandas(_verify(share), "node long, links long, parent long")
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.filter("node != parent").select(F.col("node").alias("u"), F.col("parent").alias("v")))

    named = texts.join(classes, "node", "left").join(links, "node", "left")
    named = named.select("node", "copies", "least", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    least_id = named.groupBy("label").agg(F.min("least").alias("class_id"))
    by_text = named.join(least_id, "label").select("node", "label", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    return ids.join(by_text, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("node").alias("th"),
        "label",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, one that carries its id, with its columns as they were.

    Of texts without words, which are in no class, one stays of those that repeat id and text.
    """
    classes = jaccard_classes(docs, id_col, text_col, **options)
    first = classes.filter(F.col(id_col).eqNullSafe(F.col("class_id")))
    first = first.select(F.col(id_col).alias("first_id"), F.coalesce("th", F.lit(0)).alias("first_th"), "label")
    # ids that repeat with near copies: the text of the least hash
    first = durable(first.groupBy("label", "first_id").agg(F.min("first_th").alias("first_th"), F.count("*").alias("n")))
    # rows go in a struct, so that their columns may have any names
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("own_id"),
        F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0)).alias("own_th"),
    )
    here = F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_th") == F.col("first_th"))
    again = first.filter("n > 1")
    if again.isEmpty():
        return rows.join(first, here, "left_semi").select("row.*")
    # texts are only shuffled where rows repeat
    blank = F.when(F.col("own_th") == 0, F.coalesce(F.col("row").getField(text_col), F.lit("")))
    repeated = rows.join(again, here).withColumn("blank", blank).dropDuplicates(["own_id", "own_th", "blank"]).select("row")
    return rows.join(first.filter("n = 1"), here, "left_semi").select("row").unionByName(repeated).select("row.*")
