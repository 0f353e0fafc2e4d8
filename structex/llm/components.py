"""Connected components of a graph in DataFrames: forests by task, then one task or rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structex.llm.common import durable

#: A task takes about so many edges; a graph has at least so many tasks.
EDGES_PER_TASK, LEAST_TASKS = 200_000, 8
#: Edges that a task holds at once, and up to how many edges of all forests one task joins them.
HELD, ALONE = 1 << 19, 1 << 20


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, in order, and the least node of each one's component.

    Roots of neighbouring trees are hung on the least of them until no edge joins two trees: each
    time all roots but those less than all around them go, so at least half of those with neighbours.
    """
    nodes, back = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = back.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the same components as a task's edges: each node's to the least of its own there.

    At most about HELD edges are held; where they join too little to be held on, they go out.
    """
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        nodes, least = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return [x[nodes != least] for x in (nodes, least)]

    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(2)])
        if sum(len(u) for u, _ in held) > HELD:
            held = [joined()]
            if len(held[0][0]) > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["u", "v"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], names=["u", "v"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges of a task."""
    held = [[batch.column(i).to_numpy() for i in range(2)] for batch in batches]
    if held:
        found = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (u, v); the label is the least node of a component.

    Tasks reduce their edges to forests. Where these have at most ALONE edges, which is a few tens
    of MB, one task joins them; else labels spread in rounds, however many edges there are. Rounds
    are jobs, and what the driver keeps of each job's plans, code and tasks adds up.
    """
    schema = "u long, v long"
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v")
    forests = durable(edges.mapInArrow(_forest, schema))
    n = forests.count()
    if n <= ALONE:
        return durable(forests.repartition(1).mapInArrow(_whole, "node long, label long"))
    return _by_rounds(forests, max(LEAST_TASKS, 2 * n // EDGES_PER_TASK))


def _by_rounds(edges: DataFrame, tasks: int) -> DataFrame:
    """Minimum labels with hooks and pointer jumping.

    Each round takes the least label of the neighbours (summed up before the shuffle, so a node
    with very many neighbours is no hot spot), for a node that others have as their label the
    least that any of them got as well, and then the label's own label, so that long chains take
    few rounds. Rounds end when no label changes. A round has as many tasks as the graph is
    large, not as the session's shuffles are wide.
    """
    both = durable(edges.select("u", "v").union(edges.select("v", "u")).distinct().toDF("u", "v"))
    both = both.coalesce(tasks)  # never more than there are
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = durable(labels.coalesce(tasks))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .coalesce(tasks)
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("m"))
            .coalesce(tasks)
        )
        got = durable(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("own")).coalesce(tasks))
        hooks = got.filter("own < label").groupBy(F.col("label").alias("node")).agg(F.min("own").alias("hook"))
        stepped = got.join(hooks, "node", "left").select("node", "label", F.least("own", F.coalesce("hook", "own")).alias("next")).coalesce(tasks)
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stepped.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("new"), F.col("label").alias("old")
        )
        moved = durable(moved.coalesce(tasks))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter("new != old").isEmpty():
            return labels
