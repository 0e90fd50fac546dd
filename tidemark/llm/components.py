"""Connected components by alternating large-star and small-star.

Large-star hangs each node's larger neighbours on the least of its neighbourhood, small-star does so
with the smaller ones, until every node hangs on its component's least. Each step is a minimum by node,
aggregated before its shuffle, and a join back; minima are written first, so that Spark may split the
edges of a node of very many. What a step gives is joined within its task before it is written, some
edges at a time: stars of the same nodes and components, of which there are not more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Edges that a task joins at once.
JOINED = 1 << 18


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the leasts of components, and its component's least."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        return pa.record_batch(dict(zip("uv", map(pa.array, _stars(u, v)))))

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= JOINED:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def _cut(edges: DataFrame) -> DataFrame:
    return cut(edges.mapInArrow(_joined, "u long, v long"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of edges u, v (long); loops and repeats do no
    harm, nodes with no edge to another have no row. drop() deletes the table behind the result."""
    now = _cut(edges.where("u <> v").select("u", "v"))
    while True:  # a logarithm's square of rounds in the number of nodes at most
        both = now.union(now.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")))
        if least.where("m < u and m <> most").isEmpty():  # all are leasts or have one neighbour, a lesser one
            break
        up = least.select("u", F.least("u", "m").alias("m"))
        large = _cut(both.where("v > u").join(up, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = _cut(large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down))
        drop(now, least, large, down)
        now = small
    drop(now)
    out = least.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
    out._tidemark_path = least._tidemark_path
    return out
