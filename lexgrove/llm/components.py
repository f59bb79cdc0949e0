"""Connected components of an edge table: local stars and pointer jumping, one exchange a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.cluster import cut


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node joined with each) of the edges a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars; ``moved`` where that is not what they were."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if len(b)]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, root = lowest(a, b)
    at = np.searchsorted(nodes, a)
    moved = np.zeros(len(nodes), dtype=bool)
    moved[at[root[at] != b]] = True
    out = np.flatnonzero(nodes != root)
    yield pa.RecordBatch.from_pydict({"a": nodes[out], "b": root[out], "moved": moved[out]})


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges(a, b); a = b edges and copies are harmless.

    An edge (child, parent) goes to the tasks of both its ends. Each task joins what it holds and returns stars:
    children of one node agree on the least parent, and a child meets its parent's parent, so chains halve. The
    rounds, each written, end when no task changed an edge. A node's edges meet in one task, 16 bytes each.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not e.isEmpty():
        sent = e.select("a", "b", F.explode(F.array("a", "b")).alias("_at")).repartition("_at")
        e = cut(sent.select("a", "b").mapInArrow(_stars, "a long, b long, moved boolean"))
        if e.where("moved").isEmpty():
            break
    found = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x"))
    return found.select("x.*").distinct()
