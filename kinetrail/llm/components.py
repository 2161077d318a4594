"""Connected components: forests inside tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


#: Links that a task turns into a forest at a time.
GATHERED = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) that join the same nodes as links (a, b): at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])  # every root takes the smallest root that a link shows it
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        on = root[x] != root[y]
        x, y = x[on], y[on]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _gathered(batches):
        a, b = forest(*(part.column(c).to_numpy() for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _flat(edges: DataFrame) -> bool:
    """Whether each node has one edge, and it leads to a root: one exchange of counts per node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("k")), F.struct(F.col("v").alias("n"), F.lit(0).alias("k")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.k").alias("edges"), F.min("e.k").alias("root"))
    return nodes.where("edges > 1 OR edges = 1 AND root = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over links (a, b), for each id in a link.

    Tasks first replace the links that they read by forests, so that of links within a task at most one a node is
    exchanged. Each round then points every node at its smallest neighbour, first for larger, then
    for smaller neighbours; rounds are logarithmic in practice. Edges stay in tables;
    a hub's neighbours meet its minimum by a join that AQE can split. Loops, repeated
    links and null ids (ignored) are allowed; no links: no rows.
    """
    thin = links.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forests, "a long, b long")
    edges = saved(thin.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _flat(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(edges)
        edges = new
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("comp"))
    )
