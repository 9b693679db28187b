"""Connected components of edge tables, in shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geolith.tables import dropped, few, materialised

#: Edges that one task contracts; larger graphs shrink in shuffles.
FEW = 1 << 18


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of edges, and the least node it is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:  # paths halve until all point at a root
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return nodes, nodes[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        kind = t.schema.field("a").type
        node, root = least_members(t["a"].to_numpy(), t["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node, kind), pa.array(root, kind)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node of edges (a, b: of one type), as a table.

    Every round links a node's larger neighbours, and then its smaller ones, to
    the least of them; paths shrink to stars in few rounds. Each round is written
    as a table, so lineage stays short and a lost executor costs one round. A
    graph of at most FEW edges is contracted in one task.
    """
    edges = materialised(few(edges.select("a", "b").where("a <> b").distinct()))
    kind, before = edges.schema["a"].dataType.simpleString(), None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if now[0] <= FEW:
            out = materialised(edges.coalesce(1).mapInArrow(_contracted, f"node {kind}, root {kind}"))
            dropped(edges)
            return out
        if now == before:
            break
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialised(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"), F.col("m").alias("a"))
        shorter = materialised(small.where("a <> b").select("a", "b").distinct())
        dropped(edges, large)
        edges = shorter
    out = materialised(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct()))
    dropped(edges)
    return out
