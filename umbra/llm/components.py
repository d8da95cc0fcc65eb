"""Connected components over an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import intermediates, stage_table


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0..n-1 over the edges a-b: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node that isn't the smallest; same components as a-b."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(where[: len(a)], where[len(a) :], len(nodes))
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _contract(batches):
    """Replace the edges of a task, a bounded buffer at a time, by a spanning forest."""
    held, size = [], 0

    def emit():
        a = np.concatenate([np.asarray(x.column("a"), np.int64) for x in held])
        b = np.concatenate([np.asarray(x.column("b"), np.int64) for x in held])
        node, root = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 2_000_000:
            yield emit()
            held, size = [], 0
    if held:
        yield emit()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the smallest node of its component.

    Alternating large-star and small-star rounds, each a min-aggregate and a join on the node, so a hub is
    partially aggregated before it is shuffled; tasks contract their own edges first. Each round is written
    to the shared folder. Self-loops are dropped, repeated edges don't matter, no edges give no rows.
    """
    spark = edges.sparkSession
    with intermediates(spark):
        return stage_table(_stars(edges, max_rounds), "components", keep=True)


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    e = stage_table(edges.filter("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"), "edges")
    count = e.count()
    for k in range(max_rounds):
        if count == 0:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # large-star: every larger neighbour points to the smallest; small-star: so do the smaller ones
        large = large.filter("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        e2 = stage_table(small, f"edges-{k}")
        # done when the edges are stars: each node has one edge, and no root has one of its own
        stats = e2.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes")).first()
        chained = e2.select("a").intersect(e2.select("b")).limit(1).count()
        e, count = e2, stats["n"]
        if stats["n"] == stats["nodes"] and not chained:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
