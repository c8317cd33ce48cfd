"""Connected components of an edge list: of a short one in one task, else by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import discard, materialise

#: Up to so many edges of whole numbers are put together by one task, which takes some 200 bytes each; more take rounds.
ONE_TASK = 250_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges (a, b), and the smallest that each of them reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        root[max(i, j)] = min(i, j)
    for i, up in enumerate(root):  # up <= i, and so settled
        root[i] = root[up]
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches; nodes are any ordered type.

    Edges are undirected; loops and repeats do no harm, null ends are dropped. Every step is a
    minimum by node, combined before the shuffle, and a join back, so a node with very many
    neighbours is split like any skewed join key. The edge list never grows, and each round ends in
    a table in the shared folder. An edge list of at most ONE_TASK rows takes one task and no rounds,
    whose plans cost the driver more than such a list. An empty edge list gives an empty result.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    kind = now.schema["a"].dataType
    if isinstance(kind, IntegralType) and now.count() <= ONE_TASK:

        def whole(batches):
            held = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches]
            if not held:
                return
            found = roots(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "root"])

        out = materialise(now.coalesce(1).mapInArrow(whole, f"node {kind.simpleString()}, root {kind.simpleString()}"), "cc")
        discard(now)
        return out
    before = None
    while True:  # the number of rounds grows with the logarithm of the longest path
        last, now = now, materialise(_small_star(_large_star(now)), "cc")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each neighbour above a node goes to the node's smallest neighbour, or the node itself; rows (a, b) with a > b."""
    low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    up = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    return up.join(low, "u", "left").select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each neighbour below a node, and the node, go to the smallest of them."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").where("a <> b").distinct()
