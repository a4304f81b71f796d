"""Distributed connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of the undirected graph with the given edges (long ids).

    Returns ``node, component`` for every node of an edge between two different nodes; ``component`` is its smallest
    node. Loops, repeated edges and edges with a null end add nothing; without edges the result is empty.

    Each round hooks every node to its smallest neighbour, jumps along those pointers twice, and replaces the ends of
    the edges by what they point to, until no edge is left. All steps are joins and map-side combined aggregates, so
    a node with very many neighbours is no task's burden. Every round's tables are written to the shared folder.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    edges = saved(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b and a is not null and b is not null").distinct(), "edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        hook = saved(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), "hook")
        for _ in range(2):
            on = hook.select(F.col("n").alias("p"), F.col("p").alias("q"))
            hook = hook.join(on, "p").select("n", F.col("q").alias("p"))
        hook = saved(hook, "jump")
        if labels is None:
            labels = hook.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            now = hook.select(F.col("n").alias("component"), "p")
            labels = saved(labels.join(now, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        edges = saved(
            edges.join(hook.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a")
            .join(hook.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels


def star_edges(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The components of a task's own small graph over 0..n-1, as (node, smallest node) rows: at most n - 1 edges that
    connect what the given ones do."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, label, new)  # a root follows the least of its members
        new = new[new]
        if np.array_equal(new, label):
            own = np.flatnonzero(label != np.arange(n))
            return np.stack([own, label[own]], axis=1)
        label = new
