"""Connected components of a table of links, by alternating stars."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.ship import ship
from epsgroup.workspace import Workspace


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the nodes of these links that are not the smallest themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        next_ = root.copy()
        np.minimum.at(next_, root[a], low)
        np.minimum.at(next_, root[b], low)
        next_ = next_[next_]
        if np.array_equal(next_, root):
            break
        root = next_
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _forests(batches):
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and on none that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    ends = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def components(links: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node of `links` (a, b: long); the component is named by its smallest node.

    Every batch of links is first cut down to a forest. Then each node's neighbours are tied to the smallest of them, in
    turn the larger and the smaller ones, until all components are stars; nodes with many neighbours are met by partial
    minima and by joins Spark can split.
    """
    ship(links.sparkSession)
    clean = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = ws.save(clean.mapInArrow(_forests, "a long, b long").distinct(), f"{name}-0")
    step = 0
    while not _are_stars(edges):
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ws.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), f"{name}-{step}-low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = ws.save(large.where("a <> b").distinct(), f"{name}-{step}-large")
        low = ws.save(large.groupBy("a").agg(F.min("b").alias("low")), f"{name}-{step}-small")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = ws.save(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), f"{name}-{step}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
