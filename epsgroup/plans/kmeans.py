"""K-means by Lloyd's iterations, stopped by the change of the cost."""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.functions import kernels, metrics
from epsgroup.functions.pointindex import PointIndex
from epsgroup.operators import sampling
from epsgroup.operators.nearest import UNROLLED_TERMS, nearest_point
from epsgroup.operators.sizes import points_fit
from epsgroup.operators.sums import vector_sum
from epsgroup.ship import ship
from epsgroup.workspace import Workspace


@dataclass
class Clusters:
    """`centers` has (cid, center, n, cost) after the last update; n and cost are those of the assignment before it.
    `history`, if asked for, has the same for every iteration, with the initial centres as iteration 0."""

    centers: DataFrame
    cost: float
    iterations: int
    converged: bool
    history: DataFrame | None


def _center_table(spark, state) -> DataFrame:
    """Centres held by the driver, k at most, as a table."""
    columns = list(zip(*state)) or [[], [], [], []]
    types = [pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64()]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, ["cid", "center", "n", "cost"]))


def initial_centers(rows: DataFrame, k: int, seed: int, frequency: float | None = None) -> list:
    """k vectors of the table (all if there are fewer), without replacement; with a frequency, drawn from rows that
    pass with that probability."""
    if frequency is None:
        drawn = sampling.sample_rows(rows, k, seed)
    else:
        drawn = sampling.sample_bernoulli(rows, frequency, k, seed)
    return [r[0] for r in drawn.select("features", "draw", "id").orderBy("draw", "id").select("features").collect()]


def update(rows: DataFrame, centers: list, workspace: Workspace | None = None) -> DataFrame:
    """One iteration: (cid, center, n, cost). A centre without rows is dropped. One scan and one shuffle of at most k
    rows per task. Centres beyond POINT_BYTES are compared tile by tile (see `nearest_point`)."""
    points = np.asarray(centers, dtype=float)
    k, dimension = points.shape
    if points.size <= UNROLLED_TERMS or not points_fit(k, dimension):
        near = nearest_point(rows.select("features"), points, workspace=workspace).withColumnRenamed("near", "cid")
        sums = vector_sum(near, ["cid"], dimension, extra=[F.sum("near_distance").alias("cost")])
    else:
        parts = _partial_sums(rows.select("features"), points)
        totals = [F.sum(F.col("sums")[i]).alias(f"sum_{i}") for i in range(dimension)]
        sums = parts.groupBy("cid").agg(*totals, F.sum("n").alias("n"), F.sum("cost").alias("cost"))
        sums = sums.withColumn("sums", F.array(*[f"sum_{i}" for i in range(dimension)]))
    center = F.array(*[F.col("sums")[i] / F.col("n") for i in range(dimension)])
    return sums.select("cid", center.alias("center"), F.col("n").cast("bigint").alias("n"), "cost")


def _partial_sums(rows, points):
    """Sums, counts and costs per centre, folded in every task. An index of the centres saves most distances."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(PointIndex(points, metrics.EUCLIDEAN))
    (k, dimension), metric = points.shape, metrics.EUCLIDEAN

    def fold(batches):
        sums, n, cost = np.zeros((k, dimension)), np.zeros(k, dtype=np.int64), np.zeros(k)
        for batch in batches:
            x = kernels.vectors_of(batch.column("features"), dimension)
            near, gap = shared.value.nearest(x, metric, squared=True)
            n += np.bincount(near, minlength=k)
            cost += np.bincount(near, weights=gap, minlength=k)
            for j in range(dimension):
                sums[:, j] += np.bincount(near, weights=x[:, j], minlength=k)
        used = np.flatnonzero(n)
        offsets = pa.array(np.arange(len(used) + 1) * dimension, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(sums[used].ravel())),
                pa.array(n[used]),
                pa.array(cost[used]),
            ],
            names=["cid", "sums", "n", "cost"],
        )

    return rows.mapInArrow(fold, "cid int, sums array<double>, n bigint, cost double")


def _written(ws: Workspace) -> list[list[tuple]]:
    """The states of the iterations in a workspace, as lists of (cid, center, n, cost)."""
    steps = ws.written_steps("centers")
    if not steps:
        return []
    rows = ws.steps("centers", _center_table(ws.spark, []).schema).where(F.col("step") <= steps[-1]).collect()
    states = [[] for _ in steps]
    for r in sorted(rows, key=lambda r: (r["step"], r["cid"])):
        states[r["step"]].append((r["cid"], list(r["center"]), r["n"], r["cost"]))
    return states


def fit(
    rows: DataFrame,
    k: int,
    max_iterations: int = 20,
    error: float = 1e-4,
    seed: int = 0,
    frequency: float | None = None,
    keep_history: bool = False,
    workspace: Workspace | None = None,
    resume: bool = False,
) -> Clusters:
    """Iterate until the cost changes by less than `error`, at most max_iterations times. Needs (id, features).

    The cost of an iteration is measured against the centres before its update. Every update is one job; the centres,
    k at most, are all that passes through the driver.

    With `keep_history`, the centres of every iteration are written to the workspace. `resume` goes on from the last one that a run
    with the same parameters wrote there to its end, and comes to the same result as a run that was never stopped.
    """
    spark = rows.sparkSession
    keep_history = keep_history or resume
    if resume and workspace is None:
        raise ValueError("a run is resumed from the workspace of the run before")
    features = rows.select("id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    ws = (workspace or Workspace(spark)) if keep_history else None
    before = _written(ws) if resume else []
    centers = [row[1] for row in before[0]] if before else initial_centers(features, k, seed, frequency)
    if not centers:
        features.unpersist()
        return Clusters(_center_table(spark, []), 0.0, 0, False, None)
    state = [(cid, center, None, None) for cid, center in enumerate(centers)]
    if ws and not before:
        ws.save_step(_center_table(spark, state), "centers", 0)
    previous, cost, iteration, converged = sys.float_info.max, 0.0, 0, False
    for state in before[1 : max_iterations + 1]:
        cost = sum(row[3] for row in state)
        converged = abs(previous - cost) < error
        previous = cost
        iteration += 1
    while iteration < max_iterations and not converged:
        updated = sorted(update(features, [row[1] for row in state], workspace).collect())
        state = [(cid, list(row["center"]), row["n"], row["cost"]) for cid, row in enumerate(updated)]
        cost = sum(row["cost"] for row in updated)
        converged = abs(previous - cost) < error
        previous = cost
        iteration += 1
        if ws:
            ws.save_step(_center_table(spark, state), "centers", iteration)
    features.unpersist()
    final = _center_table(spark, state)
    history = ws.steps("centers", final.schema).withColumnRenamed("step", "iteration") if ws else None
    return Clusters(final, cost, iteration, converged, history)
