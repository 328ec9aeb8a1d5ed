"""Nearest point of a small set, for every row."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgroup.functions import kernels, metrics
from epsgroup.functions.pointindex import PointIndex
from epsgroup.functions.vectors import checked
from epsgroup.operators import sizes
from epsgroup.operators.sizes import points_fit
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

NEAR = T.StructType().add("near", T.IntegerType()).add("near_distance", T.DoubleType())
UNROLLED_TERMS = 64


def unrolled_sq(vector: Column, point) -> Column:
    """Squared distance to one fixed point without array functions, so that it compiles into the stage."""
    total = F.lit(0.0)
    for i, value in enumerate(point):
        gap = vector[i] - F.lit(float(value))
        total = total + gap * gap
    return total


def nearest_point(rows: DataFrame, points, squared: bool = True, workspace: Workspace | None = None) -> DataFrame:
    """Adds `near` (index of the nearest point, the lowest index on ties) and `near_distance`. No shuffle.

    `points` is a list of vectors held by the driver. Few short points compile into the stage; more run as numpy blocks
    on Arrow batches, which an index keeps from points too far away; beyond POINT_BYTES they go to the tasks tile by tile, and the nearest so far is written between.
    All count alike, and all fail on a vector of another length.
    """
    points = np.asarray(points, dtype=float)
    if not len(points):
        raise ValueError("no points")
    if not points_fit(*points.shape):
        return _nearest_by_tiles(rows, points, squared, workspace or Workspace(rows.sparkSession))
    if points.size <= UNROLLED_TERMS:
        rows = rows.withColumn("features", checked(F.col("features"), points.shape[1]))
        gaps = [unrolled_sq(F.col("features"), p) for p in points]
        gaps = F.array(*(gaps if squared else [F.sqrt(g) for g in gaps]))
        ranked = rows.withColumn("gaps", gaps).withColumn("near_distance", F.array_min("gaps"))
        near = (F.array_position("gaps", F.col("near_distance")) - 1).cast("int")
        return ranked.withColumn("near", near).select(*rows.columns, "near", "near_distance")

    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(PointIndex(points, metrics.EUCLIDEAN))
    metric, dimension = metrics.EUCLIDEAN, points.shape[1]

    def find(batches):
        for batch in batches:
            x = kernels.vectors_of(batch.column("features"), dimension)
            near, gap = shared.value.nearest(x, metric, squared)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32()), pa.array(gap)],
                names=[*batch.schema.names, "near", "near_distance"],
            )

    schema = T.StructType([*rows.schema.fields, *NEAR.fields])
    return rows.mapInArrow(find, schema)


def _nearest_by_tiles(rows, points, squared, ws):
    """Points too many for one broadcast: a tile at a time, keeping the nearest so far."""
    step = max(1, sizes.POINT_BYTES // (8 * points.shape[1]))
    found = None
    for start in range(0, len(points), step):
        tile = nearest_point(rows if found is None else found, points[start : start + step], squared)
        if found is not None:
            closer = F.col("near_distance") < F.col("best_distance")
            tile = tile.withColumns({
                "near": F.when(closer, F.col("near") + start).otherwise(F.col("best")),
                "near_distance": F.least("near_distance", "best_distance"),
            }).drop("best", "best_distance")
        name = f"nearest-{start}-{len(points)}"
        found = ws.save(tile, name).withColumnsRenamed({"near": "best", "near_distance": "best_distance"})
    return found.withColumnsRenamed({"best": "near", "best_distance": "near_distance"})
