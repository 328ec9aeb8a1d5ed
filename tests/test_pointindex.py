import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from epsgroup.functions import kernels
from epsgroup.functions.metrics import EUCLIDEAN, MANHATTAN, MAXIMUM
from epsgroup.functions.pointindex import LEAST, PointIndex
from epsgroup.operators import partition
from epsgroup.workspace import Workspace


def vectors(rng, rows, dimension, points):
    """Whole numbers, with ties, repeated points and rows that are points."""
    p = rng.integers(-3, 4, (points, dimension)).astype(float)
    p[points // 2] = p[0]
    return np.vstack([rng.integers(-4, 5, (rows, dimension)).astype(float), p[: points // 3]]), p


@pytest.mark.parametrize("metric", [EUCLIDEAN, MANHATTAN, MAXIMUM], ids=lambda m: m.name)
@pytest.mark.parametrize("dimension", [1, 2, 9, 40])
@pytest.mark.parametrize("points", [1, 2, LEAST - 1, LEAST, 300])
def test_index_finds_what_a_scan_finds(metric, dimension, points):
    x, p = vectors(np.random.default_rng(points), 200, dimension, points)
    index = pickle.loads(pickle.dumps(PointIndex(p, metric)))
    near, gap = index.nearest(x, metric)
    want, want_gap = metric.nearest(x, p)
    assert (near == want).all() and (gap == want_gap).all()
    if metric is EUCLIDEAN:
        near, gap = index.nearest(x, metric, squared=True)
        want, want_sq = kernels.nearest(x, p, squared=True)
        assert (near == want).all() and (gap == want_sq).all()
        near = want
    for form in ("euclidean", "metric"):
        for eps in (0.0, 0.5, 2.0):
            at, to = index.targets(x, near, want_gap, metric, eps, form)
            i, j = np.nonzero(metric.copies(x, p, near, want_gap, eps, form))
            assert (at == i).all() and (to == j).all()


def test_equal_points_and_rows_far_out():
    p = np.ones((200, 12))
    index = PointIndex(p, EUCLIDEAN)
    near, gap = index.nearest(np.vstack([p[:3], np.full((1, 12), 1e9)]), EUCLIDEAN)
    assert (near == 0).all() and (gap[:3] == 0).all()
    assert len(index.nearest(np.zeros((0, 12)), EUCLIDEAN)[0]) == 0


def heaps(rng, many, rows, dimension=32):
    middles = 100 * rng.random((many, dimension))
    return middles[rng.integers(0, many, rows)] + rng.random((rows, dimension))


def test_few_distances_are_counted_in_heaps():
    """With fewer heaps than groups, work a row grows with the root of the number of points, for the nearest one and the window."""
    rng = np.random.default_rng(1)
    counted = []
    for points in (400, 6400):
        data = heaps(rng, math.isqrt(points) // 2, points + 2000)
        index = PointIndex(data[:points], EUCLIDEAN)
        near, gap = index.nearest(data[points:], EUCLIDEAN)
        assert (near == EUCLIDEAN.nearest(data[points:], data[:points])[0]).all()
        index.targets(data[points:], near, gap, EUCLIDEAN, 0.1, "euclidean")
        counted.append(index.compared / 2000)
    assert counted[1] < 8 * counted[0]  # sixteen times the points
    assert counted[1] < 0.1 * 2 * 6400  # both scans


@pytest.mark.parametrize("window", [partition.EUCLIDEAN, partition.METRIC])
def test_tiles_give_the_targets_of_shared_pivots(spark, table, tmp_path, window):
    rng = np.random.default_rng(7)
    rows = table(heaps(rng, 20, 600, 10).tolist()).withColumn("path", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    points = {p: heaps(rng, 20, 150, 10) for p in "ab"}
    listed = [(p, i, v.tolist()) for p, own in points.items() for i, v in enumerate(own)]
    pivots = spark.createDataFrame(listed, "path string, pid int, features array<double>")
    shared = partition.split_shared(rows, points, 0.4, window)
    tiled = partition.split_tiled(rows, pivots, 0.4, window, Workspace(spark, str(tmp_path)), "split", 8 * 10 * 100)
    got, want = ({r["id"]: (r["near"], r["targets"]) for r in s.select("id", "near", "targets").collect()} for s in (tiled, shared))
    assert got == want and any(len(t) > 1 for _, t in want.values())
