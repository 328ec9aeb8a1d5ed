import numpy as np
import pytest
from pyspark.sql import functions as F

from epsgroup.functions import vectors
from epsgroup.operators import exact, sizes
from epsgroup.operators.nearest import nearest_point
from epsgroup.operators.sums import vector_sum
from epsgroup.plans import kmeans, similar
from epsgroup.workspace import Workspace


def values(groups):
    return {tuple(r["features"]): r["value"] for r in groups.collect()}


def test_choices(spark):
    rows = [(-5.0, [1.0, 2.0]), (-1.0, [1.0, 2.0]), (-3.0, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "agg double, features array<double>")
    a, b = (1.0, 2.0), (1.0, 3.0)
    want = {
        exact.AVERAGE: {a: -3.0, b: -3.0},
        exact.COUNT: {a: 2, b: 1},
        exact.MAXIMUM: {a: -1.0, b: -3.0},
        exact.MINIMUM: {a: -5.0, b: -3.0},
        exact.SUM: {a: -6.0, b: -3.0},
        77: {a: -3.0, b: -3.0},
    }
    for choice, result in want.items():
        for dimension in (None, 2):
            groups = exact.group_by_vector(df, choice, dimension)
            assert values(groups) == result
            assert exact.group_number(groups).head()[0] == 2


def test_signed_zeros_are_one_group(spark):
    df = spark.createDataFrame([(1.0, [0.0]), (2.0, [-0.0])], "agg double, features array<double>")
    assert exact.group_by_vector(df, exact.SUM).count() == 1
    assert exact.group_by_vector(df, exact.SUM, 1).count() == 1


def test_aggregates_fold_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("double(id) agg", "array(1.0D, 2.0D) features")
    plan = exact.group_by_vector(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("dimension", [2, 33])
def test_vectors_of_another_length_fail(table, tmp_path, dimension, monkeypatch):
    """Longer and shorter vectors fail in every form, whatever the size."""
    right = [[float(i + j) for j in range(dimension)] for i in range(6)]
    for wrong in (right[0] + [1.0], right[0][:-1]):
        rows = table([*right, wrong])
        points = [right[0], right[3]]
        jobs = [
            lambda: exact.group_by_vector(rows, exact.SUM, dimension).collect(),
            lambda: vector_sum(rows, [], dimension).collect(),
            lambda: nearest_point(rows, points).collect(),
            lambda: kmeans.update(rows, points).collect(),
            lambda: similar.run(rows, similar.Options(1.0, num_pivots=2)).members.collect(),
            lambda: rows.select(vectors.distance_sq(F.col("features"), vectors.vector(*map(F.lit, right[0])))).collect(),
            lambda: rows.select(vectors.add(F.col("features"), vectors.vector(*map(F.lit, right[0])))).collect(),
        ]
        for job in jobs:
            with pytest.raises(Exception, match="coordinates|length|INVALID_ARRAY_INDEX|USER_RAISED"):
                job()


def test_the_key_is_the_whole_vector(table):
    rows = table([[1.0, 2.0, 3.0], [1.0, 2.0, 9.0], [1.0, 2.0, 9.0]])
    for dimension in (None, 3):
        assert sorted(tuple(r) for r in exact.group_by_vector(rows, exact.COUNT, dimension).select("value").collect()) == [(1,), (2,)]


def test_count_counts_null_measures(spark):
    rows = spark.createDataFrame([(1, None, [1.0]), (2, 3.0, [1.0])], "id long, agg double, features array<double>")
    assert exact.group_by_vector(rows, exact.COUNT).first()["value"] == 2


def test_points_beyond_one_broadcast_go_in_tiles(table, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    rows, points = table(rng.random((200, 12)).tolist()), rng.random((30, 12)).round(1)
    whole = sorted(nearest_point(rows, points).select("id", "near", "near_distance").collect())
    moved = sorted(kmeans.update(rows, points).collect())
    monkeypatch.setattr(sizes, "POINT_BYTES", 12 * 8 * 7)
    ws = Workspace(rows.sparkSession, str(tmp_path))
    assert sorted(nearest_point(rows, points, workspace=ws).select("id", "near", "near_distance").collect()) == whole
    again = sorted(kmeans.update(rows, points, ws).collect())
    assert [r["n"] for r in again] == [r["n"] for r in moved]
    assert np.allclose([r["center"] for r in again], [r["center"] for r in moved])
