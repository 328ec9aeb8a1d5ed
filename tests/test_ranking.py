import random

from pyspark.sql import functions as F

from epsgroup.operators.ranking import placed
from epsgroup.workspace import Workspace


def test_places(spark, tmp_path):
    """Places without gaps in the order of vectors and ids, nulls first, with a vector that repeats in most rows."""
    draw = random.Random(5)
    rows = [(i, [float(draw.randint(0, 2)), float(draw.randint(0, 9))] if i % 3 else [1.0, 4.0], "x") for i in range(2000)]
    rows += [(None, [1.0, 4.0], "x"), (7, None, "x"), (7, [], "x")]
    frame = spark.createDataFrame(rows, "id long, features array<double>, row string").repartition(5)
    got = placed(frame, [F.col("features"), F.col("id")], Workspace(spark, str(tmp_path)), "places").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or [], r[0] is not None, r[0] or 0))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(len(rows)))


def test_equal_rows_spread(spark, tmp_path):
    """A value in all rows is dealt to several ranges."""
    ws = Workspace(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed(spark.range(0, 5000, 1, 4).select(F.lit(1).alias("a")), [F.col("a")], ws, "places")
        assert got.agg(F.countDistinct("place"), F.max("place")).first()[:] == (5000, 4999)
        ranges = spark.read.parquet(f"{ws.path}/places").groupBy("range").count().collect()
        assert len(ranges) == 2 and max(r["count"] for r in ranges) < 3500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark, tmp_path):
    frame = spark.createDataFrame([], "a long")
    assert placed(frame, [F.col("a")], Workspace(spark, str(tmp_path)), "places").collect() == []
