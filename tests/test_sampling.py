from pyspark.sql import functions as F

from epsgroup.operators import sampling
from tests import twin


def test_sample_is_the_lowest_draws_however_the_rows_lie(spark):
    df = spark.range(5000).withColumn("features", F.array(F.col("id").cast("double")))
    want = sorted(range(5000), key=lambda i: twin.draw(4, i))[:20]
    for rows in (df, df.repartition(7)):
        assert [r["id"] for r in sampling.sample_rows(rows, 20, 4).orderBy("draw").collect()] == want
    assert sampling.sample_rows(df, 6000, 4).count() == 5000
    assert sampling.sample_rows(df.limit(0), 3, 4).count() == 0
    # A wrong total only widens the cut.
    assert [r["id"] for r in sampling.sample_rows(df, 20, 4, total=10**9).orderBy("draw").collect()] == want


def test_bernoulli(spark):
    df = spark.range(3000).withColumn("features", F.array(F.col("id").cast("double")))
    kept = [i for i in range(3000) if twin.draw(1, i) / 2**60 < 0.1]
    want = sorted(kept, key=lambda i: twin.draw(1, i))[:50]
    assert {r["id"] for r in sampling.sample_bernoulli(df, 0.1, 50, 1).collect()} == set(want)


def test_pivots_are_distinct_and_per_partition(table):
    rows = table([[i % 7, 0] for i in range(200)])
    vectors = sampling.distinct_vectors(rows, 0).withColumn("path", F.lit("a"))
    other = vectors.withColumn("path", F.lit("b")).where("id <= 3")
    found = sampling.sample_pivots(vectors.unionByName(other), 5).collect()
    a = [r for r in found if r["path"] == "a"]
    draws = {v: min(twin.draw(0, i + 1) for i in range(200) if i % 7 == v) for v in range(7)}
    want = sorted(draws, key=draws.get)[:5]
    assert [r["features"][0] for r in sorted(a, key=lambda r: r["pid"])] == want
    assert sorted(r["pid"] for r in found if r["path"] == "b") == [0, 1, 2]


def test_pivot_number(spark):
    assert [sampling.pivot_number(n, 0.1) for n in (1, 10, 29)] == [1, 1, 2]
    got = spark.range(1).select(sampling.pivot_number(F.lit(29), 0.1), sampling.pivot_number(F.lit(2), 0.1)).head()
    assert tuple(got) == (2, 1)


def test_pivots_below_the_cut_are_the_lowest(table):
    vectors = sampling.distinct_vectors(table([[i, 0] for i in range(5000)]), 0).withColumn("path", F.lit(""))
    low = vectors.where(F.col("draw") < sampling.draw_cut(F.lit(5), F.lit(5000)))
    assert low.count() < 200
    want = sorted(range(5000), key=lambda i: twin.draw(0, i + 1))[:5]
    found = sampling.sample_pivots(low, 5).orderBy("pid").collect()
    assert [r["features"][0] for r in found] == want
