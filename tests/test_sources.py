import math

import pytest
from pyspark.sql import functions as F

from epsgroup.plans import similar
from epsgroup.sources import generator, sinks, text


def test_read_ignores_blanks_and_what_follows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1, 2.5, 1.0 ,2.0,\n2,0,3,4,5,6\n")
    rows = text.read_vectors(spark, str(tmp_path), 2).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, [1.0, 2.0]), (2, 0.0, [3.0, 4.0])]
    assert text.read_vectors(spark, str(tmp_path), 2, partitions=3).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("line", ["1,2,3\n", "1,2,3,x\n", "a,2,3,4\n"])
def test_bad_lines_fail(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(line)
    with pytest.raises(Exception):
        text.read_vectors(spark, str(tmp_path), 2).collect()


def test_round_trip(table, spark, tmp_path):
    df = table([[0.1, 1e-7], [1e10, -3.0]])
    text.write_vectors(df, str(tmp_path / "v"))
    assert sorted(text.read_vectors(spark, str(tmp_path / "v"), 2).collect()) == sorted(df.collect())


def test_sinks_do_not_overwrite(table, tmp_path, spark):
    groups = table([[1.0, 2.0]]).select("features", F.col("agg").alias("value"))
    sinks.write_text(sinks.group_lines(groups), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).head()[0] == "1.0,2.0\t1.0"
    with pytest.raises(Exception):
        sinks.write_text(sinks.group_lines(groups), str(tmp_path / "g"))
    for _ in range(2):
        sinks.append_summary(groups, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.write_table(groups, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_generator(spark):
    spec = spark.createDataFrame([(1, 300), (2, 250), (3, 0)], "sf int, points bigint")
    made = generator.generate(spec, 5, 4, 9, 1.5, seed=2)
    rows = made.collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 551))
    groups = {}
    for r in rows:
        groups.setdefault(r["agg"], []).append(tuple(r["features"]))
    assert sorted(groups) == [float(i) for i in range(len(groups))]
    sizes = sorted(len(g) for g in groups.values())
    assert sizes[-1] <= 8 and sum(s < 4 for s in sizes) <= 2
    for members in groups.values():
        assert all(math.dist(a, b) <= 1.5 for a in members for b in members)
    assert max(sum(v == w for w in g) for g in groups.values() for v in g) == 3
    assert sorted(made.repartition(7).collect()) == sorted(rows)
    found = similar.run(made, similar.Options(1.5, num_pivots=5, threshold=100))
    assert found.number().head()[0] == len(groups)


def test_generator_blocks(spark, monkeypatch):
    spec = spark.createDataFrame([(1, 300), (2, 250)], "sf int, points bigint")
    want = sorted(generator.generate(spec, 2, 4, 9, 1.5, seed=2).collect())
    monkeypatch.setattr(generator, "GROUPS_PER_BLOCK", 7)
    assert sorted(generator.generate(spec, 2, 4, 9, 1.5, seed=2).collect()) == want
    monkeypatch.setattr(generator, "POINTS_PER_CHUNK", 3)
    assert sorted(generator.generate(spec, 2, 4, 9, 1.5, seed=2).collect()) == want


def test_generator_plan(spark):
    spec = spark.createDataFrame([(1, 300), (2, 250)], "sf int, points bigint")
    plan = generator.generate(spec, 2, 4, 9, 1.5, seed=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
