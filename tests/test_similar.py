import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from epsgroup.operators import partition, sampling
from epsgroup.plans import report, similar
from epsgroup.workspace import Workspace
from tests import twin

MANY = 1 << 40


def found(groups):
    """{(path, group id): ids of the original rows}"""
    result = {}
    for r in groups.original_rows().collect():
        result.setdefault((r["path"], r["group_id"]), []).append(r["id"])
    return {key: sorted(ids) for key, ids in result.items()}


def uniform(n, seed, grid=None, dimension=2):
    rng = random.Random(seed)
    return [
        tuple(rng.randrange(grid) / grid if grid else rng.random() for _ in range(dimension)) for _ in range(n)
    ]


def compare(table, vectors, options):
    groups = similar.run(table(vectors), options)
    assert found(groups) == twin.similar(list(enumerate(vectors, 1)), options)
    return groups


@pytest.mark.parametrize(
    "options",
    [
        dict(eps=0.1, num_pivots=1, threshold=MANY),
        dict(eps=0.1, num_pivots=6, threshold=MANY),
        dict(eps=0.05, num_pivots=5, threshold=90),
        dict(eps=0.05, num_pivots=4, threshold=90, pivot_ratio=0.05),
        dict(eps=0.05, num_pivots=5, threshold=150, window="metric"),
        dict(eps=0.05, num_pivots=3, threshold=60, max_rounds=2, local_rows=40, block_rows=40),
    ],
)
def test_like_plain_python(table, options):
    vectors = uniform(400, 1)
    groups = compare(table, vectors, similar.Options(**options))
    shown = [i for ids in found(groups).values() for i in ids]
    counts = groups.lost_and_doubled().head()
    assert counts["lost_rows"] == 400 - len(set(shown))
    assert counts["doubled_rows"] == len(shown) - len(set(shown))


def test_repeated_vectors(table):
    vectors = uniform(500, 2, grid=12)
    compare(table, vectors, similar.Options(0.2, num_pivots=5, threshold=150))


@pytest.mark.parametrize("dimension,eps", [(2, 0.05), (2, 0.3), (10, 0.9), (2, 3.0)])
def test_partitions_too_large_for_one_task(table, dimension, eps):
    vectors = uniform(220, 3, dimension=dimension)
    options = similar.Options(eps, num_pivots=1, threshold=MANY, local_rows=70, block_rows=70)
    compare(table, vectors, options)


def test_large_partitions_take_their_steps_together(table):
    vectors = uniform(200, 4)
    compare(table, vectors, similar.Options(0.1, num_pivots=2, threshold=MANY, local_rows=70, block_rows=70))


def test_tight_group_is_settled_after_one_block(table, spark):
    vectors = [(x * 0.3, y * 0.3) for x, y in uniform(400, 5)] + [(9.0, 9.0)]
    groups = similar.run(table(vectors), similar.Options(1.0, num_pivots=1, threshold=MANY, local_rows=50, block_rows=40))
    assert sorted(len(ids) for ids in found(groups).values()) == [1, 400]
    steps = spark.read.parquet(f"{groups.workspace.path}/large-labelled").groupBy("step").count().collect()
    assert sorted(r["count"] for r in steps if r["count"]) == [40, 361] or len(steps) <= 3


def test_equal_rows_above_the_threshold_stop(table):
    groups = similar.run(table([(1.0, 1.0)] * 300), similar.Options(0.5, num_pivots=8, threshold=50))
    assert found(groups) == {("", 1): list(range(1, 301))}
    assert (groups.cancelled, groups.above_threshold) == (1, 1)


def test_a_third_of_the_rows_are_copies(table):
    vectors = [(0.5, 0.5)] * 150 + uniform(300, 6)
    random.Random(0).shuffle(vectors)
    compare(table, vectors, similar.Options(0.06, num_pivots=6, threshold=170))


def test_pivots_crowded_into_one_spot(table):
    """A third of the rows lie in one spot: pivots apart from each other still split the rest."""
    crowd = [(5.0 + x * 0.05, 5.0 + y * 0.05) for x, y in uniform(130, 11)]
    vectors = crowd + [(10 * x, 10 * y) for x, y in uniform(270, 12)]
    random.Random(1).shuffle(vectors)
    options = similar.Options(0.2, num_pivots=20, threshold=100, max_growth=1.8)
    groups = compare(table, vectors, options)
    assert groups.members.where("path = ''").isEmpty()
    assert not groups.workspace.spark.read.parquet(f"{groups.workspace.path}/split-1-apart").isEmpty()


def test_small_tables(table, spark):
    empty = table([(0.0, 0.0)]).limit(0)
    groups = similar.run(empty, similar.Options(1.0))
    assert groups.number().head()[0] == 0 and groups.original_rows().count() == 0
    assert found(similar.run(table([(5.0,)]), similar.Options(1.0))) == {("0", 1): [1]}
    compare(table, [(float(x),) for x in (0, 1, 2, 3, 10)], similar.Options(1.0, num_pivots=2, threshold=MANY))


def test_properties(table):
    vectors = uniform(250, 7)
    options = similar.Options(0.15, num_pivots=4, threshold=120)
    groups = similar.run(table(vectors), options)
    members = found(groups)
    for ids in members.values():
        for a, b in itertools.combinations(ids, 2):
            assert twin.distance(vectors[a - 1], vectors[b - 1]) <= 0.15
    assert found(similar.run(table(vectors).repartition(9), options)) == members
    assert groups.number().head()[0] == len(members)
    for r in groups.centroids().collect():
        ids = members[r["path"], r["group_id"]]
        assert r["n"] == len(ids)
        for j in range(2):
            assert r["center"][j] == pytest.approx(sum(vectors[i - 1][j] for i in ids) / len(ids))


def test_zero_eps_is_the_exact_group_by(table):
    vectors = uniform(300, 8, grid=6)
    groups = similar.run(table(vectors), similar.Options(0.0, num_pivots=5, threshold=MANY))
    want = {}
    for i, v in enumerate(vectors, 1):
        want.setdefault(v, []).append(i)
    assert sorted(found(groups).values()) == sorted(want.values())


def test_outputs_and_summary(table):
    df = table([(0.0, 0.0), (0.1, 0.0), (5.0, 5.0)])
    assert similar.sim_group_by(df, 0.5).count() == 2
    assert similar.sim_group_by(df, 0.5, output="members").count() == 3
    groups = similar.run(df, similar.Options(0.5, num_pivots=2))
    row = report.similar_summary(groups, 5).head()
    assert (row["groups"], row["lost_rows"], row["doubled_rows"], row["dimension"]) == (2, 0, 0, 2)
    assert (row["eps"], row["elapsed_ns"]) == (0.5, 5)
    groups.workspace.discard()


def test_both_forms_of_the_split_agree(table, tmp_path):
    vectors = sampling.distinct_vectors(table(uniform(300, 9, grid=9)), 0)
    vectors = vectors.withColumn("path", F.when(F.col("id") % 2 == 0, "0").otherwise("1"))
    vectors = vectors.withColumn("base", F.array(F.lit(0)))
    pivots = sampling.sample_pivots(vectors, 6)
    for window in ("euclidean", "metric"):
        shared = partition.split_shared(vectors, partition.collect_pivots(pivots), 0.1, window)
        for tile_bytes in (1 << 20, 40):
            ws = Workspace(vectors.sparkSession, str(tmp_path))
            tiled = partition.split_tiled(vectors, pivots, 0.1, window, ws, "t", tile_bytes)
            assert sorted(tiled.collect()) == sorted(shared.select(tiled.columns).collect())
            assert "Join" not in tiled._jdf.queryExecution().executedPlan().toString()


def test_pivots_too_large_to_send_go_in_tiles(table, monkeypatch):
    monkeypatch.setattr(similar, "points_fit", lambda *_: False)
    vectors = uniform(200, 10)
    monkeypatch.setattr(similar, "POINT_BYTES", 32)
    compare(table, vectors, similar.Options(0.05, num_pivots=4, threshold=80, local_rows=80, block_rows=40))


@pytest.mark.parametrize("local_rows", [50_000, 7])
def test_vectors_that_share_an_id(table, local_rows):
    """Different vectors with one id are different rows, in one task and block by block."""
    vectors = uniform(40, 12)
    ids = [i // 4 for i in range(40)]
    options = similar.Options(0.3, num_pivots=1, local_rows=local_rows, block_rows=local_rows)
    got = similar.run(table(vectors, [i + 1 for i in ids]), options).members.collect()
    order = sorted(range(40), key=lambda i: (ids[i], list(vectors[i])))
    plain = similar.run(table([vectors[i] for i in order]), options).members.collect()
    groups = [sorted(sorted(tuple(r["features"]) for r in rows if r["group_id"] == g) for g in {r["group_id"] for r in rows}) for rows in (got, plain)]
    assert groups[0] == groups[1]
    assert sorted(r["id"] for r in got) == sorted(i + 1 for i in ids)
    far = similar.run(table([[0.0], [100.0]], [1, 1]), similar.Options(1.0, num_pivots=1)).members
    assert far.select("group_id").distinct().count() == 2


@pytest.mark.parametrize("share_rows", [1 << 18, 50])
def test_members_of_a_vector_in_a_third_of_the_rows(table, monkeypatch, share_rows):
    """Its rows are dealt to as many shares as their counted number needs; every row appears once."""
    monkeypatch.setattr(similar, "SHARE_ROWS", share_rows)
    vectors = [(5.0, 5.0)] * 330 + [(float(i % 40), 9.0) for i in range(670)]
    groups = similar.run(table(vectors), similar.Options(0.5, num_pivots=1))
    got = found(groups)
    assert sorted(i for ids in got.values() for i in ids) == list(range(1, 1001))
    assert got["0", 1] == list(range(1, 331)) and len(got) == 41


def heaps(n, seed):
    return [(10.0 * (i % 6), y) for i, (y, _) in enumerate(uniform(n, seed))]


def test_crowded_heaps_are_not_copied_to_every_pivot(table, spark, monkeypatch):
    """A ratio gives each heap many pivots, and every row of the heap would be copied to all of them."""
    monkeypatch.setattr(similar, "CROWD", 8)
    groups = similar.run(table(heaps(600, 7)), similar.Options(2.0, num_pivots=2, threshold=150, pivot_ratio=0.2))
    assert sorted(len(ids) for ids in found(groups).values()) == [100] * 6
    assert groups.lost_and_doubled().head()[:] == (0, 0)
    for name in (f"split-{r}{kind}" for r in range(2, groups.rounds + 1) for kind in ("", "-crowds")):
        try:
            split = spark.read.parquet(f"{groups.workspace.path}/{name}")
        except Exception:
            continue
        assert split.agg(F.max(F.size("targets"))).head()[0] <= 2


@pytest.mark.parametrize("vectors,threshold", [(uniform(300, 8), 90), (uniform(300, 9, grid=12), 60)])
def test_crowds_give_what_the_split_by_all_pivots_gives(table, monkeypatch, vectors, threshold):
    monkeypatch.setattr(similar, "CROWD", 4)
    compare(table, vectors, similar.Options(0.2, num_pivots=3, threshold=threshold, pivot_ratio=0.2))


def test_a_spot_that_no_pivots_separate_is_given_up_early(table, spark, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", 8)
    vectors = heaps(240, 11) + [(60.0, y / 4) for y, _ in uniform(300, 12)]
    groups = similar.run(table(vectors), similar.Options(2.0, num_pivots=2, threshold=150, pivot_ratio=0.2))
    assert sorted(len(ids) for ids in found(groups).values()) == [40] * 6 + [300]
    assert groups.cancelled >= 1


@pytest.mark.parametrize("metric", [partition.metrics.EUCLIDEAN, partition.metrics.MANHATTAN])
def test_least_copies_are_no_more_than_the_copies(table, spark, metric):
    window = partition.EUCLIDEAN if metric is partition.metrics.EUCLIDEAN else partition.METRIC
    vectors = sampling.distinct_vectors(table(uniform(500, 13)), 0).withColumns({"path": F.lit("a"), "base": F.array().cast("array<int>")})
    pivots = sampling.sample_pivots(vectors, 80).localCheckpoint()
    every = partition.split_shared(vectors, partition.collect_pivots(pivots), 0.15, window, metric)
    few = partition.crowds(pivots, 0.15, 0.3, 8, metric)
    least = partition.split_shared(vectors, partition.collect_pivots(few), 0.15, window, metric, partition.collect_pivots(few, "around"))
    both = every.select("id", F.size("targets").alias("n")).join(least.select("id", "least"), "id").collect()
    assert len(both) == 500 and all(r["least"] <= r["n"] for r in both) and sum(r["least"] for r in both) > 500
    assert partition.crowds(pivots, 0.15, 0.3, 80, metric).isEmpty()


def test_pivots_far_apart_take_little_memory():
    import tracemalloc

    import numpy as np

    x = np.random.default_rng(14).random((6000, 2))
    tracemalloc.start()
    kept = partition.far_apart(x, 0.1)
    assert tracemalloc.get_traced_memory()[1] < 4e6  # all pairs at once take 36 MB as booleans alone
    tracemalloc.stop()
    close = np.hypot(*(x[:2000, None] - x[None, :2000]).transpose(2, 0, 1)) <= 0.1
    plain = []
    for i in range(2000):
        if not close[i, plain].any():
            plain.append(i)
    assert [i for i in kept if i < 2000] == plain


def test_rows_are_placed_in_pieces(table, monkeypatch):
    """Rows that are sent to every pivot: a batch never holds more targets than the bound."""
    import pyarrow as pa

    batch = pa.record_batch({"n": list(range(1000))})
    pieces = [*partition._pieces([batch], partition.TARGETS // 300)]
    assert max(map(len, pieces)) <= 300 and pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
    vectors = sampling.distinct_vectors(table(uniform(300, 15)), 0).withColumns({"path": F.lit(""), "base": F.array().cast("array<int>")})
    pivots = sampling.sample_pivots(vectors, 40)
    points = partition.collect_pivots(pivots)
    whole = partition.split_shared(vectors, points, 0.5).select("id", "near", "targets").orderBy("id").collect()
    monkeypatch.setattr(partition, "TARGETS", 280)
    assert [len(p) for p in partition._pieces([batch], 40)][0] == 7
    assert partition.split_shared(vectors, points, 0.5).select("id", "near", "targets").orderBy("id").collect() == whole


def stacked(n, seed):
    """Heaps 10 apart, each several times as dense as the one before."""
    return [(10.0 * min(int(-math.log2(1 - z) * 2), 7), y) for z, y in uniform(n, seed)]


@pytest.mark.parametrize(
    "vectors,options",
    [
        (stacked(500, 16), dict(eps=2.0, num_pivots=5, threshold=80, window="metric")),
        (stacked(500, 17), dict(eps=2.0, num_pivots=6, threshold=80, local_rows=60, block_rows=60)),
        (stacked(500, 18), dict(eps=2.0, num_pivots=5, threshold=60, max_rounds=2)),
        ([*stacked(300, 19), *((x / 2, 3 * y) for x, y in uniform(200, 19))], dict(eps=0.4, num_pivots=7, threshold=60)),
    ],
)
def test_twins_give_what_the_children_give_one_by_one(table, monkeypatch, vectors, options):
    """Children with the same rows go on as one: paths, groups and counted splits are those of all of them."""
    groups = compare(table, vectors, similar.Options(**options))
    monkeypatch.setattr(partition, "TWINS", 1)
    plain = similar.run(table(vectors), similar.Options(**options))
    assert found(groups) == found(plain)
    assert (groups.rounds, groups.cancelled, groups.above_threshold) == (plain.rounds, plain.cancelled, plain.above_threshold)


def test_rows_of_heaps_are_not_copied_round_by_round(table, spark):
    """Pivots of one heap send every row to the children of all of them; a next round would read each row as many times."""
    groups = similar.run(table(heaps(300, 20)), similar.Options(2.0, num_pivots=5, threshold=60, window="metric"))
    assert sorted(len(ids) for ids in found(groups).values()) == [50] * 6 and groups.rounds == 3
    for r in (2, 3):
        assert spark.read.parquet(f"{groups.workspace.path}/split-{r}").count() <= 300


def test_twins_are_found_by_their_rows(spark):
    rows = [("a", i, 1, 0, [0, 2, 3] if i < 9 else [1, 2]) for i in range(12)] + [("b", i, 1, 0, [0, 1]) for i in range(9)]
    split = spark.createDataFrame(rows, "path string, id long, weight long, near int, targets array<int>")
    names = partition.twins(partition.partition_counts(split, prints=True)).select("name", "rows").collect()
    assert sorted(map(tuple, names)) == [("a.0|3", 9), ("a.1", 3), ("a.2", 12), ("b.0|1", 9)]
    assert spark.createDataFrame([("a.0|3.1|2|4",)], ["p"]).select(partition.stands_for(F.col("p"))).head()[0] == 6
