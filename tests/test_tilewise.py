import random

import numpy as np
import pytest

from epsgroup.functions.firstfit import first_fit, first_fit_in_cells
from epsgroup.plans import similar
from tests import twin


def plane(n, seed, side, dimension=2):
    draw = random.Random(seed)
    return [tuple(draw.uniform(-side, side) if j < 2 else draw.uniform(0, 0.2) for j in range(dimension)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_cells_decide_as_first_fit_does(seed):
    x = np.array(plane(600, seed, 8))
    ids = np.sort(np.random.default_rng(seed).choice(10_000, 600, replace=False))
    label, done, _ = first_fit_in_cells(ids, x, x, 1.0, np.full(600, -1), np.zeros(600, bool), np.ones(600, bool))
    assert done.all() and (label == first_fit(ids, x, 1.0)).all()


def test_rows_around_a_tile_hold_back_what_depends_on_them():
    x = np.array([[0.0, 0], [1.5, 0], [3.2, 0], [20, 0], [1.4, 0]])
    home = np.array([False, True, True, True, True])
    label, done, _ = first_fit_in_cells(np.arange(5), x, x, 1.0, np.full(5, -1), np.zeros(5, bool), home)
    assert done.tolist() == [False, False, False, True, False] and label[3] == 3
    label, done, _ = first_fit_in_cells(np.arange(5), x, x, 1.0, np.array([0, -1, -1, -1, -1]), np.array([True, *[False] * 4]), home)
    assert done.all() and label.tolist() == [0, 1, 2, 3, 1]


def test_distances_grow_with_the_rows():
    """Four times the rows on four times the area: about four times the distances, far below the square."""
    counted = []
    for n in (2000, 8000):
        x = np.array(plane(n, 1, np.sqrt(n)))
        counted.append(first_fit_in_cells(np.arange(n), x, x, 1.0, np.full(n, -1), np.zeros(n, bool), np.ones(n, bool))[2])
    assert counted[1] < 5 * counted[0] and counted[1] < 20 * 8000


@pytest.mark.parametrize("dimension, kind", [(2, "plane"), (1, "line"), (4, "flat"), (2, "dense")])
def test_large_partitions(table, spark, dimension, kind):
    """Whole runs against plain Python; `dense` has no tiles and goes block by block."""
    vectors = plane(400, 3, 0.5 if kind == "dense" else 120, dimension)
    if kind == "line":
        vectors = [(x[0] * 10,) for x in vectors]
    if kind == "plane":
        vectors += [(x + 0.3, y) for x, y in vectors[:100]] + [(0.0, 0.0)] * 5
    options = similar.Options(1.0, num_pivots=1, threshold=10**9, local_rows=100, block_rows=100)
    groups = similar.run(table(vectors), options)
    got = {}
    for r in groups.original_rows().collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    want = twin.first_fit([(i, v) for i, v in enumerate(vectors, 1)], 1.0)
    assert got == {g[0][0]: {r[0] for r in g} for g in want}
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{groups.workspace.path}/large-tile-state-1")
    assert path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) == (kind != "dense")


def test_both_kinds_and_copies(table):
    """A wide partition and a dense one beside each other, two pivots, the ownership rule on both."""
    vectors = plane(300, 5, 120) + [(x + 1000, y + 1000) for x, y in plane(150, 6, 0.6)]
    o = similar.Options(1.0, num_pivots=2, threshold=10**9, local_rows=90, block_rows=90)
    groups = similar.run(table(vectors), o)
    got = {}
    for r in groups.members.collect():
        got.setdefault((r["path"], r["group_id"]), set()).add(r["id"])
    want = twin.similar(list(enumerate(vectors, 1)), o)
    assert {k: set(v) for k, v in want.items()} == got
