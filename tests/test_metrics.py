import random

import numpy as np
import pytest

from epsgroup.functions import kernels
from epsgroup.functions.metrics import EUCLIDEAN, MANHATTAN, MAXIMUM, Metric
from epsgroup.plans import similar
from tests import twin

PLAIN = {
    "euclidean": twin.distance,
    "manhattan": lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True)),
    "maximum": lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)),
    "discrete": lambda a, b: float(sum(x != y for x, y in zip(a, b, strict=True))),
}
# A metric of a user: the number of coordinates that differ.
DISCRETE = Metric(
    "discrete", lambda a, b: (a != b).sum(axis=1).astype(float), lambda a, b: (a[:, None] != b[None]).sum(axis=2).astype(float)
)
ALL = [EUCLIDEAN, MANHATTAN, MAXIMUM, DISCRETE]


@pytest.mark.parametrize("metric", ALL, ids=lambda m: m.name)
def test_distances(metric):
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 4, (30, 3)).astype(float), draw.integers(0, 4, (20, 3)).astype(float)
    plain = np.array([[PLAIN[metric.name](x, y) for y in b] for x in a])
    assert np.allclose(metric.pairwise(a, b), plain) and np.allclose(metric.aligned(a[:20], b), plain[:20].diagonal())
    assert (metric.within(a, b, 2.0) == (plain <= 2.0)).all()
    near, gap = metric.nearest(a, b)
    assert (near == plain.argmin(1)).all() and np.allclose(gap, plain.min(1))
    low, high = metric.bounds(a, b)
    assert (low <= plain + 1e-9).all() and (plain <= high + 1e-9).all()
    copies = metric.copies(a, b, near, gap, 1.0, "metric")
    assert (copies == ((kernels.border(plain, plain.min(1)[:, None], None, "metric") <= 1.0) | (np.arange(20) == near[:, None]))).all()


def vectors(n, seed, dimension, grid):
    draw = random.Random(seed)
    return [tuple(draw.randrange(grid) / 10 for _ in range(dimension)) for _ in range(n)]


@pytest.mark.parametrize("metric", ALL[1:], ids=lambda m: m.name)
@pytest.mark.parametrize("options", [dict(num_pivots=1, local_rows=40, block_rows=40), dict(num_pivots=4, threshold=60)], ids=["blocks", "rounds"])
def test_whole_runs(table, monkeypatch, metric, options):
    """Against plain Python: partitions too large for one task, and several rounds with copies across borders."""
    monkeypatch.setattr(twin, "distance", PLAIN[metric.name])
    eps = 1.0 if metric is DISCRETE else 0.7
    rows = vectors(200, 2, 3, 4) if metric is DISCRETE else vectors(200, 2, 2, 40)
    o = similar.Options(eps, **{"threshold": 10**9, **options}, metric=metric)
    assert o.window == "metric"
    groups = similar.run(table(rows), o)
    got = {}
    for r in groups.original_rows().collect():
        got.setdefault((r["path"], r["group_id"]), []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == twin.similar(list(enumerate(rows, 1)), o)


@pytest.mark.parametrize("metric", [MANHATTAN, MAXIMUM], ids=lambda m: m.name)
def test_tiles(table, monkeypatch, metric):
    monkeypatch.setattr(twin, "distance", PLAIN[metric.name])
    rows = [(10 * x, 10 * y) for x, y in vectors(300, 3, 2, 250)]
    groups = similar.run(table(rows), similar.Options(2.0, num_pivots=1, threshold=10**9, local_rows=100, block_rows=100, metric=metric))
    got = {}
    for r in groups.original_rows().collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    assert got == {g[0][0]: {r[0] for r in g} for g in twin.first_fit(list(enumerate(rows, 1)), 2.0)}
