import numpy as np
import pytest

from epsgroup.functions import kernels
from epsgroup.functions.firstfit import first_fit, owned
from tests import twin


@pytest.mark.parametrize("dimension", [1, 2, 8, 9, 40])
def test_within_and_nearest_agree_with_plain_loops(dimension):
    rng = np.random.default_rng(dimension)
    # Whole numbers give many ties and many distances of exactly eps.
    x = rng.integers(-3, 4, (60, dimension)).astype(float)
    p = rng.integers(-3, 4, (25, dimension)).astype(float)
    gaps = np.array([[twin.distance(a, b) for b in p] for a in x])
    for eps in np.unique(gaps)[::7]:
        assert (kernels.within(x, p, eps) == (gaps <= eps)).all()
    near, distance = kernels.nearest(x, p, squared=False)
    assert (near == gaps.argmin(axis=1)).all()
    assert (distance == gaps.min(axis=1)).all()


@pytest.mark.parametrize("dimension", [2, 30])
@pytest.mark.parametrize("form", ["euclidean", "metric"])
def test_window_copies(dimension, form):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (80, dimension)).astype(float)
    p = np.vstack([rng.integers(-3, 4, (9, dimension)).astype(float), x[:2]])
    near, distance = kernels.nearest(x, p, squared=False)
    copies = kernels.window_copies(x, p, near, distance, 0.5, form)
    for a in range(len(x)):
        for i in range(len(p)):
            if i == near[a]:
                assert copies[a, i]
                continue
            d, between = twin.distance(x[a], p[i]), twin.distance(p[i], p[near[a]])
            if form == "metric":
                want = (d - distance[a]) / 2 <= 0.5
            else:
                want = between > 0 and (d * d - distance[a] * distance[a]) / (2 * between) <= 0.5
            assert copies[a, i] == want


@pytest.mark.parametrize("dimension,eps", [(1, 0.05), (2, 0.2), (2, 2.0), (12, 1.2)])
def test_first_fit(dimension, eps):
    x = np.random.default_rng(5).random((700, dimension))
    ids = np.arange(10, 710)
    label = first_fit(ids, x, eps)
    want = twin.first_fit([(int(i), tuple(v)) for i, v in zip(ids, x)], eps)
    for group in want:
        assert {int(label[m[0] - 10]) for m in group} == {group[0][0]}


def test_first_fit_boundary_is_inclusive():
    assert list(first_fit(np.array([1, 2, 3]), np.array([[0.0], [1.0], [2.0]]), 1.0)) == [1, 1, 3]


def test_owned_takes_the_lowest_base_of_every_round():
    label = np.array([1, 1, 5, 5])
    base = np.array([[0, 2], [1, 3], [1, 2], [1, 2]])
    assert list(owned(label, base, [0, 2])) == [True, True, False, False]
    assert list(owned(label, base, [1, 2])) == [False, False, True, True]
    assert owned(label, np.empty((4, 0)), []).all()


def test_unequal_lengths_fail():
    import pyarrow as pa

    with pytest.raises(ValueError):
        kernels.vectors_of(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]), 3)
