import os

import pytest

from epsgroup.operators import nearest
from epsgroup.plans import kmeans, report
from epsgroup.workspace import Workspace


def clouds():
    import random

    rng = random.Random(1)
    return [(rng.gauss(c, 1.0), rng.gauss(-c, 1.0)) for c in (0, 10, 20) for _ in range(80)]


def test_converges_and_never_gets_worse(table):
    result = kmeans.fit(table(clouds()), 5, 50, 1e-3, seed=3, keep_history=True)
    assert result.converged and result.iterations < 50
    costs = {}
    for r in result.history.collect():
        if r["cost"] is not None:
            costs[r["iteration"]] = costs.get(r["iteration"], 0.0) + r["cost"]
    series = [costs[i] for i in sorted(costs)]
    assert len(series) == result.iterations
    assert all(b <= a + 1e-9 for a, b in zip(series, series[1:]))
    assert series[-1] == pytest.approx(result.cost)
    assert sum(r["n"] for r in result.centers.collect()) == 240
    row = report.kmeans_summary(result, 5, 1e-6, 3).head()
    assert row["converged"] and row["iterations"] == result.iterations


def test_stops_after_max_iterations(table):
    result = kmeans.fit(table(clouds()), 4, 2, 0.0)
    assert (result.iterations, result.converged) == (2, False)


def test_empty_centre_is_dropped(table):
    df = table([(0.0, 0.0), (1.0, 0.0), (9.0, 0.0)])
    rows = sorted(kmeans.update(df, [[0.0, 0.0], [500.0, 500.0], [9.0, 0.0]]).collect())
    assert [(r["cid"], r["center"], r["n"], r["cost"]) for r in rows] == [(0, [0.5, 0.0], 2, 1.0), (2, [9.0, 0.0], 1, 0.0)]


def test_fewer_rows_than_centres_and_no_rows(table):
    df = table([(0.0, 0.0), (4.0, 0.0)])
    assert kmeans.fit(df, 10, 5).centers.count() == 2
    assert kmeans.fit(df.limit(0), 3).centers.count() == 0


def test_both_forms_agree(table, monkeypatch):
    df = table(clouds())
    centers = [list(v) for v in clouds()[::40]]
    unrolled = sorted(kmeans.update(df, centers).collect())
    near = sorted(nearest.nearest_point(df, centers).collect())
    monkeypatch.setattr(kmeans, "UNROLLED_TERMS", 0)
    monkeypatch.setattr(nearest, "UNROLLED_TERMS", 0)
    assert sorted(nearest.nearest_point(df, centers).collect()) == near
    for a, b in zip(unrolled, sorted(kmeans.update(df, centers).collect()), strict=True):
        assert (a["cid"], a["n"]) == (b["cid"], b["n"])
        assert a["center"] == pytest.approx(b["center"]) and a["cost"] == pytest.approx(b["cost"])


def test_ties_go_to_the_lower_index(table):
    rows = nearest.nearest_point(table([(0.0,), (2.0,)]), [[1.0], [1.0], [-1.0]]).orderBy("id").collect()
    assert [r["near"] for r in rows] == [0, 0]


def test_frequency(table):
    assert kmeans.fit(table(clouds()), 3, 3, frequency=0.5).centers.count() <= 3


@pytest.mark.parametrize("damaged", [False, True])
def test_resumes_a_stopped_run(table, spark, tmp_path, damaged):
    """After two iterations, also where the third was not written to its end; the result is that of a run never stopped."""
    rows = table(clouds())
    whole = kmeans.fit(rows, 5, 6, 1e-9, seed=3, keep_history=True)
    ws = Workspace(spark, str(tmp_path))
    kmeans.fit(rows, 5, 3 if damaged else 2, 1e-9, seed=3, keep_history=True, workspace=ws)
    if damaged:
        os.rename(f"{ws.path}/centers/step=3/_SUCCESS", f"{tmp_path}/moved")
    assert ws.written_steps("centers") == [0, 1, 2]
    again = kmeans.fit(rows, 5, 6, 1e-9, seed=3, workspace=Workspace.existing(spark, ws.path), resume=True)
    assert (again.iterations, again.converged, again.cost) == (whole.iterations, whole.converged, whole.cost)
    assert sorted(map(tuple, again.centers.collect())) == sorted(map(tuple, whole.centers.collect()))
    assert sorted(map(tuple, again.history.collect())) == sorted(map(tuple, whole.history.collect()))
    done = kmeans.fit(rows, 5, 6, 1e-9, seed=3, workspace=ws, resume=True)
    assert done.iterations == 6 and sorted(map(tuple, done.centers.collect())) == sorted(map(tuple, whole.centers.collect()))
    with pytest.raises(ValueError):
        kmeans.fit(rows, 5, resume=True)
