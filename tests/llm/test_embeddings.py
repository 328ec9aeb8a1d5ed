import random

import numpy as np
import pytest

from epsgroup.llm import embeddings


def vectors(seed, n, length=16):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = rng.standard_normal(length)
        for _ in range(rng.integers(1, 9)):
            out.append((base + rng.standard_normal(length) * rng.choice([0, 0.05, 0.2, 0.3])).astype(np.float32).tolist())
    return out[:n]


def brute(rows):
    out, n = {}, len(rows)
    good = [i for i, (d, v, k) in enumerate(rows) if d is not None and k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [[] for _ in rows]
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links[i].append(j)
    for i in range(n):
        reached, left = {i}, [i]
        while left:
            for j in links[left.pop()]:
                if j not in reached:
                    reached.add(j)
                    left.append(j)
        low = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        out[i] = (rows[i][0], len(links[i]), low, rows[i][0] is None or rows[i][0] == low)
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("tile", [2048, 8])
def test_links(frame, ws, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    random.seed(4)
    rows = [(i, v, random.choice([1, 1, 2])) for i, v in enumerate(vectors(1, 120))]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 5, [1.0] * 5]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(2000, [1.0] * 5, None), (None, [1.0] * 5, 1), (3, rows[3][1], rows[3][2])]
    got = embeddings.near_duplicates(frame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label", ws)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_doubles_and_empty(frame, ws):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.1], "a"), (3, [0.0, 1.0], "a"), (4, [1.0, 0.0], "b")]
    table = frame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(table, "vec_id", "embedding", "label", ws).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert embeddings.near_duplicates(table.limit(0), "vec_id", "embedding", "label", ws).count() == 0


def test_an_id_with_several_vectors(frame, ws):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.1], "a"), (3, [0.1, 1.0], "a"), (4, [0.0, 1.1], "a"), (5, [-1.0, 0.0], "a"), (5, [-1.0, 0.0], "a")]
    rows += [(7, [1.0, 0.0], "b"), (1, [1.0, 0.1], "b"), (8, [0.0, 1.0], "b"), (5, [0.0, -1.0], "b"), (9, [0.0, -1.0], "b")]
    table = frame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(table, "vec_id", "embedding", "label", ws).collect())
    want = [(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 1, 5), (5, 1, 5), (5, 1, 5), (7, 1, 1), (8, 0, 8), (9, 1, 5)]
    assert got == [(i, n, low, i == low) for i, n, low in want]


def test_doubles_at_the_ends_of_their_range(frame, ws):
    rows = [(1, [1e200, 0.0]), (2, [1.0001e200, 0.0]), (3, [1e-200, 0.0]), (4, [2e-200, 1e-310]), (5, [0.0, 5e-324]), (6, [1.7e308, 1.7e308])]
    docs = frame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label long")
    got = embeddings.near_duplicates(docs, "vec_id", "embedding", "label", ws).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6)]


def test_what_is_written_does_not_grow_with_the_pairs(frame, ws, monkeypatch, tmp_path):
    """Vectors of one label in twelve tiles: each is written once, packed, wherever else its tile is met."""
    monkeypatch.setattr(embeddings, "TILE", 32)
    rng, sizes = np.random.default_rng(3), {}
    rows = [(i, v, 1) for i, v in enumerate(rng.standard_normal((380, 64)).astype(np.float32).tolist())]
    rows += [(1000 + i, rows[i][1], 1) for i in range(0, 380, 40)]
    save = ws.save

    def saved(df, name):
        assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString().lower()  # copies of vectors
        out = save(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(ws, "save", saved)
    got = embeddings.near_duplicates(frame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label", ws)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert 12 <= sizes["tiles"] <= 30 and sizes["owned"] == len(rows)
    packed = ws.spark.read.parquet(f"{ws.path}/tiles").selectExpr("sum(length(vectors))", "sum(length(copies))").first()
    assert tuple(packed) == (380 * 64 * 4, 380 * 8)
