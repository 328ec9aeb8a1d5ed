import random
import re

import numpy as np
import pyarrow as pa
import pytest

from epsgroup.llm import jaccard
from epsgroup.llm.components import components


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        low.setdefault(top(i), []).append(doc)
    return sorted((doc, len(sets[i]), min((d for d in low[top(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows))


def corpus(seed, groups=12, most=12, common=()):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        text = random.choices(vocabulary, k=random.choice([3, 5, 20, 60, 200]))
        text += list(random.choice(common)) if common and random.random() < 0.7 else []
        for _ in range(random.randint(1, most)):
            own = list(text)
            for _ in range(random.randint(0, max(1, len(own) // 25))):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append(" ".join(own).upper() if random.random() < 0.3 else " ".join(own))
    random.shuffle(rows)
    return list(enumerate(rows))


def check(frame, ws, rows):
    got = jaccard.join(frame(rows, "doc_id long, text string"), "doc_id", "text", ws)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_small_regions(frame, ws, seed):
    check(frame, ws, [*corpus(seed), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c d"), (906, "a b c d"), (907, "b a c d")])


@pytest.mark.parametrize("tile", [1 << 20, 500, 60])
def test_crowded_regions(frame, ws, monkeypatch, tile):
    """Regions of more than 4 documents are crowded; with small tiles they are split by pivots, or in blocks."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    placed = []
    save = ws.save
    monkeypatch.setattr(ws, "save", lambda df, name: placed.append(name) or save(df, name))
    passage = [f"p{i}" for i in range(40)]
    check(frame, ws, corpus(7, groups=10, most=25, common=[passage, passage[:25]]))
    assert ("split-1" in placed) == (tile < 1000)


def test_frequent_shingles_come_last(frame, ws, monkeypatch):
    monkeypatch.setattr(jaccard, "SEEN_IN_RUN", 2)
    monkeypatch.setattr(jaccard, "SEEN", 3)
    check(frame, ws, corpus(3, common=[[f"p{i}" for i in range(40)]]))


def test_a_full_bitmap_loses_nothing(frame, ws, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_BITS", 64)
    check(frame, ws, corpus(4))


@pytest.mark.parametrize("seed", range(3))
def test_short_sets_of_one_region(seed):
    """Short sets from few shingles, which nearly all meet each other, against all pairs."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 62, 16, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, rng.integers(5, 10), replace=False)) for _ in range(300)]
    nodes = rng.permutation(300)
    got = jaccard.join_tile(pa.table({"node": nodes, "shingles": [s.tobytes() for s in sets]}))
    names = {int(node): int(node) for node in nodes}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if jaccard.linked(common, len(a), len(b)) and names[int(nodes[i])] != names[int(nodes[j])]:
                ends = names[int(nodes[i])], names[int(nodes[j])]
                names = {node: min(ends) if name in ends else name for node, name in names.items()}
    found = dict(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
    groups = {}
    for node, name in names.items():
        groups.setdefault(name, set()).add(found.get(node, node))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_texts_longer_than_a_slice(frame, ws):
    """A text beyond one slice, a copy of it with a changed word, and one that shares a third of it."""
    long = [f"w{i % 9973}x{i % 89}" for i in range(600_000)]
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), " ".join(long[:200_000]), "short text of five words"]
    got = jaccard.join(frame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", ws).collect()
    assert min(map(len, texts[:2])) > 4 << 20
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_repeats_nulls_and_empty(frame, ws):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (2, "y")]
    docs = frame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, "doc_id", "text", ws).collect()]
    assert sorted(got) == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 1, 2)]
    docs = frame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = [tuple(r) for r in jaccard.join(docs, "doc_id", "text", ws).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 3), (3, 2, 3), (None, 1, None)], key=str)
    assert jaccard.join(docs.limit(0), "doc_id", "text", ws).count() == 0


def test_components_of_chains_and_stars(spark, ws):
    random.seed(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 901), (901, 900), (7, 7)]
    random.shuffle(links)
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long").repartition(7), ws).collect())
    want = {i: 100 for i in range(100, 161)} | {500 + i: 500 for i in range(60)} | {900: 900, 901: 900}
    assert got == want


def sizes_written(ws, monkeypatch):
    sizes, save = {}, ws.save

    def saved(df, name):
        out = save(df, name)
        sizes[name] = out.count() if "sets" not in out.columns else out.selectExpr("sum(length(sets))").first()[0] or 0
        return out

    monkeypatch.setattr(ws, "save", saved)
    return sizes


def test_sets_that_share_little_are_no_candidates(frame, ws, monkeypatch):
    """Long documents that share a short passage meet in a few regions each, too few for their sizes."""
    sizes = sizes_written(ws, monkeypatch)
    rows = [(i, " ".join([f"d{i}w{k}" for k in range(60)] + [f"p{i // 10}x{k}" for k in range(14)])) for i in range(60)]
    check(frame, ws, [*rows, (100, rows[7][1] + " more")])
    assert sizes["pairs"] == 1 and sizes["sets"] == 2


def test_tiles_of_regions_that_pivots_cannot_split_are_written_once(frame, ws, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "TILE", 200)
    monkeypatch.setattr(jaccard, "TILE_SETS", 50)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    sizes = sizes_written(ws, monkeypatch)
    random.seed(5)
    passage = [f"p{i}" for i in range(12)]
    rows = [(i, " ".join([*passage, *(f"d{i // 2}w{k}" for k in range(4))])) for i in range(120)]
    check(frame, ws, rows)
    # 60 different sets of 12 shingles, 8 bytes each, with the frame of each tile of some hundred bytes.
    assert 60 * 12 * 8 <= sizes["tiles-1"] <= 60 * 12 * 8 * 6 and "blocks-1" in sizes
