import random

import numpy as np

from epsgroup.llm import quality
from epsgroup.llm.words import slices

VOCABULARY = [a + b + c for a in ("ba", "do", "ki", "lum", "re", "so", "ti", "van") for b in ("na", "ler", "mi", "sto", "ren", "ku") for c in ("", "sa", "n", "to", "li")]


def text(r, kind):
    words = r.choices(VOCABULARY, k=r.randint(25, 120))
    if kind == "repeated":
        words = [w for w in words[:12] for _ in range(12)]
    if kind == "symbols":
        words = [w + r.choice(["&&&", "$$$", "###"]) for w in words]
    if kind == "capitals":
        words = [w.upper() + "!!" for w in words]
    return " ".join(words).capitalize() + "." if kind == "good" else " ".join(words)


def corpus(seed, n):
    r = random.Random(seed)
    kinds = [r.choice(["good"] * 6 + ["repeated", "symbols", "capitals"]) for _ in range(n)]
    return kinds, [text(r, k) for k in kinds]


def test_held_out_accuracy(frame, monkeypatch):
    """Trained without labels on 300 texts, right on nearly all of the others."""
    monkeypatch.setattr(quality, "SAMPLE", 300)
    kinds, texts = corpus(1, 900)
    got = quality.classify(frame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    assert len(got) == 900
    right = sum(r["kept"] == (kinds[r["doc_id"]] == "good") for r in got)
    assert right >= 0.98 * 900
    assert all(r["kept"] for r in got if kinds[r["doc_id"]] == "good")


def test_accuracies_are_estimated():
    """Votes drawn from known accuracies: the estimates come close, and so does the share of good texts."""
    r = np.random.default_rng(0)
    n, m = 20000, len(quality.LABELLERS)
    good = r.random(n) < 0.7
    wrong_bad, right_bad = np.linspace(0.01, 0.08, m), np.linspace(0.5, 0.9, m)
    bad = r.random((n, m)) < np.where(good[:, None], wrong_bad, right_bad)
    silent = r.random((n, m)) < 0.3
    votes = np.where(silent, quality.NONE, np.where(bad, quality.BAD, quality.GOOD)).astype(np.int8)
    codes, counts = np.unique(quality.code(votes), return_counts=True)
    share, said, likely = quality.accuracies(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    assert abs(share - 0.7) < 0.02
    assert np.abs(said[:, 1, quality.BAD] - wrong_bad).max() < 0.03 and np.abs(said[:, 0, quality.BAD] - right_bad).max() < 0.05
    label = np.array([likely[c] for c in quality.code(votes).tolist()]) >= 0.5
    assert (label == good).mean() > 0.97


def test_edges(frame):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "a b c"), (5, "kuna " * 50000), (6, "\x00\x01"), (7, "ÉÉÉ " * 30)]
    table = frame(rows, "doc_id long, text string")
    got = quality.classify(table, "doc_id", "text").collect()
    assert len(got) == len(rows)
    assert all(r["score"] == 0 and not r["kept"] and r["bad_votes"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    same = [tuple(r) for r in got if r["doc_id"] == 4]
    assert same[0] == same[1]
    assert quality.classify(table.limit(0), "doc_id", "text").count() == 0


def test_properties():
    import pyarrow as pa

    _, texts = next(slices(pa.array(["the the the cat", "ÉTÉ Was ABC $x$", "a\na\nb"]), table=None))
    own = quality.Texts(texts).properties
    assert own["repeated"].tolist() == [0.5, 0, 1 / 3]
    assert own["different"].tolist() == [0.5, 1, 2 / 3]
    assert own["capitals"][1] == 7 / 10 or own["capitals"][1] > 0.5
    assert np.allclose(own["lines"], [0, 0, 1 / 3])
    assert own["shouted"][1] == 0.5 and own["marked"][1] == 0.25


def test_one_repeated_row_trains(spark, monkeypatch):
    """Equal rows draw alike; the cut is raised until they are in."""
    monkeypatch.setattr(quality, "SAMPLE", 16)
    for text in ("a good text of some words that says a thing or two about the world", "BUY!! NOW!! BUY!! NOW!!", "one"):
        table = spark.range(3000).selectExpr("1L AS doc_id", f"'{text}' AS text")
        assert quality.fit(table, "doc_id", "text")[0].any()
