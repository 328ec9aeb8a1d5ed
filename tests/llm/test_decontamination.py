import random

import numpy as np
import pytest

from epsgroup.llm import decontamination as D


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(items, docs):
    """(doc, item) -> least edits, for all that are within bounds."""
    out = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, passage in items:
            p = (passage or "").lower().split()
            if len(p) < D.LEAST_WORDS:
                continue
            k = int(D.edits(len(p)))
            best = min((edit_distance(p, w[a:b]) for a in range(len(w)) for b in range(a + max(1, len(p) - k), min(len(w), a + len(p) + k) + 1)), default=99)
            if best <= k:
                out[doc, item] = best
    return out


def edited(random, words, vocabulary, n):
    own = list(words)
    for _ in range(n):
        at = random.randrange(len(own))
        kind = random.choice(["put", "drop", "change"])
        own[at : at + (kind != "put")] = [] if kind == "drop" else [random.choice(vocabulary)]
    return own


def planted(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([5, 8, 14, 20, 33, 50])))) for i in range(20)]
    docs = []
    for doc in range(n):
        own = r.choices(vocabulary, k=r.randint(0, 30))
        item = r.choice(items)[1].split()
        own += edited(r, item, vocabulary, r.randint(0, len(item) // 5)) if r.random() < 0.7 else []
        docs.append((doc, " ".join(own + r.choices(vocabulary, k=r.randint(0, 30)))))
    return items, docs


def test_recall_and_no_false_find(frame):
    items, docs = planted(1)
    found = D.find(frame(docs, "doc_id long, text string"), "doc_id", "text", frame(items, "item_id long, text string"), "item_id", "text")
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    want = brute(items, docs)
    assert not set(got) - set(want)
    assert len(got) >= 0.95 * len(want) and len(want) > 150
    assert all(pair in got for pair, distance in want.items() if distance == 0)
    texts, passages = dict(docs), dict(items)
    for (doc, item), r in got.items():
        stretch = texts[doc].lower().split()[r["first_word"] : r["end_word"]]
        assert edit_distance(passages[item].lower().split(), stretch) == r["edits"] == want[doc, item]


def test_edges(frame):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (None, f"x {item} y"), (4, "one two three"), (5, f"{'a b ' * 20000}{item}\n{'the the ' * 3000}")]
    items = [(7, item), (7, item), (8, None), (9, "one two"), (None, "six seven eight nine ten"), (10, "a a a a a a a")]
    table = frame(docs, "doc_id long, text string")
    found = D.find(table, "doc_id", "text", frame(items, "item_id long, text string"), "item_id", "text").collect()
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in found), key=str)
    want = [(d, i, 0) for d in (3, 3, None, 5) for i in (7, 7, None)]
    assert got == sorted(want, key=str)
    none = frame(items, "item_id long, text string").limit(0)
    assert D.find(table, "doc_id", "text", none, "item_id", "text").count() == 0
    assert D.find(table.limit(0), "doc_id", "text", frame(items, "item_id long, text string"), "item_id", "text").count() == 0


def test_items_in_blocks(frame, monkeypatch):
    items, docs = planted(2, 60)
    one = D.find(frame(docs, "doc_id long, text string"), "doc_id", "text", frame(items, "item_id long, text string"), "item_id", "text").collect()
    monkeypatch.setattr(D, "ITEM_WORDS", 100)
    many = D.find(frame(docs, "doc_id long, text string"), "doc_id", "text", frame(items, "item_id long, text string"), "item_id", "text").collect()
    assert {(r["doc_id"], r["item_id"]) for r in one} == {(r["doc_id"], r["item_id"]) for r in many} and one


@pytest.mark.parametrize("seed", range(3))
def test_closest(seed):
    r = random.Random(seed)
    for _ in range(100):
        item, text = r.choices("abcd", k=r.randint(1, 9)), r.choices("abcd", k=r.randint(0, 15))
        best = min(edit_distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        got, end = D.closest(item, text)
        assert got == best and min(edit_distance(item, text[a:end]) for a in range(end + 1)) == best


def met(items, texts, n):
    """(text, item) pairs that are compared with each other: texts of n words as windows."""
    known = D.Items(list(range(len(items))), items)
    hashes, counts = D.words([t.encode() for t in texts])
    pairs, per_text = D.runs(hashes, counts, 2)
    rows = np.arange(len(texts))
    starts, of_words, of_pairs = np.zeros(len(texts), np.int64), np.cumsum(counts) - counts, np.cumsum(per_text) - per_text
    return set(known._candidates(n, rows, starts, hashes, counts, of_words, pairs, of_pairs))


@pytest.mark.parametrize("n", [5, 9, 10, 25, 40, 100])
def test_unrelated_texts_are_not_compared(n):
    r = random.Random(n)
    items, texts = ([" ".join(f"w{r.randrange(1000)}" for _ in range(n)) for _ in range(60)] for _ in range(2))
    assert len(met(items, texts, n)) < 0.01 * 60 * 60
    assert met(items, items, n) >= {(i, i) for i in range(60)}


@pytest.mark.parametrize("n", [5, 6, 10, 20, 50])
def test_none_is_lost_at_the_most_edits_allowed(n):
    r = random.Random(n)
    words_ = [f"w{i}" for i in range(60)] + ["the"] * 20
    items = [(i, " ".join(r.choices(words_, k=n))) for i in range(25)]
    docs = [(i, " ".join(r.choices(words_, k=9) + edited(r, items[i % 25][1].split(), words_, int(D.edits(n))) + r.choices(words_, k=r.randint(0, 9)))) for i in range(75)]
    known = D.Items([i for i, _ in items], [t for _, t in items])
    got = {(docs[row][0], item): distance for row, item, distance, *_ in known.found([t.encode() for _, t in docs])}
    least = {(doc, item): D.closest(p.split(), t.split())[0] for doc, t in docs for item, p in items}
    want = {pair: distance for pair, distance in least.items() if distance <= D.edits(n)}
    assert got == want and len(want) >= 75


@pytest.mark.parametrize("seed", range(3))
def test_recall_at_the_most_edits_allowed(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of"] * 300
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([10, 15, 25, 40, 60, 100])))) for i in range(60)]
    docs = []
    for i in range(300):
        own = items[i % 60][1].split()
        docs.append((i, " ".join(r.choices(vocabulary, k=12) + edited(r, own, vocabulary, int(D.edits(len(own)))) + r.choices(vocabulary, k=12))))
    known = D.Items([i for i, _ in items], [t for _, t in items])
    got = {(row, item) for row, item, *_ in known.found([t.encode() for _, t in docs])}
    want = {(doc, item) for doc, t in docs for item, p in items if D.closest(p.split(), t.split())[0] <= D.edits(len(p.split()))}
    assert not got - want and len(want) >= 300 and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("n", [10, 25, 60])
def test_tables_alone_part_unrelated_texts(n):
    rng = np.random.default_rng(n)
    items, texts = (rng.choice(rng.integers(1, 1 << 63, 300, dtype=np.uint64), (200, n)) for _ in range(2))
    walks, met = D.Walks(n), np.zeros((200, 200), bool)
    for turn in range(D.walks_for(D.trial_size(n))):
        for a, b in zip(walks.keys(items, turn), walks.keys(texts, turn), strict=True):
            met |= a[:, None] == b
    assert met.mean() < 0.01


def test_short_items_on_demand(frame):
    docs = [(1, "One two  one two three"), (2, "two"), (3, "x one"), (4, None), (5, "")]
    items = [(1, "one two"), (2, "TWO"), (2, "two"), (3, "a b c d"), (4, "")]
    found = D.find(frame(docs, "doc_id long, text string"), "doc_id", "text", frame(items, "item_id long, text string"), "item_id", "text", 1)
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(1, 1, 0, 0, 2), (1, 2, 0, 1, 2), (1, 2, 0, 1, 2), (2, 2, 0, 0, 1), (2, 2, 0, 0, 1)]
