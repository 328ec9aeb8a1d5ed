import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from epsgroup.llm import collocations
from epsgroup.llm.collocations import Summary, Words, asked, summed


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        totals[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, totals


def plain_phrases(rows, threshold, top):
    counts, totals = plain_counts(rows)
    frequent = {k: a for k, a in counts.items() if a >= threshold}
    out = {}
    for (lang, p), a in frequent.items():
        def inside(q):
            return any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

        if len(p) < 2 or any(x == lang and len(q) > len(p) and f >= a and inside(q) for (x, q), f in frequent.items()):
            continue
        scores = []
        for k in range(1, len(p)):
            l, r = counts[lang, p[:k]], counts[lang, p[k:]]
            scores.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(scores)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {
        (lang, rank, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    }


def corpus(draw, n):
    vocabulary = ["the", "The", "été", "a", "b'c", "x-y", "z", "q\xa0q", "I", *(f"w{i}" for i in range(30))]
    rows = []
    for _ in range(n):
        said = [draw.choice(vocabulary[: draw.choice((4, 9, 39))]) + draw.choice(["", "", "", "", ",", ". ", "!?", "\n"]) for _ in range(draw.randint(0, 40))]
        rows.append((draw.choice([" ", "  ", "\t"]).join(said), draw.choice(["en", "de", None, "und"])))
    passage = "one two three four five six"
    rows += [(f"{passage}, {passage}", "en")] * 9 + [("lead one two three four five", "en")] * 3
    return [*rows, (None, "en"), ("", "fr"), (" .,; ", "en"), ("a a a a a a a a", "rep"), ("word", "en")]


@pytest.mark.parametrize("seed", [1, 40])
def test_all_phrases(frame, ws, seed):
    draw = random.Random(seed)
    rows = corpus(draw, 150)
    docs = frame(rows, "text string, lang string")
    got = collocations.mine(docs, "text", "lang", 8, 12, ws).collect()
    assert {tuple(r) for r in got} == plain_phrases(rows, 8, 12)
    assert len(got) == len({(r["lang"], r["rank"]) for r in got}) > 20


def test_counts(frame, ws):
    """Exact counts of all frequent runs, and all words of each language, over many hash partitions."""
    rows = corpus(random.Random(2), 100)
    old, collocations.PART_BYTES = collocations.PART_BYTES, 1 << 10
    try:
        found = collocations.frequent(frame(rows, "text string, lang string"), "text", "lang", 5, ws).collect()
    finally:
        collocations.PART_BYTES = old
    counts, totals = plain_counts(rows)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in found if r["words"]} == {k: n for k, n in counts.items() if n >= 5}
    assert {r["lang"]: r["n"] for r in found if not r["words"]} == dict(totals)


def test_empty(frame, ws):
    assert collocations.mine(frame([], "text string, lang string"), "text", "lang", 2, 5, ws).collect() == []
    assert collocations.mine(frame([(None, None)], "text string, lang string"), "text", "lang", 2, 5, ws).collect() == []


def test_large_numbers(spark):
    """Products beyond 64 bits stay exact."""
    a, n, l, r = 10**9 + 7, 10**12 + 39, 10**9 + 9, 10**10 + 19
    got = spark.sql(f"SELECT (CAST({a} AS DECIMAL(19,0)) * CAST({n} AS DECIMAL(19,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))")
    assert got.first()[0] == 1000 * a * n // (l * r)


@pytest.mark.parametrize("seed", range(4))
def test_no_frequent_hash_is_lost(seed):
    """Merged in any order, a summary keeps every hash that reaches the threshold, and never more than its capacity."""
    draw = np.random.default_rng(seed)
    hashes = (draw.zipf(1.3, 20_000) % 5000).astype(np.uint64)
    threshold = 60
    summary = Summary(len(hashes) // threshold + 1)
    for piece in np.array_split(hashes, 37):
        keys, counts = np.unique(piece, return_counts=True)
        summary.merge(keys, counts)
        assert len(summary.keys) <= summary.capacity
    assert 0 < summary.lost < threshold
    keys, counts = np.unique(hashes, return_counts=True)
    assert set(keys[counts >= threshold]) <= set(summary.reaching(threshold))


def test_folding_in_pieces(monkeypatch):
    """What tasks hand on in pieces adds up to the counts of all runs; long texts are cut at breaks only."""
    texts = [" ".join(f"w{i % 7}" + "," * (i % 5 == 0) for i in range(900)), "x" * 5000, "w1 w2 w1 w2"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 3)], ["text", "lang"])

    def folded():
        rows = [b.to_pylist() for b in collocations._fold([batch], range(1, 2), 3, [])]
        rows = [r for b in rows for r in b]
        keys, counts = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("hashes", np.uint64), ("counts", np.int64)))
        assert all(set(np.frombuffer(r["hashes"], np.uint64) >> np.uint64(61)) == {r["part"]} for r in rows)
        assert sum(r["mass"] for r in rows) == counts.sum() == 905
        return [x.tolist() for x in summed(keys, counts)]

    whole = folded()
    monkeypatch.setattr(collocations, "CUT", 100)
    monkeypatch.setattr(collocations, "FOLDED", 2)
    assert folded() == whole and len(whole[0]) == 8


def test_bitmap():
    keys = np.random.default_rng(1).integers(0, 2**64, 300, np.uint64)
    for bits in (8, 12, 16):
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        for k in keys.tolist():
            bit = k >> (64 - bits)
            bitmap[bit >> 3] |= 1 << (bit & 7)
        assert asked(bitmap, keys).all()
    assert not asked(bitmap, ~keys).all()


def test_words():
    words = Words([b"the cat, the", b"", b"cat"], [1, 1, 2])
    assert [words.phrase(i, 1) for i in range(4)] == [b"the", b"cat", b"the", b"cat"]
    assert words.keys[0] == words.keys[2] and words.keys[1] != words.keys[3] and words.text.tolist() == [0, 0, 0, 2]
    assert [v.tolist() for _, _, v in words.runs(2)] == [[True] * 4, [True, False, False]]
