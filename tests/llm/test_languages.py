import math
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from epsgroup.llm import languages
from epsgroup.llm.languages import Lattice, Pieces, Words, expected, vocabulary, word_scores

PIECES = sorted({b" a", b"ab", b"abc", b"b", b"bc", b" ", b"a", b"c", b"\xc3", b"\xa9", "é".encode(), b"cab"})


def cuts(word, pieces):
    """All ways to write a word with pieces."""
    if not word:
        return [[]]
    return [[p, *rest] for p in pieces if word.startswith(p) for rest in cuts(word[len(p) :], pieces)]


@pytest.mark.parametrize("seed", range(3))
def test_sums_over_all_cuts(seed):
    """Forward sums and expected uses against every cut of every word."""
    draw = random.Random(seed)
    words = [b" " + "".join(draw.choice("abcé") for _ in range(draw.randint(0, 6))).encode() for _ in range(30)]
    log_p = np.log(np.random.default_rng(seed).dirichlet(np.ones(len(PIECES)), 2).T)
    at = {p: i for i, p in enumerate(PIECES)}
    langs, counts = np.array([draw.randint(0, 1) for _ in words]), np.array([draw.randint(1, 5) for _ in words])
    trie, uses = Pieces(PIECES), np.zeros(log_p.shape)
    scores = word_scores(trie, words, log_p)
    for i, word in enumerate(words):
        for lang in (0, 1):
            ways = [math.exp(sum(log_p[at[p], lang] for p in way)) for way in cuts(word, PIECES)]
            assert scores[i, lang] == pytest.approx(math.log(sum(ways)))
            if lang == langs[i]:
                for way, p in zip(cuts(word, PIECES), ways, strict=True):
                    for piece in way:
                        uses[at[piece], lang] += counts[i] * p / sum(ways)
    assert np.allclose(expected(trie, words, counts, langs, log_p), uses)


def test_words_and_long_words():
    words = Words([b"ab  cd\n", b"", b"x" * 150, b"ab"])
    assert [words.word(i) for i in range(len(words.keys))] == [b" ab", b" cd", b" " + b"x" * 64, b"x" * 64, b"x" * 22, b" ab"]
    assert words.text.tolist() == [0, 0, 2, 2, 2, 3] and words.keys[0] == words.keys[5] and len(set(words.keys.tolist())) == 5
    assert Lattice(Pieces(PIECES), []).nodes == 0


def test_vocabulary_covers_all_bytes():
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(pieces) == len(set(pieces)) > 30_000 and {bytes([b]) for b in range(256)} <= set(pieces)
    word = b" \xff\x00" + "日本語é".encode()
    assert np.isfinite(word_scores(Pieces(pieces), [word], np.full((len(pieces), 1), -9.0))).all()


def texts(draw, letters, n):
    return ["".join(draw.choice(letters) + draw.choice(["", "", " "]) for _ in range(draw.randint(5, 40))) for _ in range(n)]


def test_held_out_accuracy(frame, ws, monkeypatch):
    """Texts never learned from; very long, null, empty and letterless ones; a language of null is no language."""
    draw = random.Random(4)
    said = [(i, t, lang) for lang, letters in (("aa", "aaaabcd"), ("bb", "abbbbcé"), (None, "zzz")) for i, t in enumerate(texts(draw, letters, 40))]
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = languages.learn(frame(said, "doc_id long, text string, lang string"), "text", "lang", pieces, ws)
    assert model.langs == ["aa", "bb"] and np.allclose(np.exp(model.log_p).sum(0), 1) and np.allclose(np.exp(model.log_prior), 0.5)
    asked = [(i, t, lang) for i, (lang, letters) in enumerate([("aa", "aaaabcd"), ("bb", "abbbbcé")] * 20) for t in texts(draw, letters, 1)]
    asked += [(100, None, "aa"), (101, "", "aa"), (102, "12 ?!", "bb"), (103, "b b bb éb " * 100_000, "bb"), (104, "a" * 300_000, "aa"), (0, asked[0][1], "aa")]
    docs = frame(asked, "doc_id long, text string, lang string")
    got = languages.predict(docs, [F.col("doc_id"), F.col("lang"), F.col("n")], "text", model).collect()
    assert len(got) == len(asked) and all(0 <= r["score"] <= 1 and r["n"] == "x" for r in got)
    right = [r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 100 or r["doc_id"] > 102]
    assert sum(right) / len(right) > 0.95
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if 100 <= r["doc_id"] <= 102)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] > 102)


def test_prediction_is_the_sum_over_words(frame, ws):
    """The score against a plain sum over the words of a text with the learned model."""
    pieces = sorted({*PIECES, *(bytes([b]) for b in range(256))})
    model = languages.learn(frame([("ab abc cab", "x"), ("b c b bc", "y"), ("c", "y")], "text string, lang string"), "text", "lang", pieces, ws, rounds=2)
    got = languages.predict(frame([("ab bc", "x")], "text string, lang string"), [F.col("lang")], "text", model).first()
    at = {p: i for i, p in enumerate(pieces)}
    sums = [
        model.log_prior[lang] + sum(math.log(sum(math.exp(sum(model.log_p[at[p], lang] for p in way)) for way in cuts(w, pieces))) for w in (b" ab", b" bc"))
        for lang in (0, 1)
    ]
    best = max((0, 1), key=lambda lang: sums[lang])
    assert got["lang_pred"] == "xy"[best] and got["score"] == pytest.approx(1 / sum(math.exp(s - max(sums)) for s in sums))


def test_nothing_to_learn(frame, ws):
    docs = frame([("some text", None), (None, None)], "text string, lang string")
    model = languages.learn(docs, "text", "lang", PIECES, ws)
    assert {tuple(r) for r in languages.predict(docs, [F.col("lang")], "text", model).collect()} == {(None, "und", 0.0)}
    assert languages.predict(docs.limit(0), [F.col("lang")], "text", model).collect() == []


def test_cut_texts_add_up(monkeypatch):
    """A text worked on in pieces has the words of the whole."""
    text = " ".join(f"w{i % 90}" for i in range(5000)) + " " + "y" * 3000
    whole = [w.word(i) for w, _ in languages._words_of(pa.array([text, "one two"])) for i in range(len(w.keys))]
    monkeypatch.setattr(languages, "CUT", 500)
    pieces = [(w.word(i), rows[w.text[i]]) for w, rows in languages._words_of(pa.array([text, "one two"])) for i in range(len(w.keys))]
    assert [w for w, _ in pieces] == whole and [r for w, r in pieces if w in (b" one", b" two")] == [1, 1]
    assert {r for _, r in pieces[:-2]} == {0}
