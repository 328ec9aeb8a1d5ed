import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from epsgroup.llm import scoring
from epsgroup.llm.words import LOWER

ORDER = scoring.ORDER


class Twin:
    """Prediction by partial matching, one byte at a time."""

    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(ORDER + 1)]
        for text in texts:
            buf = b"\xff" * ORDER + text + b"\xff"
            for at in range(ORDER, len(buf)):
                for order in range(ORDER + 1):
                    self.seen[order][buf[at - order : at]][buf[at]] += 1

    def score(self, text):
        buf, total = b"\xff" * ORDER + text + b"\xff", 0.0
        for at in range(ORDER, len(buf)):
            out = set()
            for order in range(ORDER, -1, -1):
                counts = self.seen[order].get(buf[at - order : at], {})
                left = {s: c for s, c in counts.items() if s not in out}
                if not left:
                    continue
                size = sum(left.values()) + len(left)
                if buf[at] in left:
                    total += math.log10(left[buf[at]] / size)
                    break
                total += math.log10(len(left) / size)
                out |= set(left)
            else:
                total -= math.log10(256 - len(out))
        return total


TEXTS = ["The cat sat on the mat.", "the hat, the BAT\n\nand the rat", None, "", " \t ", "zebra éclair " * 9, "the cat sat on the mat.", "q"]


@pytest.mark.parametrize("learnt", ["doc_id % 3 <> 0", "false", "true", "cast(null as boolean)"])
def test_scores(frame, ws, learnt, monkeypatch):
    monkeypatch.setattr(scoring, "BLOB_BYTES", 40)
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 60)
    learnt = F.expr(learnt)
    rows = list(enumerate(TEXTS))
    docs = frame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.score(docs, "doc_id", "text", learnt, ws).collect()}
    raw = {i: (t or "").encode().translate(LOWER) for i, t in rows}
    learns = {r["doc_id"]: bool(r["l"]) for r in docs.select("doc_id", learnt.alias("l")).collect()}
    twin = Twin([raw[i] for i in raw if learns[i]])
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t), b""] for i, t in raw.items()}
    counts = Counter(w for i, own in tokens.items() if learns[i] for w in own)
    total, different = sum(counts.values()), len(counts)
    for i in raw:
        r = got[i]
        assert r["held_out"] == (not learns[i]) and r["train_tokens"] == total
        assert r["n_tokens"] == len(tokens[i]) and r["n_known"] == sum(w in counts for w in tokens[i])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in tokens[i])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(twin.score(raw[i]), rel=1e-9)


def test_repeats_nulls_and_empty(frame, ws):
    docs = frame([(1, "a b"), (1, "a b"), (None, "a c")], "doc_id long, text string")
    assert scoring.score(docs, "doc_id", "text", F.lit(True), ws).count() == 3
    assert scoring.score(docs.limit(0), "doc_id", "text", F.lit(True), ws).count() == 0


def test_lookup():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    look = scoring.Lookup(np.concatenate([keys, keys[:100]]), np.arange(5100.0))
    found = look(keys)
    assert np.all((found == np.arange(5000)) | (found == np.arange(5000) + 5000))
    with pytest.raises(KeyError):
        look(np.array([12345]))
