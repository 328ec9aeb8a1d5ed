"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a linear scorer.

Labellers look at one property each and vote good, bad or not at all. Texts are counted by their pattern of votes (at most
3 ** labellers patterns), and the driver estimates from these counts what each labeller votes on good texts and on the kinds of bad
ones (after Dawid and Skene) and how likely each pattern is good. With these labels a bounded sample of at most SAMPLE texts, those of
the lowest hash, trains a logistic regression over hashed words and word shapes, which then decides on every text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.llm.words import LOWER, hashed, mix, slices
from epsgroup.ship import ship

SAMPLE = 4096
BUCKETS = 1 << 14
KEEP = 0.25  # texts go only on clear evidence: very short ones give the scorer little to go by
BAD, NONE, GOOD = 0, 1, 2

# (property, bad below, good from, good up to, bad above): outside of these a labeller does not vote.
LABELLERS = (
    ("repeated", -1, 0, 0.03, 0.08),  # words equal to the one before
    ("capitals", -1, 0, 0.06, 0.15),  # capital letters among letters
    ("symbols", -1, 0, 0.005, 0.02),  # bytes that are neither letter, digit, space nor plain punctuation
    ("marked", -1, 0, 0.02, 0.10),  # words with such a byte
    ("shouted", -1, 0, 0.05, 0.20),  # words with several capital letters
    ("different", 0.40, 0.55, 1, 2),  # different words among words
    ("lines", -1, 0, 0.10, 0.40),  # lines that occurred before in the text
    ("length", 4.0, 5.0, 7.0, 8.0),  # bytes per word
)
LEAST_WORDS = {"repeated": 20, "capitals": 10, "symbols": 4, "marked": 10, "shouted": 10, "different": 20, "length": 20}

_LETTER, _CAPITAL, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF8)]] = True
_CAPITAL[65:91] = True
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-"]] = True
# Shapes: letters, capitals, digits and other bytes beyond ASCII become one character each, what else there is stays.
_SHAPE = bytes(
    ord("x") if 97 <= b <= 122 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b for b in range(256)
)


def _share(part, whole):
    return part / np.maximum(1, whole)


class Texts:
    """The properties and hashed features of some texts."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" "
        buf = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = ends - np.array([len(t) + 1 for t in texts])
        self.word, starts = hashed(np.frombuffer(joined.translate(LOWER), np.uint8))
        self.owner = np.searchsorted(ends, starts, "right")
        n = self.n = np.bincount(self.owner, minlength=len(texts))
        own = mix(self.word + self.owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        different = np.bincount(self.owner[np.unique(own, return_index=True)[1]], minlength=len(texts))
        self.again = np.zeros(len(own), bool)
        self.again[1:] = own[1:] == own[:-1]
        # Accented capitals of two bytes (C3 80 to C3 9E).
        wide = np.zeros(len(buf), bool)
        wide[:-1] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        letters, capitals, symbols = (np.add.reduceat(x.astype(np.int64), first) for x in (_LETTER[buf], _CAPITAL[buf] | wide, _SYMBOL[buf]))
        size = np.array([len(t) for t in texts])
        marks, shouts = (
            np.bincount(self.owner, np.add.reduceat(x.astype(np.int64), starts) >= least, len(texts)) if len(starts) else np.zeros(len(texts))
            for x, least in ((_SYMBOL[buf], 1), (_CAPITAL[buf] | wide, 2))
        )
        lines = [t.split(b"\n") for t in texts]
        many = np.array([len(x) for x in lines])
        self.properties = {
            "repeated": _share(np.bincount(self.owner, self.again, len(texts)), n),
            "capitals": _share(capitals, letters),
            "symbols": _share(symbols, size),
            "marked": _share(marks, n),
            "shouted": _share(shouts, n),
            "different": _share(different, n),
            "lines": 1 - _share(np.array([len(set(x)) for x in lines]), many),
            "length": _share(size, n),
        }
        self.buf = np.frombuffer(joined.translate(_SHAPE), np.uint8)

    def votes(self) -> np.ndarray:
        """(texts, labellers). A text without words gets no vote."""
        out = np.full((len(self.n), len(LABELLERS)), NONE, np.int8)
        for i, (name, low, good, up, high) in enumerate(LABELLERS):
            value = self.properties[name]
            out[(value >= good) & (value <= up), i] = GOOD
            out[(value < low) | (value > high), i] = BAD
            out[self.n < LEAST_WORDS.get(name, 1), i] = NONE
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, weight) of the words, their shapes and repeats, scaled to length 1 for each text."""
        same = np.zeros(len(self.buf), bool)
        same[1:] = self.buf[1:] == self.buf[:-1]
        shape, _ = hashed(self.buf[~same | (self.buf == 32)])
        again = np.where(self.again, np.uint64(1), np.uint64(2))
        kinds = np.concatenate([self.word, shape ^ np.uint64(0xA5A5), again]) & np.uint64(BUCKETS - 1)
        key, n = np.unique(np.tile(self.owner, 3).astype(np.uint64) * np.uint64(BUCKETS) + kinds, return_counts=True)
        text, bucket = (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int64)
        length = np.sqrt(np.bincount(text, n.astype(float) ** 2, len(self.n)))
        return text, bucket, n / length[text]


def code(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ 3 ** np.arange(len(LABELLERS))


def accuracies(patterns: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good texts, P(vote | bad or good) by labeller, P(good) by pattern) from the counts of patterns.

    Bad texts are bad in one of several ways, as many as there are labellers, since labellers that see the same flaw agree. Starts
    from "bad in the ways that labellers say" and adds one to every count, so no labeller is ever taken for infallible. A
    labeller that does not vote says nothing: short texts, on which few vote, are not suspect for that.
    """
    m = len(LABELLERS)
    if not patterns:
        return 0.5, np.full((m, 2, 3), 1 / 3), {}
    codes, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    votes = codes[:, None] // 3 ** np.arange(m) % 3
    bad = votes == BAD
    some = bad.any(1)
    kinds = np.column_stack([np.where(some, 0.1, 0.9), np.where(some[:, None], 0.9 * bad / np.maximum(1, bad.sum(1, keepdims=True)), 0.1 / m)])
    for _ in range(rounds):
        share = (n @ kinds + 1) / (n.sum() + m + 1)
        said = np.ones((m, m + 1, 3))
        for vote in (BAD, GOOD):
            said[:, :, vote] += ((n[:, None] * kinds).T @ (votes == vote)).T
        said[:, :, NONE] = 0
        said /= said.sum(2, keepdims=True)
        said[:, :, NONE] = 1
        logs = np.log(share) + np.log(said[np.arange(m), :, votes]).sum(1)
        next_ = np.exp(logs - logs.max(1, keepdims=True))
        next_ /= next_.sum(1, keepdims=True)
        if np.abs(next_ - kinds).max() < 1e-9:
            break
        kinds = next_
    worst = (said[:, 1:] * share[1:, None]).sum(1) / share[1:].sum()
    both = np.stack([worst, said[:, 0]], axis=1)
    return float(share[0]), both, dict(zip(codes.tolist(), kinds[:, 0].tolist(), strict=True))


def train(row, bucket, weight, target, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on soft targets, by full-batch gradient steps."""
    weights = np.zeros(BUCKETS + 1)
    n = max(1, len(target))
    for _ in range(rounds):
        margin = np.bincount(row, weights[bucket] * weight, len(target)) + weights[-1]
        gap = 1 / (1 + np.exp(-margin)) - target
        step = np.append(np.bincount(bucket, gap[row] * weight, BUCKETS), gap.sum())
        weights -= rate * (step / n + decay * weights)
    return weights


def _counted(batches):
    for batch in batches:
        for _, texts in slices(batch.column(0), table=None):
            codes, n = np.unique(code(Texts(texts).votes()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])


def _featured(batches):
    for batch in batches:
        for _, texts in slices(batch.column(0), table=None):
            own = Texts(texts)
            text, bucket, weight = own.features()
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (bucket, weight)]
            yield pa.RecordBatch.from_arrays([pa.array(code(own.votes())), *lists], ["code", "bucket", "weight"])


def _score(own: Texts, weights: np.ndarray) -> np.ndarray:
    text, bucket, weight = own.features()
    margin = np.bincount(text, weights[bucket] * weight, len(own.n)) + weights[-1]
    return np.where(own.n > 0, 1 / (1 + np.exp(-margin)), 0.0)


def _kept(batches, at, weights):
    for batch in batches:
        for first, texts in slices(batch.column(at), table=None):
            yield batch.slice(first, len(texts)).filter(pa.array(_score(Texts(texts), weights) >= KEEP))


def _scored(batches, weights, likely):
    for batch in batches:
        for first, texts in slices(batch.column(1), table=None):
            own = Texts(texts)
            score = _score(own, weights)
            votes = own.votes()
            label = [likely[c] for c in code(votes).tolist()]
            bad = (votes == BAD).sum(1).astype(np.int64)
            arrays = [batch.column(0).slice(first, len(texts)), pa.array(bad), pa.array(label, pa.float64()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "bad_votes", "weak_label", "score"])


def fit(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, dict[int, float]]:
    """(weights of the scorer, P(good) by pattern of votes)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    counts = rows.select("text").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    likely = accuracies({r["code"]: r["n"] for r in counts})[2]
    # Only rows below a cut that leaves a few more than SAMPLE are sorted. Equal rows draw alike, so where rows repeat the cut may
    # leave too few, and is raised.
    total = sum(r["n"] for r in counts)
    share = min(1.0, (SAMPLE + 10 * SAMPLE**0.5 + 40) / max(1, total))
    while True:
        low = rows.where(F.shiftrightunsigned(F.xxhash64("doc", "text"), 1) <= min((1 << 63) - 1, int(share * (1 << 63))))
        sample = low.orderBy(F.xxhash64("doc", "text"), "doc", "text").limit(SAMPLE).select("text")
        sample = sample.mapInArrow(_featured, "code long, bucket array<long>, weight array<double>").toArrow()
        if share == 1.0 or sample.num_rows >= min(SAMPLE, total):
            break
        share = min(1.0, 8 * share)
    lists = sample.column("bucket").combine_chunks(), sample.column("weight").combine_chunks()
    many = np.array([len(x) for x in lists[0]], np.int64)
    values = [x.flatten().to_numpy() for x in lists]
    target = np.array([likely[c] for c in sample.column("code").to_pylist()])
    return train(np.repeat(np.arange(len(many)), many), *values, target), likely


def keep(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that `classify` keeps, with all their columns and without a shuffle."""
    weights, _ = fit(docs, id_col, text_col)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _kept(b, at, weights), docs.schema)


def classify(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, bad_votes, weak_label, score, kept), one row per input row; kept means score >= KEEP.

    `weak_label` is the probability of good given the votes. A null, empty or blank text gets no votes, score 0, and is not
    kept. Equal texts get equal scores; null and repeated ids and other columns do not matter; an empty table gives no rows.
    """
    weights, likely = fit(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, bad_votes long, weak_label double, score double"
    scored = rows.mapInArrow(lambda b: _scored(b, weights, likely), schema)
    return scored.select(F.col("doc").alias(id_col), "bad_votes", "weak_label", "score", (F.col("score") >= KEEP).alias("kept"))
