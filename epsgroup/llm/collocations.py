"""Phrases of words that belong together, from exact counts of all frequent word runs.

Runs of 1 to LONGEST words are counted in three passes (words, pairs of frequent words, longer runs of frequent pairs). In each
pass every task folds its runs by hash; the folded counts go to hash partitions, and each partition merges them into a
Misra-Gries summary whose capacity is above SLACK times its counted mass divided by the threshold. Such a summary undercounts by less
than a SLACKth of the threshold, so every frequent run survives, in memory bounded by the capacity. The survivors of a partition fill a stretch of a
bitmap that the next pass asks. A last pass over the texts counts the survivors exactly, by their words and not by hash.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.llm.words import LOWER, mix, slices
from epsgroup.operators.sizes import join_small
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

LONGEST = 5
PART_BYTES = 8 << 20  # text for each hash partition, as long as there are at most 2^PART_BITS
PART_BITS = 16
FOLDED = 1 << 19  # counts a task folds before it hands them on
SLACK = 8  # a summary may miss the threshold divided by this, so that little beside the frequent runs survives
MERGED = 1 << 18  # counts a summary takes up at a time, at least
MAX_BITS = 1 << 29  # of a bitmap; a fuller one lets more pass, and loses nothing
BITS_EACH = 16
CUT = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: `keys` hashes of word and language, `starts` and `ends` in `buf`, `piece` and `text` numbers."""

    def __init__(self, texts: list[bytes], langs: list[int]):
        self.buf = b"\n".join(texts) + b"\n"
        flat = np.frombuffer(self.buf, np.uint8)
        gap = _GAP[flat]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        self.starts, self.ends = edge[0::2], edge[1::2]
        long = self.ends - self.starts
        of = np.cumsum(long) - long
        place = np.arange(long.sum(), dtype=np.int32) - np.repeat(of.astype(np.int32), long)
        powers = np.cumprod(np.full(max(1, int(long.max(initial=0))), _STEP))
        terms = (flat[~gap].astype(np.uint64) + np.uint64(1)) * powers[place]
        sums = np.add.reduceat(terms, of) if len(of) else np.zeros(0, np.uint64)
        self.piece = np.cumsum(_BREAK[flat], dtype=np.int32)[self.starts]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, side="right")
        salt = np.array(langs, np.uint64)[self.text]
        self.keys = mix((sums ^ (long.astype(np.uint64) << np.uint64(48))) + salt)

    def runs(self, longest: int):
        """(n, hashes, valid) of the runs of 1, 2, ... words from each word on; a run must not cross pieces."""
        keys, n = self.keys, 1
        yield n, keys, np.ones(len(keys), bool)
        while n < longest and len(self.keys) > n:
            keys = mix(keys[:-1] * _STEP + self.keys[n:])
            n += 1
            yield n, keys, self.piece[n - 1 :] == self.piece[: len(keys)]

    def phrase(self, first: int, n: int) -> bytes:
        return b" ".join(self.buf[a:b] for a, b in zip(self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist(), strict=True))


def _pieces(texts: list[bytes], langs: list[int]):
    """Texts of some megabytes; a longer one is cut at breaks, which no run crosses."""
    for text, lang in zip(texts, langs, strict=True):
        while len(text) > 2 * CUT and (found := _BREAKS.search(text, CUT)):
            yield text[: found.end()], lang
            text = text[found.end() :]
        yield text, lang


def _words_of(batches):
    """(Words, languages) of a few megabytes of text at a time. Batches have a text and a language column."""
    salts: dict[str, int] = {}
    for batch in batches:
        names = batch.column(1).to_pylist()
        for name in set(names) - set(salts):
            salts[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest())
        for first, texts in slices(batch.column(0), limit=CUT, table=LOWER):
            held, size, tongues = [], 0, []
            own = names[first : first + len(texts)]
            for text, lang in _pieces(texts, own):
                held.append(text)
                tongues.append(lang)
                size += len(text)
                if size >= CUT:
                    yield Words(held, [salts[x] for x in tongues]), tongues
                    held, size, tongues = [], 0, []
            if held:
                yield Words(held, [salts[x] for x in tongues]), tongues


def asked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the first bits of the hash say which it is."""
    bit = keys >> np.uint64(65 - (8 * len(bitmap)).bit_length())
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal hashes added up, sorted by hash."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Summary:
    """A mergeable Misra-Gries summary. Each count is too low by `lost` at most, and lost * (capacity + 1) <= mass."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(keys) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += cut
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
        self.keys, self.counts = keys, counts

    def reaching(self, threshold: int) -> np.ndarray:
        """All hashes whose true count may reach the threshold: no frequent one is missing if capacity >= mass / threshold."""
        return self.keys[self.counts + self.lost >= threshold]


FOLD = "part int, mass long, hashes binary, counts binary"


def _fold(batches, order: range, bits: int, filters: list):
    """Counts of the runs whose words (order 2) or pairs (order 3 and more) are in the bitmap, folded by hash, by partition."""
    held: list[tuple] = []

    def out():
        keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else [0, len(keys)]
        rows = [(p, int(counts[a:b].sum()), keys[a:b].tobytes(), counts[a:b].tobytes()) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [()] * 4, kinds, strict=True)], ["part", "mass", "hashes", "counts"])

    for words, _ in _words_of(batches):
        good = None
        for n, keys, valid in words.runs(order[-1]):
            if filters and n == order[0] - 1:
                good = asked(filters[0], keys) & valid
            if n in order:
                if good is not None:
                    for shift in range(n - order[0] + 2):
                        valid = valid & good[shift : shift + len(valid)]
                held.append(np.unique(keys[valid], return_counts=True))
        if sum(len(k) for k, _ in held) > FOLDED:
            held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if len(held[0][0]) > FOLDED // 2:
                yield out()
                held = []
    if held:
        yield out()


def _survive(batches, threshold: int):
    """Hashes of each partition that may be frequent. Rows come sorted by partition and kind: first its mass, then its counts."""
    part, summary, keys, counts = None, None, [], []

    def taken():
        if keys:
            summary.merge(np.concatenate(keys), np.concatenate(counts))
            keys.clear()
            counts.clear()

    def out():
        taken()
        found = summary.reaching(threshold)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["part", "n", "hashes"])

    for batch in batches:
        for number, mass, own, n in zip(*(batch.column(i) for i in (0, 1, 2, 3)), strict=True):
            if number.as_py() != part:
                if summary:
                    yield out()
                part, summary = number.as_py(), Summary(SLACK * mass.as_py() // threshold + 1)
                continue
            keys.append(np.frombuffer(own.as_buffer(), np.uint64))
            counts.append(np.frombuffer(n.as_buffer(), np.int64))
            if sum(map(len, keys)) > max(MERGED, summary.capacity):
                taken()
    if summary:
        yield out()


def _bits(batches, parts: int, size: int):
    """The stretch of the bitmap that each partition fills."""
    for batch in batches:
        out = []
        for part, hashes in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            bit = np.frombuffer(hashes.as_buffer(), np.uint64) >> np.uint64(65 - size.bit_length())
            flags = np.zeros(size // parts, bool)
            flags[(bit - np.uint64(part * (size // parts))).astype(np.int64)] = True
            out.append(np.packbits(flags, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["part", "bits"])


def _candidates(texts: DataFrame, order: range, shared, bits: int, threshold: int, ws: Workspace) -> np.ndarray:
    """A bitmap of at most MAX_BITS bits with the bits of all runs of so many words that may be frequent."""
    name = f"runs-{order[0]}"
    folded = texts.mapInArrow(lambda b: _fold(b, order, bits, [s.value for s in shared]), FOLD)
    folded = ws.save(folded, name)
    mass = folded.groupBy("part").agg(F.sum("mass").alias("mass")).withColumns({"hashes": F.lit(b""), "counts": F.lit(b""), "kind": F.lit(0)})
    rows = folded.withColumn("kind", F.lit(1)).unionByName(mass).repartition("part").sortWithinPartitions("part", "kind")
    found = rows.select("part", "mass", "hashes", "counts").mapInArrow(lambda b: _survive(b, threshold), "part int, n long, hashes binary")
    found = ws.save(found, f"{name}-found")
    total = found.agg(F.sum("n")).first()[0] or 0
    size = max(8 << bits, min(MAX_BITS, 1 << (BITS_EACH * total).bit_length()))
    bitmap = np.zeros(size // 8, np.uint8)
    step = len(bitmap) >> bits
    for row in found.mapInArrow(lambda b: _bits(b, 1 << bits, size), "part int, bits binary").toLocalIterator():
        bitmap[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


COUNTED = "lang string, words int, phrase string, n long"


class Counts:
    """Counts of runs by hash, with the words of each run, which are only looked up when a run is new."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.langs, self.phrases = np.zeros(0, object), np.zeros(0, object)

    def add(self, words: Words, langs: list[str], keys: np.ndarray, at: np.ndarray, n: int) -> None:
        """Count the runs of n words that begin at the words `at`."""
        unique, first, counts = np.unique(keys[at], return_index=True, return_counts=True)
        place = np.searchsorted(self.keys, unique)
        old = np.zeros(len(unique), bool)
        if len(self.keys):
            old = self.keys[np.minimum(place, len(self.keys) - 1)] == unique
        self.counts[place[old]] += counts[old]
        begin, place = at[first[~old]], place[~old]
        named, said = np.empty(len(begin), object), np.empty(len(begin), object)
        named[:] = [langs[t] for t in words.text[begin].tolist()]
        said[:] = [words.phrase(i, n).decode() for i in begin.tolist()]
        self.langs, self.phrases = np.insert(self.langs, place, named), np.insert(self.phrases, place, said)
        self.keys, self.counts = np.insert(self.keys, place, unique[~old]), np.insert(self.counts, place, counts[~old])


def _count(batches, shared):
    """Exact counts of the runs in the bitmaps, by words; with 0 words, all words of a language."""
    filters = [shared[0], shared[1], *[shared[2]] * (LONGEST - 2)]
    found = [Counts() for _ in filters]
    totals: dict[str, int] = {}

    def out():
        for n, own in enumerate(found, 1):
            yield pa.RecordBatch.from_arrays([pa.array(own.langs, pa.string()), pa.array(np.full(len(own.keys), n, np.int32)), pa.array(own.phrases, pa.string()), pa.array(own.counts)], ["lang", "words", "phrase", "n"])
        rows = [[*totals], [0] * len(totals), [""] * len(totals), [*totals.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "words", "phrase", "n"])

    for words, langs in _words_of(batches):
        for text, n in enumerate(np.bincount(words.text, minlength=len(langs)).tolist()):
            totals[langs[text]] = totals.get(langs[text], 0) + n
        for n, keys, valid in words.runs(LONGEST):
            found[n - 1].add(words, langs, keys, np.flatnonzero(valid & asked(filters[n - 1], keys)), n)
        if sum(len(own.keys) for own in found) > FOLDED // 2:
            yield from out()
            found, totals = [Counts() for _ in filters], {}
    yield from out()


def frequent(docs: DataFrame, text_col: str, lang_col: str, threshold: int, ws: Workspace) -> DataFrame:
    """(lang, words, phrase, n): all runs of 1 to LONGEST words that occur `threshold` times or more in a language, and with
    0 words the number of words of each language.

    Texts are lower-cased (A-Z), split at . , ; : ! ? and \\n to \\r into pieces and those at spaces and tabs into words;
    occurrences may overlap. A null text is empty, a null language is `und`; repeated rows count each; other columns are
    ignored; an empty table gives no rows. A piece has to fit into a task, a text does not.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(PART_BITS, max(1, (size // PART_BYTES).bit_length()))
    shared = []
    for order in (range(1, 2), range(2, 3), range(3, LONGEST + 1)):
        bitmap = _candidates(texts, order, shared[-1:], bits, threshold, ws)
        shared.append(spark.sparkContext.broadcast(bitmap))
    counted = texts.mapInArrow(lambda b: _count(b, [s.value for s in shared]), COUNTED)
    counted = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return ws.save(counted.where((F.col("n") >= threshold) | (F.col("words") == 0)), "frequent")


def mine(docs: DataFrame, text_col: str, lang_col: str, threshold: int, top: int, ws: Workspace) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to LONGEST words of each language that hold together best.

    A phrase that occurs a times and is cut after its first k words into parts that occur l and r times scores
    floor(1000 a n / (l r)); its lowest cut counts (ties: smallest k). Phrases inside a longer frequent one that occurs as often
    are left out. The first `top` by score and a (both falling) and phrase are ranked from 1. See `frequent` for the rest.
    """
    known = frequent(docs, text_col, lang_col, threshold, ws)
    totals = known.where("words = 0").select("lang", F.col("n").alias("total"))
    known = known.where("words > 0")
    parts = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    phrases = known.where("words > 1").withColumn("split", F.split("phrase", " "))
    # A phrase inside a much longer one that occurs as often lies in one longer by a word that occurs as often, too.
    longer = phrases.where("words > 2").select("lang", "n", F.explode(F.array(F.slice("split", 1, F.col("words") - 1), F.slice("split", 2, F.col("words") - 1))).alias("inner"))
    longer = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("n").alias("held"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where("held IS NULL OR held < n").drop("held")
    k = F.col("k")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "split", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice("split", F.lit(1), k), " "), "right": F.array_join(F.slice("split", k + 1, F.col("words") - k), " ")})
    cuts = cuts.drop("split", "words").join(parts.withColumnsRenamed({"part": "left", "times": "l"}), ["lang", "left"])
    cuts = cuts.join(parts.withColumnsRenamed({"part": "right", "times": "r"}), ["lang", "right"])
    cuts = join_small(cuts, totals, "lang", totals.count())
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "total")}
    cuts = cuts.withColumns(exact).withColumn("score", F.expr("(a * total * CAST(1000 AS DECIMAL(4,0))) div (l * r)"))
    whole = {c: F.col(c).cast("long") for c in ("a", "l", "r", "total")}
    best = cuts.withColumns(whole).groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.expr(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
