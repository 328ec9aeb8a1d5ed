"""Language of a text, by piece probabilities of each language summed over all ways to cut the text into pieces.

The pieces are a fixed public vocabulary and the 256 bytes, so every text can be cut. A word is its bytes behind a space, which
is where pieces begin; the ways to cut a text are those to cut its words, so each different word of some megabytes is summed
once. Piece probabilities come from expectation-maximisation over the counted words of each language: forward and backward sums
give the pieces a word is expected to use.
"""

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsgroup.llm.words import mix, slices
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

ROUNDS = 3
SMOOTH = 0.1  # added to the expected count of every piece
LONGEST = 64  # bytes of a word; longer ones go on as words without a space in front
MAX_LANGS = 1000  # the model holds a number for each piece and language
NODES = 1 << 20  # sums held at a time
HELD = 1 << 18  # different words a task counts before it hands them on
CACHE_BYTES = 48 << 20  # scores of words a worker keeps
CUT = 4 << 20
UNKNOWN = "und"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary of byte strings as a trie: `after` gives the node behind a node and byte (0: none), `piece` the piece there."""

    def __init__(self, pieces: list[bytes]):
        after, ends = [[0] * 256], {}
        for number, text in enumerate(pieces):
            node = 0
            for byte in text:
                if not after[node][byte]:
                    after[node][byte] = len(after)
                    after.append([0] * 256)
                node = after[node][byte]
            ends[node] = number
        self.after = np.array(after, np.int32)
        self.piece = np.full(len(after), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, pieces))

    def edges(self, flat: np.ndarray, left: np.ndarray):
        """(position, length, piece) of all pieces found in some bytes; `left` counts the bytes to the end of the word."""
        at, node = np.arange(len(flat)), np.zeros(len(flat), np.int32)
        for n in range(1, self.longest + 1):
            there = left[at] >= n
            at, node = at[there], node[there]
            node = self.after[node, flat[at + n - 1]]
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                return
            found = self.piece[node]
            yield at[found >= 0], n, found[found >= 0]


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece file as bytes, with a space for its word mark, and every single byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return sorted({t.replace("▁", " ").encode() for t in texts} | {bytes([b]) for b in range(256)})


_tries: dict[int, Pieces] = {}


def _trie(pieces: list[bytes]) -> Pieces:
    """One trie for each vocabulary and worker."""
    key = hash(tuple(pieces))
    if key not in _tries:
        _tries.clear()
        _tries[key] = Pieces(pieces)
    return _tries[key]


class Lattice:
    """All cuts of some words into pieces, in steps of edges that start at the same place of their word and are equally long."""

    def __init__(self, trie: Pieces, words: list[bytes]):
        size = np.array([len(w) for w in words], np.int64)
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(self.flat)) - first[word]
        found = [(p, np.full(len(p), n), x) for p, n, x in trie.edges(self.flat, size[word] - place)]
        at, long, piece = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        order = np.argsort((place[at] * (trie.longest + 1) + long).astype(np.uint16 if LONGEST * trie.longest < 1 << 15 else int), kind="stable")
        at, long, self.piece = at[order], long[order], piece[order]
        self.word = word[at]
        self.source = at + self.word  # a word of n bytes has n + 1 nodes
        self.target = self.source + long
        self.start, self.end = first + np.arange(len(words)), first + size + np.arange(len(words))
        change = np.flatnonzero(np.diff(place[at]) | np.diff(long)) + 1
        self.steps = list(zip([0, *change], [*change, len(at)], strict=True)) if len(at) else []
        self.nodes = len(self.flat) + len(words)

    def forward(self, weight) -> np.ndarray:
        """Log sums of all ways from the start of a word to each node. weight(a, b): log probabilities of those edges."""
        for k, (a, b) in enumerate(self.steps):
            w = weight(a, b)
            if not k:
                total = np.full((self.nodes, *w.shape[1:]), -np.inf)
                total[self.start] = 0.0
            total[self.target[a:b]] = np.logaddexp(total[self.target[a:b]], total[self.source[a:b]] + w)
        return total

    def backward(self, weight) -> np.ndarray:
        """The same from each node to the end of the word."""
        total = np.full(self.nodes, -np.inf)
        total[self.end] = 0.0
        for a, b in reversed(self.steps):
            total[self.source[a:b]] = np.logaddexp(total[self.source[a:b]], total[self.target[a:b]] + weight(a, b))
        return total


def word_scores(trie: Pieces, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: over all its cuts, the sum of the products of piece probabilities."""
    out = np.zeros((len(words), log_p.shape[1]))
    step = max(1, NODES // (12 * log_p.shape[1]))
    for a in range(0, len(words), step):
        lattice = Lattice(trie, words[a : a + step])
        out[a : a + step] = lattice.forward(lambda i, j, own=lattice: log_p[own.piece[i:j]])[lattice.end]
    return out


class Scores:
    """The scores of the words seen last, kept by hash, CACHE_BYTES at most."""

    def __init__(self, trie: Pieces, log_p: np.ndarray):
        self.trie, self.log_p, self.limit = trie, log_p, CACHE_BYTES // (8 + 8 * log_p.shape[1])
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, log_p.shape[1]))

    def of(self, words: "Words") -> tuple[np.ndarray, np.ndarray]:
        """(scores of the different words, number of the different word that each word is)."""
        keys, first, which = np.unique(words.keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            hit = self.keys[at] == keys
        out = np.empty((len(keys), self.log_p.shape[1]))
        out[hit] = self.values[at[hit]]
        out[~hit] = word_scores(self.trie, [words.word(i) for i in first[~hit].tolist()], self.log_p)
        if len(self.keys) + len(keys) - hit.sum() > self.limit:
            self.keys, self.values = keys[:0], out[:0]
        all_keys = np.concatenate([self.keys, keys[~hit]])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.values = all_keys[order], np.concatenate([self.values, out[~hit]])[order]
        return out, which


_scores: dict[str, Scores] = {}


def _cached(token: str, trie: Pieces, log_p: np.ndarray) -> Scores:
    """The scores a worker has made with one model, over all its tasks."""
    if token not in _scores:
        _scores.clear()
        _scores[token] = Scores(trie, log_p)
    return _scores[token]


def expected(trie: Pieces, words: list[bytes], counts: np.ndarray, langs: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by each language, over these words and how often each occurs in its language."""
    out = np.zeros(log_p.size)
    for a in range(0, len(words), NODES // 12):
        lattice = Lattice(trie, words[a : a + NODES // 12])
        lang, n = langs[a : a + NODES // 12][lattice.word], counts[a : a + NODES // 12][lattice.word]
        weights = log_p[lattice.piece, lang]
        forward, backward = lattice.forward(lambda i, j, w=weights: w[i:j]), lattice.backward(lambda i, j, w=weights: w[i:j])
        share = np.exp(forward[lattice.source] + weights + backward[lattice.target] - forward[lattice.end][lattice.word])
        out += np.bincount(lattice.piece * log_p.shape[1] + lang, share * n, log_p.size)
    return out.reshape(log_p.shape)


class Words:
    """The words of some texts: `keys` hashes, `text` numbers, and the bytes of word i by `word(i)`."""

    def __init__(self, texts: list[bytes]):
        self.buf = b" ".join(texts) + b" "
        flat = np.frombuffer(self.buf, np.uint8)
        space = _SPACE[flat]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        chunks = -(-(ends - starts) // LONGEST)
        nth = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.starts = np.repeat(starts, chunks) + LONGEST * nth
        self.ends = np.minimum(self.starts + LONGEST, np.repeat(ends, chunks))
        self.opens = nth == 0
        long = self.ends - self.starts
        of = np.cumsum(long) - long
        place = np.arange(long.sum(), dtype=np.int32) - np.repeat(of.astype(np.int32), long)
        terms = (flat[~space].astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(LONGEST, _STEP))[place]
        sums = np.add.reduceat(terms, of) if len(of) else np.zeros(0, np.uint64)
        self.keys = mix(sums ^ ((2 * long + self.opens).astype(np.uint64) << np.uint64(48)))
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, side="right")

    def word(self, i: int) -> bytes:
        return (b" " if self.opens[i] else b"") + self.buf[self.starts[i] : self.ends[i]]


def _words_of(texts):
    """(Words, rows) of a few megabytes at a time. A longer text is cut at white space, so a row may come several times."""
    for first, held in slices(texts, table=None):
        some, rows, size = [], [], 0
        for row, text in enumerate(held, first):
            while len(text) > 2 * CUT and len(found := text[CUT:].split(None, 1)) == 2:
                yield Words([text[: len(text) - len(found[1])]]), [row]
                text = found[1]
            some.append(text)
            rows.append(row)
            size += len(text)
            if size >= CUT:
                yield Words(some), rows
                some, rows, size = [], [], 0
        if some:
            yield Words(some), rows


def _counted(batches):
    """(lang, word, n): the words of the texts of each language, folded."""
    found: dict[tuple, int] = {}

    def out():
        names, words = [*zip(*found, strict=True)] or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        langs = batch.column(1).to_pylist()
        code = {name: i for i, name in enumerate(sorted(set(langs)))}
        for words, rows in _words_of(batch.column(0)):
            own = np.array([code[langs[r]] for r in rows])[words.text]
            salted = words.keys + mix(own.astype(np.uint64))
            _, first, counts = np.unique(salted, return_index=True, return_counts=True)
            for i, n in zip(first.tolist(), counts.tolist(), strict=True):
                key = langs[rows[words.text[i]]], words.word(i)
                found[key] = found.get(key, 0) + n
            if len(found) > HELD:
                yield out()
                found = {}
    yield out()


@dataclass
class Model:
    """`log_p` has the log probability of each piece in each language, `log_prior` that of the language."""

    pieces: list[bytes]
    langs: list[str]
    log_prior: np.ndarray
    log_p: np.ndarray


def learn(docs: DataFrame, text_col: str, lang_col: str, pieces: list[bytes], ws: Workspace, rounds: int = ROUNDS) -> Model:
    """A model of the texts of every language. Null texts are empty, rows with a null language are left out.

    Every word of every row counts. What tasks share is a number for each piece and language; more than MAX_LANGS languages
    are an error.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = [r["lang"] for r in sizes]
    log_prior = np.log(np.array([r["count"] for r in sizes], float) / max(1, sum(r["count"] for r in sizes)))
    log_p = np.full((len(pieces), len(langs)), -np.log(len(pieces)))
    if not langs:
        return Model(pieces, langs, log_prior, log_p)
    words = rows.mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = ws.save(words, "words")
    code = {name: i for i, name in enumerate(langs)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, log_p))

        def uses(batches, shared=shared):
            trie, total = _trie(shared.value[0]), 0
            for batch in batches:
                own = np.array([code[x] for x in batch.column(0).to_pylist()], int)
                total = total + expected(trie, batch.column(1).to_pylist(), batch.column(2).to_numpy(), own, shared.value[1])
            piece, lang = np.nonzero(total) if np.ndim(total) else ((), ())
            uses = total[piece, lang] if np.ndim(total) else ()
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(uses, pa.float64())], ["piece", "lang", "uses"])

        found = words.mapInArrow(uses, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        counts = np.full(log_p.shape, SMOOTH)
        counts[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("uses").to_numpy()
        log_p = np.log(counts / counts.sum(0))
    return Model(pieces, langs, log_prior, log_p)


def predict(docs: DataFrame, keep: list[Column], text_col: str, model: Model) -> DataFrame:
    """The columns `keep`, lang_pred and score for every row: the likeliest language of the whole text and its probability.

    A text that is null or has no letter is `und` with score 0, as is every text if no language was learned. Equally likely
    languages: the first by name. Repeated rows are rows of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    packed = docs.select(F.struct(*keep).alias("row"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    shared = spark.sparkContext.broadcast(model)

    token = uuid.uuid4().hex

    def decide(batches):
        model = shared.value
        scores = _cached(token, _trie(model.pieces), model.log_p)
        for batch in batches:
            texts = batch.column(1)
            total = np.tile(model.log_prior, (batch.num_rows, 1))
            for words, rows in _words_of(texts) if model.langs else ():
                found, which = scores.of(words)
                for lang in range(len(model.langs)):
                    total[rows, lang] += np.bincount(words.text, found[which, lang], len(rows))
            sure = texts.is_valid().to_numpy(zero_copy_only=False) & (len(model.langs) > 0)
            best = total.argmax(1) if model.langs else np.zeros(len(total), int)
            score = 1 / np.exp(total - total.max(1, initial=-np.inf)[:, None]).sum(1) if model.langs else np.zeros(len(total))
            names = np.array([*model.langs, UNKNOWN], object)[np.where(sure, best, len(model.langs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(sure, score, 0.0))], ["row", "lang_pred", "score"])

    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(decide, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")
