"""Language-model scores by prediction by partial matching over bytes, next to a smoothed word model.

Model. A trie of byte contexts up to ORDER bytes, counted over the training texts. A byte is coded in the longest context
that was seen: with method C a context of total T with D different bytes gives a byte seen c times c/(T+D) and an escape
D/(T+D). After an escape the next shorter context is used, without the bytes of the longer one (exclusion); at the end
all bytes left are equally likely. Each text is closed by the byte 255, which UTF-8 never has, and starts after ORDER of them.

Work. What a byte costs depends on its gram (context and byte) only. Texts are dealt to chunks of about CHUNK_BYTES; each
chunk sends its distinct grams and words once, with their training counts. They are summed over chunks, the trie is
worked out level by level from short to long grams by joins, and each chunk gets back the costs of its own grams, so
no task and no broadcast holds the model, however large it grows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epsgroup.llm.words import slices, words
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

ORDER = 5
CHUNK_BYTES = 40 << 20
BLOB_BYTES = 1 << 20
CLOSE = b"\xff"
_END_WORD = np.int64(0)  # stands for the end among words
GRAM, WORD = 0, 1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte and close, number of them per text). The coded byte is the lowest of the number."""
    lead = CLOSE * ORDER
    buf = np.frombuffer(b"".join(lead + t + CLOSE for t in texts), np.uint8)
    counts = np.array([len(t) + 1 for t in texts])
    whole = np.zeros(len(buf) - ORDER, np.uint64)
    for back in range(ORDER + 1):
        whole |= buf[ORDER - back : len(buf) - back].astype(np.uint64) << np.uint64(8 * back)
    at = np.arange(counts.sum()) + np.repeat(np.arange(len(texts)) * ORDER, counts)
    return whole[at].view(np.int64), counts


def _counted(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen, n = np.unique(keys[learnt], return_counts=True)
    other = np.setdiff1d(keys[~learnt], seen)
    return np.concatenate([seen, other]), np.concatenate([n, np.zeros(len(other), np.int64)])


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _items_of(texts: list[bytes], learnt: np.ndarray):
    keys, counts = grams(texts)
    yield GRAM, _counted(keys, np.repeat(learnt, counts))
    hashes, counts = words(texts)
    ends = np.full(len(texts), _END_WORD)
    yield WORD, _counted(np.concatenate([hashes.view(np.int64), ends]), np.concatenate([np.repeat(learnt, counts), learnt]))


def _counts_of(chunk, found):
    for kind, parts in found.items():
        keys, n = _merge(parts)
        for at in range(0, len(keys), 1 << 16):
            own = keys[at : at + (1 << 16)]
            head = [pa.array(np.full(len(own), x, t)) for x, t in ((chunk, np.int64), (kind, np.int8))]
            yield pa.RecordBatch.from_arrays([*head, pa.array(own), pa.array(n[at : at + (1 << 16)])], ["chunk", "kind", "key", "n"])


def _items(batches):
    """Distinct grams and words of each chunk in a task, with training counts. Memory: those of one chunk."""
    current, found = None, {}
    for batch in batches:
        for chunk, learnt, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if chunk != current:
                yield from _counts_of(current, found)
                current, found = chunk, {}
            for kind, part in _items_of(unpack(blob), np.frombuffer(learnt, bool)):
                parts = found.setdefault(kind, [])
                parts.append(part)
                if len(parts) >= 8:
                    parts[:] = [_merge(parts)]
    yield from _counts_of(current, found)


_CODEC = pa.Codec("zstd", 3)


def pack(texts: list[bytes]) -> bytes:
    sizes = np.array([len(texts), *map(len, texts)], np.int64).tobytes()
    raw = sizes + b"".join(texts)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[bytes]:
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[end - size : end] for size, end in zip(np.frombuffer(raw, np.int64, n, 8), ends, strict=True)]


def _staged(batches, blob_bytes, chunk_bytes):
    """Rows of packed texts: (chunk, learnt, texts, docs). A task starts a new chunk after chunk_bytes."""
    chunk, size = TaskContext.get().partitionId() << 20, 0
    for batch in batches:
        for first, texts in slices(batch.column(1), blob_bytes):
            own = batch.slice(first, len(texts))
            learnt = np.array(own.column(2).to_pylist(), bool).tobytes()
            docs = pa.array([own.column(0).to_pylist()], pa.list_(own.column(0).type))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([learnt], pa.binary()), pa.array([pack(texts)], pa.binary()), docs],
                ["chunk", "learnt", "texts", "docs"],
            )
            size += sum(map(len, texts))
            if size >= chunk_bytes:
                chunk, size = chunk + 1, 0


class Lookup:
    """Values of 64-bit keys by open addressing, many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.full = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, bool)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.full[at[left]]]
            slots, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[slots], self.values[slots], self.full[slots] = keys[put], values[put], True
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)

    def _at(self, keys):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be known."""
        at = self._at(keys)
        wrong = np.flatnonzero((self.keys[at] != keys) | ~self.full[at])
        while len(wrong):
            if not self.full[at[wrong]].all():
                raise KeyError("a key is not in the table")
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) | ~self.full[at[wrong]]]
        return self.values[at]


def _scored(blobs: pa.Table, costs: pa.Table, total: int, different: int) -> pa.Table:
    """Scores of the texts of one chunk from the costs of its grams and the counts of its words."""
    kind, key, value = (costs.column(c).to_numpy() for c in ("kind", "key", "value"))
    cost, count = (Lookup(key[kind == k], value[kind == k]) for k in (GRAM, WORD))
    del costs, kind, key, value
    floor = math.log10(total + 0.1 * (different + 1))
    out = []
    for row in range(blobs.num_rows):
        texts = unpack(blobs.column("texts")[row].as_py())
        keys, n = grams(texts)
        score = np.add.reduceat(cost(keys), np.cumsum(n) - n)
        hashes, n = words(texts)
        c = count(np.append(hashes.view(np.int64), _END_WORD))
        owner = np.append(np.repeat(np.arange(len(texts)), n), 0)[:-1]
        logs = np.log10(c + 0.1) - floor
        base = np.bincount(owner, logs[:-1], len(texts)) + logs[-1]
        known = np.bincount(owner, c[:-1] > 0, len(texts)) + (c[-1] > 0)
        held = ~np.frombuffer(blobs.column("learnt")[row].as_py(), bool)
        docs = blobs.column("docs")[row].values
        arrays = [docs, pa.array(held), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
        out.append(pa.Table.from_arrays(arrays, ["doc", "held_out", "n_tokens", "n_known", "base_score", "score"]))
    return pa.concat_tables(out)


def _level(items: DataFrame, order: int) -> DataFrame:
    """(key, ctx, n): grams of `order` context bytes with counts, from those of one more."""
    key = F.col("key").bitwiseAND((1 << 8 * (order + 1)) - 1)
    return items.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).withColumn("ctx", F.shiftright("key", 8))


def _log(part: Column, whole: Column) -> Column:
    return F.log10(F.try_divide(part, whole))


def costs_of(counts: DataFrame, ws: Workspace) -> DataFrame:
    """(key, value): log10 probability of every gram in `counts` (key, n); n is 0 for grams that are only looked up.

    `plain` is the cost when coding starts in the gram's own context, `after` the cost of its byte in the context one
    shorter, after an escape from this one. Each level takes both from the level below.
    """
    levels = [counts.withColumn("ctx", F.shiftright("key", 8))]
    for order in range(ORDER - 1, -1, -1):
        levels.append(ws.save(_level(levels[-1], order), f"grams-{order}"))
    below = None
    for order, rows in enumerate(reversed(levels)):
        whole = Window.partitionBy("ctx")
        if below is None:
            rows = rows.withColumns({"n_below": F.lit(0), "total_below": F.lit(0), "kinds_below": F.lit(0), "after_below": F.lit(0.0), "plain_below": F.lit(-math.log10(256))})
        else:
            shorter = below.select(*[F.col(c).alias(f"{c}_below") for c in below.columns])
            rows = rows.join(shorter, F.col("key").bitwiseAND((1 << 8 * order) - 1) == F.col("key_below"))
        seen = F.col("n") > 0
        rows = rows.withColumns({
            "total": F.sum("n").over(whole), "kinds": F.sum(seen.cast("long")).over(whole),
            "excluded": F.sum(F.when(seen, F.col("n_below")).otherwise(0)).over(whole),
        })
        if below is None:
            after = -F.log10(F.greatest(F.lit(1), 256 - F.col("kinds")))
        else:
            kinds = F.col("kinds_below") - F.col("kinds")
            size = F.col("total_below") - F.col("excluded") + kinds
            escape = F.when(kinds > 0, _log(kinds, size)).otherwise(0.0)
            after = F.when(F.col("n_below") > 0, _log(F.col("n_below"), size)).otherwise(escape + F.col("after_below"))
        size = F.col("total") + F.col("kinds")
        rows = rows.withColumn("after", after)
        plain = F.when(F.col("total") == 0, F.col("plain_below")).when(seen, _log(F.col("n"), size))
        rows = rows.withColumn("plain", plain.otherwise(_log(F.col("kinds"), size) + F.col("after")))
        below = ws.save(rows.select("key", "n", "total", "kinds", "plain", "after"), f"costs-{order}")
    return below.select("key", F.col("plain").alias("value"))


def score(docs: DataFrame, id_col: str, text_col: str, learnt: Column, ws: Workspace) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    `learnt` says which rows the models learn from (null: not). A null text is empty: the end alone. Rows with equal or
    null ids are scored one by one; other columns are ignored; an empty table gives no rows. Without training rows the
    byte model is uniform. Words are told apart by 64-bit hashes (see `words`).
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(learnt, F.lit(False)).alias("learnt"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    schema = f"chunk long, learnt binary, texts binary, docs array<{kind}>"
    blob_bytes, chunk_bytes = BLOB_BYTES, CHUNK_BYTES
    staged = ws.save(rows.coalesce(chunks).mapInArrow(lambda b: _staged(b, blob_bytes, chunk_bytes), schema), "staged")
    items = staged.select("chunk", "learnt", "texts").mapInArrow(_items, "chunk long, kind byte, key long, n long")
    items = ws.save(items, "items")
    lists = items.groupBy("kind", "key", F.shiftright("chunk", 30).alias("block"))
    lists = ws.save(lists.agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")), "lists")
    ws.discard("items")
    totals = lists.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = ws.save(totals.where(F.col("kind") == WORD).select("key", "n"), "words")
    words_seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    train_tokens, different = words_seen
    found = ws.save(totals.where(F.col("kind") == GRAM).select("key", "n"), f"grams-{ORDER}")
    values = [costs_of(found, ws).withColumn("kind", F.lit(GRAM)), counts.select("key", F.col("n").cast("double").alias("value"), F.lit(WORD).alias("kind"))]
    values = values[0].unionByName(values[1]).select(F.col("kind").cast("byte").alias("kind"), "key", "value")
    back = lists.join(values, ["kind", "key"]).select(F.explode("chunks").alias("chunk"), "kind", "key", "value")
    out_schema = f"doc {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = staged.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        lambda blobs, costs: _scored(blobs, costs, train_tokens, different), out_schema
    )
    return scored.select(
        F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
