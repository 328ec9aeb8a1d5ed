"""Passages of benchmark items in documents, with edits, found by random walks and compared exactly.

Distances are edit distances over words. Every item meets windows with as many words as it has. k edits of an item leave all but 2k of
its different word pairs in place, also in the window where the passage starts; so windows that hold too few pairs of all items of
their size are passed over. The others and the items are embedded by random walks (`Walks`), after which edits are differences at
few places. Tables of sampled places, as many as RECALL at the most edits allowed asks for, give the pairs of window and item that
are compared, by their word pairs first and then in full. Only the tables can lose a passage.

Items go to all tasks in blocks of at most ITEM_WORDS.
"""

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.llm.words import LOWER, runs, slices, words
from epsgroup.ship import ship

SIMILAR = 0.8  # at most 1 - SIMILAR edits per word of the item
LEAST_WORDS = 5  # shorter items allow no edit; they are looked for on demand, as they stand
ITEM_WORDS = 1 << 20
PAIRS = 1 << 18
RECALL = 0.999  # share of the windows at the most edits allowed that meet their item in a table
PLACES = 3  # sampled in each table
TABLES_A_WALK = 8
TRIALS = 1000  # edited texts that the number of walks is taken from


def edits(n):
    """Edits allowed for an item of n words."""
    return np.floor((1 - SIMILAR) * n + 1e-9).astype(np.int64)


class Walks:
    """Random-walk embeddings of stretches of n words, and the tables that sample their places.

    A walk shows one word at each step and goes on to the next word or stays, by a coin that step and word toss: equal words
    keep walks together, and walks parted by an edit meet again. As a walk of n words ends after 2n steps or so, places are drawn from
    the steps that nearly all walks reach.
    """

    def __init__(self, n: int):
        self.n, self.steps = n, max(n, int(2 * n - 2 * (2 * n) ** 0.5))

    def _walk(self, turn: int):
        """(coins, places, factors) of one walk, the same everywhere."""
        rng = np.random.default_rng([self.n, turn])
        odd = lambda *shape: rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return odd(self.steps), rng.integers(0, self.steps, (TABLES_A_WALK, PLACES)), odd(TABLES_A_WALK, PLACES)

    def keys(self, stretches: np.ndarray, turn: int):
        """The keys of all stretches (rows of n word hashes, 0 after the end of a text) in each table of a walk."""
        coins, places, factors = self._walk(turn)
        rows = len(stretches)
        words_ = np.concatenate([stretches, np.zeros((rows, 1), np.uint64)], axis=1).ravel()
        at = np.arange(rows) * (self.n + 1)
        end, shown = at + self.n, np.empty((self.steps, rows), np.uint64)
        for step in range(self.steps):
            shown[step] = words_[at]
            at = np.minimum(at + ((shown[step] * coins[step]) >> np.uint64(63)).astype(np.int64), end)
        for place, factor in zip(places, factors, strict=True):
            yield (shown[place] * factor[:, None]).sum(0)


@lru_cache
def walks_for(n: int) -> int:
    """How many walks let RECALL of random texts of n words meet their copies with the most edits allowed."""
    rng = np.random.default_rng(n)
    own = rng.integers(1, 1 << 63, (TRIALS, n), dtype=np.uint64)
    changed = np.empty_like(own)
    for row, text in enumerate(own.tolist()):
        for _ in range(int(edits(n))):
            at, kind = rng.integers(0, len(text)), rng.integers(0, 3)
            text[at : at + (kind > 0)] = [int(rng.integers(1, 1 << 63))] if kind < 2 else []
        text += rng.integers(1, 1 << 63, max(0, n - len(text)), dtype=np.uint64).tolist()
        changed[row] = text[:n]
    walks, met, turn = Walks(n), np.zeros(TRIALS, bool), 0
    while met.mean() < RECALL:
        for a, b in zip(walks.keys(own, turn), walks.keys(changed, turn), strict=True):
            met |= a == b
        turn += 1
    return turn


def trial_size(n: int) -> int:
    """The size whose number of walks n takes: the next of 5, 10, .. 60 and from there on of steps of a quarter, which is harder."""
    size = -(-n // 5) * 5
    if size <= 60:
        return size
    size = 60
    while size < n:
        size = -(-size // 20) * 25
    return size


def closest(item: list, text: list) -> tuple[int, int]:
    """(least edits between the item and any stretch of the text, end of the first such stretch), bit-parallel."""
    n = len(item)
    masks: dict = defaultdict(int)
    for i, word in enumerate(item):
        masks[word] |= 1 << i
    plus, minus, last, all_ = (1 << n) - 1, 0, 1 << (n - 1), (1 << n) - 1
    score = best = n
    end = 0
    for j, word in enumerate(text):
        eq = masks.get(word, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (all_ & ~(diagonal | plus)), plus & diagonal
        score += bool(up & last) - bool(down & last)
        if score < best:
            best, end = score, j + 1
        up, down = (up << 1) & all_, (down << 1) & all_
        plus, minus = down | (all_ & ~(diagonal | up)), up & diagonal
    return best, end


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list, texts: list[str], least_words: int = LEAST_WORDS):
        hashes, counts = words([t.encode().translate(LOWER) for t in texts])
        parts = np.split(hashes, np.cumsum(counts)[:-1]) if len(texts) else []
        self.by_size: dict[int, tuple] = {}
        pairs, sizes = [], []
        sized = [(int(n), np.flatnonzero(counts == n)) for n in np.unique(counts[counts >= LEAST_WORDS])]
        of_items = {r: np.unique(runs(parts[r], np.array([n]), 2)[0]) for n, rows in sized for r in rows.tolist()}
        for n, rows in sized:
            own_pairs, lost = [of_items[r] for r in rows.tolist()], 2 * int(edits(n))
            need = [max(1, len(p) - lost) for p in own_pairs]
            sets = [frozenset(p.tolist()) for p in own_pairs]
            stretches = np.array([parts[r] for r in rows.tolist()], np.uint64)
            embedding, tables = Walks(n), []
            for turn in range(walks_for(trial_size(n))):
                for keys in embedding.keys(stretches, turn):
                    order = np.argsort(keys, kind="stable")
                    tables.append((keys[order], order))
            self.by_size[n] = ([ids[r] for r in rows], [parts[r].tolist() for r in rows], embedding, tables, sets, need, min(need))
            known = np.unique(np.concatenate(own_pairs))
            pairs.append(known)
            sizes.append(np.full(len(known), n))
        self.pairs, self.sizes = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (pairs, sizes))
        order = np.argsort(self.pairs, kind="stable")
        self.pairs, self.sizes = self.pairs[order], self.sizes[order].astype(np.int64)
        self.short = {}
        for n in range(max(1, least_words), LEAST_WORDS):
            rows = np.flatnonzero(counts == n)
            if len(rows):
                keys = runs(np.concatenate([parts[r] for r in rows]), counts[rows], n)[0]
                order = np.argsort(keys, kind="stable")
                self.short[n] = keys[order], rows[order]
        self.ids = ids

    def _as_they_stand(self, hashes, counts):
        """(row, item id, 0, first word, end word) of the first place of each short item in each text."""
        for n, (keys, items) in self.short.items():
            own, many = runs(hashes, counts, n)
            of, text = np.cumsum(many) - many, np.repeat(np.arange(len(counts)), many)
            low, high = (np.searchsorted(keys, own, side) for side in ("left", "right"))
            seen = set()
            for at in np.flatnonzero(high > low).tolist():
                row = int(text[at])
                for item in items[low[at] : high[at]].tolist():
                    if (row, item) not in seen:
                        seen.add((row, item))
                        yield row, self.ids[item], 0, at - int(of[row]), at - int(of[row]) + n

    def found(self, texts: list[bytes]):
        """(row, item id, edits, first word, end word) for each text and item it holds: the closest stretch."""
        hashes, counts = words(texts)
        yield from self._as_they_stand(hashes, counts)
        pairs, per_text = runs(hashes, counts, 2)
        low = np.searchsorted(self.pairs, pairs)
        there = np.flatnonzero(self.pairs[np.minimum(low, len(self.pairs) - 1)] == pairs) if len(self.pairs) else []
        if not len(there):
            return
        low = low[there]
        many = np.searchsorted(self.pairs, pairs[there], "right") - low
        at = np.repeat(there, many)
        size = self.sizes[np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)]
        text = np.repeat(np.arange(len(texts)), per_text)[at]
        order = np.lexsort((at, size, text))
        at, size, text = at[order], size[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (text[1:] != text[:-1])]))
        of_words, of_pairs = np.cumsum(counts) - counts, np.cumsum(per_text) - per_text
        waiting = defaultdict(list)
        for start, end in zip(first, np.append(first[1:], len(at)), strict=True):
            n, row = int(size[start]), int(text[start])
            need = self.by_size[n][-1]
            if end - start < need:
                continue
            places = at[start:end] - of_pairs[row]
            same = np.argsort(pairs[at[start:end]], kind="stable")
            before = np.full(len(places), -1)
            repeated = pairs[at[start:end]][same[1:]] == pairs[at[start:end]][same[:-1]]
            before[same[1:][repeated]] = places[same[:-1][repeated]]
            # A pair counts for the windows that start after the place it was last seen at and reach it.
            held = np.zeros(counts[row] + 1, np.int64)
            np.add.at(held, np.maximum(0, np.maximum(before + 1, places - n + 2)), 1)
            np.add.at(held, places + 1, -1)
            held = np.cumsum(held)[:-1]
            for s in np.flatnonzero(held >= need):
                waiting[n].append((row, int(s), int(held[s])))
        for n, windows in waiting.items():
            yield from self._matched(n, windows, hashes, counts, of_words, pairs, of_pairs)

    def _candidates(self, n, row, start, hashes, counts, of_words, pairs, of_pairs):
        """(window, item) for the windows of n words that meet an item in a table and hold enough of its word pairs."""
        _, _, embedding, tables, sets, need, _ = self.by_size[n]
        place = start[:, None] + np.arange(n)
        inside = place < counts[row][:, None]
        stretches = np.where(inside, hashes[np.where(inside, of_words[row][:, None] + place, 0)], np.uint64(0))
        found = [np.zeros(0, np.int64)]
        for turn in range(len(tables) // TABLES_A_WALK):
            for table, keys in enumerate(embedding.keys(stretches, turn), turn * TABLES_A_WALK):
                known, items = tables[table]
                left = np.searchsorted(known, keys)
                window = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == keys)
                left = left[window]
                many = np.searchsorted(known, keys[window], "right") - left
                which = items[np.arange(many.sum()) + np.repeat(left - np.cumsum(many) + many, many)]
                found.append(np.repeat(window, many) * len(sets) + which)
        met = np.unique(np.concatenate(found))
        place, inside = place[:, :-1], inside[:, 1:]
        held, of = frozenset(), -1
        for at, item in zip((met // len(sets)).tolist(), (met % len(sets)).tolist(), strict=True):
            if at != of:
                held, of = frozenset(pairs[of_pairs[row[at]] + place[at][inside[at]]].tolist()), at
            if len(held & sets[item]) >= need[item]:
                yield at, item

    def _matched(self, n, windows, hashes, counts, of_words, pairs, of_pairs):
        ids, own = self.by_size[n][:2]
        rows, starts, held = np.array(windows).T
        groups = defaultdict(list)
        step = max(1, PAIRS // n)
        for lo in range(0, len(rows), step):
            for at, which in self._candidates(n, rows[lo : lo + step], starts[lo : lo + step], hashes, counts, of_words, pairs, of_pairs):
                groups[int(rows[lo + at]), which].append((-int(held[lo + at]), int(starts[lo + at])))
        k = int(edits(n))
        for (row, which), places in groups.items():
            tried, best = [], None
            for _, start in sorted(places):
                if any(abs(start - t) <= k for t in tried):
                    continue  # the stretch compared for that place covers this one
                low, high = max(0, start - 2 * k), min(int(counts[row]), start + n + 3 * k)
                part = hashes[of_words[row] + low : of_words[row] + high].tolist()
                distance, end = closest(own[which], part)
                tried.append(start)
                if distance <= k and (best is None or distance < best[0]):
                    back, length = closest(own[which][::-1], part[:end][::-1])
                    best = (distance, low + end - length if back == distance else start, low + end)
                if best and best[0] == 0:
                    break
            if best:
                yield row, ids[which], *best


def find(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id_col, item_id, edits, first_word, end_word): one row per document and item that it holds, with the closest stretch.

    An item is held if some stretch of the text is within 1 - SIMILAR edits per word of it; of those with the most edits RECALL
    is found, of those with fewer more. Items of under LEAST_WORDS words allow no edit and are found exactly. Items that are null or
    have under `least_words` words are not looked for; a null text holds nothing. Repeated documents and items are looked at one by one, null ids
    included; other columns are ignored; no items or no documents give no rows.
    """
    ship(docs.sparkSession)
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"doc {kinds[0]}, item {kinds[1]}, edits long, first_word long, end_word long"
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    total = wanted.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_WORDS))
    out = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        looked_for = Items(part.column(0).to_pylist(), part.column(1).to_pylist(), least_words)
        broadcast = docs.sparkSession.sparkContext.broadcast((looked_for, part.schema.field(0).type))

        def look(batches, broadcast=broadcast):
            block_items, kind = broadcast.value
            for batch in batches:
                for first, lowered in slices(batch.column(1)):
                    hits = list(block_items.found(lowered))
                    columns = [*zip(*hits, strict=True)] or [()] * 5
                    owner = batch.column(0).take(pa.array([first + r for r in columns[0]], pa.int64()))
                    numbers = [pa.array(c, pa.int64()) for c in columns[2:]]
                    names = ["doc", "item", "edits", "first_word", "end_word"]
                    yield pa.RecordBatch.from_arrays([owner, pa.array(columns[1], kind), *numbers], names)

        found = rows.mapInArrow(look, schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "edits", "first_word", "end_word")
