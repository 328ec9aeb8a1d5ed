"""Best-fit packing of documents into token sequences of a fixed size.

The plan is made over the histogram of piece lengths, not over pieces: lengths are placed from the longest to the
shortest, each into the bins with the least room that still takes it, many bins at a time. It comes out as slots: of the
pieces of one length, those of ranks lo .. lo+n-1 go to the bins from `first` on, `per_bin` in each. Pieces then find
their slot by their rank within their length. The driver sees the histogram (at most `capacity` rows) only.
"""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epsgroup.llm.tokens import encoder
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

END = 0  # the id that closes a document


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first, which takes what is left."""
    head = length % capacity or capacity
    return [(0, head)] + [(start, capacity) for start in range(head, length, capacity)]


def _pieces(batches, path: str, capacity: int, with_ids: bool):
    encode, chunk, seen = encoder(path).encode, TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        texts, rows = batch.column(1), []
        for row in range(batch.num_rows):
            ids = np.append(encode(texts[row].as_py() or ""), END).astype("<u4")
            for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                part = ids[start : start + length].tobytes()
                rows.append((row, piece, start, length, zlib.crc32(part), seen[length], part if with_ids else None))
                seen[length] += 1
        columns = [*zip(*rows, strict=True)] or [()] * 7
        owner = batch.column(0).take(pa.array(columns[0], pa.int64()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]
        names = ["doc", "chunk", "piece", "start", "length", "ids_crc32", "place", "ids"]
        yield pa.RecordBatch.from_arrays([owner, pa.array([chunk] * len(rows), pa.int64()), *arrays], names)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, with_ids=False) -> DataFrame:
    """(doc, chunk, piece, start, length, ids_crc32, place, ids): `place` counts the pieces of a length within a chunk."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, chunk long, piece int, start long, length long, ids_crc32 long, place long, ids binary"
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _pieces(batches, path, capacity, with_ids), schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, lo, n, first, per_bin, offset) for so many pieces of each length.

    Every length adds at most three ranges of bins, so there are at most 1.5 * capacity^2 slots for any number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # ranges (first bin, bins) by the room they have left
    slots, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, lo = histogram[length], 0

        def put(first, n, free, at, full):
            """n pieces into bins from `first` on, `full` in each but perhaps the last."""
            whole, rest = divmod(n, full)
            slots.append((length, at, n, first, full, capacity - free))
            if whole and free - full * length:
                room[free - full * length].append((first, whole))
            if rest and free - rest * length:
                room[free - rest * length].append((first + whole, 1))

        for free in sorted(f for f in room if f >= length):
            ranges, full = room.pop(free), free // length
            while ranges and left:
                first, count = ranges.pop()
                n = min(left, count * full)
                used = -(-n // full)
                if used < count:
                    ranges.append((first + used, count - used))
                put(first, n, free, lo, full)
                lo, left = lo + n, left - n
            room[free] += ranges
            if not room[free]:
                del room[free]
            if not left:
                break
        if left:
            full = capacity // length
            put(bins, left, capacity, lo, full)
            bins += -(-left // full)
    return slots


def pack(docs: DataFrame, id_col: str, text_col: str, path: str, ws: Workspace, capacity: int = 2048) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null text counts as empty: the closing id alone. Equal rows, null and repeated ids are packed one by one; other columns
    are ignored, whatever their names; an empty table gives no rows. A document above the capacity is cut (see `cut`).
    """
    cut_up = ws.save(pieces(docs, id_col, text_col, path, capacity).drop("ids"), "pieces")
    counts = ws.save(cut_up.groupBy("chunk", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = pa.table(
        [pa.array(c, pa.int64()) for c in [*zip(*plan(histogram, capacity), strict=True)] or [()] * 6],
        ["slot_length", "lo", "n", "first", "per_bin", "at"],
    )
    slots = docs.sparkSession.createDataFrame(slots)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut_up.join(bases, ["chunk", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    within = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n"))
    placed = ranked.join(F.broadcast(slots), within)
    step = F.col("rank") - F.col("lo")
    bin_, turn = F.expr("first + (rank - lo) div per_bin"), step % F.col("per_bin")
    return placed.select(
        F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32",
        bin_.alias("sequence_id"), (F.col("at") + turn * F.col("length")).alias("offset"),
    )


def sequences(docs: DataFrame, packed: DataFrame, id_col: str, text_col: str, path: str, capacity: int = 2048) -> DataFrame:
    """(sequence_id, ids): the packed ids themselves, little-endian 32-bit. `id_col` must be unique here."""
    parts = pieces(docs, id_col, text_col, path, capacity, with_ids=True).select(F.col("doc").alias(id_col), "piece", "ids")
    placed = parts.join(packed.select(id_col, "piece", "sequence_id", "offset"), [id_col, "piece"])
    together = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(together, lambda x: x["ids"]), ""))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
