"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= s are at most sqrt(2 - 2 s) apart. They are rotated at random and split into blocks of BLOCK
coordinates; each block gets a share of the squared distance in proportion to its coordinates, so a linked pair
keeps within the share of some block. Vectors of one label are packed into tiles of at most TILE, and every two tiles of a label
meet in a task. There each block is range-joined on its own: rows sorted by its first coordinate meet those within the block's
reach. A pair is taken from the first block whose share it keeps, and its cosine is computed in full. Tiles are written once and
read again where they meet, so what is written grows with the vectors, not with their pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgroup.llm.components import components, forest
from epsgroup.operators.sizes import join_small
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

BLOCK = 8
TILE = 4096
RUN = 256  # rows of a tile that look for others at once
PAIRS = 1 << 15  # pairs verified at once
SLACK = 1e-9  # far above rounding errors, which must not let a pair slip through
ROUNDING = 1e-5  # the same for single precision, in which candidates are looked for
FLUSH = 8 << 20  # bytes of packed vectors given out at once


class Blocks:
    """The rotation of vectors of one length, and the blocks with their shares."""

    def __init__(self, length: int, cosine: float, seed: int):
        normal = np.random.default_rng([seed, length]).standard_normal((length, length))
        self.rotation = np.linalg.qr(normal)[0]
        self.spans = [(at, min(at + BLOCK, length)) for at in range(0, length, BLOCK)]
        self.shares = [(2 - 2 * cosine) * (end - at) / length + SLACK for at, end in self.spans]

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.rotation


def _vectors(raw: bytes, length: int, kind: str) -> np.ndarray:
    """The vectors, each times a power of two that brings its largest component near 1, so that no product leaves the range of doubles."""
    vectors = np.frombuffer(raw, kind).reshape(-1, length).astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def _folded(batches, kind):
    """Rows (part, length, h1, h2, tile, copies, vector as bytes): equal vectors of a batch are one row with their number."""
    for batch in batches:
        part, h1, h2 = (batch.column(i).to_numpy() for i in (0, 2, 3))
        order = np.lexsort((h2, h1, part))
        new = np.ones(len(order), bool)
        for c in (part, h1, h2) if len(order) else ():
            new[1:] = new[1:] & (c[order[1:]] == c[order[:-1]])
        new[1:] = ~new[1:]
        first = np.flatnonzero(new)
        own = batch.take(pa.array(order[first]))
        ends = np.concatenate([[0], np.cumsum(own.column(1).to_numpy())]) * np.dtype(kind).itemsize
        values = own.column(5).flatten().to_numpy(zero_copy_only=False).astype(kind)
        raw = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])
        copies = pa.array(np.diff(np.append(first, len(order))), pa.int64())
        yield pa.RecordBatch.from_arrays([*own.columns[:5], copies, raw], ["part", "length", "h1", "h2", "tile", "copies", "vector"])


_TILES = pa.schema([
    ("part", pa.int64()), ("length", pa.int32()), ("tile", pa.int32()), ("first", pa.int64()),
    ("copies", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()), ("vectors", pa.binary()),
])


def _tiles(batches, most):
    """From rows sorted by part, length, tile and hashes: one row for each tile of at most `most` different vectors.

    `first` is the number of its first vector, the others follow on. Only the last, unfinished tile is kept between batches.
    """
    number, rows, held = TaskContext.get().partitionId() << 40, [], None

    def cut(table):
        nonlocal number
        part, length, h1, h2, tile, copies = (table.column(i).to_numpy() for i in range(6))
        new = np.ones(len(part), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        copies, vectors = np.add.reduceat(copies, first), table.column(6).take(pa.array(first))
        for at in range(0, len(first), most):
            some = first[at : at + most]
            raw = (x.astype(np.int64).tobytes() for x in (copies[at : at + most], h1[some], h2[some]))
            rows.append((part[0], length[0], tile[0], number, *raw, b"".join(vectors.slice(at, most).to_pylist())))
            number += len(some)

    def written():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TILES.types, strict=True)], schema=_TILES)
        rows.clear()
        return out

    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        keys = [table.column(i).to_numpy() for i in (0, 1, 4)]
        edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for at, end in zip([0, *edge[:-1]], edge, strict=True) if len(edge) else ():
            cut(table.slice(at, end - at))
            if len(rows) >= 1000 or sum(len(r[-1]) for r in rows[-8:]) >= FLUSH:
                yield written()
        held = table.slice(edge[-1]) if len(edge) else table
    if held is not None and held.num_rows:
        cut(held)
    if rows:
        yield written()


def _heads(batches):
    """(part, h1, h2, rep, copies) of the vectors of packed tiles."""
    for batch in batches:
        for part, first, *raw in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "copies", "h1", "h2")), strict=True):
            copies, h1, h2 = (np.frombuffer(r, np.int64) for r in raw)
            rep = np.arange(first, first + len(copies))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(rep), part, np.int64), h1, h2, rep, copies)], ["part", "h1", "h2", "rep", "copies"])


class Tile:
    """The vectors of a packed row, and their rotated blocks."""

    def __init__(self, blocks: Blocks, first: int, copies: bytes, vectors: bytes, length: int, kind: str):
        self.copies = np.frombuffer(copies, np.int64)
        self.ids = np.arange(first, first + len(self.copies))
        self.vectors = _vectors(vectors, length, kind)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.turned = blocks.rotated(self.vectors)
        self.small = self.turned.astype(np.float32)


def _set(flags: np.ndarray) -> np.ndarray:
    """The places of the few true ones, looked for eight at a time."""
    whole = len(flags) // 8 * 8
    eights = flags[:whole].reshape(-1, 8)
    some = np.flatnonzero(eights.view(np.uint64))
    row, place = np.nonzero(eights[some])
    return np.concatenate([8 * some[row] + place, whole + np.flatnonzero(flags[whole:])])


def _in_reach(x: np.ndarray, y: np.ndarray, share: float, own: bool):
    """(rows of x, rows of y), in pieces, that are within the share in one block; with some that rounding lets in.

    Both are sorted by the first coordinate; a run of x meets only the rows of y within the reach of it. Of a tile with itself a pair comes once.
    """
    orders = [np.argsort(x[:, 0], kind="stable"), np.argsort(y[:, 0], kind="stable")]
    x, y = x[orders[0]], y[orders[1]]
    one = [np.ones((len(z), 1), np.float32) for z in (x, y)]
    left = np.hstack([-2 * x, (x**2).sum(1, keepdims=True), one[0]])
    right = np.ascontiguousarray(np.hstack([y, one[1], (y**2).sum(1, keepdims=True)]).T)
    reach, most = np.float32(np.sqrt(share) + ROUNDING), np.float32(share + ROUNDING)
    for at in range(0, len(x), RUN):
        end = min(at + RUN, len(x))
        low = max(at if own else 0, np.searchsorted(y[:, 0], x[at, 0] - reach))
        high = np.searchsorted(y[:, 0], x[end - 1, 0] + reach, "right")
        if low >= high:
            continue
        a, b = np.divmod(_set((left[at:end] @ right[:, low:high] <= most).ravel()), high - low)
        if own:
            a, b = a[low + b > at + a], b[low + b > at + a]
        for some in range(0, len(a), PAIRS):
            yield orders[0][at + a[some : some + PAIRS]], orders[1][low + b[some : some + PAIRS]]


def _met(x: Tile, y: Tile, blocks: Blocks, cosine: float) -> pa.RecordBatch:
    """Links within a tile, or between two: (id, links) sums and (id, other) of a spanning forest, by number of the folded vector."""
    links, ends = [np.zeros(len(x.ids), np.int64), np.zeros(len(y.ids), np.int64)], []
    for block, ((start, end), share) in enumerate(zip(blocks.spans, blocks.shares, strict=True)):
        for a, b in _in_reach(x.small[:, start:end], y.small[:, start:end], share, x is y):
            cos = np.einsum("ij,ij->i", x.vectors[a], y.vectors[b]) / (x.norms[a] * y.norms[b])
            a, b = a[cos >= cosine], b[cos >= cosine]
            gaps = (x.turned[a] - y.turned[b]) ** 2
            first = np.full(len(a), -1)
            for i in range(len(blocks.spans) - 1, -1, -1):
                s, e = blocks.spans[i]
                first[gaps[:, s:e].sum(1) <= blocks.shares[i]] = i
            a, b = a[first == block], b[first == block]
            np.add.at(links[0], a, y.copies[b])
            np.add.at(links[1], b, x.copies[a])
            if len(a):
                ends.append(forest(x.ids[a], y.ids[b]))
    if ends:
        ends = forest(*(np.concatenate(z) for z in zip(*ends, strict=True)))
    node, low = ends if len(ends) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ids, links = (x.ids, links[0] + links[1]) if x is y else (np.concatenate([x.ids, y.ids]), np.concatenate(links))
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([ids[some], node]), pa.int64()),
        pa.array(np.concatenate([links[some], np.zeros(len(node), np.int64)]), pa.int64()),
        pa.array([None] * len(some) + low.tolist(), pa.int64()),
    ], ["id", "links", "other"])


def _meetings(batches, kind: str, cosine: float, seed: int):
    """Links within each tile (length, first, copies, vectors), or between the two of a row (then the same of the other follow)."""
    known, last = {}, (None, None)
    for batch in batches:
        for row in range(batch.num_rows):
            length, *raw = (c[row].as_py() for c in batch.columns)
            if length not in known:
                known[length] = Blocks(length, cosine, seed)
            blocks = known[length]
            if raw[0] != last[0]:
                last = raw[0], Tile(blocks, *raw[:3], length, kind)
            x = last[1]
            found = _met(x, Tile(blocks, *raw[3:], length, kind) if len(raw) > 3 else x, blocks, cosine)
            if found.num_rows:
                yield found


def near_duplicates(
    rows: DataFrame, id_col: str, vector_col: str, label_col: str, ws: Workspace, cosine: float = 0.93, seed: int = 0
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row.

    Vectors are compared when their labels are equal and not null and they are equally long. Null, empty and zero vectors,
    those with null or non-finite numbers, and rows with a null id link with nothing. Equal vectors of a label are
    folded first and count one by one as links, repeated rows included. `component_id` is the smallest id reachable;
    rows that share an id count as connected. Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    element = rows.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    wide = F.transform(vector_col, lambda x: x.cast("double"))
    usable = F.coalesce(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector_col) > 0)
        & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(wide, lambda x: x != 0), F.lit(False),
    )
    plain = F.transform(F.col(vector_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>"), lambda x: F.when(x == 0, x * x).otherwise(x))  # no zero below 0
    flat = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(label_col).alias("part"), plain.alias("vector"), usable.alias("usable"))
    # Vectors are told apart by 128 bits.
    good = flat.where("usable").select("id", "part", F.size("vector").alias("length"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vector")
    most, kinds = TILE, "part long, length int, h1 long, h2 long, tile int, copies long, vector binary"  # values for the workers
    large = good.groupBy("part", "length").count().where(F.col("count") > most)
    large = ws.save(large.select("part", "length", F.ceil(F.col("count") / most).cast("int").alias("tiles")), "large")
    many = large.count()
    dealt = join_small(good, large, ["part", "length"], many, "left")
    dealt = dealt.select("part", "length", "h1", "h2", F.pmod("h1", F.coalesce("tiles", F.lit(1))).cast("int").alias("tile"), "vector")
    dealt = dealt.mapInArrow(lambda b: _folded(b, kind), kinds)
    dealt = dealt.repartition("part", "length", "tile").sortWithinPartitions("part", "length", "tile", "h1", "h2")
    schema = "part long, length int, tile int, first long, copies binary, h1 binary, h2 binary, vectors binary"
    packed = ws.save(dealt.mapInArrow(lambda b: _tiles(b, most), schema), "tiles")
    ws.release()
    heads = packed.select("part", "first", "copies", "h1", "h2").mapInArrow(_heads, "part long, h1 long, h2 long, rep long, copies long")
    owned = ws.save(good.select("id", "part", "h1", "h2").join(heads.drop("copies"), ["part", "h1", "h2"]).select("id", "rep"), "owned")
    keys = heads.select("rep", "copies")

    # The tiles of a part meet each other as they are read from the written table: neither copies of them nor candidates are written.
    schema = "id long, links long, other long"
    tile = ["length", "first", "copies", "vectors"]
    met = ws.save(packed.select(*tile).mapInArrow(lambda b: _meetings(b, kind, cosine, seed), schema), "met")
    if many:
        split = join_small(packed, large.select("part", "length"), ["part", "length"], many, "left_semi").select("part", *tile)
        other = split.select(*(F.col(c).alias(f"other_{c}") for c in split.columns))
        odd = F.expr("(first ^ other_first) & 1 = 1")
        turn = F.when(odd, F.col("first") < F.col("other_first")).otherwise(F.col("first") > F.col("other_first"))
        pairs = split.join(other.hint("shuffle_replicate_nl"), (F.col("part") == F.col("other_part")) & (F.col("length") == F.col("other_length")) & turn)
        pairs = pairs.select(*tile, "other_first", "other_copies", "other_vectors")
        met = met.unionByName(ws.save(pairs.mapInArrow(lambda b: _meetings(b, kind, cosine, seed), schema), "met-across"))
    links = met.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    edges = met.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    shared = owned.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a <> high").select("id", "a")
    edges = edges.unionByName(shared.join(owned.withColumnRenamed("rep", "b"), "id").select("a", "b").distinct())
    groups = components(edges, ws)
    found = keys.select("rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    found = found.select("rep", n_links.alias("n_links"), F.coalesce("component", "rep").alias("group"))
    found = ws.save(owned.join(found, "rep").select("id", "n_links", "group"), "found")
    lowest = ws.save(found.groupBy("group").agg(F.min("id").alias("component")), "lowest")
    out = found.join(lowest, "group").select("id", "n_links", "component")
    out = out.unionByName(flat.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
