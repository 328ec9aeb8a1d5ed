"""Exact Jaccard join of texts by word shingles, in regions of the metric space of sets.

First level. Between texts nearly all Jaccard distances are 1, so whole documents as pivots would tie everywhere. The first
pivots are therefore single shingles. A document belongs to the regions of its first n - ceil(t n) + LEAST shingles in a
fixed order (frequent ones last), which is as far as a document within distance 1 - t can lie: two linked documents meet in at
least LEAST such regions, or in as many as they need to overlap, if that is fewer. What the sizes of the two demand is counted: of two
documents of 500 shingles about half of the first 104 of each must be shared. Regions of at most SMALL documents are joined at once: pairs that met often enough are verified on their whole sets.

Crowded regions are united where they share documents and split again by pivots that are documents. A document goes to its
nearest pivot, and by the triangle inequality also to each other one that a partner within 1 - t could be nearest to. This is
repeated until a region fits into a task, where it is joined exactly, rarest shingles first. Regions
that pivots cannot split are joined in pairs of tiles, which are written once and read again where they meet.

Sets are folded first when equal, so copies cost nothing. Sets and shingles are told apart by 63-bit and 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epsgroup.llm.components import components, forest
from epsgroup.llm.words import mix, runs, slices, words
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100  # linked when DENOMINATOR * intersection >= NUMERATOR * union
LEAST = 4
SMALL = 256
TILE = 4 << 20  # shingles of a region joined in one task
TILE_SETS = 1 << 13  # sets of one, so that there are at most 2^25 pairs to look at; each set counts as TILE / TILE_SETS shingles more
CHECKED = 1 << 20  # shingles of other sets compared at once with those of one set
MAX_BITS = 1 << 28  # of the bitmap of candidate sets; a fuller one lets more sets pass and loses nothing
BITS_EACH = 16
PIVOTS = 16
RUN_SHINGLES = 4 << 20  # frequent shingles are looked for in runs of so many
SEEN_IN_RUN, SEEN = 4, 16  # a shingle is listed as frequent if it is in so many documents of a run, and of all runs
LISTED = 1 << 18  # the most frequent ones are listed; the list only orders shingles, so its length changes no result
_HOT = np.uint64(1 << 63)
_PLAIN = np.uint64((1 << 63) - 1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted set of 63-bit shingle hashes of each lowered text."""
    hashes, counts = runs(*words(texts), WORDS)
    hashes &= _PLAIN
    out = []
    for part in np.split(hashes, np.cumsum(counts)[:-1]):
        part.sort()
        out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part)
    return out


def node_of(shingles: np.ndarray) -> int:
    """A hash of the whole set."""
    total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _described(batches, kind, seen_in_run):
    """A row (doc, node, n) for each text, and rows (shingle, seen) for the frequent shingles of each run."""
    schema = pa.schema([("doc", kind), ("node", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64()), ("seen", pa.int64())])
    run, size = [], 0

    def frequent():
        keys, seen = np.unique(np.concatenate(run), return_counts=True) if run else (np.zeros(0, np.uint64),) * 2
        keys, seen = keys[seen >= seen_in_run].view(np.int64), seen[seen >= seen_in_run].astype(np.int64)
        none = [pa.nulls(len(keys), t) for t in (kind, pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(keys), pa.array(seen)], schema=schema)

    for batch in batches:
        for first, texts in slices(batch.column(1)):
            sets = shingle_sets(texts)
            n = [len(s) for s in sets]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            none = [pa.nulls(len(sets), pa.int64())] * 2
            docs = batch.column(0).slice(first, len(sets)).cast(kind)
            yield pa.RecordBatch.from_arrays([docs, nodes, pa.array(n, pa.int64()), *none], schema=schema)
            run += sets
            size += sum(n)
            if size >= RUN_SHINGLES:
                yield frequent()
                run, size = [], 0
    yield frequent()


class Frequent:
    """Membership in the list of frequent shingles, with a bitmap before the exact look."""

    def __init__(self, listed: np.ndarray):
        self.listed, self.mask = np.sort(listed), np.uint64((1 << 22) - 1)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.listed & self.mask] = True

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        hot = self.maybe[shingles & self.mask]
        rows = np.flatnonzero(hot)
        at = np.minimum(np.searchsorted(self.listed, shingles[rows]), max(0, len(self.listed) - 1))
        hot[rows] = self.listed[at] == shingles[rows] if len(self.listed) else False
        return hot


def reach(n):
    """How many of its n shingles, in the common order, a set must show to meet every set linked to it LEAST times."""
    return np.minimum(n, n - -(-NUMERATOR * n // DENOMINATOR) + LEAST)


def _entered(batches, listed):
    """(shingle, node, place) for the regions each set enters, with its size and the shingle's place in it; equal sets of a task enter once."""
    frequent, seen = Frequent(listed), set()
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            keys, nodes, sizes = [], [], []
            for own in shingle_sets(texts):
                node = node_of(own) if len(own) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                ordered = np.sort(own | (frequent(own).astype(np.uint64) * _HOT))[: reach(len(own))]
                keys.append(ordered & _PLAIN)
                nodes.append(node)
                sizes.append((len(own), len(ordered)))
            if keys:
                n, entered = np.array(sizes).T
                place = np.arange(entered.sum()) - np.repeat(np.cumsum(entered) - entered, entered)
                arrays = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), entered), np.repeat(n, entered) << 32 | place]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["shingle", "node", "place"])


def overlap(n, m):
    """How many shingles linked sets of these sizes have in common at least."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def similar_sizes(n, m):
    return DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64()), ("crowd", pa.int64()), ("n", pa.int64())])


def _met(batches, most):
    """From rows sorted by shingle: the pairs (a, b, need) of small regions, the members (crowd, a, n) of crowded ones.

    Only the last, unfinished region is kept between batches, and once it is crowded nothing of it but its shingle.
    """
    held, crowded = [np.zeros(0, np.int64)] * 3, None

    def members(s, node, n):
        none = pa.nulls(len(s), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(node), none, none, pa.array(s), pa.array(n)], schema=_MET)

    def small(s, node, place):
        """The pairs within each run of equal s whose sizes and places let them be linked, with the meetings they need.

        For every k, the first k shingles that two sets of overlap o share lie among the first n - o + k of both, since the
        other o - k come later. The largest k is taken for which both have entered so many regions.
        """
        n, at = place >> 32, place & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(s)))
        for m in np.unique(many[many > 1]):
            i, j = np.triu_indices(m, 1)
            alike = first[many == m]
            for start in range(0, len(alike), each := max(1, CHECKED // len(i))):
                rows = alike[start : start + each, None] + np.arange(m)
                a, b = rows[:, i].ravel(), rows[:, j].ravel()
                keep = similar_sizes(n[a], n[b]) & (node[a] != node[b])
                a, b = a[keep], b[keep]
                later = -(-NUMERATOR * np.maximum(n[a], n[b]) // DENOMINATOR) - LEAST
                keep = (at[a] < n[a] - later) & (at[b] < n[b] - later)
                a, b, later = a[keep], b[keep], later[keep]
                common = overlap(n[a], n[b])
                need = np.minimum(common - later, common)
                ends = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(need), none, none], schema=_MET)

    for batch in batches:
        s, node, place = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
        s, node, place = s[new], node[new], place[new]
        if crowded is not None:
            more = s == crowded
            yield members(s[more], node[more], place[more] >> 32)
            if more.all():
                held = [np.zeros(0, np.int64)] * 3
                continue
            s, node, place, crowded = s[~more], node[~more], place[~more], None
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        many = np.diff(np.append(first, len(s)))
        big = np.repeat(many > most, many)
        yield members(s[big], node[big], place[big] >> 32)
        if many[-1] > most:
            held, crowded = [np.zeros(0, np.int64)] * 3, s[-1]
        else:
            held = [x[first[-1] :] for x in (s, node, place)]
        done = ~big & (np.arange(len(s)) < first[-1])
        yield from small(s[done], node[done], place[done])
    yield from small(*held)


def linked(common, n, m):
    return DENOMINATOR * common >= NUMERATOR * (n + m - common)


def bitmap_of(nodes: DataFrame, most: int) -> np.ndarray:
    """A bitmap, of at most `most` bits, of the leading bits of each number in the column `a`."""
    bits = min(most.bit_length() - 1, max(16, (BITS_EACH * nodes.count()).bit_length()))
    at = nodes.select(F.shiftrightunsigned("a", 64 - bits).alias("at"))
    filled = at.groupBy(F.expr("at DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return out


def _sets(batches, bitmap):
    """(node, shingles) of the sets whose bit is in the bitmap, once per task."""
    seen, bits = set(), (64 * len(bitmap)).bit_length() - 1
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            for own in shingle_sets(texts):
                node = node_of(own) if len(own) else None
                if node is None or node in seen:
                    continue
                at = (node % (1 << 64)) >> (64 - bits)
                if not int(bitmap[at >> 6]) >> (at & 63) & 1:
                    continue
                seen.add(node)
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([own.tobytes()])], ["node", "shingles"])


def _among(batches, bitmap):
    """The rows (node, shingles) whose bit is in the bitmap."""
    bits = np.uint64((64 * len(bitmap)).bit_length() - 1)
    for batch in batches:
        at = batch.column(0).to_numpy().view(np.uint64) >> (np.uint64(64) - bits)
        yield batch.filter(pa.array((bitmap[at >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))


def needed(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets with these numbers, given as `a`, and some more: the others are left out before sets are shuffled."""
    bitmap = sets.sparkSession.sparkContext.broadcast(bitmap_of(nodes.distinct(), MAX_BITS))
    return sets.select("node", "shingles").mapInArrow(lambda b: _among(b, bitmap.value), "node long, shingles binary")


def _verified(batches):
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        good = np.zeros(len(a), bool)
        for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            good[row] = linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])


def join_tile(table: pa.Table) -> pa.Table:
    """A forest of the links among the sets of one region, rarest shingles first."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    raw = table.column("shingles").take(pa.array(first)).to_pylist()
    n = np.array([len(r) // 8 for r in raw])
    of = np.concatenate([[0], np.cumsum(n)])
    _, ids, df = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(nodes)), n)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    order = np.lexsort((rank[ids], owner))
    shown = order[(np.arange(len(ids)) - of[owner] < (n - -(-NUMERATOR * n // DENOMINATOR) + 1)[owner]) & (df[ids[order]] > 1)]
    shown = shown[np.argsort(rank[ids[shown]], kind="stable")]
    # Sets that show a shingle stand together in ascending order; a set meets those after it, each once.
    shingle, members = ids[shown], owner[shown]
    ends = np.searchsorted(rank[shingle], rank[shingle], "right")
    entries = np.argsort(members, kind="stable")
    spans = np.searchsorted(members[entries], np.arange(len(nodes) + 1))
    label, marked = np.arange(len(nodes)), np.zeros(len(df), bool)
    for p in range(len(nodes)):
        later = [members[at + 1 : ends[at]] for at in entries[spans[p] : spans[p + 1]].tolist() if at + 1 < ends[at]]
        if not later:
            continue
        others = np.unique(np.concatenate(later))
        others = others[similar_sizes(n[others], n[p]) & (label[others] != label[p])]
        marked[ids[of[p] : of[p + 1]]] = True
        for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(n[others]) // CHECKED)) + 1):
            if not len(some):
                continue
            first = np.cumsum(n[some]) - n[some]
            place = np.arange(n[some].sum()) + np.repeat(of[some] - first, n[some])
            common = np.add.reduceat(marked[ids[place]].astype(np.int64), first)
            joined = np.unique(label[some[linked(common, n[some], n[p])]])
            if len(joined):
                joined = np.append(joined, label[p])
                label[np.isin(label, joined)] = joined.min()
        marked[ids[of[p] : of[p + 1]]] = False
    other = label != np.arange(len(nodes))
    return pa.table({"a": nodes[other], "b": nodes[label[other]]})


def _packed(table: pa.Table) -> pa.Table:
    """A tile of sets as one row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.select(["node", "shingles"]).schema) as out:
        out.write_table(table.select(["node", "shingles"]))
    keys = [table.column(c).slice(0, 1).combine_chunks() for c in ("region", "tiles", "tile")]
    return pa.table([*keys, pa.array([sink.getvalue().to_pybytes()])], ["region", "tiles", "tile", "sets"])


def _of_two(batches):
    """The links among the sets of two packed tiles together."""
    for batch in batches:
        for row in range(batch.num_rows):
            both = [pa.ipc.open_stream(c[row].as_buffer()).read_all() for c in batch.columns]
            yield from join_tile(pa.concat_tables(both)).to_batches()


_SPLIT = pa.schema([("region", pa.int64()), ("child", pa.int32()), ("node", pa.int64()), ("n", pa.int64())])


def _placed(tile: pa.Table, pivots: pa.Table) -> pa.Table:
    """(region, child, node, n): the pivots' regions each set of a tile goes to; the last child is the one far from all."""
    eps = 1 - NUMERATOR / DENOMINATOR
    if not tile.num_rows:
        return pa.table([pa.array([], k) for k in _SPLIT.types], _SPLIT.names)
    raw = [np.frombuffer(r, np.uint64) for r in tile.column("shingles").to_pylist()]
    n = np.array([len(r) for r in raw])
    every, of = np.concatenate(raw), np.concatenate([[0], np.cumsum(n)[:-1]])
    gaps = []
    for r in pivots.column("shingles").to_pylist():
        p = np.frombuffer(r, np.uint64)
        at = np.minimum(np.searchsorted(p, every), len(p) - 1)
        common = np.add.reduceat((p[at] == every).astype(np.int64), of)
        gaps.append(1 - common / (n + len(p) - common))
    gaps = np.array(gaps).T
    near, base = gaps.min(1), gaps.argmin(1)
    far = gaps.shape[1]
    home = np.where(near <= 0.5, base, far)
    goes = (gaps <= near[:, None] + 2 * eps + 1e-9) & (gaps <= 0.5 + eps + 1e-9)
    goes = np.column_stack([goes, home == far])
    goes[np.arange(len(n)), home] = True
    row, child = np.nonzero(goes)
    region = tile.column("region").to_numpy()[row]
    return pa.table({"region": region, "child": child.astype(np.int32), "node": tile.column("node").to_numpy()[row], "n": n[row]})


def _crowds(members: DataFrame, sets: DataFrame, ws: Workspace) -> DataFrame:
    """The links (a, b) within crowded regions, given as (crowd, node, n)."""
    if members.isEmpty():
        return members.select(F.col("node").alias("a"), F.col("node").alias("b"))
    low = ws.save(members.groupBy("crowd").agg(F.min("node").alias("low")), "crowds-low")
    united = components(members.join(low, "crowd").select(F.col("node").alias("a"), F.col("low").alias("b")), ws, "crowds")
    own = members.select("node", "n").distinct()
    places = ws.save(own.join(united, "node").select(F.col("component").alias("region"), "node", "n"), "places-0")
    step, found, cost = 0, [], F.sum(F.col("n") + TILE // TILE_SETS)
    while True:
        step += 1
        sizes = ws.save(places.groupBy("region").agg(cost.alias("size")), f"sizes-{step}")
        fits = places.join(sizes.where(F.col("size") <= TILE).select("region"), "region")
        links = fits.join(needed(sets, fits.select(F.col("node").alias("a"))), "node").select("region", "node", "shingles").groupBy("region").applyInArrow(join_tile, "a long, b long")
        found.append(ws.save(links, f"joined-{step}"))
        large = sizes.where(F.col("size") > TILE)
        if large.isEmpty():
            break
        tiles = F.ceil(2 * F.col("size") / TILE).cast("int")
        rows = places.join(large.select("region", "size", tiles.alias("tiles")), "region")
        rows = ws.save(rows.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")), f"large-{step}")
        own = needed(sets, rows.select(F.col("node").alias("a")))
        turn = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(step)), "node"))
        pivots = rows.withColumn("turn", turn).where(F.col("turn") <= PIVOTS)
        drawn = needed(sets, ws.save(pivots.select(F.col("node").alias("a")), f"drawn-{step}"))
        pivots = ws.save(pivots.join(drawn, "node").select("region", "tiles", "shingles"), f"pivots-{step}")
        pivots = pivots.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("region", "tile", "shingles")
        whole = rows.join(own, "node").select("region", "tile", "node", "shingles")
        split = whole.groupBy("region", "tile").cogroup(pivots.groupBy("region", "tile"))
        split = ws.save(split.applyInArrow(_placed, "region long, child int, node long, n long"), f"split-{step}")
        children = split.groupBy("region", "child").agg(cost.alias("child_size"))
        children = ws.save(children.join(large, "region"), f"children-{step}")
        shrunk = children.where(F.col("child_size") <= 0.7 * F.col("size"))
        next_ = split.join(shrunk.select("region", "child"), ["region", "child"])
        next_ = next_.select(F.xxhash64("region", "child", F.lit(step)).alias("region"), "node", "n")
        stuck = split.join(children.where(F.col("child_size") > 0.7 * F.col("size")), ["region", "child"])
        stuck = stuck.withColumn("tiles", F.ceil(2 * F.col("child_size") / TILE).cast("int"))
        stuck = stuck.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(step)), "tiles").cast("int"))
        stuck = ws.save(stuck.select(F.xxhash64("region", "child").alias("region"), "tiles", "tile", "node"), f"stuck-{step}")
        ws.release()
        if not stuck.isEmpty():
            rest = needed(sets, stuck.select(F.col("node").alias("a")))
            packed = stuck.join(rest, "node").select("region", "tiles", "tile", "node", "shingles").groupBy("region", "tile")
            packed = ws.save(packed.applyInArrow(_packed, "region long, tiles int, tile int, sets binary"), f"tiles-{step}")
            other = packed.select(F.col("region").alias("of"), F.col("tile").alias("with"), F.col("sets").alias("others"))
            turn = F.when(F.col("tiles") == 1, F.col("tile") == F.col("with")).otherwise(
                F.when((F.col("tile") + F.col("with")) % 2 == 0, F.col("tile") < F.col("with")).otherwise(F.col("tile") > F.col("with"))
            )
            both = packed.join(other.hint("shuffle_replicate_nl"), (F.col("region") == F.col("of")) & turn).select("sets", "others")
            found.append(ws.save(both.mapInArrow(_of_two, "a long, b long"), f"blocks-{step}"))
        places = ws.save(next_, f"places-{step}")
        ws.release()
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def join(docs: DataFrame, id_col: str, text_col: str, ws: Workspace) -> DataFrame:
    """(id_col, n_shingles, component_id), one row per input row.

    Null, empty and blank texts have no shingles and link with nothing. Texts with the same set are linked. `component_id` is the
    smallest id reachable by links (null if all ids there are null). Repeated rows and ids are kept one by one; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, node long, n long, shingle long, seen long"
    in_run, most = SEEN_IN_RUN, SMALL  # values for the workers, which do not share this module's state
    seen = ws.save(rows.mapInArrow(lambda b: _described(b, pa.int64(), in_run), schema), "described")
    described = seen.where("shingle IS NULL").select("doc", "node", "n")
    often = seen.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= SEEN)
    often = often.orderBy(F.desc("seen"), "shingle").limit(LISTED).select("shingle").toArrow().column(0).to_numpy().view(np.uint64)
    texts = rows.select("text")
    entered = texts.mapInArrow(lambda b: _entered(b, often), "shingle long, node long, place long")
    met = entered.repartition("shingle").sortWithinPartitions("shingle", "node")
    met = ws.save(met.mapInArrow(lambda b: _met(b, most), "a long, b long, need long, crowd long, n long"), "met")
    ws.release()
    pairs = met.where("crowd IS NULL").groupBy("a", "b").agg(F.count("*").alias("times"), F.max("need").alias("need"))
    pairs = ws.save(pairs.where("times >= need").select("a", "b", "times"), "pairs")
    members = met.where("crowd IS NOT NULL").select("crowd", F.col("a").alias("node"), "n")
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(members.select(F.col("node").alias("a")))
    wanted = ws.save(wanted.distinct(), "wanted")
    bitmap = spark.sparkContext.broadcast(bitmap_of(wanted, MAX_BITS))
    sets = texts.mapInArrow(lambda b: _sets(b, bitmap.value), "node long, shingles binary")
    sets = ws.save(sets.dropDuplicates(["node"]), "sets")
    ws.release()

    def verified(some: DataFrame, name: str) -> DataFrame:
        some = ws.save(some, f"{name}-asked")
        for c in "ab":
            side = needed(sets, some.select(F.col(c).alias("a")))
            some = some.join(side.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")), c)
        out = ws.save(some.select("a", "b", "of_a", "of_b").mapInArrow(_verified, "a long, b long"), name)
        ws.release()
        return out

    # First for each document the pair that met most often, then of the others those that do not lie in one group already.
    likely = ws.save(pairs.groupBy("b").agg(F.max(F.struct("times", "a"))["a"].alias("a")), "likely")
    links = verified(likely, "links").unionByName(_crowds(members, sets, ws))
    united = ws.save(components(links, ws, "united"), "united")
    ends = [united.select(F.col("node").alias(c), F.col("component").alias(f"group_{c}")) for c in "ab"]
    others = pairs.select("a", "b").join(likely, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    others = others.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b")
    others = verified(others, "other-links")
    groups = united if others.isEmpty() else ws.save(components(links.unionByName(others), ws, "groups"), "groups")
    named = described.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("first"))
    named = named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = ws.save(named.select("node", "component", "first"), "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = ws.save(named.join(lowest, "component").select("node", "component_id"), "components")
    ws.discard("met", "sets")
    ws.release()
    kind = docs.schema[id_col].dataType
    out = described.where("node IS NOT NULL").join(named, "node").select("doc", "n", "component_id")
    out = out.unionByName(described.where("node IS NULL").select("doc", "n", F.col("doc").alias("component_id")))
    return out.select(F.col("doc").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
