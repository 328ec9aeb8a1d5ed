"""Prefix trie of conversations, with totals of every subtree by time-forward processing.

A turn is known by a 128-bit hash of its role and text, a prefix by the exclusive or of hashes of its turns with their
places. Such a sum can be put together from pieces, so a conversation of any length is worked on in parts of PART turns; only
numbers are shuffled, never texts. Nodes are numbered in an order that keeps subtrees together and cut into shards of equal
size. In a shard the nodes come in reverse level order, sorted by Spark, and send their totals to their parents through a
priority queue that spills. What leaves a shard goes along the shard roots, which form a smaller tree that is worked off in
the same way; then each shard runs once more with what other shards sent it.
"""

import hashlib
import heapq
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epsgroup.operators.ranking import placed
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

PART = 1024  # turns of a conversation in one window
HEAD = 4  # first turns that order the nodes
SHARD = 1 << 15  # nodes of a shard
QUEUE = 1 << 18  # messages a queue holds in memory
PACKED = 1 << 13  # conversation numbers in one packed row


def heads(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, ws: Workspace) -> DataFrame:
    """(conv, place, t1, t2, chars): the turns of each conversation from place 0, known by their hashes.

    Turns are ordered by `turn_col` (null first); those of one number by their hashes, so repeated rows are turns of their
    own. A null role or text is empty. Rows with a null conversation belong to none and are left out. Other columns are
    ignored; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        *_turn_key(role, text), F.char_length(text).cast("long").alias("chars"),
    )
    order = [F.col(c) for c in ("conv", "turn", "t1", "t2")]
    rows = ws.save(placed(rows, order, ws, "turns", "at"), "turns-placed")
    # A conversation may lie in many ranges of places; its first place is found per block of places.
    block = F.floor(F.col("at") / PART).alias("block")
    firsts = rows.groupBy("conv", block).agg(F.min("at").alias("own"))
    start = F.min("own").over(Window.partitionBy("conv").orderBy("block")).alias("start")
    firsts = firsts.select("conv", "block", start)
    return rows.withColumn("block", block).join(firsts, ["conv", "block"]).select(
        "conv", (F.col("at") - F.col("start")).alias("place"), "t1", "t2", "chars"
    )


def _turn_key(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), role, text).alias(f"t{i}") for i in (1, 2)]


def nodes_of(turns: DataFrame, convs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of `turns` as `heads` gives them; `convs` (conv) has all conversations, turnless ones too.

    nodes: (number, shard, depth, parent, parent_shard, conv, parent_conv, n_convs, n_children, chars, t1, t2).
    ends: (number, conv), the node at which each conversation ends.
    """
    salted = [F.xxhash64(F.lit(2 + i), "place", "t1", "t2").alias(f"e{i}") for i in (1, 2)]
    rows = turns.select("*", F.floor(F.col("place") / PART).alias("part"), *salted)
    within = Window.partitionBy("conv", "part").orderBy("place")
    upto = [F.bit_xor(f"e{i}").over(within).alias(f"x{i}") for i in (1, 2)]
    rows = rows.select("conv", "part", "place", "t1", "t2", "chars", "e1", "e2", *upto)
    rows = ws.save(rows.withColumn("last", F.lead("place").over(within).isNull()), "prefixes")
    # What the parts before add, and the first HEAD prefixes of the conversation.
    sums = rows.where("last").select("conv", "part", "x1", "x2")
    first = rows.where(F.col("place") < HEAD).groupBy("conv").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "x1"))), lambda p: p["x1"]).alias("head")
    )
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(first, "conv").select(
        "conv", "part", "head", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)]
    )
    final = sums.groupBy("conv").agg(F.max("part").alias("final"))
    sums = ws.save(sums.join(final, "conv").withColumn("final", F.col("part") == F.col("final")), "parts")
    key = [F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}") for i in (1, 2)]
    above = [F.col(f"x{i}").bitwiseXOR(F.col(f"e{i}")).bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)]
    rows = rows.join(sums, ["conv", "part"]).select(
        "conv", (F.col("place") + 1).alias("depth"), *key, *above, "t1", "t2", "chars",
        F.slice("head", 1, F.least(F.col("place") + 1, F.lit(HEAD)).cast("int")).alias("head"), (F.col("last") & F.col("final")).alias("ends"),
    )
    rows = ws.save(rows, "rows")
    alike = [F.first(c).alias(c) for c in ("p1", "p2", "t1", "t2", "chars", "head")]
    found = rows.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *alike)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv", "n_convs", none.alias("p1"), none.alias("p2"),
        none.alias("t1"), none.alias("t2"), zero.alias("chars"), F.array().cast("array<long>").alias("head"),
    )
    order = [*[F.get("head", F.lit(i)) for i in range(HEAD)], F.col("conv"), F.col("depth"), F.col("k1"), F.col("k2")]
    found = ws.save(placed(found.unionByName(root), order, ws, "nodes-sorted", "number"), "nodes-placed")
    found = found.withColumn("shard", F.floor(F.col("number") / SHARD)).drop("head")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    children = children.agg(F.count("*").alias("n_children"))
    found = found.join(children, ["depth", "k1", "k2"], "left").fillna(0, ["n_children"])
    parents = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("number").alias("parent"), F.col("shard").alias("parent_shard"), F.col("conv").alias("parent_conv"),
    )
    nodes = ws.save(found.join(parents, ["depth", "p1", "p2"], "left"), "nodes")
    keys = nodes.select("depth", "k1", "k2", "number")
    ends = rows.where("ends").select("conv", "depth", "k1", "k2").join(keys, ["depth", "k1", "k2"]).select("number", "conv")
    # The root comes first in the order of the nodes.
    turnless = convs.join(turns.select("conv").distinct(), "conv", "left_anti").select(zero.alias("number"), "conv")
    return nodes.drop("k1", "k2", "p1", "p2"), ends.unionByName(turnless)


class Queue:
    """A priority queue of equally long tuples of 64-bit numbers. Beyond `limit` tuples it writes them out in sorted runs.

    Runs are scratch of one task, in a file that has no name and ends with the task.
    """

    def __init__(self, width: int, limit: int | None = None):
        self.code, self.limit = struct.Struct(f"<{width}q"), limit or QUEUE
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (first tuple, number of the run, the rest of it)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            keep = self.limit // 2
            file = tempfile.TemporaryFile()
            file.writelines(self.code.pack(*x) for x in self.heap[keep:])
            file.seek(0)
            del self.heap[keep:]
            rest = iter(lambda: file.read(self.code.size), b"")
            heapq.heappush(self.runs, (self.code.unpack(next(rest)), len(self.runs), rest))

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not self.runs or self.heap and self.heap[0] <= self.runs[0][0]:
            return heapq.heappop(self.heap)
        item, number, rest = self.runs[0]
        after = next(rest, None)
        if after is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (self.code.unpack(after), number, rest))
        return item


UP = "shard long, depth long, number long, parent_shard long, parent_depth long, parent long, leaves long, saved long, top long"


def _up(batches):
    """Totals of the nodes of each shard, sorted by shard, falling depth, number and kind.

    A row of kind 0 is a message of another shard, of kind 1 a node. `top` is the root of the node's piece of the shard.
    """
    shard, queue, done = None, Queue(4), []

    def finished():
        top = {}
        for row in reversed(done):  # parents come before their children
            inside = row[5] is not None and row[3] == row[0]
            top[row[2]] = top[row[5]] if inside else row[2]
        for a in range(0, len(done), 10_000):
            rows = [(*row, top[row[2]]) for row in done[a : a + 10_000]]
            names = [part.split()[0] for part in UP.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            here, depth, number, kind, parent_shard, parent_depth, parent, leaves, saved = row
            if here != shard:
                yield from finished()
                shard, queue, done = here, Queue(4), []
            if kind == 0:
                queue.push((-depth, number, leaves, saved))
                continue
            while (message := queue.first()) is not None and message[:2] == (-depth, number):
                queue.pop()
                leaves += message[2]
                saved += message[3]
            if parent is not None and parent_shard == here:
                queue.push((-parent_depth, parent, leaves, saved))
            done.append((here, depth, number, parent_shard, parent_depth, parent, leaves, saved))
    yield from finished()


def _pass(nodes: DataFrame, messages: DataFrame | None) -> DataFrame:
    columns = ["shard", "depth", "number", "kind", "parent_shard", "parent_depth", "parent", "leaves", "saved"]
    rows = nodes.withColumn("kind", F.lit(1)).select(columns)
    if messages is not None:
        none = [F.lit(None).cast("long").alias(c) for c in columns[4:7]]
        rows = rows.unionByName(messages.select("shard", "depth", "number", F.lit(0).alias("kind"), *none, "leaves", "saved"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "number", "kind")
    return rows.mapInArrow(_up, UP)


def subtree_totals(nodes: DataFrame, ws: Workspace, name: str = "totals") -> DataFrame:
    """(number, leaves, saved): both summed over the subtree of every node.

    nodes: (shard, depth, number, parent_shard, parent_depth, parent, leaves, saved); a parent has a smaller depth and
    number than its children, and the root has a null parent. A shard holds SHARD nodes at most.
    """
    ship(nodes.sparkSession)
    local = ws.save(_pass(nodes, None), f"{name}-local")
    leaving = local.where("parent_shard <> shard")
    target = [F.col("parent_shard").alias("shard"), F.col("parent_depth").alias("depth"), F.col("parent").alias("number")]
    targets = ws.save(leaving.select(*target).distinct(), f"{name}-targets")
    if targets.isEmpty():
        return local.select("number", "leaves", "saved")
    tops = ws.save(local.join(targets.select("number"), "number").select("number", "top"), f"{name}-tops")
    inner = ws.save(tops.select(F.col("top").alias("number")).distinct(), f"{name}-inner")
    # Roots without messages from outside are final; the others form the smaller tree.
    plain = leaving.join(inner, "number", "left_anti").groupBy(*target).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    plain = ws.save(plain, f"{name}-plain")
    given = plain.join(tops, "number").groupBy(F.col("top").alias("number"))
    given = given.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    up = local.select(F.col("number").alias("above"), F.col("depth").alias("above_depth"))
    small = local.join(inner, "number").join(given, "number", "left").join(tops.withColumnsRenamed({"number": "parent", "top": "above"}), "parent", "left")
    small = small.join(up, "above", "left").select(
        "depth", "number", F.col("above").alias("parent"), F.col("above_depth").alias("parent_depth"), F.col("parent").alias("hung_on"),
        F.col("parent_shard").alias("hung_shard"), F.col("parent_depth").alias("hung_depth"),
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )
    small = ws.save(placed(small, [F.col("number")], ws, f"{name}-roots-sorted"), f"{name}-roots")
    small = small.withColumn("shard", F.floor(F.col("place") / SHARD))
    homes = small.select(F.col("number").alias("parent"), F.col("shard").alias("parent_shard"))
    full = subtree_totals(ws.save(small.join(homes, "parent", "left"), f"{name}-small"), ws, f"{name}-up")
    sent = small.where("hung_on IS NOT NULL").select("number", "hung_on", "hung_shard", "hung_depth").join(full, "number").select(
        F.col("hung_shard").alias("shard"), F.col("hung_depth").alias("depth"), F.col("hung_on").alias("number"), "leaves", "saved"
    )
    sent = sent.unionByName(plain).groupBy("shard", "depth", "number").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return ws.save(_pass(nodes, ws.save(sent, f"{name}-sent")), f"{name}-all").select("number", "leaves", "saved")


def build(turns: DataFrame, convs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) with n_leaves and saved_tokens of every subtree: the childless nodes in it, and for each node in it the
    code points of its last text times the conversations beyond the first that share it. See `nodes_of` for the arguments."""
    nodes, ends = nodes_of(turns, convs, ws)
    own = nodes.select(
        "shard", "depth", "number", "parent_shard", (F.col("depth") - 1).alias("parent_depth"), "parent",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    totals = subtree_totals(own, ws).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    return ws.save(nodes.join(totals, "number"), "trie"), ws.save(ends, "ends")


def with_texts(nodes: DataFrame, turns: DataFrame, role_col: str, text_col: str) -> DataFrame:
    """Nodes with the role and text of their last turn (null at the root)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = turns.select(role.alias("role"), text.alias("text")).select(*_turn_key(F.col("role"), F.col("text")), "role", "text")
    said = said.groupBy("t1", "t2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(said, ["t1", "t2"], "left").drop("t1", "t2")


def _packed(batches):
    for batch in batches:
        node, conv = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = sorted({0, *range(0, len(node), PACKED), *((node[1:] != node[:-1]).nonzero()[0] + 1).tolist()})
        rows = [(int(node[a]), int(conv[a]), ",".join(map(str, conv[a:b].tolist()))) for a, b in zip(cuts, [*cuts[1:], len(node)], strict=True) if b > a]
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows, strict=True)] or [()] * 3, kinds, strict=True)], ["number", "conv", "ids"])


def _digested(batches):
    node, digest = None, None
    for batch in batches:
        out = []
        for number, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if number != node:
                if digest:
                    out.append((node, digest.hexdigest()))
                node, digest = number, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out, strict=True)] or [()] * 2, (pa.int64(), pa.string()), strict=True)], ["number", "sha"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], ["number", "sha"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(number, sha): SHA-256 of the numbers of the conversations that end at each node, ascending, with commas between.

    Ranges of (node, conversation) are packed to one row for PACKED numbers; the packed rows of a node then stream through its
    digest one by one. A digest has no parallel form, so one task reads the numbers of a node, but never holds them.
    """
    ship(ends.sparkSession)
    ranged = ends.select("number", "conv").repartitionByRange("number", "conv").sortWithinPartitions("number", "conv")
    packed = ranged.mapInArrow(_packed, "number long, conv long, ids string")
    streams = packed.repartition("number").sortWithinPartitions("number", "conv").select("number", "ids")
    return streams.mapInArrow(_digested, "number long, sha string")
