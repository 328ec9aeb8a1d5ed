"""First-fit grouping of partitions too large for one task, with the same result as grouping them in one pass.

Rows are taken in ascending id, one block per partition and step. A block is small enough for one task; it is grouped
there, and its members meet all rows still waiting, which note which groups accept them so far. A refusal is final,
because groups only grow. So a waiting row is settled early if the first group that still accepts it lies in a ball so
small that none of the rows this group may yet take can be further than eps from it. Tight groups of any size are
settled after their first block this way, everything else in its turn.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgroup.functions import kernels
from epsgroup.functions.firstfit import SAFE, first_fit
from epsgroup.functions.metrics import EUCLIDEAN, Metric
from epsgroup.operators.local import drop_copies
from epsgroup.operators.sizes import join_small
from epsgroup.operators.tilewise import group_tilewise, planned
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

ROW = "path string, id bigint, weight bigint, features array<double>, base array<int>"
LABELLED = f"{ROW}, group_id bigint"
CELLS_PER_BLOCK = 4
PAIRS = 1 << 22


@dataclass
class Block:
    """Members of one partition's block, sorted by group, as sent to the tasks."""

    x: np.ndarray
    groups: np.ndarray
    starts: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    fresh: np.ndarray
    metric: Metric

    def accepts(self, x, needed, eps):
        """Which groups accept which rows, where needed. Balls around the members decide most pairs."""
        low, high = self.metric.bounds(x, self.centers)
        result = high + self.radii <= eps * SAFE
        unsure = needed & ~result & (low - self.radii <= eps / SAFE)
        ends = np.append(self.starts[1:], len(self.x))
        for g in np.flatnonzero(unsure.any(axis=0)):
            rows = np.flatnonzero(unsure[:, g])
            result[rows, g] = self.metric.within(x[rows], self.x[self.starts[g] : ends[g]], eps).all(axis=1)
        return result


def group_large(rows: DataFrame, eps: float, block_rows: int, ws: Workspace, name: str, metric=EUCLIDEAN) -> DataFrame:
    """(path, group_id, id, weight, features) of the owned groups of all partitions in `rows`, each too large for one task.

    Partitions that can be cut into tiles many eps wide are grouped tile by tile, others block by block.
    """
    rows = ws.save(rows.select("path", "id", "weight", "features", "base"), f"{name}-rows")
    plan = planned(rows, eps if metric.coordinatewise else 0.0, block_rows, ws, name)
    number = plan.count()
    labelled = None
    if number:
        labelled = group_tilewise(join_small(rows, plan.select("path"), "path", number, "left_semi"), plan, number, eps, metric, ws, f"{name}-tile")
        rows = ws.save(rows.join(plan.select("path"), "path", "left_anti"), f"{name}-others")
    if not number or not rows.isEmpty():
        blocks = group_blockwise(rows, eps, block_rows, ws, name, metric)
        labelled = blocks if labelled is None else labelled.select(blocks.columns).unionByName(blocks)
    return drop_copies(labelled).select("path", "group_id", "id", "weight", "features")


def group_blockwise(rows: DataFrame, eps: float, block_rows: int, ws: Workspace, name: str, metric=EUCLIDEAN) -> DataFrame:
    """(path, id, weight, features, base, group_id) of all rows. All partitions take their steps together, and no member passes
    through the driver."""
    ship(rows.sparkSession)
    shares = rows.groupBy("path").agg(F.count("*").alias("total"))
    shares = ws.save(shares.select("path", F.ceil(F.col("total") / block_rows).cast("int").alias("shares")), f"{name}-shares")
    total, cell_rows = rows.count(), max(1, block_rows // CELLS_PER_BLOCK)
    slot = F.col("slot")
    waiting = (
        rows.repartitionByRange(max(1, total // block_rows), "path", "id")
        .sortWithinPartitions("path", "id")
        .withColumn("slot", F.monotonically_increasing_id())
        .withColumn("cell", slot - slot % F.lit(1 << 33) + F.floor(slot % F.lit(1 << 33) / cell_rows).cast("bigint"))
        .drop("slot")
        .withColumn("offers", F.array().cast("array<struct<group_id:bigint,gap:double>>"))
        .join(shares, "path")
        .withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        .drop("shares")
    )
    waiting = ws.save(waiting, f"{name}-waiting-0")
    founded = step = 0
    while True:
        ends = ws.save(_next_cells(waiting, block_rows), f"{name}-ends-{step}")
        if ends.isEmpty():
            break
        marked = waiting.join(ends, "path")
        block = marked.where(F.col("cell") <= F.col("end")).drop("end", "cell", "share")
        grouped = block.groupBy("path").applyInArrow(_grouper(eps, metric), LABELLED)
        ws.save_step(grouped, f"{name}-labelled", step)
        done = ws.steps(f"{name}-labelled", grouped.schema).where(F.col("step") == step)
        rest = marked.where(F.col("cell") > F.col("end")).drop("end")
        waiting = ws.save(_updated(rest, done, shares, eps, metric), f"{name}-waiting-{step + 1}")
        founded += done.where("group_id = id").count()
        settled, waiting = _settle(waiting, eps, founded)
        ws.save_step(settled, f"{name}-labelled", step + 1)
        waiting = waiting.select(rest.columns)
        step += 2
    schema = T.StructType([*rows.schema.fields, T.StructField("group_id", T.LongType())])
    return ws.steps(f"{name}-labelled", schema).drop("step")


def _next_cells(waiting, block_rows):
    """(path, end): the last cell of each partition's next block, which has whole cells, at least one, and up to
    block_rows waiting rows."""
    order = Window.partitionBy("path").orderBy("cell")
    sums = waiting.groupBy("path", "cell").count()
    sums = sums.withColumn("upto", F.sum("count").over(order)).withColumn("nr", F.row_number().over(order))
    fitting = sums.where((F.col("upto") <= block_rows) | (F.col("nr") == 1))
    return fitting.groupBy("path").agg(F.max("cell").alias("end"))


def _grouper(eps, metric):
    def group(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("id")))
        offers = table.column("offers").combine_chunks()
        keys = offers.flatten().field("group_id").to_numpy()
        bounds = np.concatenate([[0], np.cumsum(offers.value_lengths().to_numpy())])
        lists = [keys[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        label = first_fit(table.column("id").to_numpy(), kernels.vectors_of(table.column("features")), eps, lists, metric)
        return table.drop_columns(["offers"]).append_column("group_id", pa.array(label))

    return group


def _block(table: pa.Table, metric) -> Block:
    """The members of one partition's block."""
    table = table.sort_by([(name, "ascending") for name in ("group_id", "id")])
    x, ids, groups = kernels.vectors_of(table.column("features")), table.column("id").to_numpy(), table.column("group_id").to_numpy()
    keys, starts = np.unique(groups, return_index=True)
    counts = np.diff(np.append(starts, len(x)))
    centers = np.add.reduceat(x, starts, axis=0) / counts[:, None]
    offsets = metric.aligned(x, np.repeat(centers, counts, axis=0))
    radii = np.maximum.reduceat(offsets, starts) * (1 + 1e-12)
    return Block(x, keys, starts, centers, radii, np.isin(keys, ids), metric)


def _updated(rest, done, shares, eps, metric):
    """Waiting rows with their offers brought up to date: groups of the block that refuse a row are taken out of its list,
    new groups that accept it are added with the distance to their centre.

    The waiting rows of a partition are dealt to shares of about a block each, and every share gets the block's members.
    """
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    members = done.select("path", "id", "features", "group_id").join(shares, "path").select("path", every, "id", "features", "group_id")

    def update(rows: pa.Table, members: pa.Table) -> pa.Table:
        if not rows.num_rows or not members.num_rows:
            return rows
        block, x = _block(members, metric), kernels.vectors_of(rows.column("features"))
        offers = rows.column("offers").combine_chunks()
        entries = offers.flatten()
        owner = np.repeat(np.arange(len(x)), offers.value_lengths().to_numpy(zero_copy_only=False))
        group = entries.field("group_id").to_numpy(zero_copy_only=False)
        gap = entries.field("gap").to_numpy(zero_copy_only=False)
        stay = np.ones(len(group), dtype=bool)
        added = []
        for piece in kernels.row_blocks(len(x), len(block.x), PAIRS):
            held = np.flatnonzero((owner >= piece.start) & (owner < piece.stop))
            at = np.searchsorted(block.groups, group[held])
            touched = block.groups[np.minimum(at, len(block.groups) - 1)] == group[held]
            held, at = held[touched], at[touched]
            needed = np.tile(block.fresh, (piece.stop - piece.start, 1))
            needed[owner[held] - piece.start, at] = True
            accepts = block.accepts(x[piece], needed, eps)
            stay[held] = accepts[owner[held] - piece.start, at]
            i, j = np.nonzero(accepts & block.fresh)
            distance = metric.aligned(x[piece][i], block.centers[j])
            added.append((i + piece.start, block.groups[j], distance))
        owner = np.concatenate([owner[stay], *[a[0] for a in added]])
        group = np.concatenate([group[stay], *[a[1] for a in added]])
        gap = np.concatenate([gap[stay], *[a[2] for a in added]])
        order = np.lexsort((group, owner))
        fields = pa.StructArray.from_arrays([pa.array(group[order]), pa.array(gap[order])], ["group_id", "gap"])
        ends = np.searchsorted(owner[order], np.arange(len(x) + 1))
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
        return rows.set_column(rows.schema.get_field_index("offers"), "offers", column)

    together = rest.groupBy("path", "share").cogroup(members.groupBy("path", "share"))
    return together.applyInArrow(update, rest.schema)


def _settle(waiting, eps, groups):
    """(settled rows with group_id, rows that go on waiting). `groups` bounds the number of groups so far."""
    reach = (
        waiting.select("path", F.inline("offers")).groupBy("path", "group_id").agg(F.max("gap").alias("radius"))
    )
    first = F.col("offers")[0]
    has_offer = F.size("offers") > 0
    marked = waiting.withColumn("group_id", F.when(has_offer, first["group_id"])).withColumn(
        "gap", F.when(has_offer, first["gap"])
    )
    marked = join_small(marked, reach, ["path", "group_id"], groups, "left")
    safe = F.coalesce(F.col("gap") + F.col("radius") <= eps * SAFE, F.lit(False))
    settled = marked.where(safe).select("path", "id", "weight", "features", "base", "group_id")
    return settled, marked.where(~safe)
