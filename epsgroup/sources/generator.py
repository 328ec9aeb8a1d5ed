"""Test tables of well separated groups."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epsgroup.workspace import Workspace

GROUPS_PER_BLOCK = 4096
POINTS_PER_CHUNK = 4096
MAX_COPIES = 3


def _random(seed: int, *parts, chunk: int = 0) -> Column:
    """A number below 2^32 from a hash of seed and parts; each hash yields four, chosen by `chunk`."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1 + 8 * chunk, 8), 16, 10).cast("bigint")


def group_sizes(spec: DataFrame, min_points: int, max_points: int, seed: int, ws: Workspace) -> DataFrame:
    """(sf, grp, size, before): groups of size min..max-1 until the points of each scale factor are used up; the last
    one is cut. `before` counts the points of the scale factor in front of the group.

    Running totals come in two levels, blocks of groups and groups in a block, so no task sorts a whole scale factor.
    """
    if not 1 <= min_points < max_points:
        raise ValueError("need 1 <= min_points < max_points")
    zero = F.lit(0).cast("bigint")
    most = F.ceil(F.col("points") / min_points).cast("bigint")
    block = F.explode(F.sequence(zero, F.floor((most - 1) / GROUPS_PER_BLOCK))).alias("block")
    blocks = spec.where("points > 0").select("sf", "points", most.alias("most"), block).repartition("sf", "block")
    first = F.col("block") * GROUPS_PER_BLOCK
    grp = F.explode(F.sequence(first, F.least(first + GROUPS_PER_BLOCK, F.col("most")) - 1)).alias("grp")
    drawn = blocks.select("sf", "points", "block", grp)
    drawn = drawn.withColumn("size", _random(seed, "size", F.col("sf"), F.col("grp")) % (max_points - min_points))
    drawn = ws.save(drawn.withColumn("size", F.col("size") + min_points), "drawn")
    blocks = drawn.groupBy("sf", "block").agg(F.sum("size").alias("block_size"))
    in_sf = Window.partitionBy("sf").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("sf", "block", F.coalesce(F.sum("block_size").over(in_sf), F.lit(0)).alias("offset"))
    in_block = Window.partitionBy("sf", "block").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    running = drawn.withColumn("inner", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    placed = running.join(blocks, ["sf", "block"]).withColumn("before", F.col("inner") + F.col("offset"))
    cut = F.least(F.col("size"), F.col("points") - F.col("before"))
    return placed.where(F.col("before") < F.col("points")).select("sf", "grp", cut.alias("size"), "before")


def _points(sizes: DataFrame, seed: int) -> DataFrame:
    """(sf, grp, size, before, chunk, point, copies): the points of each group, in chunks."""
    zero, chunk = F.lit(0).cast("bigint"), F.col("chunk")
    last = F.floor((F.col("size") - 1) / POINTS_PER_CHUNK)
    chunks = sizes.select("sf", "grp", "size", "before", F.explode(F.sequence(zero, last)).alias("chunk"))
    end = F.least((chunk + 1) * POINTS_PER_CHUNK, F.col("size")) - 1
    points = chunks.select("*", F.explode(F.sequence(chunk * POINTS_PER_CHUNK, end)).alias("point"))
    copies = _random(seed, "copies", F.col("sf"), F.col("grp"), F.col("point")) % MAX_COPIES + 1
    return points.withColumn("copies", copies)


def generate(
    spec: DataFrame, dimension: int, min_points: int, max_points: int, eps: float, seed: int, workspace: Workspace | None = None
) -> DataFrame:
    """(id, agg, features, sf) for a table of scale factors (sf, points); `agg` is the number of the true group.

    The points of a group lie in a cube whose diagonal is eps; groups are 2 eps apart along the first coordinate and
    scale factors along the second. Every point appears 1 to 3 times. Ids and group numbers run over all scale factors.
    The same seed gives the same table on any cluster. The sizes of the groups are written once; a group of any size is
    made in chunks, so none is one row or one window.
    """
    if dimension < 2:
        raise ValueError("need at least two dimensions")
    ws = workspace or Workspace(spec.sparkSession)
    sizes = ws.save(group_sizes(spec, min_points, max_points, seed, ws), "sizes")
    in_order = Window.orderBy("sf").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("sf").agg(F.sum("size").alias("sf_points"), F.count("*").alias("sf_groups"))
    starts = totals.select(
        "sf",
        F.coalesce(F.sum("sf_points").over(in_order), F.lit(0)).alias("first_id"),
        F.coalesce(F.sum("sf_groups").over(in_order), F.lit(0)).alias("first_group"),
    )
    in_chunk = Window.partitionBy("sf", "grp", "chunk").orderBy("point").rowsBetween(Window.unboundedPreceding, -1)
    points = _points(sizes, seed).withColumn("used", F.coalesce(F.sum("copies").over(in_chunk), F.lit(0)))
    large = sizes.where(F.col("size") > POINTS_PER_CHUNK)
    if not large.isEmpty():
        chunks = _points(large, seed).groupBy("sf", "grp", "chunk").agg(F.sum("copies").alias("chunk_copies"))
        in_group = Window.partitionBy("sf", "grp").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.select("sf", "grp", "chunk", F.coalesce(F.sum("chunk_copies").over(in_group), F.lit(0)).alias("earlier"))
        points = points.join(chunks, ["sf", "grp", "chunk"], "left")
        points = points.withColumn("used", F.col("used") + F.coalesce("earlier", F.lit(0)))
    points = points.where(F.col("used") < F.col("size"))
    side = eps / math.sqrt(dimension)
    names = F.col("sf"), F.col("grp"), F.col("point")
    drawn = [_random(seed, f"x{d // 4}", *names, chunk=d % 4) for d in range(dimension)]
    inside = [number / F.lit(4294967296.0) * F.lit(side) for number in drawn]
    inside[0] = inside[0] + F.col("grp") * F.lit(2.0 * eps)
    inside[1] = inside[1] + F.col("sf") * F.lit(2.0 * eps)
    shown = F.least(F.col("copies"), F.col("size") - F.col("used"))
    rows = points.select("*", F.array(*inside).alias("features"), F.explode(F.sequence(F.lit(1), shown)).alias("copy"))
    return rows.join(starts, "sf").select(
        (F.col("first_id") + F.col("before") + F.col("used") + F.col("copy")).alias("id"),
        (F.col("first_group") + F.col("grp")).cast("double").alias("agg"),
        "features",
        "sf",
    )
