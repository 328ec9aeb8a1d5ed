"""First-fit grouping of large partitions tile by tile, with the same result as grouping them in one pass.

Whether a row joins a group depends on rows at most 2 eps away only: a group it may join has a founder within eps of it, and
members within eps of the founder. So a row is decided as soon as no earlier row within 2 eps waits. Each task takes a tile of
the plane of the two widest coordinates and the rows up to 2 eps around it, and decides what it can, in the order of ids; inside,
a row meets only the cells of an eps grid next to its own. The tiles lie elsewhere in the next round, so that what waits at a
border comes to lie inside. Coordinates never differ by more than the distance, which makes the grid exact in any dimension.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.functions import kernels
from epsgroup.functions.firstfit import first_fit_in_cells
from epsgroup.operators.sizes import dimension_of, join_small
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

CELL = 4.0  # eps
NARROWEST = 4  # a tile is 2^NARROWEST cells wide at least: in narrower ones nearly all rows would wait for a neighbour
WIDEST = 24
SLACK = 1 + 1e-9
FARTHEST = 2.0**40  # cells from the origin, so that their numbers stay exact
SHIFTS = ((0.0, 0.0), (0.5, 0.5), (0.0, 0.5), (0.5, 0.0))
ROW = "path string, id bigint, weight bigint, features array<double>, base array<int>, x double, y double, width double, group_id bigint"


def planned(rows: DataFrame, eps: float, tile_rows: int, ws: Workspace, name: str) -> DataFrame:
    """(path, first, second, width): the two widest coordinates of the partitions that can be cut into tiles, and the widest
    tile that holds at most `tile_rows` rows. A partition of one coordinate has null as its second."""
    dimension = dimension_of(rows)
    spreads = [F.struct((F.max(F.col("features")[j]) - F.min(F.col("features")[j])).alias("spread"), F.lit(j).alias("j")) for j in range(dimension)]
    widest = F.sort_array(F.array(*spreads), asc=False) if dimension else F.array()
    if not dimension or eps <= 0:
        return rows.sparkSession.createDataFrame([], "path string, first int, second int, width double")
    chosen = rows.groupBy("path").agg(widest.alias("widest"))
    chosen = ws.save(chosen.select("path", F.get("widest", F.lit(0))["j"].alias("first"), F.get("widest", F.lit(1))["j"].alias("second")), f"{name}-axes")
    cells = on_axes(rows, chosen, chosen.count())
    cells = cells.groupBy("path", *[F.floor(F.col(c) / (CELL * eps)).alias(f"c{c}") for c in "xy"]).agg(
        F.count("*").alias("n"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far")
    )
    level = F.explode(F.sequence(F.lit(NARROWEST), F.lit(WIDEST))).alias("level")
    tiles = cells.select("path", "n", "far", "cx", "cy", level)
    tiles = tiles.groupBy("path", "level", *[F.floor(F.col(f"c{c}") / F.pow(F.lit(2.0), "level")).alias(f"t{c}") for c in "xy"])
    tiles = tiles.agg(F.sum("n").alias("n"), F.max("far").alias("far")).groupBy("path", "level").agg(F.max("n").alias("most"), F.max("far").alias("far"))
    fitting = tiles.where((F.col("most") <= tile_rows) & (F.col("far") <= FARTHEST * CELL * eps)).groupBy("path").agg(F.max("level").alias("level"))
    width = F.lit(CELL * eps) * F.pow(F.lit(2.0), "level")
    return ws.save(chosen.join(fitting, "path").select("path", "first", "second", width.alias("width")), f"{name}-tiles")


def on_axes(rows: DataFrame, chosen: DataFrame, number: int) -> DataFrame:
    """Rows with their coordinates `x` and `y` on the chosen axes."""
    y = F.when(F.col("second").isNull(), F.lit(0.0)).otherwise(F.get("features", F.col("second")))
    return join_small(rows, chosen, "path", number).withColumns({"x": F.get("features", F.col("first")), "y": y}).drop("first", "second")


def group_tilewise(rows: DataFrame, plan: DataFrame, number: int, eps: float, metric, ws: Workspace, name: str) -> DataFrame:
    """(path, id, weight, features, base, group_id) of the partitions of a plan (of so many rows).

    Each round is one job over the rows of the tiles that still have waiting rows. The first of all waiting rows is decided in any
    round, and with tiles many eps wide, a good share of each tile.
    """
    ship(rows.sparkSession)
    state = on_axes(rows.select("path", "id", "weight", "features", "base"), plan, number)
    state = ws.save(state.withColumn("group_id", F.lit(None).cast("long")).select(*[c.split()[0] for c in ROW.split(", ")]), f"{name}-state-0")
    turn = 0
    while True:
        shift = SHIFTS[turn % len(SHIFTS)]
        tile = [F.floor((F.col(c) / F.col("width")) + s) for c, s in zip("xy", shift, strict=True)]
        homes = state.select("*", tile[0].alias("tx"), tile[1].alias("ty"))
        busy = ws.save(homes.where("group_id IS NULL").select("path", "tx", "ty").distinct(), f"{name}-busy-{turn}")
        if busy.isEmpty():
            return state.drop("x", "y", "width")
        reach = F.lit(2 * eps * SLACK)

        def touched(c, s):
            return F.explode(F.sequence(F.floor((F.col(c) - reach) / F.col("width") + s), F.floor((F.col(c) + reach) / F.col("width") + s)))

        seen = state.select("*", touched("x", shift[0]).alias("tx")).select("*", touched("y", shift[1]).alias("ty"))
        home = (tile[0] == F.col("tx")) & (tile[1] == F.col("ty"))
        seen = seen.withColumn("home", home).join(busy, ["path", "tx", "ty"], "left_semi")
        decided = seen.groupBy("path", "tx", "ty").applyInArrow(lambda t: _decide(t, eps, metric), ROW)
        quiet = homes.join(busy, ["path", "tx", "ty"], "left_anti").select(state.columns)
        turn += 1
        state = ws.save(decided.unionByName(quiet), f"{name}-state-{turn}")


def _decide(table: pa.Table, eps: float, metric) -> pa.Table:
    table = table.take(pc.sort_indices(table.column("id")))
    home = table.column("home").to_numpy(zero_copy_only=False)
    known = table.column("group_id")
    group = np.where(known.is_null().to_numpy(), -1, known.fill_null(-1).to_numpy())
    decided = known.is_valid().to_numpy()
    plane = np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()])
    label, done, _ = first_fit_in_cells(table.column("id").to_numpy(), kernels.vectors_of(table.column("features")), plane, eps, group, decided, home, metric)
    out = table.drop_columns(["tx", "ty", "home", "group_id"]).append_column("group_id", pa.array(label, pa.int64(), mask=~done))
    return out.filter(pa.array(home))
