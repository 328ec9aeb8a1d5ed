"""Partitioning of the vector space by pivots, with copies across the borders.

`path` names a partition by the pivot indices of all rounds ("" before the first, then "3", "3.0", ...). `base` holds
the index of the nearest pivot in every round. Children of one partition that get the same rows ("twins") go on as one, whose
path has the indices of all of them ("3|7.0"); the groups found there get the path of the twin that owns them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgroup.functions import kernels, metrics
from epsgroup.functions.pointindex import PointIndex
from epsgroup.ship import ship
from epsgroup.workspace import Workspace

TARGETS = 1 << 21  # rows are placed in pieces that cannot have more targets, as a row may be sent to every pivot
TWINS = 64  # taken together at most, so that paths stay short
SAMPLE, STEPS, INSIDE = 256, 32, 1 - 1e-9
PLACED = T.StructType().add("near", T.IntegerType()).add("targets", T.ArrayType(T.IntegerType()))
EUCLIDEAN, METRIC = "euclidean", "metric"


def split_tiled(rows: DataFrame, pivots: DataFrame, eps: float, window: str, ws: Workspace, name: str, tile_bytes: int, metric=metrics.EUCLIDEAN) -> DataFrame:
    """Adds `near` and `targets` (all pivots the row is sent to), with the pivots sent to the tasks tile by tile.

    For pivot sets too large to send everywhere at once. The first passes find the nearest pivot, the second ones the other
    targets; what is known of each row is written between them. No join, so no partition can be hot.
    """
    ship(rows.sparkSession)
    size = pivots.agg(F.count("*"), F.max(F.size("features"))).head()
    tiles = max(1, -(-size[0] * 8 * (size[1] or 0) // tile_bytes))
    numbered = pivots.withColumn("tile", F.pmod(F.xxhash64("path", "pid"), F.lit(tiles)))
    state = "best int, gap double, base_features array<double>, found array<int>"
    known = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(state).fields])
    for place in (_closer, _bordering):
        for tile in range(tiles):
            points = _tile(numbered.where(F.col("tile") == tile), metric)
            shared = rows.sparkSession.sparkContext.broadcast(points)
            step = known.mapInArrow(lambda batches, p=place, s=shared: p(batches, s.value, eps, window, metric), known.schema)
            known = ws.save(step, f"{name}-{place.__name__}-{tile}")
    targets = F.array_sort(F.array_union(F.array("best"), F.coalesce("found", F.array().cast("array<int>"))))
    return known.select(*rows.columns, F.col("best").alias("near"), targets.alias("targets"))


def _tile(pivots: DataFrame, metric) -> dict:
    """{path: (pids, index)} of one tile."""
    table = pivots.select("path", "pid", "features").toArrow().sort_by([("path", "ascending"), ("pid", "ascending")])
    if not len(table):
        return {}
    coded = table.column("path").combine_chunks().dictionary_encode()
    starts = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))[1:]
    pids, points = table.column("pid").to_numpy(), kernels.vectors_of(table.column("features"))
    indexed = [PointIndex(own, metric) for own in np.split(points, starts)]
    return dict(zip(coded.dictionary.to_pylist(), zip(np.split(pids, starts), indexed, strict=True), strict=True))


def _by_path(batch, points):
    """(vectors, [(rows of a path, its pids, its index)]) for the paths of a batch that are in the tile."""
    coded = batch.column("path").dictionary_encode()
    code, x = coded.indices.to_numpy(zero_copy_only=False), kernels.vectors_of(batch.column("features"))
    paths = [(np.flatnonzero(code == i), *points[p]) for i, p in enumerate(coded.dictionary.to_pylist()) if p in points]
    if any(p.points.shape[1] != x.shape[1] for _, _, p in paths):
        raise ValueError("vectors and pivots differ in length")
    return x, paths


def _replaced(batch, **columns):
    for name, values in columns.items():
        at = batch.schema.get_field_index(name)
        batch = batch.set_column(at, batch.schema.field(at), values)
    return batch


def _lists(at, values, rows, kind) -> pa.ListArray:
    """The values of each row, which `at` gives, as a list column."""
    order = np.argsort(at, kind="stable")
    offsets = np.searchsorted(at[order], np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[order], kind))


def _closer(batches, points, eps, window, metric):
    for batch in batches:
        x, paths = _by_path(batch, points)
        best, gap = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).copy() for c in ("best", "gap"))
        held = batch.column("base_features")
        seen, base = held.is_valid().to_numpy(zero_copy_only=False).copy(), np.zeros(x.shape)
        base[seen] = kernels.vectors_of(held.drop_null(), x.shape[1])
        for here, pids, own in paths:
            near, distance = own.nearest(x[here], metric)
            new = np.isnan(gap[here]) | (distance < gap[here]) | ((distance == gap[here]) & (pids[near] < best[here]))
            rows, seen[here] = here[new], True
            base[rows], best[rows], gap[rows] = own.points[near[new]], pids[near[new]], distance[new]
        offsets = np.concatenate([[0], np.cumsum(seen * x.shape[1])])
        base = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(base[seen].ravel()), mask=pa.array(~seen))
        best, gap = pa.array(best, pa.float64(), from_pandas=True).cast(pa.int32()), pa.array(gap, from_pandas=True)
        yield _replaced(batch, best=best, gap=gap, base_features=base)


def _pieces(batches, most: int):
    """The batches in pieces whose rows have at most TARGETS targets if each is sent to `most` pivots."""
    for batch in batches:
        step = max(1, TARGETS // max(1, most))
        yield from (batch.slice(start, step) for start in range(0, len(batch), step))


def _bordering(batches, points, eps, window, metric):
    for batch in _pieces(batches, max((len(pids) for pids, _ in points.values()), default=1)):
        x, paths = _by_path(batch, points)
        gap, found = batch.column("gap").to_numpy(zero_copy_only=False), batch.column("found")
        many = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at, to = [np.repeat(np.arange(len(x)), many)], [found.flatten().to_numpy(zero_copy_only=False)]
        base = kernels.vectors_of(batch.column("base_features"), x.shape[1]) if paths else x
        for here, pids, own in paths:
            i, j = own.bordering(x[here], base[here], np.arange(len(here)), gap[here], metric, eps, window)
            at.append(here[i])
            to.append(pids[j])
        yield _replaced(batch, found=_lists(np.concatenate(at), np.concatenate(to), len(x), pa.int32()))


def split_shared(rows: DataFrame, pivots: dict, eps: float, window: str = EUCLIDEAN, metric=metrics.EUCLIDEAN, around: dict | None = None) -> DataFrame:
    """The same with the pivots of all partitions sent to every task: {path: matrix}. No shuffle.

    With `around` (see `crowds`, {path: matrix}) adds `least`: of all pivots that these were kept from, the row would be sent to
    that many at least; 0 unless the row is at most eps from its nearest one here, which then is one of them. For a row g from
    the pivot, the border with a pivot d from there is at most half of d + 2 g away.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast({k: PointIndex(v, metric) for k, v in pivots.items()})
    most = max(map(len, pivots.values()), default=1)

    def place(batches):
        for batch in _pieces(batches, most):
            coded = batch.column("path").dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            x = kernels.vectors_of(batch.column("features"))
            near, least = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int64)
            at, to = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for number, path in enumerate(coded.dictionary.to_pylist()):
                own, here = shared.value[path], np.flatnonzero(code == number)
                if x.shape[1] != own.points.shape[1]:
                    raise ValueError("vectors and pivots differ in length")
                near[here], gap = own.nearest(x[here], metric)
                if around is not None:
                    steps = np.floor(STEPS * (1 - gap / (eps * INSIDE))).astype(np.int64)
                    least[here] = np.where(steps >= 0, around[path][near[here], np.maximum(steps, 0)], 0)
                i, j = own.targets(x[here], near[here], gap, metric, eps, window)
                at.append(here[i])
                to.append(j)
            targets = _lists(np.concatenate(at), np.concatenate(to), len(x), pa.int32())
            added = {"near": pa.array(near, pa.int32()), "targets": targets} | ({} if around is None else {"least": pa.array(least)})
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    schema = T.StructType([*rows.schema.fields, *PLACED.fields, *([] if around is None else [T.StructField("least", T.LongType())])])
    return rows.mapInArrow(place, schema)


def collect_pivots(pivots: DataFrame, column: str = "features") -> dict:
    """{path: matrix} of a pivot table whose size was checked."""
    table = pivots.toArrow().sort_by([("path", "ascending"), ("pid", "ascending")])
    if not len(table):
        return {}
    coded = table.column("path").combine_chunks().dictionary_encode()
    starts = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))
    return dict(zip(coded.dictionary.to_pylist(), np.split(kernels.vectors_of(table.column(column)), starts[1:])))


def keep_apart(pivots: DataFrame, gap: float, metric=metrics.EUCLIDEAN) -> DataFrame:
    """Pivots without those at most `gap` from an earlier one of their partition, numbered anew."""
    ship(pivots.sparkSession)

    def thin(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        kept = far_apart(kernels.vectors_of(table.column("features")), gap, metric)
        return table.take(kept).set_column(1, "pid", pa.array(range(len(kept)), pa.int32()))

    return pivots.groupBy("path").applyInArrow(thin, "path string, pid int, features array<double>")


def crowds(pivots: DataFrame, eps: float, gap: float, most: float, metric=metrics.EUCLIDEAN) -> DataFrame:
    """(path, pid, features, around): pivots kept apart as by `keep_apart`, only for partitions that crowd around their pivots: those
    whose first SAMPLE pivots, rows themselves, would be sent to more than `most` pivots each on average. `around` holds the
    number of all pivots within 0, 1, ... STEPS steps of 2 eps / STEPS."""
    ship(pivots.sparkSession)

    def near(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        x = kernels.vectors_of(table.column("features"))
        sent = sum(int(metric.within(x[i : i + 1], x, 2 * eps).sum()) for i in range(min(SAMPLE, len(x))))
        kept = far_apart(x, gap, metric) if eps > 0 and sent > most * min(SAMPLE, len(x)) else []
        reach = np.linspace(0, 2 * eps, STEPS + 1) * INSIDE
        around = [np.searchsorted(np.sort(metric.pairwise(x[i : i + 1], x)[0]), reach, "right") for i in kept]
        table = table.take(pa.array(kept, pa.int64())).set_column(1, "pid", pa.array(range(len(kept)), pa.int32()))
        return table.append_column("around", pa.array(around, pa.list_(pa.int64())))

    return pivots.groupBy("path").applyInArrow(near, "path string, pid int, features array<double>, around array<bigint>")


def far_apart(x: np.ndarray, gap: float, metric=metrics.EUCLIDEAN) -> list[int]:
    """The rows of x that are farther than `gap` from all rows kept before them. Memory for one row of distances at a time."""
    kept, left = [], np.arange(len(x))
    while len(left):
        kept.append(int(left[0]))
        left = left[1:][~metric.within(x[left[:1]], x[left[1:]], gap)[0]]
    return kept


def child_path(path: Column, index: Column) -> Column:
    return F.when(path == "", index.cast("string")).otherwise(F.concat_ws(".", path, index.cast("string")))


def copies_of(split: DataFrame) -> DataFrame:
    """One row per copy: `child` is the pivot it goes to, `path` and `base` get this round appended."""
    kept = [c for c in split.columns if c not in ("path", "base", "near", "targets", "least")]
    return split.select("*", F.explode("targets").alias("child")).select(
        F.col("path").alias("parent"),
        "child",
        child_path(F.col("path"), F.col("child")).alias("path"),
        F.array_append("base", F.col("near")).alias("base"),
        *kept,
    )


def partition_counts(split: DataFrame, prints: bool = False) -> DataFrame:
    """(path, child, rows, vectors, own_rows, own_vectors): original rows and distinct vectors each pivot receives, and
    those of them that are nearest to it. Vectors are not read. With `least` (see `split_shared`), also the rows that have it
    (least_rows) and its sum over them (least_copies). `prints` adds `print`, 128 bits that tell sets of ids apart."""
    own = F.col("child") == F.col("near")
    sums = {"least_rows": F.when(F.col("least") > 0, F.col("weight")), "least_copies": F.col("weight") * F.col("least")}
    extra = ["least"] if "least" in split.columns else []
    halves = [F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit(1), "id"))]
    ids = ["id"] if prints else []
    return (
        split.select("path", "weight", "near", *extra, *ids, F.explode("targets").alias("child"))
        .groupBy("path", "child")
        .agg(
            F.sum("weight").alias("rows"),
            F.count("*").alias("vectors"),
            F.sum(F.when(own, F.col("weight")).otherwise(0)).alias("own_rows"),
            F.count_if(own).alias("own_vectors"),
            *[F.coalesce(F.sum(F.when(own, value)), F.lit(0)).alias(name) for name, value in sums.items() if extra],
            *([F.struct(*halves).alias("print")] if prints else []),
        )
    )


def twins(counts: DataFrame) -> DataFrame:
    """The children of `partition_counts` with prints, one for all that have the same rows, with the path `name` of all of these.

    Where pivots lie close together, rows far from all of them are sent to each, so that their children are often the same. These
    would be split by the same pivots and grouped alike, round by round, with as many more copies of every row.
    """
    same = ["path", "rows", "vectors", "print"]
    place = F.row_number().over(Window.partitionBy(*same).orderBy("child")) - 1
    together = Window.partitionBy(*same, "block")
    children = F.array_sort(F.collect_list("child").over(together)).cast("array<string>")
    counts = counts.withColumn("block", F.floor(place / TWINS))
    counts = counts.withColumns({"name": child_path(F.col("path"), F.array_join(children, "|")), "first": F.min("child").over(together)})
    return counts.where(F.col("child") == F.col("first")).drop("block", "first", "print")


def stands_for(path: Column) -> Column:
    """How many partitions a path with twins stands for."""
    return F.aggregate(F.split(path, "\\."), F.lit(1.0), lambda n, part: n * F.size(F.split(part, "\\|")))


def ready(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("rows") <= threshold)


def oversized(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("rows") > threshold)
