"""Similarity group-by: groups in which every two rows are at most eps apart, by the Euclidean or any other metric."""

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epsgroup.functions.metrics import EUCLIDEAN, Metric
from epsgroup.functions.vectors import checked
from epsgroup.operators import partition, sampling, sizes
from epsgroup.operators.blockwise import group_large
from epsgroup.operators.local import MEMBERS, group_partitions
from epsgroup.operators.sizes import POINT_BYTES, dimension_of, join_small, points_fit
from epsgroup.operators.sums import vector_mean
from epsgroup.workspace import Workspace

APART = 4.0
CROWD = 64  # pivots of a partition, and copies per row, from which a split is tried with few pivots first
TASK_BYTES = 256 << 20
HOT_KEYS = 1000
SHARE_ROWS = 1 << 18


@dataclass(frozen=True)
class Options:
    """Parameters of one run.

    threshold: a partition with more original rows is split again, with the same seed and number of pivots.
    pivot_ratio: from the second round on, pivots per partition as a share of its rows instead of num_pivots.
    window: "euclidean" or "metric" (see `kernels.border`).
    shrink, max_growth, max_rounds: a split is given up where it leaves a child above the threshold that holds more
        than `shrink` of the rows, or leaves one and makes more than `max_growth` copies per row. Without this, rows
        that no pivots separate never end; with it, every round shrinks each partition that is split on, so the number
        of rounds needs no bound. max_rounds sets one, after which nothing is split.
    local_rows: partitions with more distinct vectors are grouped tile by tile or block by block over many tasks (less if the
        vectors of that many rows take more than TASK_BYTES).
    block_rows: size of such a tile or block.
    metric: the distance (`functions.metrics`); any but the Euclidean one takes the "metric" window.
    """

    eps: float
    num_pivots: int = 200
    threshold: int = 50_000
    seed: int = 0
    pivot_ratio: float | None = None
    window: str = partition.EUCLIDEAN
    shrink: float = 0.9
    max_growth: float = 4.0
    max_rounds: int | None = None
    local_rows: int = 50_000
    block_rows: int = 50_000
    metric: Metric = EUCLIDEAN

    def __post_init__(self):
        if self.metric.name != EUCLIDEAN.name:
            object.__setattr__(self, "window", partition.METRIC)


@dataclass
class Groups:
    """Outcome of a run: `members` has (path, group_id, id, weight, features), one row per distinct vector and group;
    `weight` counts the original rows, `id` is the lowest of them and `group_id` the lowest id of the group. Where
    different vectors share an id, `group_id` is the place of its first vector in the order of id and vector."""

    rows: DataFrame
    vectors: DataFrame
    members: DataFrame
    dimension: int
    rounds: int = 0
    cancelled: int = 0
    above_threshold: int = 0
    options: Options | None = None
    workspace: Workspace | None = field(default=None, repr=False)

    def centroids(self) -> DataFrame:
        """(path, group_id, center, n), one row per group."""
        return vector_mean(self.members, ["path", "group_id"], self.dimension, "weight")

    def number(self) -> DataFrame:
        """One row: how many groups there are."""
        return self.members.select("path", "group_id").distinct().agg(F.count("*").alias("groups"))

    def original_rows(self) -> DataFrame:
        """(path, group_id, id, agg, features), one row per original row and group it is in.

        Vectors that repeat in more than 1/1000 of the rows number at most 1000. Their rows are dealt by id to shares of about
        SHARE_ROWS rows, as many as their counted rows need, and each share meets the memberships of its vector.
        """
        total = self.vectors.agg(F.sum("weight")).head()[0] or 0
        shares = F.when(F.col("weight") > total / HOT_KEYS, F.ceil(F.col("weight") / SHARE_ROWS)).otherwise(1)
        hot = self.vectors.select("features", shares.alias("shares")).where("shares > 1")
        salt = F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1)))
        left = self.rows.join(F.broadcast(hot), "features", "left").withColumn("salt", salt).drop("shares")
        right = self.members.select(
            "path", "group_id", "features", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("salt")
        )
        return left.join(right, ["features", "salt"]).select("path", "group_id", "id", "agg", "features")

    def lost_and_doubled(self) -> DataFrame:
        """One row: original rows in no group, and extra appearances of rows in several groups. Both are 0 on
        separated data and with one pivot; elsewhere neighbouring partitions may group the same rows differently."""
        shown = self.members.groupBy("features").agg(F.count("*").alias("shown"))
        joined = self.vectors.select("features", "weight").join(shown, "features", "left").fillna(0, ["shown"])
        lost = F.sum(F.when(F.col("shown") == 0, F.col("weight")).otherwise(0))
        doubled = F.sum(F.col("weight") * F.greatest(F.col("shown") - 1, F.lit(0)))
        return joined.agg(
            F.coalesce(lost, F.lit(0)).alias("lost_rows"), F.coalesce(doubled, F.lit(0)).alias("doubled_rows")
        )


def sim_group_by(rows: DataFrame, eps: float, output: str = "centroids", workspace=None, **options) -> DataFrame:
    """Similarity group-by of (id, agg, features), in the order of `id` (and of the vectors where ids repeat). Output
    "centroids" or "members"."""
    groups = run(rows, Options(eps, **options), workspace)
    return groups.centroids() if output == "centroids" else groups.original_rows()


def run(rows: DataFrame, options: Options, workspace: Workspace | None = None) -> Groups:
    """Fold equal vectors, split by pivots round by round, group every partition, drop the copies.

    Equal vectors always share a group, so folding them first changes no group and keeps a vector that repeats often
    from growing any partition.
    """
    ws = workspace or Workspace(rows.sparkSession)
    dimension = dimension_of(rows)
    rows = rows.withColumn("features", checked(F.col("features"), dimension))
    vectors = ws.save(sampling.distinct_vectors(rows, options.seed), "vectors")
    keyed = None
    if not vectors.groupBy("id").count().where("count > 1").isEmpty():
        # Several vectors share an id: they are told apart by their place in the order of id and vector.
        ordered = vectors.repartitionByRange("id", "features").sortWithinPartitions("id", "features")
        keyed = ws.save(ordered.withColumn("place", F.monotonically_increasing_id()), "keyed")
        vectors = keyed.drop("id").withColumnRenamed("place", "id").select(vectors.columns)
    fitting = TASK_BYTES // (8 * max(1, dimension))
    blocks = min(options.block_rows, options.local_rows, fitting, sizes.POINT_BYTES // (8 * max(1, dimension)))
    options = replace(options, local_rows=min(options.local_rows, fitting), block_rows=max(1, blocks))
    groups = Groups(rows, vectors, vectors, dimension, options=options, workspace=ws)
    local, large = _partitions(groups)
    members = group_partitions(local, options.eps, options.metric) if local is not None else None
    if large is not None:
        blocks = group_large(large, options.eps, options.block_rows, ws, "large", options.metric)
        members = blocks if members is None else members.unionByName(blocks)
    if members is None:
        members = rows.sparkSession.createDataFrame([], MEMBERS)
    if keyed is not None:
        names = keyed.select(F.col("place").alias("id"), F.col("id").alias("named"))
        members = members.join(names, "id").drop("id").withColumnRenamed("named", "id")
        members = members.select("path", "group_id", "id", "weight", "features")
        groups.vectors = keyed.drop("place")
    groups.members = ws.save(members, "members")
    return groups


def _partitions(groups: Groups):
    """(rows of partitions one task can group, rows of larger ones), each None if there are none.

    A partition whose split leaves it stuck is split once more with pivots that lie well apart: where a large share of
    the rows crowds into one spot, so do the pivots, and every row of the spot is copied to all of them. If that does
    not help either, the partition is grouped unsplit.

    Under a ratio the pivots grow with the rows, and so do the copies of each row where rows crowd. Partitions that crowd are split
    with pivots apart first (`_split_crowds`). That split stands where it makes no copy at all, so that no group can be cut, or
    where the counts prove that the split by all pivots would be stuck, which is then not made.

    Per split: the pivots, one written table of the rows with their targets (no copies yet), and one of the child
    counts. Copies are made when a later step reads the rows, and only for splits that are kept, once for all children with the
    same rows (`partition.twins`). Whether a split is kept is counted with all of its children.
    """
    o = groups.options
    empty = F.array().cast("array<int>")
    active = groups.vectors.select(F.lit("").alias("path"), empty.alias("base"), *groups.vectors.columns)
    parts, number = None, 1
    local, large = [], []

    def finish(rows, counts, count_local, count_large):
        """Hand the rows of the partitions in `counts` (path, name, vectors) to the right kind of grouping."""
        is_large = F.col("vectors") > o.local_rows
        for kind, count, wanted in ((local, count_local, ~is_large), (large, count_large, is_large)):
            if count:
                kind.append(_named(rows, counts.where(wanted), count).select(*_PLACED))

    while True:
        groups.rounds += 1
        over, over_local, over_large, over_splits = [], 0, 0, 0

        def keep(split, children, n):
            """Hand on the children of the splits that are kept."""
            nonlocal over_local, over_large, over_splits
            kept, copies = children.where("keep"), partition.copies_of(split)
            finish(copies, partition.ready(kept, o.threshold), n["ready_local"], n["ready_large"])
            if n["over_local"] or n["over_large"]:
                over_local, over_large = over_local + n["over_local"], over_large + n["over_large"]
                over_splits += n["over_splits"]
                over.append((copies, partition.oversized(kept, o.threshold).select("path", "name", "rows", "vectors")))

        columns, drawn = active.columns, None
        if o.pivot_ratio is not None and groups.rounds > 1:
            drawn = _pivots(o, active, parts, number, False)
            crowded = _split_crowds(groups, active, number, *drawn)
            if crowded is not None:
                split, decided = crowded[0], crowded[1].where("decided")
                n = _tally(decided, o)
                keep(split, decided, n)
                stuck = n["stuck_local"] + n["stuck_large"]
                if stuck:
                    groups.cancelled += n["stuck_splits"]
                    groups.above_threshold += n["stuck_above"]
                    unsplit = _parents(decided.where(~F.col("keep")))
                    finish(join_small(split, unsplit.select("path"), "path", stuck).select(columns), unsplit, n["stuck_local"], n["stuck_large"])
                settled = _parents(decided).select("path")
                many = settled.count()
                if many:
                    number, drawn = number - many, None
                    active, parts = (join_small(rows, settled, "path", many, "left_anti") for rows in (active, parts))
        for apart in (False, True):
            if number:
                split, children = _split(groups, active, parts, number, apart, drawn)
                n = _tally(children, o)
                keep(split, children, n)
                number, drawn = n["stuck_local"] + n["stuck_large"], None
                parts = _parents(children.where(~F.col("keep")))
                active = join_small(split, parts.select("path"), "path", number).select(columns)
        if number:
            groups.cancelled += n["stuck_splits"]
            groups.above_threshold += n["stuck_above"]
            finish(active, parts, n["stuck_local"], n["stuck_large"])
        number = over_local + over_large
        if not number:
            break
        active = [_named(rows, names, number).select(columns) for rows, names in over]
        parts = [names.drop("path").withColumnRenamed("name", "path") for _, names in over]
        active, parts = reduce(DataFrame.unionByName, active), reduce(DataFrame.unionByName, parts)
        if groups.rounds == o.max_rounds:
            groups.cancelled += over_splits
            groups.above_threshold += over_splits
            finish(active, parts, over_local, over_large)
            break
    return [reduce(DataFrame.unionByName, rows) if rows else None for rows in (local, large)]


def _named(rows: DataFrame, names: DataFrame, number: int) -> DataFrame:
    """The rows of the partitions in `names`, under the `name` that stands for their twins as well, if they have one."""
    if "name" not in names.columns:
        return join_small(rows, names.select("path"), "path", number)
    return join_small(rows, names.select("path", "name"), "path", number).drop("path").withColumnRenamed("name", "path")


def _parents(children: DataFrame) -> DataFrame:
    """(path, rows, vectors) of the partitions that were split into these children."""
    names = {"parent": "path", "parent_rows": "rows", "parent_vectors": "vectors"}
    return children.where("lead").select(*[F.col(a).alias(b) for a, b in names.items()])


_PLACED = ["path", "id", "weight", "features", "base"]


def _split(groups, active, parts, number, apart, drawn=None):
    """One split: (rows with `near` and `targets`, one row per child partition). `drawn`: its pivots, where they are known.

    Children have parent, path, name, rows, vectors, the number of rows and vectors of their parent, `keep` (the split of
    the parent is kept) and `lead` (first child of its parent). Of twins only the first is there, with the `name` of all.
    """
    o, ws = groups.options, groups.workspace
    r = f"{groups.rounds}{'-apart' if apart else ''}"
    pivots, most = drawn or _pivots(o, active, parts, number, groups.rounds == 1)
    if apart:
        pivots = partition.keep_apart(pivots, APART * o.eps, o.metric)
    if points_fit(number * most, groups.dimension):
        split = partition.split_shared(active, partition.collect_pivots(pivots), o.eps, o.window, o.metric)
    else:
        split = partition.split_tiled(active, ws.save(pivots, f"pivots-{r}"), o.eps, o.window, ws, f"tiles-{r}", POINT_BYTES, o.metric)
    split = ws.save(split, f"split-{r}")
    return split, ws.save(_children(split, o), f"children-{r}")


def _split_crowds(groups, active, number, pivots, most):
    """As `_split`, for partitions whose rows crowd around more than CROWD pivots, by pivots that lie well apart; None if there are none.

    `decided`: the split stands in the place of that by all pivots, either because it makes no copies and leaves no child with more than
    `shrink` of the rows, or because that by all pivots would be stuck: already the rows within eps of one of these pivots, all of
    which it sends there, and the least number of their copies pass the bounds.
    """
    o, ws = groups.options, groups.workspace
    if most <= CROWD or not points_fit(number * most, groups.dimension):
        return None
    r = f"{groups.rounds}-crowds"
    pivots = ws.save(partition.crowds(pivots, o.eps, APART * o.eps, CROWD, o.metric), f"pivots-{r}")
    points, around = partition.collect_pivots(pivots), partition.collect_pivots(pivots, "around")
    if not points:
        return None
    rows = join_small(active, pivots.select("path").distinct(), "path", len(points))
    split = ws.save(partition.split_shared(rows, points, o.eps, o.window, o.metric, around), f"split-{r}")
    return split, ws.save(_children(split, o), f"children-{r}")


def _children(split, o):
    """Child partitions of a split (see `_split`), with `decided` for one by `_split_crowds`."""
    family = Window.partitionBy("path")
    counts = partition.partition_counts(split, prints=True).select(
        "*",
        F.sum("own_rows").over(family).alias("parent_rows"),
        F.sum("own_vectors").over(family).alias("parent_vectors"),
        F.max("rows").over(family).alias("largest"),
        F.sum("rows").over(family).alias("copies"),
        (F.min("child").over(family) == F.col("child")).alias("lead"),
    )
    stuck = (F.col("largest") > o.threshold) & (
        (F.col("largest") > o.shrink * F.col("parent_rows")) | (F.col("copies") > o.max_growth * F.col("parent_rows"))
    )
    path = partition.child_path(F.col("path"), F.col("child"))
    decided = []
    if "least" in split.columns:
        most, every = F.max("least_rows").over(family), F.sum("least_copies").over(family)
        whole = (F.col("copies") == F.col("parent_rows")) & (F.col("largest") <= o.shrink * F.col("parent_rows"))
        proven = (most > o.threshold) & ((most > o.shrink * F.col("parent_rows")) | (every > o.max_growth * F.col("parent_rows")))
        counts, decided = counts.withColumn("decided", whole | proven), ["decided"]
    return partition.twins(counts).select(
        F.col("path").alias("parent"),
        path.alias("path"),
        *("name", "rows", "vectors", "parent_rows", "parent_vectors", "lead"),
        (~stuck).alias("keep"),
        *decided,
    )


def _tally(children, o):
    """How many partitions are stuck (split cancelled), ready, or over the threshold, by whether one task holds them. Twins count
    as one in these, and one by one in stuck_splits, stuck_above and over_splits."""
    ready, stuck = F.col("rows") <= o.threshold, ~F.col("keep") & F.col("lead")
    counts, splits = {}, {
        "stuck_splits": (stuck, "parent"),
        "stuck_above": (stuck & (F.col("parent_rows") > o.threshold), "parent"),
        "over_splits": (F.col("keep") & ~ready, "name"),
    }
    for name, wanted, size in (
        ("stuck", stuck, "parent_vectors"),
        ("ready", F.col("keep") & ready, "vectors"),
        ("over", F.col("keep") & ~ready, "vectors"),
    ):
        counts[f"{name}_local"] = wanted & (F.col(size) <= o.local_rows)
        counts[f"{name}_large"] = wanted & (F.col(size) > o.local_rows)
    summed = [F.sum(F.when(c, partition.stands_for(F.col(path)))).alias(name) for name, (c, path) in splits.items()]
    found = children.agg(*[F.count_if(c).alias(name) for name, c in counts.items()], *summed).head().asDict()
    return {name: int(n or 0) for name, n in found.items()}


def _pivots(o, active, parts, number, first):
    """(pivots of all partitions of the split, the most one partition can have). Only rows with low draws are ranked: about
    as many original rows as pivots are wanted, and more until every partition has its pivots, however often rows repeat."""
    if o.pivot_ratio is None or first:
        wanted, most = F.lit(o.num_pivots), o.num_pivots
    else:
        wanted = sampling.pivot_number(F.col("rows"), o.pivot_ratio)
        most = parts.agg(F.max(wanted)).head()[0]
    if parts is None:
        whole = active.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("rows"), F.count("*").alias("vectors"))
        parts = whole.withColumn("path", F.lit(""))
    wanted = parts.select("path", "vectors", wanted.alias("wanted"), sampling.draw_cut(wanted, F.greatest("rows", F.lit(1))).alias("cut"))
    widen = 1
    while True:
        cuts = join_small(active, wanted.select("path", "cut"), "path", number)
        low = cuts.where(F.col("draw") < F.col("cut") * widen)
        drawn = wanted.join(low.groupBy("path").count(), "path", "left")
        if drawn.where(F.coalesce("count", F.lit(0)) < F.least("wanted", "vectors")).isEmpty():
            break
        widen *= 8
    pivots = sampling.sample_pivots(low, most)
    if o.pivot_ratio is not None and not first:
        pivots = join_small(pivots, wanted, "path", number).where(F.col("pid") < F.col("wanted"))
    return pivots.select("path", "pid", "features"), most
