"""Grouping inside partitions that fit one task, and the rule that drops the copies of a group."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.functions import kernels
from epsgroup.functions.firstfit import first_fit, lowest, owned
from epsgroup.functions.metrics import EUCLIDEAN
from epsgroup.ship import ship

MEMBERS = "path string, group_id bigint, id bigint, weight bigint, features array<double>"


def base_matrix(table: pa.Table, rounds: int) -> np.ndarray:
    flat = table.column("base").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), rounds)


def group_partitions(rows: DataFrame, eps: float, metric=EUCLIDEAN) -> DataFrame:
    """(path, group_id, id, weight, features) of the groups each partition owns. A partition that stands for twins (see
    `partition.twins`) owns the groups of all of them, each under the path of the one that owns it.

    One task holds one partition, so callers pass partitions of checked size only.
    """

    ship(rows.sparkSession)
    def group(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("id")))
        path = table.column("path")[0].as_py()
        assigned = [[int(index) for index in twins.split("|")] for twins in path.split(".")] if path else []
        ids = table.column("id").to_numpy()
        label = first_fit(ids, kernels.vectors_of(table.column("features")), eps, metric=metric)
        base = base_matrix(table, len(assigned))
        keep = owned(label, base, assigned)
        if "|" in path:
            names = [".".join(map(str, low)) for low in lowest(label, base).tolist()]
            table = table.set_column(table.schema.get_field_index("path"), "path", pa.array(names, pa.string()))
        table = table.select(["path", "id", "weight", "features"]).add_column(1, "group_id", pa.array(label))
        return table.filter(pa.array(keep))

    # A fixed number of tasks: grouping costs far more per byte than adaptive execution assumes when it merges them.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("path", "id", "weight", "features", "base").repartition(tasks, "path")
    return placed.groupBy("path").applyInArrow(group, MEMBERS)


def drop_copies(labelled: DataFrame) -> DataFrame:
    """Rows of the owned groups, for groups spread over many tasks: a group is dropped where in any round the lowest
    base index of its members is not the assigned index, or none of those of twins, whose groups get the path of their owner."""
    lowest = (
        labelled.select("path", "group_id", F.posexplode("base").alias("round", "index"))
        .groupBy("path", "group_id", "round")
        .agg(F.min("index").alias("lowest"))
    )
    assigned = F.split(F.split("path", "\\.")[F.col("round")], "\\|").cast("array<int>")
    rounds = F.array_sort(F.collect_list(F.struct("round", "lowest")))
    owners = lowest.groupBy("path", "group_id").agg(
        F.bool_and(F.array_contains(assigned, F.col("lowest"))).alias("owned"),
        F.array_join(F.transform(rounds, lambda x: x["lowest"].cast("string")), ".").alias("owner"),
    )
    kept = labelled.join(owners, ["path", "group_id"], "left").where(F.coalesce("owned", F.lit(True)))
    return kept.withColumn("path", F.coalesce("owner", "path")).drop("owned", "owner")
