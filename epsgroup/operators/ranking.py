"""Places of rows in a total order of the whole table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsgroup.workspace import Workspace

INDEX = (1 << 33) - 1  # the bits of monotonically_increasing_id that number the rows of a partition


def placed(rows: DataFrame, order: list[Column], ws: Workspace, name: str, column: str = "place") -> DataFrame:
    """Adds `column`: the place of every row in the ascending order of all rows, from 0, without gaps.

    Rows are dealt to ranges of the order and sorted there; the place is the number within the range and the counted rows of
    the ranges before. Rows that are equal in the order are told apart by their number in the table, so that a value that
    repeats in most rows still spreads over many ranges. Nulls come first. An empty table gives no rows. The only thing all
    tasks share is one number for each range.
    """
    keys = [f"key_{i}" for i in range(len(order))]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[o.alias(k) for o, k in zip(order, keys)])
    packed = packed.withColumn("number", F.monotonically_increasing_id())
    ranged = packed.repartitionByRange(*keys, "number").sortWithinPartitions(*keys, "number")
    ranged = ws.save(ranged.select("row", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), name)
    sizes = ranged.groupBy("range").count().orderBy("range").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["range"], total))
        total += r["count"]
    ranges = F.broadcast(rows.sparkSession.createDataFrame(before, "range int, before long"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit(INDEX))
    return ranged.join(ranges, "range").select("row.*", place.alias(column))
