"""Exact group-by: the whole vector is the key, one aggregate over the measure."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsgroup.functions.vectors import checked

# The numbers a run may name; any other number means the average.
AVERAGE, COUNT, MAXIMUM, MINIMUM, SUM = 1, 2, 3, 4, 5

_AGGREGATES = {AVERAGE: F.avg, COUNT: lambda _: F.count(F.lit(1)), MAXIMUM: F.max, MINIMUM: F.min, SUM: F.sum}

UNROLLED_KEYS = 32


def measure_of(choice: int, column: str = "agg") -> Column:
    return _AGGREGATES.get(choice, F.avg)(F.col(column))


def group_by_vector(rows: DataFrame, choice: int = AVERAGE, dimension: int | None = None) -> DataFrame:
    """(features, value), one row per distinct vector.

    The key is always the whole vector; with the dimension given, a vector of another length fails the job. All five
    aggregates have partial forms, so a hot vector is folded in every task before the one shuffle. A known and small
    dimension spreads the key over scalar columns, which keeps the whole stage in generated code.
    """
    value = measure_of(choice).alias("value")
    if dimension is not None:
        rows = rows.withColumn("features", checked(F.col("features"), dimension))
    if dimension is None or dimension > UNROLLED_KEYS:
        return rows.select("features", "agg").groupBy("features").agg(value)
    keys = [f"key_{i}" for i in range(dimension)]
    flat = rows.select(*[F.col("features")[i].alias(key) for i, key in enumerate(keys)], "agg")
    return flat.groupBy(*keys).agg(value).select(F.array(*keys).alias("features"), "value")


def group_number(groups: DataFrame) -> DataFrame:
    """One row: how many groups there are."""
    return groups.agg(F.count("*").alias("groups"))
