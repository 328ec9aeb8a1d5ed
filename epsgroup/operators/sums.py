"""Element-wise sums and means of vectors by key, and the total cost of an assignment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.functions.vectors import checked


def vector_sum(rows: DataFrame, keys: list[str], dimension: int, weight=None, extra=()) -> DataFrame:
    """(keys, sums, n, extra...). One plain sum per coordinate, so partial sums form in every task and no row is
    exploded into its coordinates. A vector of another length fails the job."""
    rows = rows.withColumn("features", checked(F.col("features"), dimension))
    values = [F.col("features")[i] for i in range(dimension)]
    if weight is not None:
        values = [v * F.col(weight) for v in values]
    count = F.count("*") if weight is None else F.sum(weight)
    coordinates = [F.sum(v).alias(f"sum_{i}") for i, v in enumerate(values)]
    summed = rows.groupBy(*keys).agg(*coordinates, count.alias("n"), *extra)
    names = [c for c in summed.columns if c not in {f"sum_{i}" for i in range(dimension)}]
    sums = F.array(*[f"sum_{i}" for i in range(dimension)]).alias("sums")
    return summed.select(*keys, sums, *[c for c in names if c not in keys])


def vector_mean(rows: DataFrame, keys: list[str], dimension: int, weight=None) -> DataFrame:
    """(keys, center, n)."""
    means = [(F.col("sums")[i] / F.col("n")) for i in range(dimension)]
    return vector_sum(rows, keys, dimension, weight).select(*keys, F.array(*means).alias("center"), "n")


def total_cost(assigned: DataFrame) -> DataFrame:
    """One row: the sum of the squared distances to the nearest centre."""
    return assigned.agg(F.sum("near_distance").alias("cost"))
