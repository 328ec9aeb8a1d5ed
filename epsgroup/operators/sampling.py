"""Seeded samples of rows. The order of a sample is a hash of seed and id, so it does not depend on partitioning."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
DRAWS = 1 << 60


def draw(seed: int, id_column: str = "id") -> Column:
    """The random order of the rows: a whole number below DRAWS."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_fraction(column: Column) -> Column:
    """A draw as a number in [0, 1)."""
    return column / F.lit(float(DRAWS))


def sample_rows(rows: DataFrame, k: int, seed: int, total: int | None = None) -> DataFrame:
    """The k rows with the lowest draws, without replacement; all rows if there are fewer.

    Only rows below a cut that leaves a few more than k are sorted, so no task receives k rows from every other task.
    """
    total = rows.count() if total is None else total
    drawn = rows.withColumn("draw", draw(seed))
    expected = k + 10.0 * math.sqrt(k) + 40.0
    while expected < total:
        low = drawn.where(F.col("draw") < int(expected / total * DRAWS))
        if low.count() >= k:
            return low.orderBy("draw", "id").limit(k)
        expected *= 4
    return drawn.orderBy("draw", "id").limit(k)


def distinct_vectors(rows: DataFrame, seed: int) -> DataFrame:
    """(id, weight, draw, features), one row per distinct vector: lowest id, number of rows, lowest draw."""
    return (
        rows.select("id", "features", draw(seed).alias("draw"))
        .groupBy("features")
        .agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min("draw").alias("draw"))
        .select("id", "weight", "draw", "features")
    )


def sample_pivots(vectors: DataFrame, k: int) -> DataFrame:
    """(path, pid, features): the k lowest draws in each partition, numbered in that order.

    Rows are drawn until k distinct vectors are found. A vector drawn twice would give an idle second pivot: ties go to
    the lower number, and its window against its twin is empty. A first ranking within salts keeps a hot partition
    from sending k rows per task to one task.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    for keys in (["path", "salt"], ["path"]):
        ranked = Window.partitionBy(*keys).orderBy("draw", "id")
        source = vectors.select("path", "id", "draw", "features", salt.alias("salt")) if "salt" in keys else vectors
        vectors = source.withColumn("pid", F.row_number().over(ranked)).where(F.col("pid") <= k)
    return vectors.select("path", (F.col("pid") - 1).alias("pid"), "features")


def draw_cut(k: Column, rows: Column) -> Column:
    """A bound that at least k of so many draws fall below, but for a chance of about e^-40; about k do."""
    return (k + 10 * F.sqrt(k) + 40) / rows * DRAWS


def sample_bernoulli(rows: DataFrame, frequency: float, k: int, seed: int) -> DataFrame:
    """Rows kept with probability `frequency`, and of these the k with the lowest draws."""
    kept = rows.where(draw_fraction(draw(seed)) < frequency)
    return sample_rows(kept, k, seed)


def pivot_number(rows: Column | int, ratio: float = 0.1):
    """How many pivots a partition of that many rows gets under a ratio; at least one."""
    if isinstance(rows, int):
        return max(1, math.floor(rows * ratio))
    return F.greatest(F.lit(1), F.floor(rows * F.lit(ratio)).cast("bigint"))
