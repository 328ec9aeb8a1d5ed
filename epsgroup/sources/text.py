"""Vector tables as comma separated text: id, measure, then the coordinates; no header."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgroup.functions.vectors import to_text


def read_vectors(spark: SparkSession, path, dimension: int, partitions: int | None = None) -> DataFrame:
    """(id, agg, features) from one or many text files.

    Reads the first `dimension` coordinates and ignores what follows. Blanks around numbers are allowed; a line that
    does not parse, or has too few coordinates, fails the job.
    """
    tokens = F.split("value", ",")

    def number(i: int, kind: str = "double") -> Column:
        bad = F.raise_error(F.concat(F.lit(f"no {kind} in field {i + 1}: "), F.col("value"))).cast(kind)
        return F.coalesce(F.trim(F.get("tokens", F.lit(i))).try_cast(kind), bad)

    rows = (
        spark.read.text(path)
        .withColumn("tokens", tokens)
        .select(
            number(0, "bigint").alias("id"),
            number(1).alias("agg"),
            F.array(*[number(i + 2) for i in range(dimension)]).alias("features"),
        )
    )
    return rows.repartition(partitions) if partitions else rows


def vector_lines(rows: DataFrame) -> DataFrame:
    """Rows in the form `read_vectors` reads."""
    line = F.concat_ws(",", F.col("id").cast("string"), F.col("agg").cast("string"), to_text(F.col("features")))
    return rows.select(line.alias("value"))


def write_vectors(rows: DataFrame, path: str) -> None:
    vector_lines(rows).write.mode("overwrite").text(path)
