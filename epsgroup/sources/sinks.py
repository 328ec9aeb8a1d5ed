"""Results on storage, as Parquet tables or as lines of text. One write per run, so runs cannot overwrite each other's
rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.functions.vectors import to_text


def group_lines(groups: DataFrame) -> DataFrame:
    """Exact groups: the vector, a tab, the value."""
    line = F.concat_ws("\t", to_text(F.col("features")), F.col("value").cast("string"))
    return groups.select(line.alias("value"))


def centroid_lines(centroids: DataFrame) -> DataFrame:
    """Similarity groups or K-means centres: the centre only."""
    return centroids.select(to_text(F.col("center")).alias("value"))


def center_lines(centers: DataFrame) -> DataFrame:
    """K-means centres: the cost, a tab, the centre."""
    line = F.concat_ws("\t", F.coalesce(F.col("cost"), F.lit(0.0)).cast("string"), to_text(F.col("center")))
    return centers.select(line.alias("value"))


def member_lines(members: DataFrame) -> DataFrame:
    """Members of similarity groups: id, a tab, the measure and the vector. The group is given by
    the first two fields of the line, since lines of one group may come from many tasks."""
    row = F.concat_ws(",", F.col("agg").cast("string"), to_text(F.col("features")))
    line = F.concat_ws("\t", F.col("path"), F.col("group_id").cast("string"), F.col("id").cast("string"), row)
    return members.select(line.alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").parquet(path)


def append_summary(summary: DataFrame, path: str) -> None:
    """Run summaries of many runs in one table."""
    summary.write.mode("append").parquet(path)
