"""One-row summaries of runs."""

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.plans.kmeans import Clusters
from epsgroup.plans.similar import Groups


def similar_summary(groups: Groups, elapsed_ns: int | None = None) -> DataFrame:
    """Parameters, number of groups, lost and doubled rows, rounds and cancelled splits of a similarity group-by."""
    o = asdict(groups.options)
    parameters = [F.lit(o[name]).alias(name) for name in ("eps", "num_pivots", "threshold", "seed", "window")]
    shown = groups.lost_and_doubled().head()
    facts = {
        "dimension": groups.dimension,
        "rounds": groups.rounds,
        "cancelled_splits": groups.cancelled,
        "unsplit_above_threshold": groups.above_threshold,
        "lost_rows": shown["lost_rows"],
        "doubled_rows": shown["doubled_rows"],
    }
    return groups.number().select(
        *parameters,
        *[F.lit(value).alias(name) for name, value in facts.items()],
        "groups",
        F.lit(elapsed_ns).cast("bigint").alias("elapsed_ns"),
    )


def exact_summary(groups: DataFrame, choice: int, elapsed_ns: int | None = None) -> DataFrame:
    return groups.agg(F.count("*").alias("groups")).select(
        F.lit(choice).alias("choice"), "groups", F.lit(elapsed_ns).cast("bigint").alias("elapsed_ns")
    )


def kmeans_summary(clusters: Clusters, k: int, error: float, seed: int, elapsed_ns: int | None = None) -> DataFrame:
    return clusters.centers.agg(F.count("*").alias("centers")).select(
        F.lit(k).alias("k"),
        F.lit(error).alias("error"),
        F.lit(seed).alias("seed"),
        "centers",
        F.lit(clusters.iterations).alias("iterations"),
        F.lit(clusters.converged).alias("converged"),
        F.lit(clusters.cost).alias("cost"),
        F.lit(elapsed_ns).cast("bigint").alias("elapsed_ns"),
    )
