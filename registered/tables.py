"""Vector tables (id, agg, features) made from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgroup.functions.vectors import vector


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineitem(spark, folder):
    """No unique id: for the exact group-by only."""
    return given(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("agg"), vector("l_quantity", "l_discount", "l_tax").alias("features")
    )


def separated_customers(spark, folder):
    """Groups of one nation each lie 10 apart and are at most 1.1 wide."""
    return given(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("agg"),
        vector(F.lit(10.0) * F.col("c_nationkey"), F.col("c_acctbal") / F.lit(10000.0)).alias("features"),
    )


def separated_parts(spark, folder):
    """Groups of one size each lie 10 apart and are at most 1 wide; some vectors repeat."""
    return given(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("agg"),
        vector(F.lit(10.0) * F.col("p_size"), F.col("p_retailprice") / F.lit(100.0)).alias("features"),
    )


def mixed_parts(spark, folder):
    """Not separated: prices spread over 100, sizes over 1000."""
    return given(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("agg"),
        vector("p_retailprice", F.lit(20.0) * F.col("p_size")).alias("features"),
    )


def plane_customers(spark, folder):
    """Balances over 11,000 and nations over 960: few neighbours within 40."""
    return given(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("agg"),
        vector("c_acctbal", F.lit(40.0) * F.col("c_nationkey")).alias("features"),
    )


def cluster_parts(spark, folder):
    return given(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("agg"),
        vector("p_size", F.col("p_retailprice") / F.lit(10.0)).alias("features"),
    )


def events(spark, folder):
    return given(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("value").alias("agg"),
        vector("value", F.col("user_id") / F.lit(10.0)).alias("features"),
    )


def embeddings(spark, folder):
    return given(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("double").alias("agg"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def scale_factors(spark, folder):
    """(sf, points): one scale factor per market segment, as large as its number of customers."""
    segments = given(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("points"))
    # The five market segments in alphabetical order.
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("c_mktsegment"))
    return segments.select(number.cast("int").alias("sf"), "points")
