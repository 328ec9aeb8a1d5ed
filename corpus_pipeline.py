"""Corpus pipeline: from documents to packed training sequences."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgroup.llm import decontamination, jaccard, packing, quality
from epsgroup.llm.queries import SEQUENCE, TOKENIZER
from epsgroup.workspace import Workspace


def row_key() -> Column:
    """A key of id and text together: ids may be null or stand for several texts."""
    return F.xxhash64("doc_id", F.isnull("doc_id"), "text", F.isnull("text")).alias("row_key")


def without(spark: SparkSession, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows but those with these keys. All columns stay as they are, whatever their names."""
    gone = Workspace(spark).save(keys.select(F.col("row_key").alias("gone")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key"))
    return rows.join(gone, rows["key"] == gone["gone"], "left_anti").select("row.*")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep(docs, "doc_id", "text")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id (null last; of texts with that id any one)."""
    ws, rows = Workspace(spark), docs.select(row_key(), "doc_id", "text")
    groups = ws.save(jaccard.join(rows, "row_key", "text", ws), "duplicates").select("row_key", "component_id")
    many = groups.where("row_key <> component_id").select("component_id").distinct()
    members = groups.join(many, "component_id", "left_semi").distinct()
    members = ws.save(members.join(rows.select("row_key", "doc_id").distinct(), "row_key"), "members")
    ws.release()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    first = members.groupBy("component_id").agg(first["row_key"].alias("first"))
    gone = members.join(first, "component_id").where("row_key <> first").select("row_key")
    kept = without(spark, docs, gone)
    repeated = not groups.groupBy("row_key").count().where("count > 1").isEmpty()
    if not repeated:
        return kept
    packed = kept.select(F.struct("*").alias("row"), row_key().alias("key")).dropDuplicates(["key"])
    return packed.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    items, rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.select(row_key(), "text")
    return without(spark, docs, decontamination.find(rows, "row_key", "text", items, "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the training sequences."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER), Workspace(spark), SEQUENCE)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

# The classifier is trained and the tokens come from a vocabulary file: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
