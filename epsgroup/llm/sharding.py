"""Sharding by extendible hashing, with DataFrame functions only.

Every row has an address: the bits of a hash of its key, then those of a hash of its number among all rows. A bucket is a
prefix of the address. A bucket above the byte limit is split on its next bit, others are left alone, until every
bucket fits or holds a single row.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsgroup.workspace import Workspace

WORD = 60  # bits taken from one hash: its first 15 hexadecimal digits
FINER = 4  # a histogram has this many bits more than shards of equal size would need


def _bits(text: Column) -> Column:
    number = F.conv(F.substring(F.md5(text), 1, WORD // 4), 16, 10).cast("long")
    return F.lpad(F.bin(number), WORD, "0")


def _fitting(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_rows): for each cell the shallowest bucket above it, from depth `low`, that fits.

    Cells are prefixes of length `high` with their bytes and rows. Cells that fit at no depth are left out.
    """
    each = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    each = each.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    buckets = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fitting = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    first = F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("first")
    return each.join(fitting, ["depth", "prefix"]).groupBy("cell").agg(first).select("cell", "first.*")


def assign(rows: DataFrame, keys: list[str], size: Column, limit: int, ws: Workspace) -> DataFrame:
    """(keys, bytes, shard, depth, shard_bytes, shard_rows), one row per input row.

    `shard` holds the bits of the bucket ("" if all rows fit in one). Null keys count as one more key, a null size as 0.
    Rows of one key stay together only while they fit: a key that repeats beyond the limit is split by row number, so
    no key can overflow a shard. A row larger than the limit gets a shard of its own. An empty table gives no rows.
    Other columns of `rows` are ignored, whatever their names.
    """
    key = F.concat_ws(":", *[F.coalesce(F.hex(F.col(k).cast("string")), F.lit("null")) for k in keys])
    picked = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    flat = rows.select(*picked, _bits(key).alias("own"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"))
    heads = ws.save(flat.withColumn("number", F.monotonically_increasing_id()), "heads")
    heads = heads.withColumn("address", F.concat("own", _bits(F.col("number").cast("string"))))
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(2 * WORD, FINER + math.ceil(math.log2(max(1, total / limit))))
    parts, left = [], heads
    while True:
        left = left.withColumn("cell", F.expr(f"substring(address, 1, {high})"))
        cells = ws.save(left.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), f"cells-{high}")
        found = ws.save(_fitting(cells, low, high, limit), f"found-{high}")
        parts.append(left.join(found, "cell"))
        over = cells.join(found, "cell", "left_anti").select("cell")
        if high == 2 * WORD or over.isEmpty():
            break
        left = left.join(over, "cell", "left_semi")
        low, high = high + 1, min(2 * WORD, high + 12)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    back = [F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)]
    shard = F.expr("substring(address, 1, depth)").alias("shard")
    return out.select(*back, "bytes", shard, "depth", "shard_bytes", "shard_rows")


def write_shards(rows: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """Write the rows as one folder per shard. `key` must be unique."""
    shards = assigned.select(key, F.concat(F.lit("b"), "shard").alias("shard"))
    rows.join(shards, key).repartition("shard").write.partitionBy("shard").parquet(path)
