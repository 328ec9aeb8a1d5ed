import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from epsgroup.llm import sharding


def bits(text):
    return f"{int(hashlib.md5(text.encode()).hexdigest()[:15], 16):060b}"


def test_only_large_buckets_are_split(frame, ws):
    rows = [(i, "x" * (i % 40)) for i in range(500)] + [(1000, "y" * 5000), (1001, None)]
    docs = frame(rows, "doc_id long, text string")
    got = sharding.assign(docs, ["doc_id"], F.octet_length("text"), 800, ws).collect()
    address = {i: bits(str(i).encode().hex().upper()) for i, _ in rows}
    size = {i: len(t or "") for i, t in rows}
    for r in got:
        own = address[r["doc_id"]]
        for depth in range(61):
            inside = [i for i in size if address[i].startswith(own[:depth])]
            if sum(size[i] for i in inside) <= 800 or len(inside) == 1:
                break
        assert (r["shard"], r["depth"], r["shard_rows"]) == (own[:depth], depth, len(inside))
        assert r["shard_bytes"] == sum(size[i] for i in inside) and r["bytes"] == size[r["doc_id"]]
    assert len(got) == len(rows)


def test_a_hot_key_is_split_too(frame, ws):
    docs = frame([(None, "x" * 10)] * 200 + [(7, "x" * 10)] * 200, "doc_id long, text string")
    got = sharding.assign(docs, ["doc_id"], F.octet_length("text"), 100, ws).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["shard"]] += r["bytes"]
    assert len(got) == 400 and max(sizes.values()) <= 100
    assert sharding.assign(docs.limit(0), ["doc_id"], F.octet_length("text"), 100, ws).count() == 0


def test_write(frame, ws, spark):
    docs = frame([(i, "x" * 10) for i in range(100)], "doc_id long, text string")
    given = sharding.assign(docs, ["doc_id"], F.octet_length("text"), 200, ws)
    sharding.write_shards(docs.select("doc_id", "text"), given, "doc_id", f"{ws.path}/shards")
    back = spark.read.parquet(f"{ws.path}/shards")
    assert back.count() == 100 and back.select("shard").distinct().count() == given.select("shard").distinct().count()
