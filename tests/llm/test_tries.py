import hashlib
import random
import zlib

import pytest

from epsgroup.llm import queries, tries
from epsgroup.llm.tries import Queue


def plain(rows):
    """{(smallest member, depth): (parent, members, children, leaves, saved, digest)} of conversations as lists of turns."""
    nodes = {}
    for conv, said in rows.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(conv)
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = sorted(c for c in members if len(rows[c]) == len(path))
        out[min(members), len(path)] = (
            min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(childless),
            saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def grouped(rows):
    """Conversations as lists of turns, in the order of the turns (null first)."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(said, key=lambda x: x[:2])] for c, said in convs.items()}


def built(turns, convs, ws):
    nodes, ends = tries.build(ws.save(turns, "turns-in"), ws.save(convs, "convs-in"), ws)
    digest = {r["number"]: r["sha"] for r in tries.ends_digest(ends).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {
        (r["conv"], r["depth"]): (r["parent_conv"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], digest.get(r["number"], empty))
        for r in nodes.collect()
    }


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard, part", [(1 << 15, 1024), (5, 3)])
def test_all_conversations(spark, frame, ws, monkeypatch, shard, part):
    """Against a plain trie: shared openings, one long conversation, nulls, shards and parts of a few rows."""
    monkeypatch.setattr(tries, "SHARD", shard)
    monkeypatch.setattr(tries, "PART", part)
    draw = random.Random(shard)
    rows = []
    for conv in range(40):
        rows += [(conv, t, "user" if t % 2 else None, f"{draw.choice('abé')}" * draw.randint(0, 2) or None) for t in range(draw.randint(1, 6))]
    rows += [(7, t, "user", "long" * (t % 3)) for t in range(6, 60)]
    rows += [(8, None, "user", "first"), (None, 0, "user", "nobody's"), (41, 0, "user", "x" * 100_000)]
    draw.shuffle(rows)
    heads = tries.heads(frame(rows, SCHEMA), "conv_id", "turn", "role", "text", ws)
    heads = ws.save(heads, "heads")
    assert built(heads, heads.select("conv").distinct(), ws) == plain(grouped(rows))


def test_regenerated(spark, frame, ws, monkeypatch):
    monkeypatch.setattr(tries, "SHARD", 6)
    draw = random.Random(3)
    rows = [(c, t, "user", f"{c % 7} {t}") for c in (0, 1, 2, 5, 99, 100, 101, 150, 307, 308, 399, -4) for t in range(draw.randint(1, 7))]
    convs = grouped(rows)
    want = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        want[c] = convs.get(base, [])[:h] + convs[c][h:]
    heads = ws.save(tries.heads(frame(rows, SCHEMA), "conv_id", "turn", "role", "text", ws), "heads")
    assert any(not said for said in want.values())
    assert built(*queries.regenerated(heads), ws) == plain(want)


def test_repeated_rows_and_texts(spark, frame, ws):
    """Repeated rows are turns of their own; nodes get their texts back."""
    rows = [(c, 0, "user", "hi") for c in (1, 1, 2)]
    frame = frame(rows, SCHEMA)
    heads = ws.save(tries.heads(frame, "conv_id", "turn", "role", "text", ws), "heads")
    nodes, _ = tries.build(heads, heads.select("conv").distinct(), ws)
    got = tries.with_texts(nodes, frame, "role", "text").select("conv", "depth", "n_convs", "role", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, None, None), (1, 1, 2, "user", "hi"), (1, 2, 1, "user", "hi")]


def test_empty(spark, frame, ws):
    heads = ws.save(tries.heads(frame([], SCHEMA), "conv_id", "turn", "role", "text", ws), "heads")
    assert built(heads, heads.select("conv").distinct(), ws) == {}


def test_queue_spills():
    draw = random.Random(1)
    queue, waiting, got = Queue(2, limit=16), [], []
    for step in range(3000):
        if draw.random() < 0.6:
            item = (draw.randint(-50, 50), step)
            queue.push(item)
            waiting.append(item)
        elif waiting:
            assert queue.first() == min(waiting)
            got.append(queue.pop())
            waiting.remove(got[-1])
    assert len(queue.runs) > 3
    assert [queue.pop() for _ in range(len(waiting))] == sorted(waiting)


def test_packing_of_numbers():
    """Packed rows of one node add up to one digest, over batches as well."""
    import numpy as np
    import pyarrow as pa

    node, conv = np.repeat([3, 4, 9], [20_000, 1, 2]), np.arange(20_003)
    batches = [pa.RecordBatch.from_arrays([pa.array(node[a : a + 7_000]), pa.array(conv[a : a + 7_000])], ["number", "conv"]) for a in range(0, 20_003, 7_000)]
    packed = [pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["number", "ids"]) for b in tries._packed(batches)]
    got = {n: s for b in tries._digested(packed) for n, s in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {n: hashlib.sha256(",".join(map(str, conv[node == n])).encode()).hexdigest() for n in (3, 4, 9)}
