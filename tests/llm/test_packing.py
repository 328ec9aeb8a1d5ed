import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epsgroup.llm import packing
from epsgroup.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_file():
    plain = Tokenizer.from_file(PATH)
    texts = ["", " ", "a b  c\n\n\td ", "It's we'll 12345 <|endoftext|> !!!", "ä ß é x  ", "日本語 ½ ²³ ٣", "\x1c\x85 a b", "x" * 5000, "́e" * 50]
    random.seed(1)
    texts += ["".join(chr(random.choice([32, 10, 65, 97, 39, 48, 0xE9, 0x4E00, 0x1F600])) for _ in range(200)) for _ in range(20)]
    for text in texts:
        assert encoder(PATH).encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_plan_fills_bins_without_overlap(seed):
    random.seed(seed)
    histogram = {random.randint(1, 64): random.randint(1, 40) for _ in range(30)}
    bins, placed = defaultdict(list), defaultdict(set)
    for length, lo, n, first, per_bin, at in packing.plan(histogram, 64):
        for k in range(n):
            bins[first + k // per_bin].append((at + k % per_bin * length, length))
            placed[length].add(lo + k)
    assert {length: len(x) for length, x in placed.items()} == histogram
    for parts in bins.values():
        parts.sort()
        assert [at for at, _ in parts] == [0, *np.cumsum([length for _, length in parts])[:-1]] and sum(p for _, p in parts) <= 64
    one_by_one = []
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [b for b, free in enumerate(one_by_one) if free >= length]
        best = min(fits, key=one_by_one.__getitem__, default=len(one_by_one))
        if best == len(one_by_one):
            one_by_one.append(64)
        one_by_one[best] -= length
    assert len(bins) <= len(one_by_one)


def test_pack(frame, ws):
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 700), (4, "word " * 700), (None, "x"), (5, "hello world")]
    docs = frame(texts, "doc_id long, text string")
    rows = packing.pack(docs, "doc_id", "text", PATH, ws, 128).collect()
    encode = encoder(PATH).encode
    want = []
    for doc, text in texts:
        ids = np.append(encode(text or ""), 0).astype("<u4")
        for piece, (start, length) in enumerate(packing.cut(len(ids), 128)):
            assert length == 128 or piece == 0
            want.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(docs.limit(0), "doc_id", "text", PATH, ws, 128).count() == 0


def test_sequences(frame, ws):
    docs = frame([(i, "some words " * (5 * i + 1)) for i in range(30)], "doc_id long, text string")
    packed = packing.pack(docs, "doc_id", "text", PATH, ws, 64)
    got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(docs, packed, "doc_id", "text", PATH, 64).collect()}
    for r in packed.collect():
        part = got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
