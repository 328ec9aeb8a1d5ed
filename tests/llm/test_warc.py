import glob
import gzip
import hashlib
import random

import pytest

from epsgroup.llm import warc


def test_round_trip(frame, ws, spark):
    long = "<p>é WARC/1.1\r\n\r\n</p>" * 20
    pages = [(5, "http://a/\r\nX: y", long), (3, None, long), (9, "http://b", long), (1, "c", None), (2, "d", ""), (4, "e", "short"), (6, "f", "short"),
             (7, "g", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (None, "h", long), (3, "i", long), (8, "j", "z" * 200_000)]
    table = frame(pages, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(table, "page_id", "url", "html", ws).collect()), key=str)
    want = []
    for page, _, html in pages:
        raw = (html or "").encode()
        revisit = html == long and page != 3
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    found = warc.resolve(warc.read(spark, f"{ws.path}/archives")).collect()
    assert sorted((r["payload"] for r in found), key=str) == sorted((h or "" for _, _, h in pages), key=str)


def test_archives_are_whole_records(frame, ws):
    table = frame([(i, "u", f"<html>{i}</html>" * 20) for i in range(40)], "page_id long, url string, html string")
    warc.write(table, "page_id", "url", "html", f"{ws.path}/w", ws, "2020-01-01T00:00:00Z")
    kinds = [f["WARC-Type"] for p in glob.glob(f"{ws.path}/w/*.gz") for f, _ in warc.records(gzip.open(p).read())]
    assert kinds == ["response"] * 40


def test_empty(frame, ws):
    table = frame([(1, "u", "x")], "page_id long, url string, html string").limit(0)
    assert warc.round_trip(table, "page_id", "url", "html", ws).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_archives_keep_their_size(frame, ws, spark, monkeypatch, adaptive):
    """Also where the revisits are too many to be sent to all tasks."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 16)
    draw = random.Random(1)
    pages = [(i, "u", "".join(draw.choices("abcdef", k=2000)) if i % 2 else "copied " * 300) for i in range(800)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        warc.write(frame(pages, "page_id long, url string, html string"), "page_id", "url", "html", f"{ws.path}/w", ws, "2020-01-01T00:00:00Z")
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
    sizes = [len(gzip.open(p).read()) for p in glob.glob(f"{ws.path}/w/*.gz")]
    assert max(sizes) <= 2 << 16 and sum(s > 0 for s in sizes) >= 20
    kinds = [f["WARC-Type"] for p in glob.glob(f"{ws.path}/w/*.gz") for f, _ in warc.records(gzip.open(p).read())]
    assert kinds.count("response") == 401 and kinds.count("revisit") == 399
