"""WARC archives: revisit resolution against a plain version, and the round trip of payloads."""

import collections
import gzip
import hashlib
import random

import pytest

from palimpsest.llm import warc

PAGES = "page_id long, url string, html string"


def plain(rows, least=warc.MIN_BYTES):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and top[h or ""] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(out, key=str)


def test_digest(spark):
    rng = random.Random(11)
    bodies = [None, "", "short", "é" * 499, "é" * 500, "x" * 999, "x" * 1000, "line\r\n\r\nWARC/1.1\r\n\r\n" * 80, "\n" * 1500, "a" * 1500 + "\r\n", "a" * 1500 + "\r", "€" * 70_000]
    rows = [(i, rng.choice([None, "http://a/\r\nx: y", f"http://h/{i}"]), rng.choice(bodies)) for i in range(240)] + [(1000 + i, "u", "hot" * 400) for i in range(120)]
    df = spark.createDataFrame([(*r, "revisit", b"z") for r in rows], PAGES + ", record_type string, payload binary").repartition(6)
    got = warc.archive_digest(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert warc.archive_digest(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    big, own = "b" * 2000, "o" * 2000
    rows = [(5, "u", big), (5, "v", big), (5, "v", big), (None, "w", big), (None, "x", own), (None, "y", own), (7, "s", "small"), (7, "s", "small")]
    got = [tuple(r) for r in warc.archive_digest(spark.createDataFrame(rows, PAGES)).select("page_id", "record_type", "refers_to").collect()]
    assert collections.Counter(got) == {(5, "response", None): 1, (5, "revisit", 5): 2, (None, "revisit", 5): 1, (None, "response", None): 1, (None, "revisit", None): 1, (7, "response", None): 2}


def test_files_restore_and_second_pass(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>\r\n" * 200) for i in range(30)] + [(50, "http://h/50", "tiny"), (51, "http://h/51", "tiny")]
    first = f"file://{tmp_path}/a"
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), first)
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "a").glob("part-*.gz")))
    assert raw.count(b"WARC-Type: revisit\r\n") == 23 and raw.count(b"WARC-Type: response\r\n") == 9 and raw.endswith(b"\r\n\r\n")
    read = warc.read_archives(spark, first)
    assert {(int(r.source_id), r.url, bytes(r.payload).decode()) for r in warc.restored(read).collect()} == set(rows)
    assert read.select("record_id").distinct().count() == len(rows) and read.filter("stated_digest <> payload_digest").count() == 0
    assert all(r.refers_to_source == str(max(i for i, _, h in rows if h.startswith(f"<p>{int(r.source_id) % 7}<"))) for r in read.filter("record_type = 'revisit'").collect())
    # Two archives, one of which has only a revisit: it finds its original, and another stays without one.
    lost = read.filter("source_id = '3'").withColumn("source_id", read["source_id"]).selectExpr("record_id", "record_type", "source_id", "url", "date", "refers_to", "refers_to_source", "payload_bytes", "repeat('0', 40) AS stated_digest", "payload_digest", "payload")
    second = f"file://{tmp_path}/b"
    warc.write_archives(read.unionByName(lost), second, "source_id", "url", "payload", "date", archived=True)
    again = warc.read_archives(spark, second)
    assert again.filter("record_type = 'revisit' AND refers_to IS NULL").select("source_id", "payload_digest").collect() == [("3", "0" * 40)]
    whole = warc.restored(again.filter("refers_to IS NOT NULL OR record_type = 'response'"))
    assert {(int(r.source_id), r.url, bytes(r.payload).decode()) for r in whole.collect()} == set(rows)


def test_broken_archive(spark, tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc"
    (tmp_path / "x.gz").write_bytes(gzip.compress(good))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, f"file://{tmp_path}/x.gz").collect()
    (tmp_path / "y.gz").write_bytes(gzip.compress(b"other\r\n"))
    with pytest.raises(Exception, match="no record begins here"):
        warc.read_archives(spark, f"file://{tmp_path}/y.gz").collect()
