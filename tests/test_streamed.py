"""Contents that stream by give what contents in one row give."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunks as C
from palimpsest.operators import normalize as N
from palimpsest.operators import streamed as X


def sha(b):
    return f"sha256:{hashlib.sha256(b).hexdigest()}"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def contents(rng):
    return {(f"k{i}", i % 3): rng.randbytes(rng.choice([1, 10, 16, 17, 900])) for i in range(25)}


def pieces(spark, data, size=16):
    rows = [(*k, p // size, bytearray(b[p : p + size]), sha(b[p : p + size])) for k, b in data.items() for p in range(0, len(b), size)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "name string, part_of int, pos int, bytes binary, sha256 string").repartition(4)


@pytest.mark.parametrize("row_bytes", [5, 16, X.ROW_BYTES])
def test_digests(spark, small_batches, row_bytes):
    data = contents(random.Random(3))
    got = X.stream_digests(pieces(spark, data), ["name", "part_of"], "pos", F.col("bytes"), F.col("sha256"), row_bytes).collect()
    assert {(r.name, r.part_of): (r.content_id, r.byte_length, r.pieces, r.intact, r.gapless) for r in got} == {k: (sha(b), len(b), -(-len(b) // 16), True, True) for k, b in data.items()}
    one = C.reassemble(pieces(spark, data), ["name", "part_of"]).collect()
    assert {sha(bytes(r.content)) for r in one} == {r.content_id for r in got}


def test_broken_pieces(spark, small_batches):
    rows = [("gap", 0, b"a"), ("gap", 2, b"b"), ("twice", 0, b"a"), ("twice", 0, b"b"), ("null", 0, None), ("late", 1, b"x"), ("bad", 0, b"q"), ("bad", 1, b"y")]
    df = spark.createDataFrame([(n, p, b if b is None else bytearray(b), sha(b"other") if n == "bad" and p else None) for n, p, b in rows], "n string, pos int, bytes binary, s string")
    got = {r.n: (r.byte_length, r.intact, r.gapless) for r in X.stream_digests(df, ["n"], "pos", F.col("bytes"), F.col("s")).collect()}
    assert got == {"gap": (2, True, False), "twice": (2, True, False), "null": (0, True, True), "late": (1, True, False), "bad": (2, False, True)}
    assert X.stream_digests(df.limit(0), ["n"], "pos", F.col("bytes")).collect() == []


def test_verify(spark, small_batches):
    data = {("a", 0): b"1" * 40, ("b", 0): b"2" * 40, ("c", 0): b"3" * 40, ("d", 0): b"4" * 5}
    rows = pieces(spark, data).withColumn("bytes", F.when((F.col("name") == "d"), F.encode(F.lit("44444!"), "UTF-8")).otherwise(F.col("bytes")))
    declared = [("a", 0, sha(b"1" * 40), 40), ("b", 0, sha(b"x"), 40), ("c", 0, sha(b"3" * 40), 41), ("d", 0, sha(b"44444"), 5), ("gone", 0, sha(b"g"), 1), ("empty", 0, sha(b""), 0), ("wrong", 0, sha(b"w"), 0)]
    bad = C.verify_whole(rows, spark.createDataFrame(declared, "name string, part_of int, logical_sha256 string, byte_length long"), ["name", "part_of"])
    assert {r.name: r.rule for r in bad.collect()} == {"b": "content_hash", "c": "content_length", "d": "chunk", "gone": "no_chunks", "wrong": "content_hash"}


def test_parts(spark, small_batches, tmp_path):
    data = contents(random.Random(4))
    rows = pieces(spark, data).withColumn("sha256", F.when(F.col("name") == "k7", "sha256:x").otherwise(F.col("sha256")))
    verdict = X.publish_contents(rows, ["name", "part_of"], "pos", F.col("bytes"), F.col("sha256"), str(tmp_path / "out"), 100)
    assert {r.name for r in verdict.filter("NOT sound").collect()} == {"k7"} and verdict.count() == len(data)
    again = {}
    for r in sorted(X.read_contents(spark, str(tmp_path / "out"), ["name", "part_of"]).collect(), key=lambda r: (r.name, r.part)):
        again[r.name, r.part_of] = again.get((r.name, r.part_of), b"") + bytes(r.bytes)
        assert len(r.bytes) <= 100
    assert again == {k: b for k, b in data.items() if k[0] != "k7"}


def test_lines(spark, small_batches):
    rng = random.Random(6)
    rows = [(f"f{f}", n, bytearray(rng.randbytes(rng.randrange(30))), rng.choice(["\n", "\r\n"])) for f in range(5) for n in range(20)]
    lines = spark.createDataFrame(rows, "file string, line_no long, raw binary, ending string").repartition(3)
    whole = {r.file: bytes(r.content) for r in N.joined_lines(lines, ["file"]).collect()}
    assert {r.file: (r.content_id, r.byte_length) for r in N.content_of_lines(lines, ["file"]).collect()} == {k: (sha(b), len(b)) for k, b in whole.items()}
    parts = N.line_parts(lines, ["file"], 64).filter("part IS NOT NULL").collect()
    assert {f: b"".join(bytes(r.bytes) for r in sorted(parts, key=lambda r: r.part) if r.file == f) for f in whole} == whole
