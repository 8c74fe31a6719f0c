"""Small cases of the archive operators and the invariants that hold for any input."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import expr as E
from palimpsest.operators import chunks as C
from palimpsest.operators import diffmerge as D
from palimpsest.operators import graph as G
from palimpsest.operators import history as H
from palimpsest.operators import normalize as N
from palimpsest.operators import paths as P
from palimpsest.operators import validate as V
from palimpsest.sources import rollouts as S


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def threads(spark, d):
    return spark.createDataFrame([(k, h, f"title {k}") for k, h in d.items()] or [("x", "x", "x")], "thread_id string, hash string, title string").filter("thread_id <> 'x'")


def test_merge_branches(spark):
    base = threads(spark, {"a": "1", "b": "1", "c": "1", "d": "1", "e": "1", "f": "1", "n": None})
    local = threads(spark, {"a": "2", "b": "1", "c": "2", "e": "2", "f": "1", "l": "1", "n": None})
    remote = threads(spark, {"a": "1", "b": "2", "c": "3", "d": "2", "e": "2", "r": "1", "n": None})
    got = {r.thread_id: (r.side, r.conflict_kind) for r in D.merge3(base, local, remote).collect()}
    assert got == {
        "a": ("local", None), "b": ("remote", None), "c": (None, "both_modified"), "d": (None, "local_deleted_remote_modified"), "e": ("local", None),
        "f": (None, None), "l": ("local", None), "r": ("remote", None), "n": ("local", None),
    }


def test_null_group_keys_meet(spark):
    def side(v):
        return spark.createDataFrame([(None, "a", v, "t"), ("h", "a", v, "t"), ("h", None, v, "t")], "home_key string, thread_id string, hash string, title string")

    merged = D.merge3(side("1"), side("2"), side("3"), ["home_key", "thread_id"])
    assert [r.conflict_kind for r in merged.collect()] == ["both_modified"] * 3
    assert {r.status for r in D.snapshot_diff(side("1"), side("1"), ["home_key", "thread_id"]).collect()} == {"unchanged"}


def test_import_of_an_id_that_is_listed_twice(spark):
    incoming = spark.createDataFrame([("a", "1", "p", 1), ("b", "1", "q", 1), ("c", None, "r", 1)], "thread_id string, hash string, path string, index_rows int")
    target = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("b", "1", "z"), ("c", None, "x"), ("c", "1", "x")], "thread_id string, hash string, path string")
    assert {r.thread_id: r.action for r in D.import_plan(incoming, target).collect()} == {"a": "conflict", "b": "skip", "c": "conflict"}


@pytest.mark.parametrize(
    "text, canonical",
    [
        ('{"b":1e400}', None), ("-1e400", None), ("NaN", None), ("-Infinity", None), ("1e-400", "0.0"), ("-0", "-0.0"), ("0.00001", "0.00001"), ("-1.5e-5", "-0.000015"), ("0.000001", "1e-6"), ("12e-7", "1.2e-6"), ("1e16", "1e16"), ("1e15", "1000000000000000.0"),
        ("1.25E+30", "1.25e30"), ("18446744073709551616", "1.8446744073709552e19"), ("-9223372036854775809", "-9.223372036854776e18"), ("9223372036854775808", "9223372036854775808"), ('["1e5",1e5]', '["1e5",100000.0]'),
        ("[" * 127 + "]" * 127, "[" * 127 + "]" * 127), ("[" * 128 + "]" * 128, None), ('"' + "[" * 300 + '"', '"' + "[" * 300 + '"'),
    ],
)
def test_canonical_numbers(text, canonical):
    value, ok = N._strict(text)
    assert (N._dump(value) if ok else None) == canonical


def test_merge_invariants(spark):
    base, other = threads(spark, {"a": "1", "b": "1"}), threads(spark, {"b": "2", "c": "1"})
    for merged in (D.merge3(base, other, base), D.merge3(base, base, other)):
        assert rows(D.resolve(merged, spark.createDataFrame([], "thread_id string, conflict_id string, choice string")), "thread_id", "hash") == [("b", "2"), ("c", "1")]


def test_a_problem_rejects_the_whole_merge(spark):
    base, local, remote = (threads(spark, {"a": v, "b": v, "c": "1"}) for v in "123")
    merged = D.merge3(base, local, remote)
    ids = {r.thread_id: r.conflict_id for r in D.conflict_ids(merged).collect()}
    given = lambda *r: spark.createDataFrame(r, "thread_id string, conflict_id string, choice string")
    good = given(("a", ids["a"], "local"), ("b", ids["b"], "remote"))
    assert rows(D.resolve(merged, good), "thread_id", "hash") == [("a", "2"), ("b", "3"), ("c", "1")]
    for bad in (given(("a", ids["a"], "local")), given(("a", ids["a"], "local"), ("b", "old", "remote")), good.unionByName(given(("x", "y", "local"))), good.unionByName(given(("a", ids["a"], "local")))):
        assert D.resolution_problems(D.conflict_ids(merged), bad).count() and D.resolve(merged, bad).count() == 0


def test_conflict_id_binds_versions(spark):
    base, local = threads(spark, {"a": "1"}), threads(spark, {"a": "2"})
    one = D.conflict_ids(D.merge3(base, local, threads(spark, {"a": "3"}))).first().conflict_id
    two = D.conflict_ids(D.merge3(base, local, threads(spark, {"a": "4"}))).first().conflict_id
    assert one != two and E is not None


def test_chunks_round_trip(spark):
    data = bytes(range(40))
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data + b"abcdef")), (3, bytearray())], "id int, content binary")
    c = C.chunk(df, 16).cache()
    assert rows(c.filter("id = 1"), "pos", "byte_length") == [(0, 16), (1, 16), (2, 8)]
    a, b = ([r.sha256 for r in c.filter(F.col("id") == i).orderBy("pos").collect()] for i in (1, 2))
    assert a[:2] == b[:2] and a[2] != b[2]
    assert {r.id: bytes(r.content) for r in C.reassemble(c, ["id"]).collect()} == {1: data, 2: data + b"abcdef"}


@pytest.mark.parametrize(
    "path, mapped",
    [("d:/projects/demo", "F:\\workspace\\demo"), ("D:/projects-old/demo", None), ("D:\\projects", "F:\\workspace"), ("\\\\?\\D:\\projects\\X y", "F:\\workspace\\X y")],
)
def test_path_rules(spark, path, mapped):
    rules = spark.createDataFrame([("D:\\projects", "F:\\workspace"), ("D:/", "G:/")], "remote_prefix string, local_prefix string").filter("remote_prefix <> 'D:/'")
    got = P.map_paths(spark.createDataFrame([(path,)], "path string"), rules).first().mapped
    assert got == mapped


def test_path_key(spark):
    cases = {"\\\\?\\UNC\\Srv\\Share\\": "//srv/share", "\\\\?\\C:\\Users": "c:/users", "/Home/x/": "/Home/x", "C:/A/": "c:/a"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.k for r in df.select("p", E.path_key(F.col("p")).alias("k")).collect()} == cases


def test_unique_names_repeat(spark):
    df = spark.createDataFrame([("/1/a",), ("/2/a",), ("/3/a-2",), ("/4/A",), ("/5/..",)], "path string")
    names = [r.name.lower() for r in P.unique_names(df, []).collect()]
    assert len(set(names)) == 5 and "project" in names


def test_minimal_roots(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d/e",), ("/c/d",)], "path string")
    assert rows(P.minimal_roots(df), "key") == [("/a",), ("/ab",), ("/c/d",)]


def lines(spark, text, thread="t1"):
    return S.split_lines(spark.createDataFrame([("f", thread, bytearray(text.encode()))], "file string, thread_id string, content binary"))


HEAD = '{"type":"session_meta","payload":{"id":"t1","cwd":"/a","model_provider":"p"}}'


def test_normal_form_is_equal_and_idempotent(spark):
    other = '{"payload": {"model_provider": "q", "id": "t1", "cwd": "/b"}, "type": "session_meta"}'
    tail = '\r\n{"type":"message","model_provider":"kept"}\nbad-json\n{"type":"session_meta","payload":{"id":"else","model_provider":"p"}}'
    one, two = (N.normalize_lines(lines(spark, h + tail)) for h in (HEAD, other))
    a, b = (N.content_of_lines(x, ["thread_id"]).first().content_id for x in (one, two))
    again = N.content_of_lines(N.normalize_lines(one.drop("warning")), ["thread_id"]).first().content_id
    assert a == b == again
    assert [r.warning for r in one.orderBy("line_no").collect()] == [None, None, "invalid_json", None]
    kept = one.filter("line_no = 1").first()
    assert bytes(kept.raw) == b'{"type":"message","model_provider":"kept"}' and kept.ending == "\n"


def test_round_trip_of_machine_values(spark):
    m = spark.createDataFrame([("t1", "p", "/a")], "thread_id string, provider string, workspace string")
    back = N.materialize_lines(N.normalize_lines(lines(spark, HEAD)).drop("warning"), m, "thread_id").first()
    assert json.loads(bytes(back.raw)) == json.loads(HEAD)


def test_broken_header(spark):
    assert N.normalize_lines(lines(spark, HEAD, "t2")).first().warning == "broken_header"


def test_headers(spark):
    big = b'{"type":"session_meta","x":"' + b"a" * (1 << 20) + b'"}'
    cases = {"empty": (b"", "empty_rollout"), "big": (big, "invalid_json"), "utf8": (b"{\xff}", "invalid_utf8"), "ok": (HEAD.encode(), None), "trail": (HEAD.encode() + b" x", "invalid_json")}
    df = spark.createDataFrame([(k, False, len(v[0]), bytearray(v[0])) for k, v in cases.items()], "path string, archived boolean, byte_length long, header binary")
    assert {r.path: r.kind for r in V.classify_headers(df).collect()} == {k: v[1] for k, v in cases.items()}


def test_gc_keeps_what_is_shared(spark):
    edges = spark.createDataFrame([("r", "1", "c", "x"), ("r", "2", "c", "x"), ("r", "2", "c", "y"), ("c", "y", "d", "z")], "owner_kind string, owner_sha256 string, target_kind string, target_sha256 string")
    roots = spark.createDataFrame([("r", "1")], "kind string, sha256 string")
    objects = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "kind string, sha256 string").withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    reached = G.reachable(roots, edges)
    assert rows(G.gc_plan(objects, reached, F.lit("2024-01-01").cast("timestamp")), "sha256") == [("y",), ("z",)]


def test_deletion_plan(spark):
    refs = spark.createDataFrame([("s1", "c", "x", 5), ("s1", "c", "y", 7), ("s2", "c", "x", 5)], "snapshot_id string, kind string, sha256 string, byte_length long")
    none = spark.createDataFrame([("s2",)], "snapshot_id string")
    got = {r.snapshot_id: (r.shared_objects, r.exclusive_objects, r.exclusive_bytes, r.eligible) for r in G.deletion_plan(refs, none, none.limit(0)).collect()}
    assert got == {"s1": (1, 1, 7, True), "s2": (1, 0, 0, False)}


COMMITS = [
    (1, 1, 10, None, None, 0, "commit", "created"),
    (1, 2, 10, None, None, 0, "commit", "already_committed"),
    (1, 3, 11, 10, 10, 1, "commit", "wrong_epoch"),
    (1, 4, 11, 10, 9, 0, "commit", "head_mismatch"),
    (1, 5, 11, 9, 10, 0, "commit", "conflict"),
    (1, 6, 11, 10, 10, 0, "commit", "created"),
    (1, 7, 10, None, None, 0, "commit", "conflict"),
    (1, 8, 0, None, None, 0, "bump", "bumped"),
    (1, 9, 12, 11, 11, 1, "commit", "created"),
]
LOG = "namespace_id long, seq long, request_id long, parent long, expected_head long, expected_epoch long, action string"


def test_replay(spark):
    log = spark.createDataFrame([c[:-1] for c in COMMITS], LOG)
    assert [r.outcome for r in H.replay_commits(log).orderBy("seq").collect()] == [c[-1] for c in COMMITS]


def test_read_files(spark, tmp_path):
    for p, data in (("sessions/2024/rollout-a.jsonl", b"x\r\ny"), ("archived_sessions/rollout-b.jsonl", b"\xff\n"), ("sessions/other.jsonl", b"z")):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    inventory = spark.createDataFrame([("sessions/rollout-e.jsonl", 0)], "path string, byte_length long").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    assert rows(S.read_rollout_files(spark, str(tmp_path), inventory), "path", "byte_length", "archived") == [
        ("archived_sessions/rollout-b.jsonl", 2, True), ("sessions/2024/rollout-a.jsonl", 4, False), ("sessions/rollout-e.jsonl", 0, False)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40)
    try:
        (tmp_path / "sessions/rollout-long.jsonl").write_bytes(b"".join(b"line %d\xfe\r\n" % i if i % 3 else b"\n" for i in range(60)) + b"end\r")
        long, whole = (sorted((r.file, r.line_no, bytes(r.raw), r.ending) for r in read(spark, str(tmp_path)).collect()) for read in (S.read_large_lines, S.read_rollout_lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert long == whole and len(long) == 64
    (tmp_path / "sessions/rollout-long.jsonl").unlink()
    got = [(r.file, r.line_no, bytes(r.raw), r.ending) for r in S.read_rollout_lines(spark, str(tmp_path)).orderBy("file", "line_no").collect()]
    assert got == [("archived_sessions/rollout-b.jsonl", 0, b"\xff", "\n"), ("sessions/2024/rollout-a.jsonl", 0, b"x", "\r\n"), ("sessions/2024/rollout-a.jsonl", 1, b"y", "")]


def test_snapshot_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", "A", False, "c1", "p", "/x"), ("b", None, True, "c2", None, None)], "thread_id string, title string, archived boolean, content_id string, observed_provider string, local_path string")
    S.publish_snapshot(t, "s1", str(tmp_path))
    assert rows(S.load_snapshot(spark, "s1", str(tmp_path)), *t.columns) == rows(t)
    with pytest.raises(Exception, match="already exists"):
        S.publish_snapshot(t, "s1", str(tmp_path))


def test_restore_counts_are_those_of_the_pairs(spark):
    tracking = spark.createDataFrame([(1, 0, 5, 1), (2, 0, 4, 1), (3, 0, 5, 2), (1, 1, None, 1), (4, 2, 5, 1)], "home_key long, namespace_id long, integrated_head long, remote_epoch long")
    namespaces = spark.createDataFrame([(0, 5, 1), (1, None, 1), (3, 5, 1)], "namespace_id long, head_revision long, namespace_epoch long")
    revisions = spark.createDataFrame([(0, 1, 0), (0, 2, 3), (0, 3, None), (1, 4, 0), (3, 5, 0)], "namespace_id long, revision long, warning_count long")
    want = D.restore_status(tracking, namespaces, revisions).groupBy("home_key", "restore").agg(F.count(F.lit(1)).alias("n"))
    got = D.restore_counts(tracking, namespaces, revisions)
    assert rows(got) == rows(want, *got.columns) and (1, "restorable", 3) in rows(got)


def test_restore_counts_of_one_large_namespace(spark):
    """100,000 homes and 1,000,000 revisions of one namespace: no pair of them is made."""
    tracking = spark.range(100_000).select(F.col("id").alias("home_key"), F.lit(0).alias("namespace_id"), F.lit(1).alias("integrated_head"), F.lit(1).alias("remote_epoch"))
    namespaces = spark.createDataFrame([(0, 1, 1)], "namespace_id int, head_revision int, namespace_epoch int")
    revisions = spark.range(1_000_000).select(F.lit(0).alias("namespace_id"), F.col("id").alias("revision"), (F.col("id") % 4).alias("warning_count"))
    got = D.restore_counts(tracking, namespaces, revisions).groupBy("restore", "n").count()
    assert rows(got) == [("has_warnings", 750_000, 100_000), ("restorable", 250_000, 100_000)]


def test_resolve_namespace_by_groups_of_rules(spark):
    """Against every pair of identity and rule; fields of identities and namespaces may be null, ids of rules repeat."""
    import random

    rng = random.Random(4)
    some = lambda *v: rng.choice([None, *v])
    who = [(i, rng.choice([0, 1, None]), i % 7 > 0, 99 if i % 11 == 0 else None, 7 if i % 3 == 0 else None, some(1, 2, 3), some("p", "q"), some(5, 6)) for i in range(300)]
    rules = [(rng.randrange(60), rng.choice([0, 1, None]), some(1, 2) if i % 3 else 1, some(1, 2, 3), some("p", "q"), some(5, 6)) for i in range(40)]
    rules = list({r[0]: r for r in rules}.values()) + [rules[0]]
    want = []
    for i, remote, auto, override, default, *mine in who:
        hits = [(sum(s for v, s in zip(r[3:], (4, 2, 1)) if v is not None), r) for r in rules if remote is not None and r[1] == remote and any(v is not None for v in r[3:]) and all(v is None or v == m for v, m in zip(r[3:], mine))]
        top = [r for score, r in hits if score == max(h[0] for h in hits)]
        spaces = {r[2] for r in top} - {None}
        kind = "default" if not auto else "override" if override else "ambiguous" if len(spaces) > 1 else "rule" if spaces else "default" if default else "none"
        first = [r[2] for r in sorted(top, key=lambda r: r[0])[:1]]
        ns = {"override": override, "rule": first[0] if first else None, "default": default}.get(kind)
        want.append((i, kind, ns, ",".join(sorted({str(r[0]) for r in top})) if kind == "ambiguous" else None))
    identities = spark.createDataFrame(who, "identity long, remote_id long, auto boolean, override int, default_ns int, fingerprint long, provider string, home_key int")
    found = P.resolve_namespace(identities, spark.createDataFrame(rules, "id long, remote_id long, namespace_id int, fingerprint long, provider string, home_key int"))
    assert rows(found) == want and {"ambiguous", "rule", "override", "default", "none"} == {w[1] for w in want}


def test_resolve_namespace_with_large_groups_of_rules(spark):
    """100,000 identities and 1,000,000 rules with the same fields: no pair of them is made."""
    none = lambda kind: F.lit(None).cast(kind)
    who = spark.range(100_000).select(F.col("id").alias("identity"), F.lit(1).alias("remote_id"), F.lit(True).alias("auto"), none("int").alias("override"), none("int").alias("default_ns"), F.lit(1).alias("fingerprint"), F.lit("p").alias("provider"), F.lit(2).alias("home_key"))
    given = spark.range(1_000_000).select("id", F.lit(1).alias("remote_id"), F.lit(3).alias("namespace_id"), none("int").alias("fingerprint"), F.lit("p").alias("provider"), none("int").alias("home_key"))
    got = P.resolve_namespace(who, given).groupBy("kind", "namespace_id", "rules").count()
    assert rows(got) == [("rule", 3, None, 100_000)]
