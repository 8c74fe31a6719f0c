"""Lists, trees and graphs of any depth against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import expr as E
from palimpsest.operators import graph as G
from palimpsest.operators import history as H
from palimpsest.operators.chains import rank_lists

REVISIONS = "namespace_id long, id long, parent long"


def test_rank_lists(spark):
    rows = [(f"a{i}", f"a{i + 1}" if i < 99 else None, 1, i) for i in range(100)] + [("b", None, 1, 7), ("c", "gone", 1, 8)] + [(f"o{i}", f"o{(i + 1) % 5}", 1, 0) for i in range(5)]
    got = {r.node: (r.end, r.n, r.w) for r in rank_lists(spark.createDataFrame(rows, "node string, to string, n long, w long"), ["n", "w"]).collect()}
    assert all(got[f"a{i}"] == ("a99", 100 - i, sum(range(i, 100))) for i in range(100))
    assert got["b"] == ("b", 1, 7) and got["c"] == ("c", 1, 8) and all(got[f"o{i}"][0] is None for i in range(5)) and len(got) == len(rows)


def forest(rng):
    rows = []
    for ns, n in ((1, 60), (2, 1), (3, 25), (None, 4)):
        for i in range(n):
            rows.append((ns, i, None if i == 0 or rng.random() < 0.05 else rng.choice([i - 1, rng.randrange(i), 900])))
    rows += [(4, 1, 2), (4, 2, 3), (4, 3, 1), (4, 4, 3), (4, 5, None)]  # a circle and what hangs on it
    return rows + [(5, i, i - 1 if i else None) for i in range(50)]


@pytest.mark.parametrize("task_rows, listed", [(H.TASK_ROWS, H.LISTED), (10, H.LISTED), (0, 2)])
def test_labels(spark, monkeypatch, task_rows, listed):
    monkeypatch.setattr(H, "LISTED", listed)
    rows = forest(random.Random(5))
    if not task_rows:
        rows = [r for r in rows if r[0] is not None]
    parent = {(ns, i): p for ns, i, p in rows}
    df = spark.createDataFrame(rows, REVISIONS)
    labelled = H.labels(df, task_rows).cache()
    want, chains = {}, {}
    for ns, i, _ in rows:
        chain = [i]
        while (p := parent[ns, chain[-1]]) is not None and (ns, p) in parent and len(chain) < 99:
            chain.append(p)
        chains[ns, i] = chain if len(chain) < 99 else []
        want[ns, i] = (len(chain) - 1, chain[-1], parent[ns, chain[-1]] is not None) if len(chain) < 99 else (None,) * 3
    assert {(r.namespace_id, r.id): (r.depth, r.root, r.broken) for r in labelled.collect()} == want
    pairs = [(ns, a, b) for (ns, b) in parent if ns is not None for (of, a) in parent if of == ns] + [(1, 7_000, 3), (77, 1, 1)]
    got = {tuple(r)[:3]: r.is_ancestor for r in H.is_ancestor(spark.createDataFrame(pairs, "namespace_id long, ancestor long, id long"), labelled, 40).collect()}
    assert got == {(ns, a, b): a in (c := chains.get((ns, b), [])) and c.index(a) <= 40 for ns, a, b in pairs}
    assert H.labels(df.limit(0)).collect() == []


def test_truncation_outcomes(spark):
    r = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(6)] + [(2, i, i - 1 if i else None) for i in range(6)] + [(3, 0, 99)], REVISIONS).withColumn("state", F.lit("active"))
    n = spark.createDataFrame([(1, 5, 0), (2, 5, 3), (3, 0, 0), (4, None, 0)], "namespace_id long, head_revision long, namespace_epoch long")
    asked = [(1, 1, 5, 0, 2), (2, 1, 5, 0, None), (3, 2, 5, 0, 2), (4, 2, 4, 3, 2), (5, 9, None, 0, None), (6, 3, 0, 0, None), (7, 4, None, 0, None), (8, 1, 5, 0, 5), (9, 1, 5, 0, 77)]
    plan = H.plan_truncation(r, n, spark.createDataFrame(asked, "operation_id long, namespace_id long, expected_head long, expected_epoch long, new_head long"), F.lit("2024-01-01").cast("timestamp"))
    assert {x.operation_id: (x.outcome, x.revision_count) for x in plan.collect()} == {
        1: ("planned", 3), 2: ("planned", 6), 3: ("epoch_mismatch", None), 4: ("head_mismatch", None), 5: ("not_found", None), 6: ("conflict", None), 7: ("conflict", None), 8: ("conflict", None), 9: ("conflict", None)}
    gone = H.truncated_revisions(plan, r)
    assert sorted((x.operation_id, x.id) for x in gone.filter("namespace_id = 1").collect()) == [(1, 3), (1, 4), (1, 5), *((2, i) for i in range(6))]


def edges_of(spark, pairs):
    return spark.createDataFrame([("o", str(a), "o", str(b)) for a, b in pairs], "owner_kind string, owner_sha256 string, target_kind string, target_sha256 string")


def reach(pairs, roots):
    after, seen, todo = {}, set(roots), list(roots)
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def shapes():
    rng = random.Random(9)
    yield [(i, i + 1) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(40)], [20, 1010]
    yield [(i, i + 1) for i in range(200)] + [(i, 5000 + i) for i in range(200)] + [(5000 + i, 6000 + i // 9) for i in range(200)], [150, 3]  # a chain with leaves
    yield [(i, (i + 1) % 60) for i in range(60)] + [(7, 100), (100, 101), (101, 7), (59, 200)], [30]  # circles
    yield [(i, i // 2) for i in range(1, 400)], [399, 7, 5]  # many into one
    yield [(i // 2, i) for i in range(1, 400)], [3, 250]  # one into many
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(330)], [1, 2, 299]
    yield [(i, j) for i in range(0, 120) for j in (i + 1, i + 2)], [4]  # a ladder that nothing contracts
    yield [], [5]


@pytest.mark.parametrize("which", [slice(0, 4), slice(4, 8)])
def test_reachable_at_any_depth(spark, which):
    """Graphs of all shapes, side by side."""
    pairs, roots = [], []
    for k, (p, r) in enumerate(list(shapes())[which]):
        pairs += [(a + k * 10**6, b + k * 10**6) for a, b in p]
        roots += [x + k * 10**6 for x in r]
    got = G.reachable(spark.createDataFrame([("o", str(r)) for r in roots], "kind string, sha256 string"), edges_of(spark, pairs), shallow=1)
    assert sorted(int(r.sha256) for r in got.collect()) == sorted(reach(pairs, roots))


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """100,000 objects in a row: tables are written in rounds that grow with the logarithm of the depth."""
    n, written = 100_000, []
    for where in ("palimpsest.operators.graph", "palimpsest.operators.chains"):
        import importlib

        module = importlib.import_module(where)
        plain = module.rewritten
        monkeypatch.setattr(module, "rewritten", lambda df, label, plain=plain: written.append(label) or plain(df, label))
    e = spark.range(n - 1).select(F.lit("o").alias("owner_kind"), F.col("id").cast("string").alias("owner_sha256"), F.lit("o").alias("target_kind"), (F.col("id") + 1).cast("string").alias("target_sha256"))
    got = G.reachable(spark.createDataFrame([("o", "0")], "kind string, sha256 string"), e)
    assert got.distinct().count() == got.count() == n and len(written) < 25


def test_what_was_followed_is_not_contracted(spark, monkeypatch):
    """Chains of ten entered at the third: after four rounds only what lies ahead of the seventh is left; content ids are held as their bytes."""
    written, plain = {}, G.rewritten
    monkeypatch.setattr(G, "rewritten", lambda df, label: written.setdefault(label, plain(df, label)) if label in ("pairs", "nodes") and label not in written else plain(df, label))
    name = lambda k: E.content_id((F.col("id") * 10 + k).cast("string"))
    e = spark.range(30).select("id", F.explode(F.array(*(F.struct(name(k).alias("owner_sha256"), name(k + 1).alias("target_sha256")) for k in range(1, 10)))).alias("e")).select(F.lit("o").alias("owner_kind"), "e.owner_sha256", F.lit("o").alias("target_kind"), "e.target_sha256")
    got = G.reachable(spark.range(30).select(F.lit("o").alias("kind"), name(3).alias("sha256")), e)
    want = spark.range(30).select(F.explode(F.array(*(name(k) for k in range(3, 11)))).alias("sha256"))
    assert sorted(r.sha256 for r in got.collect()) == sorted(r.sha256 for r in want.collect())
    assert written["nodes"].count() == 30 * 3
    assert written["pairs"].selectExpr("max(octet_length(a.name))").first()[0] == 33


def test_clean_up_reads_and_writes_once(spark, monkeypatch):
    """h9_gc_results derives its objects once and writes no edges beside those that are followed."""
    from palimpsest.plans import graph_queries as Q

    written, objects = [], []
    plain, made = Q.rewritten, Q._objects
    monkeypatch.setattr(Q, "rewritten", lambda df, label: written.append(label) or plain(df, label))
    monkeypatch.setattr(Q, "_objects", lambda *x: objects.append(1) or made(*x))
    assert Q.h9_gc_results(spark, "/root/testdata/sf0.001").count()
    assert written == ["objects", "queue"] and len(objects) == 1


LOG = "namespace_id long, seq long, request_id long, parent long, expected_head long, expected_epoch long, action string"


def plain_replay(rows):
    out, state = {}, {}
    for ns, seq, rid, parent, expected, epoch, action in sorted(rows, key=lambda r: r[:2]):
        head, now, known = state.setdefault(ns, [None, 0, {}])
        if action == "bump":
            state[ns][1] += 1
            out[ns, seq] = ("bumped", now + 1)
            continue
        if epoch != now:
            result = "wrong_epoch"
        elif rid == head and known[head] == parent:
            result = "already_committed"
        elif rid in known:
            result = "conflict"
        elif head != expected:
            result = "head_mismatch"
        elif parent != expected:
            result = "conflict"
        else:
            result = "created"
            state[ns][0] = rid
            known[rid] = parent
        out[ns, seq] = (result, now)
    return out


def commit_rows(rng, n, ids, reuse):
    """A log in which heads move on, requests come again, parents and expected heads are stale, and ids come back under other parents."""
    rows, head, used, epoch = [], None, [], 0
    for seq in range(n):
        x = rng.random()
        if x < 0.03:
            rows.append((1, seq * 3, 0, None, None, 0, "bump"))
            epoch += 1
        elif x < 0.15 and used:
            rows.append((1, seq * 3, *rng.choice(used), epoch, "commit"))
        elif x < 0.25:
            rows.append((1, seq * 3, rng.randrange(ids), rng.choice([None, 3, head]), rng.choice([None, 3, head]), epoch - rng.choice([0, 1]), "commit"))
        else:
            rid = rng.choice([u[0] for u in used]) if used and rng.random() < reuse else len(used) + ids
            used.append((rid, head, head))
            rows.append((1, seq * 3, rid, head, head, epoch, "commit"))
            if rng.random() < 0.9:
                head = rid
    return rows


@pytest.mark.parametrize("seed, reuse, task_rows, span", [(1, 0.0, 20, 16), (2, 0.05, 20, 50), (3, 0.5, 20, 7), (4, 0.02, 0, 1 << 16), (5, 0.0, 10**6, 16)])
def test_replay_of_large_namespaces(spark, seed, reuse, task_rows, span):
    rng = random.Random(seed)
    rows = commit_rows(rng, 250, 40, reuse) + [(2, *r[1:]) for r in commit_rows(rng, 15, 40, reuse)] + [(3, *r[1:]) for r in commit_rows(rng, 90, 10, 0)]
    got = H.replay_commits(spark.createDataFrame(rows, LOG).repartition(4), task_rows, span).collect()
    assert {(r.namespace_id, r.seq): (r.outcome, r.epoch) for r in got} == plain_replay(rows) and len(got) == len(rows)


def test_one_namespace_spreads_over_tasks(spark):
    """No sort, window or Python task gets a namespace as a whole."""
    n = 4_000
    log = spark.range(n).select(F.lit(1).cast("long").alias("namespace_id"), F.col("id").alias("seq"), F.col("id").alias("request_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.when(F.col("id") > 0, F.col("id") - 1).alias("expected_head"), F.lit(0).cast("long").alias("expected_epoch"), F.lit("commit").alias("action"))
    got = H.replay_commits(log, 100, 64)
    assert got.filter("outcome = 'created'").count() == n
    assert "MapInPandas" not in H._scanned(log, 100, 64)._jdf.queryExecution().toString()


def test_small_groups_of_steps_are_walked(spark, monkeypatch):
    """Walks and pointers take the same steps; pointers are made only for groups of more than task_rows."""
    rng, rows, want = random.Random(8), [], set()
    for g in range(40):
        state = None
        for seq in range(rng.choice([3, 20, 60])):
            needs, gives = rng.choice([None, 0, 1, 2]), rng.randrange(3)
            rows.append((g, seq, needs, gives))
            if needs == state:
                state = gives
                want.add((g, seq))
    steps = spark.createDataFrame(rows, "grp long, seq long, needs long, gives long")
    pointed, plain = [], H.following
    monkeypatch.setattr(H, "following", lambda df, span: pointed.append(df.select("grp").distinct().count()) or plain(df, span))
    for task_rows, groups in ((100, []), (20, [sum(1 for g in range(40) if sum(r[0] == g for r in rows) > 20)]), (0, [40])):
        pointed.clear()
        assert {tuple(r) for r in H.taken_steps(steps, task_rows, 16).collect()} == want and pointed == groups
