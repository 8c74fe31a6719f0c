"""Queries of history, object graph, clean-up and accounting."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import content_id
from ..operators import chunks as C
from ..operators import graph as G
from ..operators import history as H
from ..operators import transitions as T
from ..sources.scratch import rewritten, shared_dir
from ..sources.versioned import publish, read_table
from .bindings import CHUNKS_SQL, LISTED_SQL, NAMESPACES_SQL, REVISIONS_SQL, TREE_SQL, chunk_rows, namespaces, revision_tree, revisions, table

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _now():
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


def h1_list_revisions(spark, d):
    return H.list_revisions(revisions(spark, d), 5).select("namespace_id", "id", F.col("place").cast("long").alias("place"))


def h1_list_namespaces(spark, d):
    return H.list_namespaces(namespaces(spark, d))


def h2_namespace_heads(spark, d):
    return H.namespace_heads(revisions(spark, d), namespaces(spark, d))


def h4_ancestors(spark, d):
    return H.ancestors(revision_tree(spark, d))


def h4_is_ancestor(spark, d):
    """Each revision with ids shortly before it, in its own namespace and in others."""
    r = rewritten(revision_tree(spark, d), "tree")
    w = Window.partitionBy("namespace_id").orderBy("seq")
    near = r.select("namespace_id", F.coalesce(F.lag("id", 5).over(w), F.col("id")).alias("ancestor"), "id")
    far = r.select("namespace_id", F.greatest(F.col("id") - F.pmod(F.col("id") * 7, F.lit(150)) - 1, F.lit(0)).alias("ancestor"), "id")
    return H.is_ancestor(near.union(far).distinct(), rewritten(H.labels(r), "labels")).drop("namespace_id")


def h4_labels(spark, d):
    """Per namespace the pairs of revisions one of which is above the other, counted by labels alone."""
    x = rewritten(H.labels(revision_tree(spark, d)), "labels")
    y = x.select(F.col("namespace_id").alias("of"), F.col("root").alias("top"), F.col("first").alias("f"), F.col("last").alias("l"))
    inside = (F.col("namespace_id") == F.col("of")) & (F.col("root") == F.col("top")) & (F.col("f") <= F.col("first")) & (F.col("last") <= F.col("l"))
    return x.join(y, inside).groupBy("namespace_id").agg(F.count(F.lit(1)).alias("pairs"))


def _ops(spark, d):
    r = revisions(spark, d)
    return r.select(
        "id", "namespace_id", F.when(F.col("id") % 2 == 0, "active").otherwise("restored").alias("state"), F.col("id").alias("old_head"), (F.col("id") % 400).alias("new_head"),
        "created_at", (F.col("created_at") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"),
    )


def _wanted(spark, d):
    """A request per namespace: new heads on the chain, on a branch, in another namespace, the head itself or none; some expect a wrong head or epoch."""
    r = rewritten(revision_tree(spark, d), "tree")
    n = rewritten(H.namespace_heads(r, namespaces(spark, d)), "namespaces")
    k = F.col("namespace_id")
    wanted = r.filter("seq = 6").join(n.select("namespace_id", "head_revision", "namespace_epoch"), "namespace_id").select(
        (k + 1_000).alias("operation_id"), "namespace_id", F.when(k % 13 == 5, F.col("id")).otherwise(F.col("head_revision")).alias("expected_head"), (F.col("namespace_epoch") + F.when(k % 17 == 6, 1).otherwise(0)).alias("expected_epoch"),
        F.when(k % 7 == 1, F.col("head_revision")).when(k % 7 == 2, F.col("id") + 1).when(k % 7 != 3, F.col("id")).alias("new_head"),
    )
    return r, n, wanted


def _truncation(spark, d):
    """Those requests, and some for namespaces that are not there."""
    r, n, wanted = _wanted(spark, d)
    k = F.col("namespace_id")
    unknown = wanted.filter(k % 5 == 0).withColumn("operation_id", k + 2_000_000).withColumn("namespace_id", -k - 1)
    labelled = rewritten(H.labels(r.filter("state = 'active'")), "labels")
    return r, n, H.plan_truncation(r, n, wanted.unionByName(unknown), _now(), labelled), labelled


def h5_plan_truncation(spark, d):
    return _truncation(spark, d)[2]


def h5_truncated_revisions(spark, d):
    r, _, plan, labelled = _truncation(spark, d)
    return H.truncated_revisions(plan, r, labelled).drop("namespace_id")


def h5_moved_heads(spark, d):
    _, n, plan, _ = _truncation(spark, d)
    return H.moved_heads(plan, n).select("namespace_id", "head_revision", "namespace_epoch")


def h6_plan_restore(spark, d):
    heads = revisions(spark, d).groupBy("namespace_id").agg((F.max("id") % 400).alias("head_revision"))
    return H.plan_restore(_ops(spark, d).withColumn("new_head", F.when(F.col("id") % 3 == 0, F.col("new_head"))), heads.withColumn("head_revision", F.when(F.col("namespace_id") % 2 == 0, F.col("head_revision"))), _now())


def h6_restores(spark, d):
    """A request per trash operation: some name another namespace, an operation that is not there, or a stale head or epoch."""
    k = F.col("id")
    ops = _ops(spark, d).withColumn("new_head", F.when(k % 3 == 0, F.col("new_head")))
    heads = revisions(spark, d).groupBy("namespace_id").agg((F.max("id") % 400).alias("head")).select("namespace_id", F.when(F.col("namespace_id") % 2 == 0, F.col("head")).alias("head_revision"), (F.col("namespace_id") % 3).alias("namespace_epoch"))
    asked = ops.select("id", "namespace_id").join(heads, "namespace_id").select(
        F.when(k % 19 == 0, k + 10_000_000).otherwise(k).alias("operation_id"), F.when(k % 17 == 0, -F.col("namespace_id") - 1).otherwise(F.col("namespace_id")).alias("namespace_id"),
        F.when(k % 13 == 0, k).otherwise(F.col("head_revision")).alias("expected_head"), (F.col("namespace_epoch") + F.when(k % 11 == 0, 1).otherwise(0)).alias("expected_epoch"),
    )
    return T.plan_restores(asked, ops, heads)


def h6_restored_store(spark, d):
    """Truncations and then restores of half of them, each published as one version: heads, epochs and trashed revisions that are left."""
    r, n, wanted = _wanted(spark, d)
    root = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    kept = r.select("id", "namespace_id", "parent", "state", F.lit(None).cast("long").alias("trash_operation_id"))
    publish(spark, root, {"revisions": kept, "operations": spark.createDataFrame([], T.HISTORY["operations"]), "namespaces": n.select("namespace_id", "head_revision", "namespace_epoch")})
    done = T.commit_truncations(spark, root, wanted, _now()).filter("outcome = 'planned' AND namespace_id % 2 = 0")
    T.commit_restores(spark, root, done.select("operation_id", "namespace_id", F.col("new_head").alias("expected_head"), F.col("epoch_after").alias("expected_epoch")))
    trashed = read_table(spark, root, "revisions", T.HISTORY["revisions"]).groupBy("namespace_id").agg(F.count("trash_operation_id").alias("trashed"))
    return read_table(spark, root, "namespaces", T.HISTORY["namespaces"]).join(trashed, "namespace_id")


def h17_list_trash(spark, d):
    return H.list_trash(_ops(spark, d)).select("id", "namespace_id", F.col("place").cast("long").alias("place"))


def h17_snapshot_trash(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type")
    return H.list_snapshot_trash(e, e.filter("event_type <> 'view'"), ["user_id"]).select("user_id", "id", F.col("place").cast("long").alias("place"))


def h18_timeline(spark, d):
    """Purchases and errors are remote revisions, all else local snapshots; some have tags."""
    k = F.col("event_id")
    tags = F.when(k % 3 == 0, F.array(F.lit("a"), F.concat(F.lit("t"), k % 5))).when(k % 3 == 1, F.array().cast("array<string>"))
    e = table(spark, d, "events").select(F.col("user_id").alias("home"), k.alias("id"), F.col("ts").alias("created_at"), "event_type", (k % 4 == 0).alias("pinned"), tags.alias("tags"))
    remote = F.col("event_type").isin("purchase", "error")
    return H.version_timeline(e.filter(~remote), e.filter(remote), ["home"]).withColumn("labels", F.array_join("labels", ",")).drop("created_at")


def h19_chain_breaks(spark, d):
    r = revisions(spark, d)
    return H.chain_breaks(r.withColumn("parent", F.when(F.col("id") % 41 == 0, F.col("id") - 1).otherwise(F.col("parent")))).select("id", "namespace_id", "parent")


def commit_log(spark, d, bumps=False):
    """The chain with retries (every 9th request twice), stale heads and wrong epochs; with bumps, another of nine is followed by a bump of the epoch, which all later requests know of."""
    r = revisions(spark, d)
    seq = F.col("seq") * 2
    stale = F.when(F.col("id") % 31 == 0, F.col("parent") - 1).otherwise(F.col("parent"))
    known = F.count_if(F.col("id") % 9 == 5).over(Window.partitionBy("namespace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)) if bumps else F.lit(0)
    base = r.select("namespace_id", seq.alias("seq"), F.col("id").alias("request_id"), "parent", stale.alias("expected_head"), (known + F.when(F.col("id") % 53 == 0, 9).otherwise(0)).cast("long").alias("expected_epoch"), F.lit("commit").alias("action"))
    after = lambda m: base.filter(F.col("request_id") % 9 == m).withColumn("seq", F.col("seq") + 1)
    log = base.unionByName(after(0))
    if not bumps:
        return log
    none = F.lit(None).cast("long")
    return log.unionByName(after(5).withColumns({"parent": none, "expected_head": none, "action": F.lit("bump")}))


def h19_replay(spark, d):
    return H.replay_commits(commit_log(spark, d))


# Sources are revisions, documents threads, their texts contents; equal texts share one manifest.


def _parts(spark, d):
    t = table(spark, d, "documents")
    docs = t.select("source", F.concat(F.lit("t"), "doc_id").alias("thread"), content_id(F.col("text")).alias("content"), "doc_id")
    whole = t.select(F.col("doc_id").alias("id"), F.col("source").alias("snapshot_id"), content_id(F.col("text")).alias("whole"), F.encode("text", "UTF-8").alias("content"))
    return docs, C.chunk(whole, 256).drop("bytes").withColumnRenamed("whole", "content")


def _edges(spark, d):
    docs, c = _parts(spark, d)
    return G.edge_rows(docs.select(F.col("source").alias("root"), "thread"), docs, c)


def _reached(spark, d):
    docs, _ = _parts(spark, d)
    r = docs.select(F.col("source").alias("root")).distinct()
    n = F.regexp_extract("root", r"(\d+)$", 1).cast("int")
    r = r.select("root", F.when(n % 3 == 0, "trashed").otherwise("active").alias("state"), n.alias("trash_operation_id"))
    ops = r.select(F.col("trash_operation_id").alias("id"), F.lit("active").alias("state"), F.when(n % 2 == 0, F.expr("TIMESTAMP_NTZ '2024-02-02 00:00:00'")).otherwise(F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")).alias("expires_at"))
    return G.reachable(G.root_set(r, ops, _now()), _edges(spark, d))


def _objects(spark, d):
    """Every chunk as a stored object, its age by its id."""
    c = chunk_rows(spark, d).groupBy("sha256").agg(F.first("byte_length").alias("byte_length"), F.min("id").alias("id"))
    return c.select(F.lit("chunk").alias("kind"), "sha256", "byte_length", F.when(F.col("id") % 10 == 0, F.expr("TIMESTAMP_NTZ '2024-01-31 23:30:00'")).otherwise(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).alias("created_at"))


def h7_reachable(spark, d):
    return _reached(spark, d)


def h7_reachable_frontier(spark, d):
    roots = table(spark, d, "documents").select(F.lit("revision_root").alias("kind"), F.col("source").alias("sha256"))
    return G.reachable(roots.unionByName(_deep_roots(spark, d)), _edges(spark, d).unionByName(_deep_edges(spark, d)))


def _deep_edges(spark, d):
    """Chains of orders of a customer, each pointing at the next: deeper than any fixed number of joins."""
    o = table(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    e = o.select(before.cast("string").alias("owner_sha256"), F.col("o_orderkey").cast("string").alias("target_sha256")).filter("owner_sha256 IS NOT NULL")
    return e.select(F.lit("order").alias("owner_kind"), "owner_sha256", F.lit("order").alias("target_kind"), "target_sha256")


def _deep_roots(spark, d):
    """Of every customer the third order."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", place.alias("place")).filter("place = 3").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("sha256"))


def h8_gc_plan(spark, d):
    return G.gc_plan(_objects(spark, d), _reached(spark, d), _now()).select("kind", "sha256", "byte_length")


def h8_gc_fingerprint(spark, d):
    return G.gc_fingerprint(h8_gc_plan(spark, d))


def h9_gc_enqueue(spark, d):
    """The plan as it stands against fingerprints that were shown for it, and against those of another plan."""
    plan = rewritten(h8_gc_plan(spark, d), "plan")
    shown = G.gc_fingerprint(plan).select("kind", "fingerprint")
    old = G.gc_fingerprint(plan.withColumn("byte_length", F.col("byte_length") + 1)).select("kind", "fingerprint")
    now = G.gc_enqueue(plan, shown).withColumn("case", F.lit("now"))
    return now.unionByName(G.gc_enqueue(plan, old).withColumn("case", F.lit("old")))


def h9_gc_results(spark, d):
    """Objects that are left after quarantine."""
    objects = rewritten(_objects(spark, d).select("kind", "sha256", "byte_length"), "objects")
    q = rewritten(_queue(objects, _reached(spark, d)), "queue")
    return G.gc_results(q, objects, _edges(spark, d))[0]


def h9_gc_recheck(spark, d):
    return _queue(_objects(spark, d), _reached(spark, d))


def _queue(objects, reached):
    q = objects.select("kind", "sha256", F.when(F.col("byte_length") < 256, "done").otherwise("pending").alias("state"))
    return G.gc_recheck(q, reached)


def h10_missing(spark, d):
    c = chunk_rows(spark, d).select(F.lit("chunk").alias("kind"), "sha256", "byte_length", "snapshot_id", "id")
    have = c.filter("snapshot_id LIKE '%2' OR snapshot_id LIKE '%4'").withColumn("byte_length", F.when(F.col("id") % 6 == 0, -1).otherwise(F.col("byte_length")))
    return G.missing_objects(c.filter("snapshot_id NOT LIKE '%4'"), have)


def h10_over_cap(spark, d):
    return G.over_cap(chunk_rows(spark, d).select(F.lit("chunk").alias("kind"), "sha256", "snapshot_id"), ["snapshot_id"], 400)


def h11_build_edges(spark, d):
    """Short texts are stored whole."""
    docs, c = _parts(spark, d)
    small = table(spark, d, "documents").filter(F.octet_length("text") < 256).select(F.concat(F.lit("t"), "doc_id").alias("thread"), content_id(F.col("text")).alias("sha256"))
    long = docs.join(small.select("thread"), "thread", "left_anti")
    return G.build_edges(docs.select(F.col("source").alias("root"), "thread"), long, c.join(long.select("content").distinct(), "content", "left_semi"), small)


def _refs(spark, d):
    docs, c = _parts(spark, d)
    return c.select("snapshot_id", F.concat(F.lit("t"), "id").alias("thread"), F.lit("chunk").alias("kind"), "sha256", "byte_length")


def h3_revision_stats(spark, d):
    return G.revision_stats(_refs(spark, d).withColumnRenamed("snapshot_id", "revision"))


def h12_list_snapshots(spark, d):
    meta = table(spark, d, "documents").groupBy(F.col("source").alias("snapshot_id")).agg((F.min("doc_id") % 2 == 0).alias("pinned"), F.timestamp_seconds(F.max("doc_id") * 3600).cast("timestamp_ntz").alias("created_at"))
    return G.list_snapshots(_refs(spark, d), meta)


def h13_deletion_plan(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("snapshot_id")).distinct()
    return G.deletion_plan(_refs(spark, d), s.filter("snapshot_id LIKE '%5'"), s.filter("snapshot_id LIKE '%7'"))


def _journals(spark, d):
    """Journals of every kind and of none: by id, some with two kinds of marks, in other cases, without id or status, with null marks, or broken."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    marks = F.element_at(F.create_map(*(F.lit(x) for x in (
        "view", '"backupDir": "/b"', "click", '"targetProvider": "p", "files": []', "signup", '"databaseBackups": null', "purchase", '"targetProvider": "p"', "error", '"importedThreadIds": ["a"]'))), F.col("event_type"))
    two = F.when((k % 11 == 0) & (F.col("event_type") != "signup"), ', "directorySwaps": {}').otherwise("")
    status = F.when(k % 5 == 0, '"status": "Completed", ').when(k % 5 == 1, '"status": "rolled_back", ').when(k % 5 == 2, '"status": "RolledBack", ').when(k % 5 == 3, '"status": "running", ').otherwise("")
    op = F.when(k % 7 != 0, F.concat(F.lit('"operationId": "op'), k, F.lit('", '))).otherwise("")
    body = F.concat(F.lit("{"), op, status, F.lit('"updatedAt": "t'), k * 60, F.lit('", "snapshotId": "src'), k % 20, F.lit('", '), marks, two, F.lit("}"))
    broken = F.when(k % 29 == 0, F.lit("{")).otherwise(body)
    return e.select(F.concat(F.lit("journals/j"), k, F.lit(".json")).alias("path"), "user_id", broken.alias("body"))


def h14_protected_by(spark, d):
    return G.protected_by(_journals(spark, d))


def h15_storage_summary(spark, d):
    c = chunk_rows(spark, d).withColumn("repo", F.pmod("id", F.lit(5))).withColumn("kind", F.lit("chunk"))
    return G.storage_summary(c.filter("id % 7 < 4"), c.filter("id % 7 = 4"), c, ["repo"], c.filter("id % 7 = 5"))


def h15_server_summary(spark, d):
    objects, reached = _objects(spark, d), _reached(spark, d)
    plan = rewritten(G.gc_plan(objects, reached, _now()).select("kind", "sha256", "byte_length"), "plan")
    return G.server_summary(objects, reached, plan, plan.filter("byte_length < 256"))


def h7_local_roots(spark, d):
    """Everything that local snapshots reach: sources are snapshots, some trashed, some known by their revision only."""
    n = F.regexp_extract("sha256", r"(\d+)$", 1).cast("int") % 4
    s = table(spark, d, "documents").select(F.col("source").alias("sha256")).distinct()
    roots = G.local_roots(s.filter(n == 0), s.filter(n == 1), s.filter(n == 2))
    edges = _edges(spark, d)
    snapshots = edges.filter("owner_kind = 'revision_root'").withColumn("owner_kind", F.lit("snapshot_root"))
    return G.reachable(roots, edges.unionByName(snapshots)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def h16_recovery_points(spark, d):
    j = _journals(spark, d)
    return G.ordered_recovery(G.recovery_points(j).join(j.select("path", "user_id"), "path"), ["user_id"]).drop("user_id").withColumn("place", F.col("place").cast("long"))


QUERIES = {f.__name__: f for f in (
    h7_local_roots, h15_server_summary, h1_list_namespaces, h5_truncated_revisions, h5_moved_heads, h9_gc_enqueue, h9_gc_results, h10_over_cap, h17_snapshot_trash, h1_list_revisions, h2_namespace_heads, h3_revision_stats, h4_ancestors, h4_is_ancestor, h4_labels, h5_plan_truncation, h6_plan_restore, h6_restores, h6_restored_store, h7_reachable, h7_reachable_frontier, h8_gc_plan,
    h8_gc_fingerprint, h9_gc_recheck, h10_missing, h11_build_edges, h12_list_snapshots, h13_deletion_plan, h14_protected_by, h15_storage_summary, h16_recovery_points, h17_list_trash,
    h18_timeline, h19_chain_breaks, h19_replay)}

_GRAPH = f"""{CHUNKS_SQL},
  docs AS (SELECT source, 't' || CAST(doc_id AS VARCHAR) AS thread, 'sha256:' || sha256(text) AS content, doc_id FROM documents),
  parts AS (SELECT c.*, content FROM chunks c JOIN docs ON id = doc_id),
  edges AS (
    SELECT 'revision_root' AS owner_kind, source AS owner_sha256, 'thread' AS target_kind, thread AS target_sha256 FROM docs
    UNION SELECT 'thread', thread, 'chunk_manifest', content FROM docs UNION SELECT 'chunk_manifest', content, 'chunk', sha256 FROM parts),
  live AS (SELECT DISTINCT source FROM docs WHERE CAST(substr(source, 4) AS INT) % 3 <> 0 OR CAST(substr(source, 4) AS INT) % 2 = 0),
  ld AS (SELECT docs.* FROM docs JOIN live USING (source)),
  reached AS (SELECT 'revision_root' AS kind, source AS sha256 FROM live UNION SELECT 'thread', thread FROM ld UNION SELECT 'chunk_manifest', content FROM ld
              UNION SELECT 'chunk', p.sha256 FROM parts p WHERE content IN (SELECT content FROM ld)),
  objects AS (SELECT 'chunk' AS kind, sha256, any_value(byte_length) AS byte_length, CASE WHEN min(id) % 10 = 0 THEN TIMESTAMP '2024-01-31 23:30:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at FROM chunks GROUP BY sha256),
  plan AS (SELECT kind, sha256, byte_length FROM objects WHERE created_at < {NOW} - INTERVAL 1 HOUR AND sha256 NOT IN (SELECT sha256 FROM reached))"""
_OPS = f"""{REVISIONS_SQL}, ops AS (SELECT id, namespace_id, CASE WHEN id % 2 = 0 THEN 'active' ELSE 'restored' END AS state, id AS old_head, id % 400 AS new_head, created_at, created_at + INTERVAL 20 DAYS AS expires_at
  FROM revisions)"""
_JOURNALS = """j AS (SELECT 'journals/j' || CAST(event_id AS VARCHAR) || '.json' AS path, user_id, event_id AS k, event_id % 29 = 0 AS broken, CASE WHEN event_id % 7 <> 0 THEN 'op' || CAST(event_id AS VARCHAR) END AS op,
    CASE event_id % 5 WHEN 0 THEN 'Completed' WHEN 1 THEN 'rolled_back' WHEN 2 THEN 'RolledBack' WHEN 3 THEN 'running' END AS status, event_id % 5 > 2 AS open, 't' || CAST(event_id * 60 AS VARCHAR) AS upd, 'src' || CAST(event_id % 20 AS VARCHAR) AS snap,
    event_type = 'click' AS prov, event_type IN ('view', 'error') AS imp, event_type = 'signup' OR event_id % 11 = 0 AS chk FROM events)"""
_WALK = f"""WITH RECURSIVE {TREE_SQL}, walk AS (SELECT id, namespace_id, id AS node, 0 AS steps FROM tree UNION ALL SELECT w.id, w.namespace_id, p.id, steps + 1 FROM walk w JOIN tree t ON t.id = w.node JOIN tree p ON p.id = t.parent AND p.namespace_id = w.namespace_id)"""
_TRUNCATION = f"""WITH RECURSIVE {TREE_SQL}, {NAMESPACES_SQL}, heads AS (SELECT namespace_id, namespace_epoch, arg_max(t.id, t.seq) FILTER (state = 'active') AS head_revision FROM namespaces JOIN tree t USING (namespace_id) GROUP BY 1, 2),
  w AS (SELECT t.namespace_id + 1000 AS operation_id, t.namespace_id, CASE WHEN t.namespace_id % 13 = 5 THEN t.id ELSE n.head_revision END AS expected_head, namespace_epoch + CASE WHEN t.namespace_id % 17 = 6 THEN 1 ELSE 0 END AS expected_epoch, head_revision AS old_head, namespace_epoch,
    CASE WHEN t.namespace_id % 7 = 1 THEN head_revision WHEN t.namespace_id % 7 = 2 THEN t.id + 1 WHEN t.namespace_id % 7 <> 3 THEN t.id END AS new_head FROM tree t JOIN heads n USING (namespace_id) WHERE seq = 6),
  live AS (SELECT * FROM tree WHERE state = 'active'),
  live_walk AS (SELECT id, namespace_id, id AS node, 0 AS steps FROM live WHERE id IN (SELECT old_head FROM w) UNION ALL SELECT w.id, w.namespace_id, p.id, steps + 1 FROM live_walk w JOIN live t ON t.id = w.node JOIN live p ON p.id = t.parent AND p.namespace_id = w.namespace_id),
  hits AS (SELECT w.*, (SELECT steps FROM live_walk x WHERE x.id = old_head AND x.node = new_head) AS found, (SELECT max(steps) + 1 FROM live_walk x JOIN live l ON l.id = x.node WHERE x.id = old_head AND l.parent IS NULL) AS all_of_it FROM w),
  plan AS (SELECT *, CASE WHEN old_head IS DISTINCT FROM expected_head THEN 'head_mismatch' WHEN namespace_epoch <> expected_epoch THEN 'epoch_mismatch' WHEN new_head IS NOT DISTINCT FROM old_head OR (new_head IS NULL AND all_of_it IS NULL) OR (new_head IS NOT NULL AND found IS NULL) THEN 'conflict' ELSE 'planned' END AS outcome,
    CASE WHEN outcome = 'planned' THEN CASE WHEN new_head IS NULL THEN all_of_it ELSE found END END AS revision_count FROM hits)"""
ORACLE_SQL = {
    "h1_list_revisions": f"""WITH {REVISIONS_SQL} SELECT namespace_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY namespace_id ORDER BY created_at DESC, id DESC) AS place FROM revisions WHERE state = 'active') WHERE place <= 5""",
    "h1_list_namespaces": f"WITH {NAMESPACES_SQL} SELECT * FROM namespaces",
    "h2_namespace_heads": f"""WITH {REVISIONS_SQL}, {NAMESPACES_SQL}, a AS (SELECT namespace_id, arg_max(id, seq) AS head_revision, count(*) AS revisions FROM revisions WHERE state = 'active' GROUP BY 1)
        SELECT namespace_id, namespace_epoch, a.head_revision, coalesce(revisions, 0) AS revisions FROM namespaces LEFT JOIN a USING (namespace_id)""",
    "h3_revision_stats": f"""WITH {CHUNKS_SQL}, o AS (SELECT snapshot_id AS revision, sha256, any_value(byte_length) AS n FROM chunks GROUP BY 1, 2)
        SELECT revision, count(*) AS object_count, CAST(sum(n) AS BIGINT) AS total_bytes, (SELECT count(DISTINCT id) FROM chunks WHERE snapshot_id = revision) AS thread_count FROM o GROUP BY revision""",
    "h4_ancestors": f"""{_WALK} SELECT w.id, w.namespace_id, max(steps) AS depth, arg_max(node, steps) AS root, (SELECT parent IS NOT NULL FROM tree t WHERE t.id = arg_max(w.node, w.steps)) AS broken FROM walk w GROUP BY w.id, w.namespace_id""",
    "h4_is_ancestor": f"""{_WALK}, pairs AS (SELECT coalesce(lag(id, 5) OVER (PARTITION BY namespace_id ORDER BY seq), id) AS a, id FROM tree UNION SELECT greatest(id - (id * 7) % 150 - 1, 0), id FROM tree)
        SELECT a AS ancestor, id, EXISTS (SELECT 1 FROM walk w WHERE w.id = p.id AND w.node = p.a) AS is_ancestor FROM pairs p""",
    "h4_labels": f"{_WALK} SELECT namespace_id, count(*) AS pairs FROM walk GROUP BY 1",
    "h5_plan_truncation": f"{_TRUNCATION} SELECT operation_id, namespace_id, old_head, new_head, outcome, revision_count, namespace_epoch AS epoch_before, namespace_epoch + CASE WHEN outcome = 'planned' THEN 1 ELSE 0 END AS epoch_after, CASE WHEN outcome = 'planned' THEN {NOW} + INTERVAL 30 DAYS END AS expires_at FROM plan UNION ALL SELECT namespace_id + 2000000, -namespace_id - 1, NULL, new_head, 'not_found', NULL, NULL, NULL, NULL FROM w WHERE namespace_id % 5 = 0",
    "h5_truncated_revisions": f"{_TRUNCATION} SELECT node AS id, operation_id FROM plan JOIN live_walk w ON w.id = old_head WHERE outcome = 'planned' AND steps < revision_count",
    "h5_moved_heads": f"{_TRUNCATION} SELECT n.namespace_id, CASE WHEN outcome = 'planned' THEN new_head ELSE n.head_revision END AS head_revision, n.namespace_epoch + CASE WHEN outcome = 'planned' THEN 1 ELSE 0 END AS namespace_epoch FROM heads n LEFT JOIN plan p USING (namespace_id)",
    "h6_plan_restore": f"""WITH {_OPS}, h AS (SELECT namespace_id, CASE WHEN namespace_id % 2 = 0 THEN max(id) % 400 END AS head FROM revisions GROUP BY 1),
        r AS (SELECT o.*, head, state = 'active' AND (CASE WHEN id % 3 = 0 THEN new_head END) IS NOT DISTINCT FROM head AS can FROM ops o LEFT JOIN h USING (namespace_id))
        SELECT id, namespace_id, can AS restorable, CASE WHEN can THEN old_head ELSE head END AS head_after, expires_at <= {NOW} AS expired FROM r""",
    "h6_restores": f"""WITH {_OPS}, h AS (SELECT namespace_id, CASE WHEN namespace_id % 2 = 0 THEN max(id) % 400 END AS head, namespace_id % 3 AS epoch FROM revisions GROUP BY 1),
        a AS (SELECT id AS k, CASE WHEN id % 19 = 0 THEN id + 10000000 ELSE id END AS op, CASE WHEN id % 17 = 0 THEN -namespace_id - 1 ELSE namespace_id END AS ns, CASE WHEN id % 13 = 0 THEN id ELSE head END AS expected, epoch + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS expected_epoch FROM ops JOIN h USING (namespace_id)),
        c AS (SELECT a.*, h.head, h.epoch, o.old_head, CASE WHEN h.namespace_id IS NULL THEN 'no_namespace' WHEN h.head IS DISTINCT FROM expected THEN 'head_mismatch' WHEN h.epoch <> expected_epoch THEN 'epoch_mismatch' WHEN o.id IS NULL THEN 'no_operation'
            WHEN o.state <> 'active' OR (CASE WHEN o.id % 3 = 0 THEN o.new_head END) IS DISTINCT FROM h.head THEN 'conflict' ELSE 'restored' END AS can FROM a LEFT JOIN h ON h.namespace_id = ns LEFT JOIN ops o ON o.id = op AND o.namespace_id = ns),
        d AS (SELECT *, CASE WHEN can = 'restored' AND row_number() OVER (PARTITION BY ns, can ORDER BY op) > 1 THEN 'repeated' ELSE can END AS outcome FROM c)
        SELECT op AS operation_id, ns AS namespace_id, outcome, CASE WHEN outcome = 'restored' THEN old_head ELSE head END AS head_after, epoch + CASE WHEN outcome = 'restored' THEN 1 ELSE 0 END AS epoch_after FROM d""",
    "h6_restored_store": f"""{_TRUNCATION}, done AS (SELECT * FROM plan WHERE outcome = 'planned')
        SELECT n.namespace_id, CASE WHEN d.namespace_id % 2 = 1 THEN d.new_head ELSE n.head_revision END AS head_revision, n.namespace_epoch + CASE WHEN d.namespace_id IS NULL THEN 0 WHEN d.namespace_id % 2 = 1 THEN 1 ELSE 2 END AS namespace_epoch,
          CASE WHEN d.namespace_id % 2 = 1 THEN revision_count ELSE 0 END AS trashed FROM heads n LEFT JOIN done d USING (namespace_id)""",
    "h7_reachable": f"WITH {_GRAPH} SELECT kind, sha256 FROM reached",
    "h7_reachable_frontier": f"""WITH {_GRAPH}, o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
        SELECT 'revision_root' AS kind, source AS sha256 FROM docs UNION SELECT 'thread', thread FROM docs UNION SELECT 'chunk_manifest', content FROM docs UNION SELECT 'chunk', sha256 FROM parts UNION SELECT 'order', k FROM o WHERE place >= 3""",
    "h8_gc_plan": f"WITH {_GRAPH} SELECT * FROM plan",
    "h8_gc_fingerprint": f"""WITH {_GRAPH}, l AS (SELECT kind, sha256 || ':' || CAST(byte_length AS VARCHAR) AS t, byte_length FROM plan), {LISTED_SQL.format(by='kind')}
        SELECT kind, fingerprint, n AS objects, (SELECT CAST(sum(byte_length) AS BIGINT) FROM l x WHERE x.kind = listed.kind) AS bytes FROM listed""",
    "h9_gc_enqueue": f"WITH {_GRAPH} SELECT kind, sha256, byte_length, 'pending' AS state, 'now' AS case FROM plan UNION ALL SELECT kind, sha256, byte_length, 'stale', 'old' FROM plan".replace(" AS case", ' AS "case"'),
    "h9_gc_results": f"WITH {_GRAPH} SELECT kind, sha256, byte_length FROM objects WHERE byte_length < 256 OR sha256 IN (SELECT sha256 FROM reached)",
    "h9_gc_recheck": f"WITH {_GRAPH} SELECT kind, sha256, CASE WHEN byte_length < 256 THEN 'done' WHEN sha256 IN (SELECT sha256 FROM reached) THEN 'cancelled' ELSE 'quarantined' END AS state FROM objects",
    "h10_missing": f"""WITH {CHUNKS_SQL}, w AS (SELECT sha256, min(byte_length) AS n FROM chunks WHERE snapshot_id NOT LIKE '%4' GROUP BY 1),
        h AS (SELECT sha256, min(CASE WHEN id % 6 = 0 THEN -1 ELSE byte_length END) AS m FROM chunks WHERE snapshot_id LIKE '%2' OR snapshot_id LIKE '%4' GROUP BY 1)
        SELECT 'chunk' AS kind, w.sha256, n AS byte_length, CASE WHEN m IS NULL THEN 'missing' ELSE 'length' END AS problem FROM w LEFT JOIN h ON w.sha256 = h.sha256 WHERE m IS NULL OR m <> n""",
    "h10_over_cap": f"WITH {CHUNKS_SQL} SELECT snapshot_id, 'chunk' AS kind, count(DISTINCT sha256) AS objects FROM chunks GROUP BY 1 HAVING count(DISTINCT sha256) > 400",
    "h11_build_edges": f"""WITH {_GRAPH}, sized AS (SELECT docs.*, octet_length(encode(text)) < 256 AS small FROM docs JOIN documents USING (doc_id))
        SELECT 'revision_root' AS owner_kind, source AS owner_sha256, 'thread' AS target_kind, thread AS target_sha256 FROM docs UNION SELECT 'thread', thread, CASE WHEN small THEN 'whole' ELSE 'chunk_manifest' END, content FROM sized
        UNION SELECT 'chunk_manifest', content, 'chunk', sha256 FROM parts WHERE content IN (SELECT content FROM sized WHERE NOT small)""",
    "h12_list_snapshots": f"""WITH {CHUNKS_SQL}, o AS (SELECT snapshot_id, sha256, count(*) AS r, any_value(byte_length) AS n FROM chunks GROUP BY 1, 2), m AS (SELECT source AS snapshot_id, min(doc_id) % 2 = 0 AS pinned, make_timestamp(max(doc_id) * 3600000000) AS created_at FROM documents GROUP BY 1),
        s AS (SELECT snapshot_id, count(*) + 1 AS object_count, CAST(sum(n) AS BIGINT) AS physical_bytes, CAST(sum(n * r) AS BIGINT) AS logical_bytes FROM o GROUP BY 1), t AS (SELECT snapshot_id, count(DISTINCT id) AS thread_count FROM chunks GROUP BY 1)
        SELECT * FROM s JOIN t USING (snapshot_id) JOIN m USING (snapshot_id)""",
    "h13_deletion_plan": f"""WITH {CHUNKS_SQL}, p AS (SELECT DISTINCT snapshot_id, sha256, byte_length FROM chunks), o AS (SELECT *, count(*) OVER (PARTITION BY sha256) = 1 AS own FROM p),
        l AS (SELECT snapshot_id, 'chunk:' || sha256 || ':' || CAST(own AS VARCHAR) AS t FROM o), {LISTED_SQL.format(by='snapshot_id')},
        s AS (SELECT snapshot_id, count(*) FILTER (NOT own) AS shared_objects, count(*) FILTER (own) AS exclusive_objects, CAST(coalesce(sum(byte_length) FILTER (own), 0) AS BIGINT) AS exclusive_bytes,
          snapshot_id LIKE '%5' AS pinned, snapshot_id LIKE '%7' AS guarded FROM o GROUP BY snapshot_id)
        SELECT s.*, NOT (pinned OR guarded) AS eligible, 'sha256:' || sha256(concat_ws(chr(10), snapshot_id, CAST(pinned AS VARCHAR), CAST(guarded AS VARCHAR), fingerprint)) AS fingerprint FROM s JOIN listed USING (snapshot_id)""",
    "h14_protected_by": f"WITH {_JOURNALS} SELECT snap AS snapshot_id, string_agg(DISTINCT coalesce(op, path), ',' ORDER BY coalesce(op, path)) AS operations FROM j WHERE NOT broken AND open GROUP BY snap",
    "h15_storage_summary": f"""WITH {CHUNKS_SQL}, c AS (SELECT *, id % 5 AS repo FROM chunks), l AS (SELECT repo, sha256, count(*) AS uses, count(DISTINCT snapshot_id) AS holders FROM c WHERE id % 7 < 4 GROUP BY 1, 2),
        t AS (SELECT DISTINCT repo, sha256, true AS trashed FROM c WHERE id % 7 = 4), o AS (SELECT repo, sha256, any_value(byte_length) AS n FROM c GROUP BY 1, 2)
        SELECT repo, CAST(coalesce(sum(n * uses), 0) AS BIGINT) AS logical_bytes, CAST(sum(n) AS BIGINT) AS physical_bytes, CAST(coalesce(sum(n) FILTER (holders IS NOT NULL), 0) AS BIGINT) AS active_bytes,
          CAST(coalesce(sum(n) FILTER (holders > 1), 0) AS BIGINT) AS shared_bytes, CAST(coalesce(sum(n) FILTER (holders = 1), 0) AS BIGINT) AS exclusive_bytes,
          CAST(coalesce(sum(n) FILTER (holders IS NULL AND trashed), 0) AS BIGINT) AS trash_only_bytes, CAST(coalesce(sum(n) FILTER (holders IS NULL AND trashed IS NULL), 0) AS BIGINT) AS reclaimable_bytes,
          (SELECT CAST(coalesce(sum(byte_length), 0) AS BIGINT) FROM c WHERE id % 7 = 5 AND c.repo = o.repo) AS quarantine_bytes
        FROM o LEFT JOIN l USING (repo, sha256) LEFT JOIN t USING (repo, sha256) GROUP BY repo""",
    "h7_local_roots": f"""WITH {_GRAPH}, r AS (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) % 4 AS n FROM docs), l AS (SELECT * FROM docs WHERE CAST(substr(source, 4) AS INT) % 4 < 3)
        SELECT 'snapshot_root' AS kind, count(*) AS n FROM r WHERE n < 2 HAVING count(*) > 0 UNION ALL SELECT 'revision_root', count(*) FROM r WHERE n = 2 HAVING count(*) > 0 UNION ALL SELECT 'thread', count(*) FROM l HAVING count(*) > 0
        UNION ALL SELECT 'chunk_manifest', count(DISTINCT content) FROM l HAVING count(*) > 0 UNION ALL SELECT 'chunk', count(DISTINCT sha256) FROM parts WHERE content IN (SELECT content FROM l) HAVING count(*) > 0""",
    "h15_server_summary": f"""WITH {_GRAPH}, s AS (SELECT kind, sum(byte_length) AS physical FROM objects GROUP BY 1), l AS (SELECT kind, count(*) AS n FROM reached GROUP BY 1),
        p AS (SELECT kind, count(*) AS n, sum(byte_length) AS b, coalesce(sum(byte_length) FILTER (byte_length < 256), 0) AS q FROM plan GROUP BY 1)
        SELECT kind, CAST(coalesce(physical, 0) AS BIGINT) AS physical_bytes, coalesce(l.n, 0) AS reachable_objects, coalesce(p.n, 0) AS reclaimable_objects, CAST(coalesce(b, 0) AS BIGINT) AS reclaimable_bytes, CAST(coalesce(q, 0) AS BIGINT) AS quarantine_bytes,
          coalesce(l.n, 0) + coalesce(p.n, 0) AS object_count, CAST(greatest(coalesce(physical, 0) - coalesce(b, 0), 0) AS BIGINT) AS reachable_bytes FROM s FULL JOIN l USING (kind) FULL JOIN p USING (kind)""",
    "h16_recovery_points": f"""WITH {_JOURNALS}, k AS (SELECT *, [CASE WHEN prov THEN 'provider_sync' END, CASE WHEN imp THEN 'import' END, CASE WHEN chk THEN 'checkout' END] AS fits FROM j WHERE NOT broken),
        r AS (SELECT path, user_id, coalesce(op, 'j' || CAST(k AS VARCHAR)) AS operation_id, coalesce(fits[1], fits[2], fits[3]) AS kind, CAST(prov AS INT) + CAST(imp AS INT) + CAST(chk AS INT) > 1 AS ambiguous, coalesce(status, 'unknown') AS status, open AS attention, upd AS updated_at FROM k)
        SELECT * EXCLUDE (user_id), row_number() OVER (PARTITION BY user_id ORDER BY attention DESC, updated_at DESC, operation_id DESC) AS place FROM r WHERE kind IS NOT NULL""",
    "h17_list_trash": f"WITH {_OPS} SELECT id, namespace_id, row_number() OVER (PARTITION BY namespace_id ORDER BY created_at DESC, id DESC) AS place FROM ops",
    "h17_snapshot_trash": "SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type <> 'view'",
    "h18_timeline": """WITH e AS (SELECT *, event_id AS k, event_type IN ('purchase', 'error') AS remote, row_number() OVER (PARTITION BY user_id, event_type IN ('purchase', 'error') ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        SELECT user_id AS home, k AS id, 'local' AS origin, CASE WHEN k % 4 = 0 THEN 'PINNED' ELSE 'SNAPSHOT' END || CASE WHEN k % 3 = 0 THEN ',a,t' || CAST(k % 5 AS VARCHAR) ELSE '' END AS labels FROM e WHERE NOT remote AND rn <= 3
        UNION ALL SELECT user_id, k, 'remote', CASE WHEN rn = 1 THEN 'HEAD' ELSE '' END FROM e WHERE remote""",
    "h19_replay": f"""WITH RECURSIVE {REVISIONS_SQL},
        base AS (SELECT namespace_id AS ns, seq * 2 AS seq, id, parent, CASE WHEN id % 31 = 0 THEN parent - 1 ELSE parent END AS expected, CASE WHEN id % 53 = 0 THEN 9 ELSE 0 END AS e FROM revisions),
        log AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY seq) AS rn FROM (SELECT * FROM base UNION ALL SELECT ns, seq + 1, id, parent, expected, e FROM base WHERE id % 9 = 0)),
        s AS (SELECT ns, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS head, CAST(NULL AS BIGINT) AS up, CAST([] AS BIGINT[]) AS known, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT ns FROM log)
          UNION ALL SELECT ns, rn, seq, id, CASE WHEN outcome = 'created' THEN id ELSE head END, CASE WHEN outcome = 'created' THEN parent ELSE up END, CASE WHEN outcome = 'created' THEN list_append(known, id) ELSE known END, outcome
          FROM (SELECT l.*, head, up, known, CASE WHEN e <> 0 THEN 'wrong_epoch' WHEN l.id = head AND l.parent IS NOT DISTINCT FROM up THEN 'already_committed' WHEN list_contains(known, l.id) THEN 'conflict'
            WHEN head IS DISTINCT FROM expected THEN 'head_mismatch' WHEN l.parent IS DISTINCT FROM expected THEN 'conflict' ELSE 'created' END AS outcome FROM s JOIN log l ON l.ns = s.ns AND l.rn = s.rn + 1))
        SELECT ns AS namespace_id, seq, id AS request_id, outcome, CAST(0 AS BIGINT) AS epoch FROM s WHERE rn > 0""",
    "h19_chain_breaks": f"WITH {REVISIONS_SQL} SELECT id, namespace_id, id - 1 AS parent FROM revisions WHERE id % 41 = 0 AND parent IS DISTINCT FROM id - 1",
}
