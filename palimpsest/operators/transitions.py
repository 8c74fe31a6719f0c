"""Changes of several tables at once: truncation, restore and quarantine, each computed as a whole and published as one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.versioned import current, publish, read_table
from .graph import gc_recheck, gc_results
from .history import moved_heads, plan_truncation, trash_rows, truncated_revisions


def plan_restores(requests: DataFrame, ops: DataFrame, namespaces: DataFrame) -> DataFrame:
    """What each request to restore a trash operation would do: operation_id, namespace_id, outcome, head_after, epoch_after.

    requests: operation_id, namespace_id, expected_head, expected_epoch; ops: id, namespace_id, old_head, new_head, state;
    namespaces: namespace_id, head_revision, namespace_epoch. In this order: no_namespace, head_mismatch, epoch_mismatch,
    no_operation (in that namespace), conflict (it is not active, or the head is not the one it left), repeated (an earlier request of this
    set restores in the namespace) or restored: then the head is the operation's old one and the epoch is one higher.
    """
    n = namespaces.select("namespace_id", "head_revision", "namespace_epoch", F.lit(True).alias("there"))
    o = ops.select(F.col("id").alias("operation_id"), "namespace_id", "old_head", "new_head", "state")
    rows = requests.select("operation_id", "namespace_id", "expected_head", "expected_epoch").join(n, "namespace_id", "left").join(o, ["operation_id", "namespace_id"], "left")
    can = (
        F.when(F.col("there").isNull(), "no_namespace")
        .when(~F.col("head_revision").eqNullSafe(F.col("expected_head")), "head_mismatch")
        .when(F.col("namespace_epoch") != F.col("expected_epoch"), "epoch_mismatch")
        .when(F.col("state").isNull(), "no_operation")
        .when((F.col("state") != "active") | ~F.col("new_head").eqNullSafe(F.col("head_revision")), "conflict")
        .otherwise("restored")
    )
    first = F.row_number().over(Window.partitionBy("namespace_id", "can").orderBy("operation_id")) > 1
    rows = rows.withColumn("can", can).withColumn("outcome", F.when((F.col("can") == "restored") & first, "repeated").otherwise(F.col("can")))
    ok = F.col("outcome") == "restored"
    return rows.select("operation_id", "namespace_id", "outcome", F.when(ok, F.col("old_head")).otherwise(F.col("head_revision")).alias("head_after"), (F.col("namespace_epoch") + ok.cast("int")).alias("epoch_after"))


def restored(plan: DataFrame, revisions: DataFrame, ops: DataFrame, namespaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """revisions, ops and namespaces after the planned restores: trashed revisions are active again, operations restored, heads and epochs moved."""
    done = plan.filter("outcome = 'restored'")
    back = done.select(F.col("operation_id").alias("trash_operation_id"), F.lit(True).alias("back"))
    r = revisions.join(back, "trash_operation_id", "left")
    r = r.withColumn("state", F.when(F.col("back"), "active").otherwise(F.col("state"))).withColumn("trash_operation_id", F.when(F.col("back").isNull(), F.col("trash_operation_id")))
    o = ops.join(done.select(F.col("operation_id").alias("id"), F.lit(True).alias("back")), "id", "left").withColumn("state", F.when(F.col("back"), "restored").otherwise(F.col("state")))
    n = namespaces.join(done.select("namespace_id", "head_after", "epoch_after"), "namespace_id", "left")
    moved = F.col("epoch_after").isNotNull()
    n = n.withColumn("head_revision", F.when(moved, F.col("head_after")).otherwise(F.col("head_revision"))).withColumn("namespace_epoch", F.coalesce("epoch_after", "namespace_epoch"))
    return r.select(*revisions.columns), o.select(*ops.columns), n.select(*namespaces.columns)


def truncated(plan: DataFrame, revisions: DataFrame, ops: DataFrame, namespaces: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """revisions, ops and namespaces after the planned truncations (one per namespace)."""
    gone = truncated_revisions(plan, revisions).select("id", "namespace_id", "operation_id")
    r = revisions.join(gone, ["id", "namespace_id"], "left")
    trashed = F.col("operation_id").isNotNull()
    r = r.withColumn("state", F.when(trashed, "trashed").otherwise(F.col("state"))).withColumn("trash_operation_id", F.coalesce("operation_id", "trash_operation_id"))
    o = ops.unionByName(trash_rows(plan, now).select(*ops.columns))
    return r.select(*revisions.columns), o, moved_heads(plan, namespaces).select(*namespaces.columns)


def _tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> tuple[int, list[DataFrame]]:
    version = current(spark, root)[0]
    return version, [read_table(spark, root, name, schema, version) for name, schema in schemas.items()]


#: Tables of a server's history, as a versioned store keeps them.
HISTORY = {
    "revisions": "id long, namespace_id long, parent long, state string, trash_operation_id long",
    "operations": "id long, namespace_id long, old_head long, new_head long, epoch_before long, epoch_after long, expires_at timestamp_ntz, revision_count long, created_at timestamp_ntz, state string",
    "namespaces": "namespace_id long, head_revision long, namespace_epoch long",
}
#: Tables of a clean-up, and what its outcome is read from.
CLEANUP = {
    "objects": "kind string, sha256 string, byte_length long",
    "edges": "owner_kind string, owner_sha256 string, target_kind string, target_sha256 string",
    "queue": "kind string, sha256 string, state string",
}


def commit_truncations(spark: SparkSession, root: str, wanted: DataFrame, now: Column) -> DataFrame:
    """Carry out the requests against the newest version and publish revisions, operations and heads together; the outcome of each."""
    version, (r, o, n) = _tables(spark, root, HISTORY)
    plan = plan_truncation(r, n, wanted, now)
    after = truncated(plan, r, o, n, now)
    number = publish(spark, root, dict(zip(HISTORY, after)) | {"outcomes": plan}, expected=version)
    return read_table(spark, root, "outcomes", plan.schema, number)


def commit_restores(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """The same for restores; see plan_restores."""
    version, (r, o, n) = _tables(spark, root, HISTORY)
    plan = plan_restores(requests, o, n)
    number = publish(spark, root, dict(zip(HISTORY, restored(plan, r, o, n))) | {"outcomes": plan}, expected=version)
    return read_table(spark, root, "outcomes", plan.schema, number)


def commit_quarantine(spark: SparkSession, root: str, reached: DataFrame) -> DataFrame:
    """Check the queue again, take what is quarantined out of objects and edges, and publish the three together; the queue."""
    version, (objects, edges, queue) = _tables(spark, root, CLEANUP)
    checked = gc_recheck(queue, reached).select(*queue.columns)
    objects, edges = gc_results(checked, objects, edges)
    number = publish(spark, root, {"objects": objects, "edges": edges, "queue": checked}, expected=version)
    return read_table(spark, root, "queue", CLEANUP["queue"], number)
