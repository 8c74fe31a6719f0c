"""Diff, three-way merge, conflicts and plans over sets of threads.

A set of threads is a table with `thread_id` and `hash`, the semantic hash; a null hash is a
value like any other, and presence is always a flag of its own.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import content_id, is_sha256_id
from ..sources.scratch import rewritten
from .chains import SPAN, as_of
from .history import TASK_ROWS, taken_steps


def _outer(sides: dict[str, DataFrame], columns: list[str], keys: list[str]) -> DataFrame:
    """A full join of the sides; keys that are null on both meet."""
    out = None
    for name, df in sides.items():
        side = df.select(*(F.col(k).alias(f"__{name}_{k}") for k in keys), F.lit(True).alias(f"in_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
        if out is None:
            out = side.select(*(F.col(f"__{name}_{k}").alias(f"__{k}") for k in keys), *(c for c in side.columns if not c.startswith("__")))
            continue
        same = reduce(and_, (F.col(f"__{k}").eqNullSafe(F.col(f"__{name}_{k}")) for k in keys))
        both = out.join(side, same, "full")
        out = both.select(*(F.coalesce(f"__{k}", f"__{name}_{k}").alias(f"__{k}") for k in keys), *(c for c in both.columns if not c.startswith("__")))
    return out.select(*(F.col(f"__{k}").alias(k) for k in keys), *(F.coalesce(f"in_{n}", F.lit(False)).alias(f"in_{n}") for n in sides), *(f"{n}_{c}" for n in sides for c in columns))


def snapshot_diff(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each thread of either side as added, deleted, modified or unchanged; the right side's title, else the left's."""
    keys = keys or ["thread_id"]
    both = _outer({"left": left, "right": right}, ["hash", "title"], keys)
    status = (
        F.when(~F.col("in_left"), "added")
        .when(~F.col("in_right"), "deleted")
        .when(F.col("left_hash").eqNullSafe(F.col("right_hash")), "unchanged")
        .otherwise("modified")
    )
    return both.select(*keys, status.alias("status"), F.when(F.col("in_right"), F.col("right_title")).otherwise(F.col("left_title")).alias("title"))


def diff_summary(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    kinds = ("added", "deleted", "modified", "unchanged")
    return diff.groupBy(*(by or [])).agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds))


def merge3(base: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per thread the side that wins (null: absent in the result) or the kind of its conflict.

    keys: thread_id, after the columns of the merge it belongs to where there are several.

    A side has changed if it differs from the base in presence or hash. Neither: local, else
    remote; one: that side, whose absence deletes; both alike: local; else a conflict.
    """
    m = _outer({"base": base, "local": local, "remote": remote}, ["hash", "title"], keys or ["thread_id"])

    def same(a: str, b: str) -> Column:
        return (F.col(f"in_{a}") == F.col(f"in_{b}")) & (~F.col(f"in_{a}") | F.col(f"{a}_hash").eqNullSafe(F.col(f"{b}_hash")))

    present = lambda side: F.when(F.col(f"in_{side}"), F.lit(side))
    local_same, remote_same = same("base", "local"), same("base", "remote")
    conflict = (
        F.when(local_same | remote_same | same("local", "remote"), F.lit(None).cast("string"))
        .when(~F.col("in_local"), "local_deleted_remote_modified")
        .when(~F.col("in_remote"), "remote_deleted_local_modified")
        .otherwise("both_modified")
    )
    side = (
        F.when(conflict.isNotNull(), F.lit(None).cast("string"))
        .when(local_same & remote_same, F.coalesce(present("local"), present("remote")))
        .when(local_same, present("remote"))
        .otherwise(present("local"))
    )
    title = F.coalesce("local_title", "remote_title", "base_title")
    return m.select("*", side.alias("side"), conflict.alias("conflict_kind"), title.alias("title"))


def duplicate_ids(threads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Violations: ids that occur more than once in a set."""
    keys = keys or ["thread_id"]
    return threads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conflict_ids(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The conflicts with an id that changes when any version of the thread changes."""
    parts = ["thread_id", "conflict_kind", "base_hash", "local_hash", "remote_hash"]
    text = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in parts))
    return merged.filter("conflict_kind IS NOT NULL").select(*(by or []), "thread_id", "title", "conflict_kind", "in_local", "in_remote", content_id(text).alias("conflict_id"))


def resolution_problems(conflicts: DataFrame, resolutions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows that reject a merge's resolutions: missing, extra, duplicate, stale id, unknown choice.

    by: the columns that name a merge, where there are several.
    """
    keys = [*(by or []), "thread_id"]
    given = resolutions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("conflict_id").alias("given_id"), F.max("choice").alias("choice"))
    both = conflicts.select(*keys, "conflict_id").join(given, keys, "full")
    problem = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("conflict_id").isNull(), "extra")
        .when(F.col("n") > 1, "duplicate")
        .when(~F.col("conflict_id").eqNullSafe(F.col("given_id")), "stale")
        .when(~F.coalesce(F.col("choice").isin("local", "remote"), F.lit(False)), "unknown_choice")
    )
    return both.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def resolve(merged: DataFrame, resolutions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """thread_id, side, hash of each merged set after the choices; a chosen absent side deletes.

    resolutions: by.., thread_id, conflict_id, choice. A merge (one per group of `by`, else all is one) with any
    problem is rejected as a whole: it gives no rows here, and its problems by resolution_problems.
    """
    keys = [*(by or []), "thread_id"]
    problems = resolution_problems(conflict_ids(merged, by), resolutions, by)
    if by:
        sound = merged.join(problems.select(*by).distinct(), by, "left_anti")
    else:
        sound = merged.join(problems.agg((F.count(F.lit(1)) > 0).alias("rejected")), ~F.col("rejected"), "left_semi")  # one row
    joined = sound.join(resolutions.select(*keys, "choice"), keys, "left")
    side = F.when(F.col("conflict_kind").isNull(), F.col("side")).otherwise(
        F.when((F.col("choice") == "local") & F.col("in_local"), "local").when((F.col("choice") == "remote") & F.col("in_remote"), "remote")
    )
    picked = joined.withColumn("side", side).filter("side IS NOT NULL")
    return picked.select(*keys, "side", F.when(F.col("side") == "local", F.col("local_hash")).otherwise(F.col("remote_hash")).alias("hash"))


def same_state(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Per group, whether both sets hold the same threads with the same hashes."""
    diff = snapshot_diff(a, b, [*by, "thread_id"])
    return diff.groupBy(*by).agg((F.count_if(F.col("status") != "unchanged") == 0).alias("same"))


def apply_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Threads that an apply left missing, unexpected or changed."""
    found = snapshot_diff(expected, actual)
    kind = F.when(F.col("status") == "deleted", "missing").when(F.col("status") == "added", "unexpected").otherwise("changed")
    return found.filter("status <> 'unchanged'").select("thread_id", kind.alias("problem"))


def import_plan(incoming: DataFrame, target: DataFrame) -> DataFrame:
    """skip, conflict, path_taken, path_repeated, index_rows or insert for each incoming thread.

    incoming: thread_id, hash, path, index_rows; target: thread_id, hash, path. An id that the target lists
    more than once is skipped only if all its hashes are the incoming one.
    """
    repeated = F.count(F.lit(1)).over(Window.partitionBy("path")) > 1
    hashes = F.struct("hash")
    by_id = target.groupBy("thread_id").agg(F.min(hashes)["hash"].alias("target_hash"), (F.min(hashes) != F.max(hashes)).alias("several"), F.lit(True).alias("known"))
    by_path = target.select("path", F.lit(True).alias("taken")).distinct()
    rows = incoming.withColumn("repeated", repeated).join(by_id, "thread_id", "left").join(by_path, "path", "left")
    action = (
        F.when(F.col("known") & ~F.col("several") & F.col("hash").eqNullSafe(F.col("target_hash")), "skip")
        .when(F.col("known"), "conflict")
        .when(F.col("taken"), "path_taken")
        .when(F.col("repeated"), "path_repeated")
        .when(F.col("index_rows") != 1, "index_rows")
        .otherwise("insert")
    )
    return rows.select("thread_id", "path", action.alias("action"))


def align_to_target(rows: DataFrame, target: list[str], overrides: dict[str, Column] | None = None) -> DataFrame:
    """Only the target's columns, in its order: overridden, taken over, derived from their twin, or null.

    A missing `x_ms` comes from `x` times 1000, a missing `x` from `x_ms`, a missing recency from
    the update time. A target that shares no column with the rows is an error.
    """
    have, overrides = set(rows.columns), overrides or {}
    if not have & set(target):
        raise ValueError("the target has none of the rows' columns")

    def column(name: str) -> Column:
        if name in overrides:
            return overrides[name]
        for source in (name, name.replace("recency", "updated")):
            if source in have:
                return F.col(source)
            if source.endswith("_ms") and source[:-3] in have:
                return F.col(source[:-3]) * 1000
            if f"{source}_ms" in have:
                return F.floor(F.col(f"{source}_ms") / 1000)
        return F.lit(None)

    return rows.select(*(column(c).alias(c) for c in target))


def provider_drift(files: DataFrame, index: DataFrame, provider: str, by: list[str]) -> DataFrame:
    """Per group: files and index rows whose provider differs from the configured one, their bytes, and whether none does."""
    off = ~F.col("model_provider").eqNullSafe(F.lit(provider))
    f = files.groupBy(*by).agg(F.count_if(off).alias("files"), F.coalesce(F.sum(F.when(off, F.col("byte_length"))), F.lit(0)).alias("bytes"))
    i = index.groupBy(*by).agg(F.count_if(off).alias("rows"))
    both = f.join(i, by, "full").fillna(0, ["files", "bytes", "rows"])
    return both.withColumn("no_changes", (F.col("files") == 0) & (F.col("rows") == 0))


def set_provider(rows: DataFrame, provider: str) -> DataFrame:
    """The configured provider in every row, and whether that changed the row."""
    changed = ~F.col("model_provider").eqNullSafe(F.lit(provider))
    return rows.withColumn("changed", changed).withColumn("model_provider", F.lit(provider))


def sync_status(tracking: DataFrame, namespaces: DataFrame, equal: DataFrame) -> DataFrame:
    """Per home and namespace: epoch_changed, no_changes, pushable or pull_first, and the pull's state.

    tracking: home_key, namespace_id, integrated_head, remote_epoch; namespaces: namespace_id,
    head_revision, namespace_epoch; equal: home_key, namespace_id, same.
    """
    rows = tracking.join(namespaces, "namespace_id").join(equal, ["home_key", "namespace_id"], "left")
    at_head = F.col("head_revision").eqNullSafe(F.col("integrated_head"))
    push = (
        F.when(F.col("remote_epoch") != F.col("namespace_epoch"), "epoch_changed")
        .when(F.coalesce("same", F.lit(False)), "no_changes")
        .when(at_head, "pushable")
        .otherwise("pull_first")
    )
    pull = (
        F.when(F.col("remote_epoch") != F.col("namespace_epoch"), "epoch_changed")
        .when(F.col("head_revision").isNull(), "no_head")
        .when(at_head, "no_changes")
        .otherwise("pullable")
    )
    return rows.select("home_key", "namespace_id", push.alias("push"), pull.alias("pull"))


def restore_status(tracking: DataFrame, namespaces: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per home and revision of its namespace whether it can be restored: epoch_changed, pull_first (the head is not integrated), has_warnings or restorable.

    revisions: namespace_id, revision, warning_count.
    """
    rows = tracking.join(namespaces, "namespace_id").join(revisions, "namespace_id")
    return rows.select("home_key", "namespace_id", "revision", _restore_state(F.col("warning_count") > 0).alias("restore"))


def _restore_state(warned: Column) -> Column:
    return (
        F.when(F.col("remote_epoch") != F.col("namespace_epoch"), "epoch_changed")
        .when(~F.col("head_revision").eqNullSafe(F.col("integrated_head")), "pull_first")
        .when(warned, "has_warnings")
        .otherwise("restorable")
    )


def restore_counts(tracking: DataFrame, namespaces: DataFrame, revisions: DataFrame) -> DataFrame:
    """home_key, restore, n: how many revisions each home finds in each state of restore_status.

    The state of a revision depends only on whether it has warnings, so revisions are counted by namespace and that
    before homes meet them: a home meets at most two rows of a namespace, not its revisions.
    """
    warned = F.coalesce(F.col("warning_count") > 0, F.lit(False))
    held = revisions.groupBy("namespace_id", warned.alias("warned")).agg(F.count(F.lit(1)).alias("n"))
    rows = tracking.join(namespaces.join(held, "namespace_id"), "namespace_id")
    return rows.groupBy("home_key", _restore_state(F.col("warned")).alias("restore")).agg(F.sum("n").alias("n"))


def workspace_clean(local: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """Per home, whether nothing is unpublished."""
    return same_state(local, base, by).withColumnRenamed("same", "clean")


def latest_tracking(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest generation per key of an append-only log, and the gaps in its generations."""
    w = Window.partitionBy(*keys).orderBy("generation")
    gap = F.col("generation") - F.coalesce(F.lag("generation").over(w), F.col("generation") - 1) != 1
    return log.withColumn("gap", gap).groupBy(*keys).agg(
        F.max("generation").alias("generation"), F.max_by("integrated_head", "generation").alias("integrated_head"), F.count_if("gap").alias("gaps")
    )


def compare_and_set(log: DataFrame, task_rows: int = TASK_ROWS, span: int = SPAN) -> DataFrame:
    """The outcome of every attempt to move a tracking record, in order: home_key, remote_id, namespace_id, seq, outcome, generation, integrated_head, active.

    log: home_key, remote_id, namespace_id, seq (unique in a home), action (set or checkout), expected_generation (null: no
    record yet), integrated_head (an id or null), activate. An attempt is applied if the record's generation is the
    expected one, which it raises by one; with activate a checkout also makes its namespace the home's active one. A checkout
    that finds its own result is already_applied, or not_active if it should have activated another namespace than is
    active. invalid_head: an id that is none; changed: another generation. generation, integrated_head (of the record) and active
    (this is the home's namespace) are those after the attempt.

    The attempts that are applied are found by history.taken_steps: records of up to task_rows attempts are walked in order, many in a task, and
    of a larger one they are a path of pointers from generation to generation, so it is spread over tasks.
    """
    record, home = ["grp"], ["home_key"]
    key = F.to_json(F.struct("home_key", "remote_id", "namespace_id"), {"ignoreNullFields": "false"})
    good = F.col("integrated_head").isNull() | is_sha256_id(F.col("integrated_head"))
    after = F.coalesce("expected_generation", F.lit(0)).cast("long") + 1
    rows = rewritten(log.select("home_key", "remote_id", "namespace_id", "seq", "action", F.col("expected_generation").cast("long").alias("expected"), "integrated_head", "activate", key.alias("grp"), good.alias("good"), after.alias("after")), "attempts")
    steps = rows.filter("good").select("grp", "seq", F.col("expected").alias("needs"), F.col("after").alias("gives"))
    taken = taken_steps(steps, task_rows, span).select("grp", "seq", F.lit(True).alias("taken"))
    rows = rewritten(rows.join(taken, ["grp", "seq"], "left").withColumn("taken", F.coalesce("taken", F.lit(False))), "taken")
    rows = as_of(rows, record, "seq", F.when(F.col("taken"), F.struct(F.col("after").alias("generation"), F.col("integrated_head").alias("head"))), span=span).withColumnRenamed("__last", "was")
    activates = F.col("taken") & (F.col("action") == "checkout") & F.coalesce("activate", F.lit(False))
    rows = as_of(rewritten(rows, "attempts"), home, "seq", F.when(activates, F.col("grp")), True, span).withColumnRenamed("__last", "current")
    own = F.coalesce(F.col("current") == F.col("grp"), F.lit(False))
    again = (F.col("action") == "checkout") & (F.col("was.generation") == F.col("after")) & F.col("was.head").eqNullSafe(F.col("integrated_head"))
    outcome = (
        F.when(~F.col("good"), "invalid_head")
        .when(F.coalesce(again, F.lit(False)), F.when(F.coalesce("activate", F.lit(False)) & ~own, "not_active").otherwise("already_applied"))
        .when(F.col("taken"), "applied")
        .otherwise("changed")
    )
    now = lambda new, old: F.when(F.col("taken"), F.col(new)).otherwise(F.col(old))
    return rows.select("home_key", "remote_id", "namespace_id", "seq", outcome.alias("outcome"), now("after", "was.generation").alias("generation"), now("integrated_head", "was.head").alias("integrated_head"), own.alias("active"))


def active_binding(log: DataFrame) -> DataFrame:
    """Per home its active namespace by the newest generation of each binding, and how many are active: more than one names none.

    log: home_key, remote_id, namespace_id, generation, active.
    """
    newest = log.groupBy("home_key", "remote_id", "namespace_id").agg(F.max_by("active", "generation").alias("active"))
    rows = newest.groupBy("home_key").agg(F.count_if("active").alias("n_active"), F.max(F.when(F.col("active"), F.col("namespace_id"))).alias("namespace_id"))
    return rows.withColumn("namespace_id", F.when(F.col("n_active") == 1, F.col("namespace_id")))


def primary_source(index: DataFrame, by: list[str]) -> DataFrame:
    """Per home the index source with the most rows; ties go to the first by name."""
    counted = index.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "source"))
    return counted.withColumn("rn", first).filter("rn = 1").drop("rn")
