"""Revision chains: listing, ancestry, truncation, restore, trash, timelines, commit replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import rewritten
from .chains import SPAN, as_of, counted, following, rank_lists

RETENTION_DAYS = 30
#: Fixed value: the most revisions that one request may trash.
MAX_TRUNCATED = 100_000
#: Namespaces of more revisions are not walked by one task; a filter lists at most LISTED of them.
TASK_ROWS = 500_000
LISTED = 1_000
#: How often a path of commits is found again without a request that turned out to be known.
ROUNDS = 6


def list_revisions(revisions: DataFrame, limit: int) -> DataFrame:
    """The newest active revisions of every namespace, newest first; limit clamped to 1..500."""
    n = max(1, min(500, limit))
    w = Window.partitionBy("namespace_id").orderBy(F.desc("created_at"), F.desc("id"))
    return revisions.filter("state = 'active'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def list_namespaces(namespaces: DataFrame) -> DataFrame:
    """All namespaces by time of creation and id."""
    return namespaces.orderBy("created_at", "namespace_id")


def namespace_heads(revisions: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Head (the last active revision; null if there is none), number of active revisions and epoch of each namespace.

    namespaces: namespace_id, namespace_epoch.
    """
    active = revisions.filter("state = 'active'").groupBy("namespace_id").agg(F.max_by("id", "seq").alias("head_revision"), F.count(F.lit(1)).alias("revisions"))
    return namespaces.select("namespace_id", "namespace_epoch").join(active, "namespace_id", "left").fillna(0, ["revisions"])


def _linked(revisions: DataFrame) -> DataFrame:
    """id, namespace_id, up (the parent, where it stands in the same namespace) and whether a parent is missing there."""
    own = revisions.select(F.col("namespace_id").alias("of"), F.col("id").alias("up"))
    rows = revisions.select("id", "namespace_id", "parent").join(own, (F.col("namespace_id") == F.col("of")) & (F.col("parent") == F.col("up")), "left")
    return rows.select("id", "namespace_id", "up", (F.col("parent").isNotNull() & F.col("up").isNull()).alias("broken"))


def _tree(ids: list, parents: list) -> list[tuple]:
    """depth, root, broken, first and last of the revisions of one namespace; nulls below a circle."""
    place = {x: i for i, x in enumerate(ids)}
    up = [-1 if p is None else place.get(p, -1) for p in parents]
    below: list[list] = [[] for _ in ids]
    for i, p in enumerate(up):
        if p >= 0:
            below[p].append(i)
    out, count = [(None, None, None, None, None)] * len(ids), 0
    for top in (i for i, p in enumerate(up) if p < 0):
        broken, path = parents[top] is not None, [(top, count, iter(below[top]))]
        count += 1
        while path:
            node, first, rest = path[-1]
            child = next(rest, None)
            if child is None:
                path.pop()
                out[node] = (len(path), ids[top], broken, first, count - 1)
            else:
                path.append((child, count, iter(below[child])))
                count += 1
    return out


def _toured(revisions: DataFrame) -> DataFrame:
    """labels by an Euler tour that is ranked as a list, for namespaces that no task should hold."""
    at = lambda id_, up: F.struct(F.col("namespace_id").alias("ns"), id_.alias("id"), F.lit(up).alias("up"))
    rows = rewritten(_linked(revisions), "linked")
    sibling = F.lead("id").over(Window.partitionBy("namespace_id", "up").orderBy("id"))
    eldest = rows.filter("up IS NOT NULL").groupBy(F.col("namespace_id").alias("of"), F.col("up").alias("over")).agg(F.min("id").alias("child"))
    rows = rows.withColumn("next", F.when(F.col("up").isNotNull(), sibling)).join(eldest, (F.col("namespace_id") == F.col("of")) & (F.col("id") == F.col("over")), "left")
    down = rows.select(at(F.col("id"), False).alias("node"), F.when(F.col("child").isNotNull(), at(F.col("child"), False)).otherwise(at(F.col("id"), True)).alias("to"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("open"))
    back = F.when(F.col("next").isNotNull(), at(F.col("next"), False)).when(F.col("up").isNotNull(), at(F.col("up"), True))
    up = rows.select(at(F.col("id"), True).alias("node"), back.alias("to"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("open"))
    ranked = rank_lists(down.unionByName(up), ["n", "open"]).filter("end IS NOT NULL")
    side = lambda up, c: F.max(F.when(F.col("node.up") == up, F.col(c)))
    found = ranked.groupBy(F.col("node.ns").alias("of"), F.col("node.id").alias("of_id")).agg((-side(False, "open")).alias("depth"), side(False, "end.id").alias("root"), (-side(False, "n")).alias("first"), (-side(True, "n")).alias("last"))
    ends = rows.filter("up IS NULL").select(F.col("namespace_id").alias("ns"), F.col("id").alias("top"), "broken")
    rows = rows.select("id", "namespace_id").join(found, (F.col("namespace_id") == F.col("of")) & (F.col("id") == F.col("of_id")), "left")
    return rows.join(ends, (F.col("namespace_id") == F.col("ns")) & (F.col("root") == F.col("top")), "left").select("id", "namespace_id", "depth", "root", "broken", "first", "last")


def labels(revisions: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The forest of revisions with labels: id, namespace_id, depth (steps to the end of its chain), root (that end),
    broken (the end lacks its parent), first and last.

    Of two revisions of one namespace and root one is above the other exactly if its first and last
    enclose the other's. Ids are unique inside a namespace. Namespaces of up to task_rows revisions are
    walked by one task each, all at once; a larger one is turned into an Euler tour whose ranks come from
    pointer jumping. Revisions in a circle, or above which one stands, have nulls.
    """
    kind = revisions.schema["id"].dataType.simpleString()
    names = ["id", "namespace_id", "depth", "root", "broken", "first", "last"]
    schema = f"id {kind}, namespace_id {revisions.schema['namespace_id'].dataType.simpleString()}, depth long, root {kind}, broken boolean, first long, last long"

    def walk(batches):
        import pyarrow as pa

        kinds, of, ids, parents = None, None, [], []

        def done():
            tree = list(zip(*_tree(ids, parents))) or [()] * 5
            columns = [ids, [of] * len(ids), *tree]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            kinds = [batch.schema.field("id").type, batch.schema.field("namespace_id").type, pa.int64(), batch.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64()]
            for ns, id_, parent in zip(*(batch.column(c).to_pylist() for c in ("namespace_id", "id", "parent"))):
                if ns != of and ids:
                    yield done()
                    ids, parents = [], []
                of = ns
                ids.append(id_)
                parents.append(parent)
        if ids:
            yield done()

    rows = revisions.select("id", "namespace_id", "parent")
    large = [r[0] for r in rows.groupBy("namespace_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_rows).select("namespace_id").limit(LISTED + 1).collect()]
    if len(large) > LISTED:  # more large ones than a filter should list: all by the tour
        return _toured(rows)
    inside = F.coalesce(F.col("namespace_id").isin(large), F.lit(False)) if large else F.lit(False)
    small = rows.filter(~inside).repartition("namespace_id").sortWithinPartitions("namespace_id", "id").mapInArrow(walk, schema)
    return small.unionByName(_toured(rows.filter(inside))) if large else small


def ancestors(revisions: DataFrame, max_steps: int = 10_000, task_rows: int = TASK_ROWS) -> DataFrame:
    """id, namespace_id, depth, root and broken of labels; a chain longer than max_steps, or a circle, has nulls."""
    known = F.col("depth") <= max_steps
    return labels(revisions, task_rows).select("id", "namespace_id", *(F.when(known, F.col(c)).alias(c) for c in ("depth", "root", "broken")))


def is_ancestor(pairs: DataFrame, labelled: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """pairs (namespace_id, ancestor, id) with the flag, by comparing labels; an id is its own ancestor.

    Ids that the namespace does not have, and more than max_steps between the two, are false.
    """
    d = labelled.select(F.col("namespace_id").alias("of"), F.col("id").alias("at"), "depth", "root", "first", "last")
    above = labelled.select(F.col("namespace_id").alias("of2"), F.col("id").alias("over"), F.col("depth").alias("depth2"), F.col("root").alias("root2"), F.col("first").alias("first2"), F.col("last").alias("last2"))
    rows = pairs.join(d, (F.col("namespace_id") == F.col("of")) & (F.col("id") == F.col("at")), "left")
    rows = rows.join(above, (F.col("namespace_id") == F.col("of2")) & (F.col("ancestor") == F.col("over")), "left")
    inside = (F.col("root") == F.col("root2")) & (F.col("first2") <= F.col("first")) & (F.col("last") <= F.col("last2")) & (F.col("depth") - F.col("depth2") <= max_steps)
    return rows.select("namespace_id", "ancestor", "id", F.coalesce(inside, F.lit(False)).alias("is_ancestor"))


def plan_truncation(revisions: DataFrame, namespaces: DataFrame, wanted: DataFrame, now: Column, labelled: DataFrame | None = None) -> DataFrame:
    """One row per request: what it would do. A null new_head trashes all.

    namespaces: namespace_id, head_revision, namespace_epoch; wanted: operation_id, namespace_id,
    expected_head, expected_epoch, new_head. outcome: not_found (no such namespace), head_mismatch, epoch_mismatch, conflict (the
    new head is the head, no walk over active revisions leads from the head to it, or it is longer than MAX_TRUNCATED) or planned.
    labelled: labels of the active revisions, where they are kept as a table.
    """
    d = labels(revisions.filter("state = 'active'")) if labelled is None else labelled
    known = namespaces.select("namespace_id", "head_revision", "namespace_epoch", F.lit(True).alias("there"))
    rows = wanted.join(known, "namespace_id", "left")
    side = lambda p, id_: d.select(F.col("namespace_id").alias(f"{p}_of"), F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("depth", "root", "broken", "first", "last")))
    for p, id_ in (("head", "head_revision"), ("new", "new_head")):
        rows = rows.join(side(p, id_), (F.col("namespace_id") == F.col(f"{p}_of")) & (F.col(id_) == F.col(f"{p}_id")), "left")
    inside = (F.col("head_root") == F.col("new_root")) & (F.col("new_first") <= F.col("head_first")) & (F.col("head_last") <= F.col("new_last"))
    steps = F.col("head_depth") - F.when(F.col("new_head").isNull(), -1).otherwise(F.col("new_depth"))
    walk = F.when(F.col("new_head").isNull(), ~F.col("head_broken")).otherwise(inside) & (steps <= MAX_TRUNCATED)
    outcome = (
        F.when(F.col("there").isNull(), "not_found")
        .when(~F.col("head_revision").eqNullSafe(F.col("expected_head")), "head_mismatch")
        .when(F.col("namespace_epoch") != F.col("expected_epoch"), "epoch_mismatch")
        .when(F.col("head_revision").eqNullSafe(F.col("new_head")) | ~F.coalesce(walk, F.lit(False)), "conflict")
        .otherwise("planned")
    )
    ok = F.col("outcome") == "planned"
    return rows.withColumn("outcome", outcome).select(
        "operation_id", "namespace_id", F.col("head_revision").alias("old_head"), "new_head", "outcome", F.when(ok, steps).alias("revision_count"), F.col("namespace_epoch").alias("epoch_before"),
        (F.col("namespace_epoch") + F.when(ok, 1).otherwise(0)).alias("epoch_after"), F.when(ok, now + F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")).alias("expires_at"),
    )


def truncated_revisions(plan: DataFrame, revisions: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """id, namespace_id, operation_id of the revisions that the planned requests trash: those on the walk from the head, the new head left out."""
    d = labels(revisions.filter("state = 'active'")) if labelled is None else labelled
    wanted = plan.filter("outcome = 'planned'").select("operation_id", F.col("namespace_id").alias("of"), "old_head", "revision_count")
    head = d.select(F.col("namespace_id").alias("of2"), F.col("id").alias("old_head2"), *(F.col(c).alias(f"head_{c}") for c in ("depth", "root", "first", "last")))
    heads = wanted.join(head, (F.col("of") == F.col("of2")) & (F.col("old_head") == F.col("old_head2")))
    inside = (F.col("root") == F.col("head_root")) & (F.col("first") <= F.col("head_first")) & (F.col("head_last") <= F.col("last")) & (F.col("depth") > F.col("head_depth") - F.col("revision_count"))
    return d.join(heads, (F.col("namespace_id") == F.col("of")) & inside).select("id", "namespace_id", "operation_id")


def trash_rows(plan: DataFrame, now: Column) -> DataFrame:
    """The trash operations of the planned requests."""
    columns = ["namespace_id", "old_head", "new_head", "epoch_before", "epoch_after", "expires_at", "revision_count"]
    return plan.filter("outcome = 'planned'").select(F.col("operation_id").alias("id"), *columns, now.alias("created_at"), F.lit("active").alias("state"))


def moved_heads(plan: DataFrame, namespaces: DataFrame) -> DataFrame:
    """namespaces with the heads and epochs after the planned requests (one per namespace)."""
    new = plan.filter("outcome = 'planned'").select("namespace_id", F.col("new_head").alias("to"), "epoch_after", F.lit(True).alias("moved"))
    rows = namespaces.join(new, "namespace_id", "left")
    return rows.withColumn("head_revision", F.when(F.col("moved"), F.col("to")).otherwise(F.col("head_revision"))).withColumn("namespace_epoch", F.coalesce("epoch_after", "namespace_epoch")).drop("to", "epoch_after", "moved")


def plan_restore(ops: DataFrame, heads: DataFrame, now: Column) -> DataFrame:
    """Which trash operations can be undone: active ones whose new head is still the head; expired is a flag only."""
    rows = ops.join(heads.select("namespace_id", F.col("head_revision").alias("head")), "namespace_id", "left")
    can = (F.col("state") == "active") & F.col("new_head").eqNullSafe(F.col("head"))
    return rows.select("id", "namespace_id", can.alias("restorable"), F.when(can, F.col("old_head")).otherwise(F.col("head")).alias("head_after"), (F.col("expires_at") <= now).alias("expired"))


def list_trash(ops: DataFrame) -> DataFrame:
    """Trash operations of every namespace, newest first."""
    w = Window.partitionBy("namespace_id").orderBy(F.desc("created_at"), F.desc("id"))
    return ops.withColumn("place", F.row_number().over(w))


def list_snapshot_trash(entries: DataFrame, manifests: DataFrame, by: list[str]) -> DataFrame:
    """Trashed snapshots whose manifest is there, newest first in each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("id"))
    return entries.join(manifests.select("id").distinct(), "id", "left_semi").withColumn("place", F.row_number().over(w))


def version_timeline(local: DataFrame, remote: DataFrame, by: list[str], newest: int = 3) -> DataFrame:
    """The newest local snapshots (id, created_at, pinned, tags) and all remote revisions (id, created_at) in one schema, newest first.

    labels: PINNED or SNAPSHOT and the tags of a local one, HEAD for the newest remote one.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("id"))
    mine = local.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest)
    kind = F.array(F.when(F.col("pinned"), "PINNED").otherwise("SNAPSHOT"))
    mine = mine.select(*by, "id", "created_at", F.lit("local").alias("origin"), F.concat(kind, F.coalesce("tags", F.array().cast("array<string>"))).alias("labels"))
    head = F.when(F.row_number().over(w) == 1, F.array(F.lit("HEAD"))).otherwise(F.array().cast("array<string>"))
    theirs = remote.select(*by, "id", "created_at", F.lit("remote").alias("origin"), head.alias("labels"))
    return mine.unionByName(theirs).orderBy(*by, F.desc("created_at"), F.desc("id"))


def chain_breaks(revisions: DataFrame) -> DataFrame:
    """Revisions whose parent is not the one before them in their namespace."""
    before = F.lag("id").over(Window.partitionBy("namespace_id").orderBy("seq"))
    return revisions.withColumn("before", before).filter(~F.col("parent").eqNullSafe(F.col("before"))).drop("before")


def taken_steps(steps: DataFrame, task_rows: int = TASK_ROWS, span: int = SPAN) -> DataFrame:
    """grp, seq of the steps that are taken when each group starts with a null state and a step is taken if the state is what it needs; the state then
    is what it gives.

    steps: grp, seq (unique in a group), needs, gives (not null). Groups of up to task_rows steps are walked in order, many in a task; of
    a larger one each step points at the first later one that needs what it gives;
    pointers only lead forward, so they make a forest, and the steps taken are the path from the first step that
    needs nothing: those of which that step is below, which labels tell.
    """
    large = rewritten(steps.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_rows).select("grp"), "large")
    if not large.limit(1).count():
        return _walked(steps)
    return _walked(steps.join(large, "grp", "left_anti")).unionByName(_pointed(steps.join(large, "grp", "left_semi"), task_rows, span))


def _walked(steps: DataFrame) -> DataFrame:
    """taken_steps, a group after another in each task, holding no more than the state."""

    def walk(batches):
        import pyarrow as pa

        of, state, begun = None, None, False
        for batch in batches:
            taken = []
            for grp, needs, gives in zip(*(batch.column(c).to_pylist() for c in ("grp", "needs", "gives"))):
                if not begun or grp != of:
                    of, state, begun = grp, None, True
                taken.append(needs == state)
                state = gives if taken[-1] else state
            yield batch.filter(pa.array(taken, pa.bool_())).select(["grp", "seq"])

    ordered = steps.select("grp", "seq", "needs", "gives").repartition("grp").sortWithinPartitions("grp", "seq")
    return ordered.mapInArrow(walk, steps.select("grp", "seq").schema)


def _pointed(steps: DataFrame, task_rows: int, span: int) -> DataFrame:
    """taken_steps by pointers, for groups that no task should walk."""
    pointed = rewritten(following(steps, span), "steps")
    start = pointed.filter("needs IS NULL").groupBy("grp").agg(F.min("seq").alias("start"))
    forest = pointed.join(start.select("grp"), "grp", "left_semi").select(F.col("seq").alias("id"), F.col("grp").alias("namespace_id"), F.col("next").alias("parent"))
    d = rewritten(labels(forest, task_rows), "labels")
    low = d.join(start.select(F.col("grp").alias("of"), "start"), (F.col("namespace_id") == F.col("of")) & (F.col("id") == F.col("start")))
    low = low.select("of", F.col("root").alias("top"), F.col("first").alias("f"), F.col("last").alias("l"))
    above = d.join(low, (F.col("namespace_id") == F.col("of")) & (F.col("root") == F.col("top")) & (F.col("first") <= F.col("f")) & (F.col("l") <= F.col("last")))
    return above.select(F.col("namespace_id").alias("grp"), F.col("id").alias("seq"))


_OUTCOMES = "namespace_id long, seq long, request_id long, outcome string, epoch long"


def _replayed(log: DataFrame) -> DataFrame:
    """replay_commits, a namespace after another in each task, row by row."""

    def replay(batches):
        import pandas as pd

        of = head = None
        epoch, parents = 0, {}
        none = lambda x: None if x is None or x != x else int(x)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.namespace_id != of:
                    of, head, epoch, parents = r.namespace_id, None, 0, {}
                parent, expected = none(r.parent), none(r.expected_head)
                if r.action == "bump":
                    epoch, result = epoch + 1, "bumped"
                elif r.expected_epoch != epoch:
                    result = "wrong_epoch"
                elif r.request_id == head and parents[head] == parent:
                    result = "already_committed"
                elif r.request_id in parents:
                    result = "conflict"
                elif head != expected:
                    result = "head_mismatch"
                elif parent != expected:
                    result = "conflict"
                else:
                    head, result = int(r.request_id), "created"
                    parents[head] = parent
                out.append((result, epoch))
            yield pdf[["namespace_id", "seq", "request_id"]].assign(outcome=[o for o, _ in out], epoch=[e for _, e in out])

    ordered = log.repartition("namespace_id").sortWithinPartitions("namespace_id", "seq")
    return ordered.mapInPandas(replay, _OUTCOMES)


def _scanned(log: DataFrame, task_rows: int, span: int) -> DataFrame:
    """replay_commits by a parallel scan: the same outcomes, for namespaces that no task should hold."""
    by = ["namespace_id"]
    rows = rewritten(counted(log, by, "seq", (F.col("action") == "bump").cast("long"), span).withColumnRenamed("__sum", "epoch"), "log")
    commits = rows.filter("action IS DISTINCT FROM 'bump' AND expected_epoch = epoch")
    # Only these can be created; whether they are depends on the head they find and on whether their id is known.
    able = rewritten(commits.filter(F.col("parent").eqNullSafe(F.col("expected_head"))).select(F.col("namespace_id").alias("grp"), "seq", F.col("expected_head").alias("needs"), F.col("request_id").alias("gives")), "able")
    outcomes = None
    for left in range(ROUNDS, -1, -1):
        taken = taken_steps(able, task_rows, span)
        made = rewritten(able.join(taken, ["grp", "seq"]).select(F.col("grp").alias("namespace_id"), "seq", F.col("gives").alias("id"), F.col("needs").alias("parent")), "made")
        at = commits.join(made.select("namespace_id", "seq", F.struct("id", "parent").alias("new")), ["namespace_id", "seq"], "left")
        at = as_of(at, by, "seq", F.col("new"), span=span)
        since = made.groupBy("namespace_id", "id").agg(F.min("seq").alias("since")).select(F.col("namespace_id").alias("of"), F.col("id").alias("made_id"), "since")
        at = at.join(since, (F.col("namespace_id") == F.col("of")) & (F.col("request_id") == F.col("made_id")), "left")
        outcome = (
            F.when((F.col("request_id") == F.col("__last.id")) & F.col("parent").eqNullSafe(F.col("__last.parent")), "already_committed")
            .when(F.col("since") < F.col("seq"), "conflict")
            .when(~F.col("__last.id").eqNullSafe(F.col("expected_head")), "head_mismatch")
            .when(~F.col("parent").eqNullSafe(F.col("expected_head")), "conflict")
            .otherwise("created")
        )
        at = rewritten(at.select("namespace_id", "seq", "request_id", outcome.alias("outcome"), "epoch", F.col("new").isNotNull().alias("taken")), "outcomes")
        # A step that was taken although its id was known: the first of a namespace is wrong for certain, what follows it is open.
        wrong = at.filter("taken AND outcome <> 'created'").groupBy(F.col("namespace_id").alias("grp")).agg(F.min("seq").alias("seq"))
        wrong = rewritten(wrong, "wrong")
        some = bool(wrong.limit(1).count())
        settled = at.join(wrong.select(F.col("grp").alias("namespace_id")), "namespace_id", "left_anti") if some else at
        settled = settled.drop("taken")
        outcomes = settled if outcomes is None else outcomes.unionByName(settled)
        if not some:
            break
        commits = commits.join(wrong.select(F.col("grp").alias("namespace_id")), "namespace_id", "left_semi")
        if not left:  # ids that come again and again under other parents: these namespaces in order
            outcomes = outcomes.unionByName(_replayed(log.join(wrong.select(F.col("grp").alias("namespace_id")), "namespace_id", "left_semi")).join(commits.select("namespace_id", "seq"), ["namespace_id", "seq"]).select(*settled.columns))
            break
        able = rewritten(able.join(wrong.select("grp"), "grp", "left_semi").join(wrong, ["grp", "seq"], "left_anti"), "able")
    other = rows.filter("action = 'bump' OR expected_epoch IS DISTINCT FROM epoch")
    kind = F.when(F.col("action") == "bump", "bumped").otherwise("wrong_epoch")
    return outcomes.unionByName(other.select("namespace_id", "seq", "request_id", kind.alias("outcome"), "epoch"))


def replay_commits(log: DataFrame, task_rows: int = TASK_ROWS, span: int = SPAN) -> DataFrame:
    """The outcome of each ordered commit request of every namespace.

    log: namespace_id, seq (unique in a namespace), request_id, parent, expected_head, expected_epoch, action (commit or
    bump). wrong_epoch; the head again with the same parent: already_committed; another known id:
    conflict; head is not the expected one: head_mismatch; parent is not the expected head:
    conflict; else created, and the head moves. bump raises the epoch. Namespaces of up to task_rows requests
    are replayed by a task each; a larger one is spread over many tasks: epochs are a running count, the
    requests that are created are a path of pointers (see taken_steps), and heads and known ids follow from that path by joins.
    A request on that path whose id was created before is taken out and the path found again, up to ROUNDS times; then the
    namespace is replayed in order after all.
    """
    columns = ["namespace_id", "seq", "request_id", "parent", "expected_head", "expected_epoch", "action"]
    rows = log.select(*columns)
    large = rows.groupBy("namespace_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_rows).select("namespace_id")
    large = rewritten(large, "large")
    if not large.limit(1).count():
        return _replayed(rows)
    return _replayed(rows.join(large, "namespace_id", "left_anti")).unionByName(_scanned(rows.join(large, "namespace_id", "left_semi"), task_rows, span).select("namespace_id", "seq", "request_id", "outcome", "epoch"))
