"""The object graph: edges, reachability, clean-up plans, storage accounting, journals."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import content_id, is_sha256_id
from .chains import rank_lists
from .chunks import list_fingerprint
from ..sources.scratch import rewritten

OBJECT = ["kind", "sha256"]
#: Levels that reachable() follows one by one before it contracts what is left.
SHALLOW = 4
#: States of journals that need nothing more, in lower case.
FINISHED = ("completed", "rolled_back", "rolledback")
#: The fields that tell the kind of a journal.
PROVIDER_MARKS = ("targetProvider", "files")
IMPORT_MARKS = ("backupDir", "plannedRollouts", "importedThreadIds")
CHECKOUT_MARKS = ("repositoryBackupDir", "databaseBackups", "directorySwaps", "expectedThreadHashes")


def edge_rows(roots: DataFrame, threads: DataFrame, chunks: DataFrame, wholes: DataFrame | None = None) -> DataFrame:
    """owner -> target edges, as often as they are named.

    roots: root, thread; threads: thread, content; chunks: content, sha256; wholes (contents
    stored in one piece): thread, sha256.
    """
    edge = lambda df, ok, o, tk, t: df.select(F.lit(ok).alias("owner_kind"), F.col(o).alias("owner_sha256"), F.lit(tk).alias("target_kind"), F.col(t).alias("target_sha256"))
    parts = [edge(roots, "revision_root", "root", "thread", "thread"), edge(threads, "thread", "thread", "chunk_manifest", "content"), edge(chunks, "chunk_manifest", "content", "chunk", "sha256")]
    if wholes is not None:
        parts.append(edge(wholes, "thread", "thread", "whole", "sha256"))
    return reduce(DataFrame.unionByName, parts)


def build_edges(roots: DataFrame, threads: DataFrame, chunks: DataFrame, wholes: DataFrame | None = None) -> DataFrame:
    """edge_rows, distinct."""
    return edge_rows(roots, threads, chunks, wholes).distinct()


def _frontier(roots: DataFrame, edges: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes reached in so many rounds (None: all), those of them whose edges were followed, and the others, none once nothing is left."""
    seen = front = rewritten(roots, "seen")
    followed = front.limit(0)
    while front.limit(1).count() and (rounds is None or rounds > 0):
        step = front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = rewritten(step.join(seen, "node", "left_anti"), "front")
        followed, seen, rounds = seen, seen.unionByName(front), rounds and rounds - 1
    return seen, followed, front


def _contracted(roots: DataFrame, edges: DataFrame, shallow: int) -> DataFrame:
    """Nodes reached from roots. roots: node; edges: a, b, distinct, without a = b."""
    seen, followed, front = _frontier(roots, edges, shallow)
    if not front.limit(1).count():
        return seen
    # Edges that were followed, and others into what is reached, have nothing more to tell. Owners that nothing points at and that are no roots lead nowhere.
    seen_before, roots = seen, front
    edges = edges.join(followed.select(F.col("node").alias("a")), "a", "left_anti").join(seen.select(F.col("node").alias("b")), "b", "left_anti")
    edges = rewritten(edges, "ahead")
    edges = edges.join(edges.select(F.col("b").alias("a")).unionByName(front.select(F.col("node").alias("a"))).distinct(), "a", "left_semi")
    # Ends are put aside: an end is reached if one before it is.
    inner = rewritten(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "inner")
    into = inner.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    out = inner.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("b").alias("next"))
    nodes = into.join(out, "node", "full").join(roots.withColumn("root", F.lit(True)), "node", "left")
    nodes = rewritten(nodes.fillna(0, ["n_in", "n_out"]).fillna(False, ["root"]), "nodes")
    # Paths: from a node with one way out to a node with one way in that is no root.
    single = nodes.filter("n_in = 1 AND NOT root").select(F.col("node").alias("next"))
    to = nodes.filter("n_out = 1").select("node", "next").join(single, "next", "left_semi")
    links = nodes.join(to.select("node", F.col("next").alias("to")), "node", "left")
    ranked = rank_lists(links.select("node", "to", F.lit(1).cast("long").alias("place"), "root", "n_in"), ["place"])
    # A circle of such nodes has no root in it and no way in, so it is not reached.
    ranked = rewritten(ranked.filter("end IS NOT NULL").join(nodes.select("node", "n_in", "n_out", "root"), "node"), "ranked")
    head = F.max(F.struct("place", "node", "n_in", "root")).alias("head")
    paths = ranked.groupBy("end").agg(head).select("end", F.col("head.node").alias("head"), F.col("head.n_in").alias("head_in"), F.col("head.root").alias("head_root"))
    live = paths.filter("head_root OR head_in > 0")  # a path that nothing leads to goes
    named = live.select(F.col("end").alias("a"), F.col("head").alias("from"))
    short = inner.join(named, "a").select(F.col("from").alias("a"), "b").join(live.select(F.col("head").alias("b")), "b", "left_semi").filter("a <> b")
    short = rewritten(short.select("a", "b").distinct(), "short")
    whole = live.filter("head_root").select(F.col("head").alias("node")).distinct()
    before, after = inner.count(), short.count()
    heads = _contracted(whole, short, shallow) if after <= 0.9 * before else _frontier(whole, short, None)[0]
    reached = ranked.join(live.join(heads.select(F.col("node").alias("head")), "head", "left_semi").select("end"), "end", "left_semi").select("node")
    reached = rewritten(reached, "reached")
    # Ends, and roots that are ends themselves.
    ends = edges.join(reached.unionByName(roots).distinct().select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
    return seen_before.unionByName(reached.unionByName(ends).join(roots, "node", "left_anti").distinct())


def _packed(kind: Column, sha256: Column) -> Column:
    """An object as a short value: a content id as its 32 bytes, any other name as it is, with a mark that tells them apart."""
    name = F.when(is_sha256_id(sha256), F.concat(F.lit(b"\1"), F.unhex(F.substring(sha256, 8, 64)))).otherwise(F.concat(F.lit(b"\0"), sha256.cast("binary")))
    return F.struct(kind.alias("kind"), name.alias("name"))


def _unpacked(node: Column) -> list[Column]:
    name = F.substring(node["name"], 2, 2**31 - 1)
    given = F.when(F.substring(node["name"], 1, 1) == F.lit(b"\1"), F.concat(F.lit("sha256:"), F.lower(F.hex(name)))).otherwise(name.cast("string"))
    return [node["kind"].alias("kind"), given.alias("sha256")]


def reachable(roots: DataFrame, edges: DataFrame, shallow: int = SHALLOW) -> DataFrame:
    """Objects in the closure of roots (kind, sha256), however deep.

    A frontier runs for `shallow` rounds, which is all that the usual graph needs. What is left then is
    contracted: ends are put aside, owners that nothing leads to are dropped, and paths become one node each by
    pointer jumping, so a chain costs rounds by the logarithm of its length; the smaller graph is treated in the same way, and
    its answer is spread over the paths and to the ends. Where contraction finds hardly anything to do, the frontier
    runs to the end. Each round is written, so it survives the loss of executors. Circles are followed once; repeated
    edges and roots count once.
    """
    node = lambda k, s: _packed(F.col(k), F.col(s))
    pairs = edges.select(node("owner_kind", "owner_sha256").alias("a"), node("target_kind", "target_sha256").alias("b")).filter("a <> b").distinct()
    found = _contracted(roots.select(node("kind", "sha256").alias("node")).distinct(), rewritten(pairs, "pairs"), shallow)
    return found.select(*_unpacked(F.col("node")))


def root_set(revisions: DataFrame, ops: DataFrame, now: Column) -> DataFrame:
    """Active revisions, and trashed ones whose operation is active and has not expired."""
    live = ops.filter((F.col("state") == "active") & (F.col("expires_at") > now)).select(F.col("id").alias("trash_operation_id"))
    kept = revisions.filter("state = 'trashed'").join(live, "trash_operation_id", "left_semi")
    return revisions.filter("state = 'active'").select("root").unionByName(kept.select("root")).select(F.lit("revision_root").alias("kind"), F.col("root").alias("sha256")).distinct()


def local_roots(snapshots: DataFrame, trashed: DataFrame, cached: DataFrame) -> DataFrame:
    """What a local store keeps: all its snapshots, trashed ones too, and the revision roots it has cached (each: sha256)."""
    kinds = (("snapshot_root", snapshots), ("snapshot_root", trashed), ("revision_root", cached))
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), "sha256") for kind, df in kinds)).distinct()


def gc_plan(objects: DataFrame, reached: DataFrame, now: Column, grace: str = "1 HOUR") -> DataFrame:
    """Objects past the grace period that nothing reaches."""
    return objects.filter(F.col("created_at") < now - F.expr(f"INTERVAL {grace}")).join(reached, OBJECT, "left_anti")


def gc_fingerprint(plan: DataFrame) -> DataFrame:
    """Per kind the fingerprint of the planned objects, their number and bytes."""
    text = F.concat_ws(":", "sha256", F.col("byte_length").cast("string"))
    return list_fingerprint(plan, ["kind"], text).join(plan.groupBy("kind").agg(F.sum("byte_length").alias("bytes")), "kind")


def gc_enqueue(plan: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The planned objects as pending entries, of the kinds whose fingerprint is still the given one; of others `stale`.

    fingerprints: kind, fingerprint, as they were shown. A kind without one is stale.
    """
    now = gc_fingerprint(plan).select("kind", F.col("fingerprint").alias("now"))
    rows = plan.join(now.join(fingerprints.select("kind", "fingerprint"), "kind", "left"), "kind")
    return rows.withColumn("state", F.when(F.col("now").eqNullSafe(F.col("fingerprint")), "pending").otherwise("stale")).drop("now", "fingerprint")


def gc_recheck(queue: DataFrame, reached: DataFrame) -> DataFrame:
    """Each pending entry: cancelled if it is reached again, else quarantined; other states stay."""
    rows = queue.join(reached.withColumn("hit", F.lit(True)), OBJECT, "left")
    return rows.withColumn("state", F.when(F.col("state") != "pending", F.col("state")).when(F.col("hit"), "cancelled").otherwise("quarantined")).drop("hit")


def gc_results(checked: DataFrame, objects: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects and edges without those that were quarantined (edges by their owner)."""
    gone = checked.filter("state = 'quarantined'").select(*OBJECT).distinct()
    owner = gone.select(F.col("kind").alias("owner_kind"), F.col("sha256").alias("owner_sha256"))
    return objects.join(gone, OBJECT, "left_anti"), edges.join(owner, ["owner_kind", "owner_sha256"], "left_anti")


def over_cap(wanted: DataFrame, by: list[str], cap: int = 10_000) -> DataFrame:
    """Requests that name more distinct objects of a kind than may be asked for at once."""
    return wanted.select(*by, *OBJECT).distinct().groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("objects")).filter(F.col("objects") > cap)


def missing_objects(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct wanted objects the other side lacks, and those whose length it disputes."""
    w = wanted.groupBy(*OBJECT).agg(F.min("byte_length").alias("byte_length"))
    h = have.groupBy(*OBJECT).agg(F.min("byte_length").alias("have_length"))
    problem = F.when(F.col("have_length").isNull(), "missing").when(F.col("have_length") != F.col("byte_length"), "length")
    return w.join(h, OBJECT, "left").withColumn("problem", problem).filter("problem IS NOT NULL").drop("have_length")


def revision_stats(refs: DataFrame) -> DataFrame:
    """Threads, distinct objects and their bytes per revision. refs: revision, thread, kind, sha256, byte_length."""
    objects = refs.groupBy("revision", *OBJECT).agg(F.first("byte_length").alias("n")).groupBy("revision").agg(F.count(F.lit(1)).alias("object_count"), F.sum("n").alias("total_bytes"))
    threads = refs.select("revision", "thread").distinct().groupBy("revision").agg(F.count(F.lit(1)).alias("thread_count"))
    return objects.join(threads, "revision")


def list_snapshots(refs: DataFrame, meta: DataFrame) -> DataFrame:
    """Per snapshot: threads, distinct objects (and its overlay), logical and physical bytes, metadata; newest first, ids descending at one time.

    meta: snapshot_id, created_at and what else is known of a snapshot.
    """
    stats = revision_stats(refs.withColumnRenamed("snapshot_id", "revision")).withColumnRenamed("revision", "snapshot_id")
    logical = refs.groupBy("snapshot_id").agg(F.sum("byte_length").alias("logical_bytes"))
    rows = stats.join(logical, "snapshot_id").join(meta, "snapshot_id", "left")
    return rows.withColumn("object_count", F.col("object_count") + 1).withColumnRenamed("total_bytes", "physical_bytes").orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def deletion_plan(refs: DataFrame, pinned: DataFrame, protected: DataFrame) -> DataFrame:
    """For every snapshot at once: objects shared with others and its own, the bytes a deletion frees, and whether it may go.

    The fingerprint changes with the set of objects, with which of them are shared, and with both flags.
    """
    per = refs.groupBy("snapshot_id", *OBJECT).agg(F.first("byte_length").alias("n"))
    holders = per.groupBy(*OBJECT).agg((F.count(F.lit(1)) == 1).alias("own"))
    rows = per.join(holders, OBJECT).groupBy("snapshot_id").agg(
        F.count_if(~F.col("own")).alias("shared_objects"), F.count_if("own").alias("exclusive_objects"), F.coalesce(F.sum(F.when(F.col("own"), F.col("n"))), F.lit(0)).alias("exclusive_bytes")
    )
    marked = rows.join(pinned.select("snapshot_id", F.lit(True).alias("pinned")), "snapshot_id", "left").join(protected.select("snapshot_id", F.lit(True).alias("guarded")).distinct(), "snapshot_id", "left")
    marked = marked.fillna(False, ["pinned", "guarded"])
    listed = list_fingerprint(per.join(holders, OBJECT), ["snapshot_id"], F.concat_ws(":", "kind", "sha256", F.col("own").cast("string"))).select("snapshot_id", F.col("fingerprint").alias("listed"))
    fingerprint = content_id(F.concat_ws("\n", "snapshot_id", F.col("pinned").cast("string"), F.col("guarded").cast("string"), "listed"))
    return marked.join(listed, "snapshot_id").withColumn("eligible", ~F.col("pinned") & ~F.col("guarded")).withColumn("fingerprint", fingerprint).drop("listed")


def storage_summary(refs: DataFrame, trash: DataFrame, objects: DataFrame, by: list[str], quarantine: DataFrame | None = None) -> DataFrame:
    """Logical, physical, active, shared, exclusive, trash-only, reclaimable and quarantined bytes per group.

    refs: by.., snapshot_id, kind, sha256, byte_length of live snapshots; trash: the same of
    trashed ones; objects: by.., kind, sha256, byte_length of all that is stored; quarantine:
    by.., byte_length of what waits outside the store.
    """
    live = refs.groupBy(*by, *OBJECT).agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("snapshot_id").alias("holders"))
    dead = trash.select(*by, *OBJECT).distinct().withColumn("trashed", F.lit(True))
    rows = objects.dropDuplicates([*by, *OBJECT]).join(live, [*by, *OBJECT], "left").join(dead, [*by, *OBJECT], "left")
    size, used = F.col("byte_length"), F.col("holders").isNotNull()
    total = lambda test, value=size: F.coalesce(F.sum(F.when(test, value)), F.lit(0))
    summed = rows.groupBy(*by).agg(
        total(used, size * F.col("uses")).alias("logical_bytes"),
        F.sum(size).alias("physical_bytes"),
        total(used).alias("active_bytes"),
        total(F.col("holders") > 1).alias("shared_bytes"),
        total(F.col("holders") == 1).alias("exclusive_bytes"),
        total(~used & F.col("trashed")).alias("trash_only_bytes"),
        total(~used & F.col("trashed").isNull()).alias("reclaimable_bytes"),
    )
    if quarantine is None:
        return summed
    return summed.join(quarantine.groupBy(*by).agg(F.sum("byte_length").alias("quarantine_bytes")), by, "left").fillna(0, ["quarantine_bytes"])


def server_summary(objects: DataFrame, reached: DataFrame, plan: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Per kind: objects that count (reached or planned for clean-up), stored, reached, reclaimable and quarantined objects and bytes.

    What is neither reached nor old enough to be planned is stored but not counted.
    """
    stored = objects.groupBy("kind").agg(F.sum("byte_length").alias("physical_bytes"))
    live = reached.groupBy("kind").agg(F.count(F.lit(1)).alias("reachable_objects"))
    out = plan.groupBy("kind").agg(F.count(F.lit(1)).alias("reclaimable_objects"), F.sum("byte_length").alias("reclaimable_bytes"))
    held = quarantine.groupBy("kind").agg(F.sum("byte_length").alias("quarantine_bytes"))
    rows = reduce(lambda a, b: a.join(b, "kind", "full"), (stored, live, out, held)).fillna(0)
    rows = rows.withColumn("object_count", F.col("reachable_objects") + F.col("reclaimable_objects"))
    return rows.withColumn("reachable_bytes", F.greatest(F.col("physical_bytes") - F.col("reclaimable_bytes"), F.lit(0)))


def _open_status(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit("unknown"))).isin(*FINISHED)


def protected_by(journals: DataFrame) -> DataFrame:
    """Per snapshot the unfinished operations that hold it. journals: path, body (JSON text).

    An operation without an id goes by its journal's path.
    """
    v = F.try_parse_json("body")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    rows = journals.select(F.coalesce(text("operationId"), "path").alias("op"), text("status").alias("status"), text("snapshotId").alias("snapshot_id"))
    open_ = rows.filter(_open_status(F.col("status")) & F.col("snapshot_id").isNotNull())
    return open_.groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_set("op")), ",").alias("operations"))


def recovery_points(journals: DataFrame) -> DataFrame:
    """Journals of a known kind, with status and whether they need attention.

    Kinds by their fields, in this order: provider_sync (both of its marks), import and checkout
    (any of theirs); `ambiguous` where more than one kind fits. Journals of no kind are left out,
    an operation without an id goes by its file's name.
    """
    v = F.try_parse_json("body")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    has = lambda name: F.coalesce(F.array_contains("keys", name), F.lit(False))
    fits = {"provider_sync": reduce(and_, map(has, PROVIDER_MARKS)), "import": reduce(or_, map(has, IMPORT_MARKS)), "checkout": reduce(or_, map(has, CHECKOUT_MARKS))}
    kind = F.coalesce(*(F.when(fit, F.lit(name)) for name, fit in fits.items()))
    rows = journals.withColumn("keys", F.when(v.isNotNull(), F.json_object_keys("body"))).withColumn("kind", kind).filter("kind IS NOT NULL")
    status = F.coalesce(text("status"), F.lit("unknown"))
    return rows.select(
        "path", F.coalesce(text("operationId"), F.regexp_extract("path", r"([^/\\]*?)(\.[^./\\]*)?$", 1)).alias("operation_id"), "kind", (sum((f.cast("int") for f in fits.values()), F.lit(0)) > 1).alias("ambiguous"),
        status.alias("status"), _open_status(status).alias("attention"), text("updatedAt").alias("updated_at"),
    )


def ordered_recovery(points: DataFrame, by: list[str]) -> DataFrame:
    """Points that need attention first, then the newest."""
    w = Window.partitionBy(*by).orderBy(F.desc("attention"), F.desc("updated_at"), F.desc("operation_id"))
    return points.withColumn("place", F.row_number().over(w))
