"""Checks that return violations as rows: key, rule and detail; one bad archive never stops the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clean_provider, is_rfc3339, is_sha256_id, json_string, lenient_string, trimmed
from .normalize import is_json

MIB = 1 << 20
#: Bytes allowed per kind of object.
MAX_BYTES = {"whole": 64 << 30, "chunk": 4 * MIB, "chunk_manifest": 16 * MIB, "thread": 16 * MIB, "revision_root": 16 * MIB, "snapshot_overlay": 16 * MIB}
HEADER_BYTES = MIB
TIMES = ("created_at_ms", "updated_at_ms")
MAX_REFERENCES, MAX_MANIFESTS, MAX_TOTAL = 500_000, 10_000, 20_000
FINGERPRINT = r"\Ahmac-sha256:[0-9a-f]{64}\z"
UUID7 = r"\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row per key and failed rule; a null test counts as failed."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items())))
    return df.select(*keys, F.explode(failed).alias("rule"))


def classify_headers(files: DataFrame) -> DataFrame:
    """Warning kind or header fields of each file; the first check that fails names the kind.

    files: path, archived, byte_length, header (binary, the first line). Whether a header is JSON
    is asked of a strict parser, which takes one value and nothing behind it.
    """
    text = F.regexp_replace(F.decode("header", "UTF-8"), "^\ufeff", "")
    rows = files.withColumn("valid_text", F.is_valid_utf8(F.col("header").cast("string"))).withColumn("text", F.when(F.col("valid_text"), text))
    v = F.when(is_json(F.col("text")), F.try_parse_json("text"))
    rows = rows.withColumn("type", json_string(v, "$.type")).withColumn("ok", v.isNotNull())
    rows = rows.withColumns({c: lenient_string(v, f"$.payload.{name}") for c, name in (("thread_id", "id"), ("cwd", "cwd"), ("model_provider", "model_provider"))})
    kind = (
        F.when(F.col("byte_length") == 0, "empty_rollout")
        .when(F.octet_length("header") > HEADER_BYTES, "invalid_json")
        .when(~F.col("valid_text"), "invalid_utf8")
        .when(trimmed(F.col("text")) == "", "empty_rollout")
        .when(~F.col("ok"), "invalid_json")
        .when(~F.col("type").eqNullSafe(F.lit("session_meta")), "missing_session_meta")
        .when(F.col("thread_id").isNull(), "missing_thread_id")
    )
    good = lambda c: F.when(kind.isNull(), F.col(c)).alias(c)
    return rows.select("path", "archived", "byte_length", kind.alias("kind"), good("thread_id"), good("cwd"), good("model_provider"))


def dedupe_threads(valid: DataFrame) -> DataFrame:
    """`duplicate` on all but the first file of a thread; active files stand before archived ones."""
    w = Window.partitionBy("thread_id").orderBy("archived", "path")
    return valid.withColumn("duplicate", F.row_number().over(w) > 1)


def enrich_with_index(rollouts: DataFrame, index: DataFrame) -> DataFrame:
    """Index values where there are any, else the file's; the title falls back to the id, and the index' times are taken over."""
    i = index.select("thread_id", *(F.col(c).alias(f"i_{c}") for c in ("title", "archived", "cwd", "model_provider")), *(c for c in TIMES if c in index.columns))
    rows = rollouts.join(i, "thread_id", "left")
    title = F.coalesce(F.when(trimmed(F.col("i_title")) != "", trimmed(F.col("i_title"))), F.col("thread_id").cast("string"))
    pick = lambda c: F.coalesce(f"i_{c}", c).alias(c)
    return rows.select("thread_id", "path", "byte_length", title.alias("title"), pick("archived"), pick("cwd"), pick("model_provider"), *(c for c in TIMES if c in index.columns))


def warning_counts(classified: DataFrame) -> DataFrame:
    return classified.filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scan_dashboard(threads: DataFrame, by: list[str], previews: int = 8) -> DataFrame:
    """Counts, bytes and the first previews (by id) of each home."""
    first = threads.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("thread_id"))).filter(F.col("rn") <= previews)
    listed = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("thread_id")), lambda x: x.cast("string")), ",").alias("previews"))
    sums = threads.groupBy(*by).agg(F.count_if(~F.col("archived")).alias("active"), F.count_if("archived").alias("archived"), F.count(F.lit(1)).alias("total"), F.sum("byte_length").alias("bytes"))
    return sums.join(listed, by)


def check_thread_refs(refs: DataFrame) -> DataFrame:
    """blank ids, malformed hashes and ids that a root lists twice. refs: root, thread_id, hash."""
    n = F.count(F.lit(1)).over(Window.partitionBy("root", "thread_id"))
    rows = refs.withColumn("n", n)
    return violations(rows, ["root", "thread_id"], {"blank_id": trimmed(F.col("thread_id").cast("string")) == "", "bad_hash": ~is_sha256_id(F.col("hash")), "duplicate": F.col("n") > 1})


def check_chunk_manifests(manifests: DataFrame, version: int = 4, max_chunk: int = 4 * MIB, max_chunks: int = 16_384) -> DataFrame:
    """manifest_id, version, chunk_size, byte_length, chunks (array of pos, sha256, byte_length)."""
    size, chunks = F.col("chunk_size"), F.col("chunks")
    sizes = F.transform(chunks, lambda c: c["byte_length"])
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    return violations(
        manifests,
        ["manifest_id"],
        {
            "version": F.col("version") != version,
            "chunk_size": (size <= 0) | (size > max_chunk),
            "chunk_hash": ~F.forall(chunks, lambda c: is_sha256_id(c["sha256"])),
            "chunk_length": ~F.forall(sizes, lambda n: (n > 0) & (n <= size)),
            "short_chunk": ~F.forall(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))), lambda n: n == size),
            "total": total != F.col("byte_length"),
            "count": F.size(chunks) > max_chunks,
        },
    )


def conflicting_lengths(objects: DataFrame) -> DataFrame:
    """Hashes declared with more than one length."""
    return objects.groupBy("sha256").agg(F.count_distinct("byte_length").alias("lengths"), F.min("byte_length").alias("least")).filter("lengths > 1")


def check_revisions(revisions: DataFrame) -> DataFrame:
    """id, version, namespace_id, parent_revision, created_at (text), thread_ids (array)."""
    ids = F.col("thread_ids")
    return violations(
        revisions,
        ["id"],
        {
            "version": F.col("version") != 4,
            "namespace": ~F.coalesce(F.col("namespace_id").rlike(UUID7), F.lit(False)),
            "parent": F.col("parent_revision").isNotNull() & ~is_sha256_id(F.col("parent_revision")),
            "created_at": ~is_rfc3339(F.col("created_at")),
            "blank_thread": F.exists(ids, lambda x: trimmed(x) == ""),
            "repeated_thread": F.size(F.array_distinct(ids)) != F.size(ids),
        },
    )


def check_revision_threads(threads: DataFrame) -> DataFrame:
    """revision, thread_id, schema_version, sha256, media_type of the threads and attachments that revisions list."""
    return violations(
        threads,
        ["revision", "thread_id"],
        {
            "thread_version": F.col("schema_version") != 4,
            "blank_thread": trimmed(F.col("thread_id").cast("string")) == "",
            "object_hash": ~is_sha256_id(F.col("sha256")),
            "media_type": trimmed(F.col("media_type").cast("string")) == "",
        },
    )


def check_descriptors(d: DataFrame) -> DataFrame:
    """id, schema_version, normalization_version, thread_id, related (array of table names) and the content reference: media_type, logical_sha256, byte_length, storage_kind, storage_sha256."""
    return violations(
        d,
        ["id"],
        {
            "version": (F.col("schema_version") != 4) | (F.col("normalization_version") != 1),
            "blank_id": trimmed(F.col("thread_id").cast("string")) == "",
            "media_type": trimmed(F.col("media_type").cast("string")) == "",
            "hash": ~is_sha256_id(F.col("logical_sha256")),
            "byte_length": (F.col("byte_length") < 0) | (F.col("byte_length") > MAX_BYTES["whole"]),
            "storage_kind": ~F.col("storage_kind").isin("whole", "chunked"),
            "storage_hash": ~is_sha256_id(F.col("storage_sha256")),
            "whole_is_content": (F.col("storage_kind") == "whole") & (F.col("storage_sha256") != F.col("logical_sha256")),
            "forbidden_table": F.array_contains("related", "thread_timeline_ledger"),
        },
    )


def check_object_limits(objects: DataFrame, remote: bool = True) -> DataFrame:
    """Objects over their kind's bytes, of unknown kind, or (remote) overlays, which stay local."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in MAX_BYTES.items() for x in kv)), F.col("kind"))
    rules = {"kind": limit.isNull(), "size": limit.isNotNull() & (F.col("byte_length") > limit)}
    if remote:
        rules["local_only"] = F.col("kind") == "snapshot_overlay"
    return violations(objects, ["kind", "sha256"], rules)


def check_graph(refs: DataFrame, descriptors: DataFrame, manifests: DataFrame, chunk_refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Broken links: refs without descriptor or with another's id, contents without manifest or with one of another identity, chunks that are absent or of another length.

    refs: root, thread_id, descriptor; descriptors: descriptor, thread_id, content, logical_sha256,
    byte_length; manifests: content, logical_sha256, byte_length; chunk_refs: content, sha256,
    byte_length; objects: sha256, byte_length.
    """
    d = descriptors.select("descriptor", F.col("thread_id").alias("own_id"), F.lit(True).alias("hit"))
    a = refs.join(d, "descriptor", "left")
    a = a.select(F.col("descriptor").alias("key"), F.when(F.col("hit").isNull(), "no_descriptor").when(F.col("own_id") != F.col("thread_id"), "descriptor_id").alias("rule"))
    m = manifests.select("content", F.col("logical_sha256").alias("own_hash"), F.col("byte_length").alias("own_length"), F.lit(True).alias("hit"))
    other = ~F.col("own_hash").eqNullSafe(F.col("logical_sha256")) | ~F.col("own_length").eqNullSafe(F.col("byte_length"))
    b = descriptors.join(m, "content", "left").select(F.col("content").alias("key"), F.when(F.col("hit").isNull(), "no_manifest").when(other, "manifest_identity").alias("rule"))
    o = objects.select("sha256", F.col("byte_length").alias("stored"), F.lit(True).alias("hit"))
    c = chunk_refs.join(o, "sha256", "left")
    c = c.select(F.col("sha256").alias("key"), F.when(F.col("hit").isNull(), "no_chunk").when(F.col("stored") != F.col("byte_length"), "chunk_length").alias("rule"))
    return a.unionByName(b).unionByName(c).filter("rule IS NOT NULL").distinct()


def check_revision_limits(refs: DataFrame, max_references: int = MAX_REFERENCES, max_manifests: int = MAX_MANIFESTS, max_total: int = MAX_TOTAL) -> DataFrame:
    """Revisions whose graph is too large. refs: revision, manifest, sha256."""
    sums = refs.groupBy("revision", "manifest").agg(F.count(F.lit(1)).alias("n")).groupBy("revision").agg(F.sum("n").alias("references"), F.count("manifest").alias("manifests"))
    return violations(sums, ["revision"], {"references": F.col("references") > max_references, "manifests": F.col("manifests") > max_manifests, "total": F.col("references") > max_total})


def complete_only(snapshots: DataFrame) -> DataFrame:
    """Snapshots without warnings; only those may be published or applied."""
    return snapshots.filter("warning_count = 0")


def _not_uuid7(c: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(UUID7), F.lit(False))


def _bad_text(c: str, most: int) -> Column:
    """Blank, longer than `most` characters or with control characters; null is bad."""
    text = trimmed(F.col(c))
    return F.coalesce((F.char_length(text) < 1) | (F.char_length(text) > most) | F.col(c).rlike(r"\p{Cc}"), F.lit(True))


def check_path_rules(rules: DataFrame) -> DataFrame:
    """id, label, remote_prefix, local_prefix, created_at (text) of mapping rules."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return violations(
        rules.withColumn("n", n),
        ["id"],
        {
            "id": _not_uuid7("id"),
            "repeated_id": F.col("n") > 1,
            "label": _bad_text("label", 128),
            "remote_prefix": _bad_text("remote_prefix", 1024),
            "local_prefix": _bad_text("local_prefix", 1024),
            "created_at": ~is_rfc3339(F.col("created_at")),
        },
    )


def check_namespace_rules(rules: DataFrame) -> DataFrame:
    """id, remote_id, namespace_id, label, fingerprint, provider, home_key, created_at, updated_at of selection rules; null conditions are not set."""
    conditions = ["remote_id", "fingerprint", "provider", "home_key"]
    rows = rules.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(*conditions))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    set_ = lambda c: F.col(c).isNotNull()
    return violations(
        rows,
        ["id"],
        {
            "id": _not_uuid7("id"),
            "remote_id": _not_uuid7("remote_id"),
            "namespace_id": _not_uuid7("namespace_id"),
            "repeated_id": F.col("n") > 1,
            "label": _bad_text("label", 128),
            "no_condition": F.coalesce("fingerprint", "provider", "home_key").isNull(),
            "fingerprint": set_("fingerprint") & ~F.col("fingerprint").rlike(FINGERPRINT),
            "provider": set_("provider") & ~clean_provider(F.col("provider"), lower=True).eqNullSafe(F.col("provider")),
            "home_key": set_("home_key") & _bad_text("home_key", 1 << 30),
            "created_at": ~is_rfc3339(F.col("created_at")),
            "updated_at": ~is_rfc3339(F.col("updated_at")),
            "same_conditions": F.col("same") > 1,
        },
    )


def check_overrides(overrides: DataFrame) -> DataFrame:
    """remote_id, namespace_id, home_key, updated_at of manual overrides; a remote overrides a home once."""
    rows = overrides.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("remote_id", "home_key")))
    return violations(
        rows,
        ["remote_id", "home_key"],
        {
            "remote_id": _not_uuid7("remote_id"),
            "namespace_id": _not_uuid7("namespace_id"),
            "home_key": _bad_text("home_key", 1 << 30),
            "updated_at": ~is_rfc3339(F.col("updated_at")),
            "repeated": F.col("n") > 1,
        },
    )
