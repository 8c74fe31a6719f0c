"""Queries of paths, rules and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import paths as P
from ..operators import validate as V
from .bindings import CHUNKS_SQL, chunk_rows, table


def paths(spark, d):
    """URLs without scheme, query and fragment as paths of threads."""
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("thread_id"), F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "").alias("path"), (F.col("page_id") % 4 == 0).alias("archived"))


def rules(spark, d):
    """A rule per host that starts with m or t, and one per host and language that starts with t."""
    h = paths(spark, d).select(F.split("path", "/").alias("s"))
    one = h.select(F.get("s", F.lit(0)).alias("remote_prefix")).filter("remote_prefix RLIKE '^[mt]'")
    two = h.select(F.concat_ws("/", F.get("s", F.lit(0)), F.get("s", F.lit(1))).alias("remote_prefix")).filter("remote_prefix LIKE 't%'")
    return one.union(two).distinct().withColumn("local_prefix", F.concat(F.lit("/data/"), F.replace("remote_prefix", F.lit("/"), F.lit("_"))))


def p1_path_key(spark, d):
    p = paths(spark, d).withColumn("path", F.when(F.col("thread_id") % 3 == 0, F.concat(F.lit("\\\\?\\C:\\"), F.initcap("path"), F.lit("/"))).when(F.col("thread_id") % 3 == 1, F.concat(F.lit("\\\\?\\UNC\\Srv\\"), "path")).otherwise(F.concat("path", F.lit("//"))))
    return p.groupBy(E.path_key(F.col("path")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def p2_map_paths(spark, d):
    return P.map_paths(paths(spark, d), rules(spark, d)).select("thread_id", "path", "mapped")


def p4_canonical_paths(spark, d):
    return P.canonical_paths(paths(spark, d), rules(spark, d)).groupBy("mapped").agg(F.count(F.lit(1)).alias("n"))


def p3_ambiguous_rules(spark, d):
    r = rules(spark, d).withColumn("remote_id", F.lit("r"))
    extra = r.filter("remote_prefix LIKE 'm%'").withColumn("local_prefix", F.lit("C:\\"))
    return P.ambiguous_rules(r.unionByName(extra), ["remote_id"]).select("side", "key", "rule")


def p5_reference_paths(spark, d):
    p = paths(spark, d)
    t = p.select("thread_id", F.when(F.col("thread_id") % 5 != 0, F.col("path")).alias("source_path"), F.lit("/cwd").alias("cwd"))
    twice = p.withColumn("thread_id", F.col("thread_id") - F.when(F.col("thread_id") % 35 == 1, 1).otherwise(0)).filter("thread_id % 7 = 0")
    return P.with_reference_paths(t, twice.select("thread_id", F.upper("path").alias("source_path"))).select("thread_id", "source_path", "problem")


def p6_path_usage(spark, d):
    t = paths(spark, d).select("thread_id", F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("path"), "archived")
    return P.path_usage(t.filter("thread_id % 3 <> 0"), t, [])


def p7_classify_paths(spark, d):
    p = paths(spark, d)
    p = p.unionByName(p.filter("thread_id % 5 = 3").withColumn("path", F.concat("path", F.lit("/x"))))  # below others
    return P.classify_paths(p, rules(spark, d), p.filter("thread_id % 2 = 0").select("path")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("listed").alias("listed"))


def _roots(spark, d):
    p = paths(spark, d)
    return p.filter("thread_id % 5 = 0").select(F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("path")).union(p.select("path"))


def p8_minimal_roots(spark, d):
    return P.minimal_roots(_roots(spark, d))


def p9_path_overlap(spark, d):
    p = paths(spark, d)
    return P.path_overlap(p.filter("thread_id % 9 = 0").select(F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("path")).union(p.filter("thread_id % 10 = 1").select("path")), p.filter("thread_id % 4 = 0").select("path"))


def p10_unique_names(spark, d):
    """Per suggested name: its paths, their different names, and how many keep it."""
    names = P.unique_names(paths(spark, d).select("path").distinct(), [])
    rows = names.select(F.lower("name").alias("l"), F.lower(E.suggest_name(F.col("path"))).alias("suggested"))
    all_ = names.agg(F.count_distinct(F.lower("name")).alias("different"))
    return rows.groupBy("suggested").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("l").alias("names"), F.count_if(F.col("l") == F.col("suggested")).alias("keep")).crossJoin(F.broadcast(all_))


def p11_assign_projects(spark, d):
    t = paths(spark, d).select("thread_id", F.regexp_extract("path", r"^[^/]+(/[^/]+)?", 0).alias("path"))
    roots = rules(spark, d).filter("remote_prefix NOT LIKE '%/%'").select(F.col("remote_prefix").alias("path"))
    known = roots.select("path", F.concat(F.lit("p-"), "path").alias("project_id"))
    return P.assign_projects(t, roots, known)


def p12_explode_projects(spark, d):
    body = F.concat(F.lit('{"p'), F.col("c_custkey"), F.lit('": {"name": "'), "c_name", F.lit('", "roots": ["/a/'), "c_mktsegment", F.lit('", "/b"]}, "q": {"roots": ["/c"]}}'))
    return P.explode_projects(table(spark, d, "customer").select(F.col("c_custkey").alias("home_key"), body.alias("body")))


def p13_resolve_namespace(spark, d):
    c = table(spark, d, "customer")
    ident = c.select(
        F.col("c_custkey").alias("identity"), (F.col("c_custkey") % 2).alias("remote_id"), (F.col("c_custkey") % 17 != 0).alias("auto"), F.when(F.col("c_custkey") % 13 == 0, 99).alias("override"),
        F.when(F.col("c_custkey") % 3 == 0, 7).alias("default_ns"), (F.col("c_custkey") % 50).alias("fingerprint"), F.col("c_mktsegment").alias("provider"), F.col("c_nationkey").alias("home_key"),
    )
    k = F.col("c_custkey")
    rules_ = c.filter("c_custkey % 40 = 1 OR c_custkey % 55 = 2").select(
        k.alias("id"), (k % 2).alias("remote_id"), (k % 5).cast("int").alias("namespace_id"), F.when(k % 3 == 0, k % 50).alias("fingerprint"), F.when(k % 4 < 2, F.col("c_mktsegment")).alias("provider"), F.when(k % 5 < 2, F.col("c_nationkey")).alias("home_key"),
    )
    return P.resolve_namespace(ident, rules_)


def p14_dedupe_rules(spark, d):
    p = paths(spark, d).select(F.col("thread_id").alias("id"), F.concat(F.lit("C:/"), F.regexp_extract("path", r"^[^/]+", 0)).alias("remote_prefix"))
    r = p.withColumn("remote_prefix", F.when(F.col("id") % 2 == 0, F.upper("remote_prefix")).otherwise(F.col("remote_prefix"))).withColumn("created_at", F.col("id") % 10)
    return P.dedupe_rules(r, []).select("id", "key")


def p15_cleanup(spark, d):
    p = paths(spark, d)
    u = p.filter("thread_id % 2 = 0").select("path", F.when(F.col("archived"), 0).otherwise(1).alias("active"), F.when(F.col("archived"), 1).otherwise(0).alias("archived"))
    dirs = p.filter("thread_id % 3 = 0").select("path", F.when(F.col("thread_id") % 9 == 0, "used").otherwise("empty").alias("state"))
    return P.cleanup_candidates(u, rules(spark, d).select(F.col("remote_prefix").alias("local_prefix")).filter("local_prefix LIKE '%.com'"), p.filter("thread_id % 5 = 0").select("path", F.concat(F.lit("n"), F.col("thread_id") % 3).alias("name")), dirs, p.filter("thread_id % 11 = 0").select("path"))


def p16_search_paths(spark, d):
    e = paths(spark, d).withColumn("names", F.array(F.concat(F.lit("Name-"), F.col("thread_id"))))
    return P.search_paths(e, ~F.col("archived"), "NAME-1").select("thread_id", "path")


# Checks.


def headers(spark, d):
    """A session header per conversation; some are broken, one way per residue of the id."""
    c = table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("k"))
    k = F.col("k")
    head = F.concat(F.lit('{"type":"session_meta","payload":{"id":"t'), k - k % 2, F.lit('","cwd":"/w/'), k % 5, F.lit('","model_provider":" "}}'))
    text = (
        F.when(k % 11 == 1, "").when(k % 11 == 2, "  ").when(k % 11 == 3, '{"type":').when(k % 11 == 4, '{"type":"event"}').when(k % 11 == 5, '{"type":"session_meta","payload":{}}').when(k % 11 == 6, F.concat(F.lit("\ufeff"), head)).when(k % 11 == 8, F.concat(head, F.lit(" {}"))).when(k % 11 == 9, F.regexp_replace(head, " ", "\\\\ud800")).otherwise(head)
    )
    b = F.when(k % 11 == 7, F.unhex(F.lit("7BFF7D"))).otherwise(F.encode(text, "UTF-8"))
    return c.select(F.concat(F.when(k % 3 == 0, "archived_sessions/").otherwise("sessions/"), k).alias("path"), (k % 3 == 0).alias("archived"), F.octet_length(b).cast("long").alias("byte_length"), b.alias("header"))


def v1_classify_headers(spark, d):
    return V.classify_headers(headers(spark, d)).select("path", "kind", "thread_id", "cwd", "model_provider")


def v1_odd_headers(spark, d):
    """Headers of white space that is not a space, and ids that are no text, blank, or text between white space."""
    c = table(spark, d, "conversations").filter("turn = 0")
    k = F.col("conv_id")
    head = lambda id_: F.concat(F.lit('{"type":"session_meta","payload":{"id":'), id_, F.lit("}}"))
    text = F.when(k % 7 == 0, "\t").when(k % 7 == 1, "\u3000\u00a0").when(k % 7 == 2, head(k.cast("string"))).when(k % 7 == 3, head(F.lit('"\\t"'))).when(k % 7 == 4, head(F.lit("true"))).when(k % 7 == 5, '{"type":7,"payload":{"id":"x"}}').otherwise(head(F.concat(F.lit('" t'), k, F.lit('"'))))
    b = F.encode(text, "UTF-8")
    rows = c.select(k.cast("string").alias("path"), F.lit(False).alias("archived"), F.octet_length(b).cast("long").alias("byte_length"), b.alias("header"))
    return V.classify_headers(rows).select("path", "kind", "thread_id")


def v2_dedupe_threads(spark, d):
    return V.dedupe_threads(V.classify_headers(headers(spark, d)).filter("kind IS NULL")).select("path", "thread_id", "duplicate")


def v3_enrich(spark, d):
    r = V.classify_headers(headers(spark, d)).filter("kind IS NULL")
    i = table(spark, d, "conversations").filter("turn = 0 AND conv_id % 4 = 0").select((F.col("conv_id") * 1000).alias("updated_at_ms"), F.concat(F.lit("t"), "conv_id").alias("thread_id"), F.when(F.col("conv_id") % 8 == 0, " ").otherwise(" Title ").alias("title"), F.when(F.col("conv_id") % 3 == 1, True).alias("archived"), F.lit("/i").alias("cwd"), F.lit("p").alias("model_provider"))
    return V.enrich_with_index(r, i).select("path", "title", "archived", "cwd", "model_provider", "updated_at_ms")


def v4_warning_counts(spark, d):
    return V.warning_counts(V.classify_headers(headers(spark, d)))


def v5_dashboard(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("home_key"), F.col("doc_id").alias("thread_id"), (F.col("doc_id") % 4 == 0).alias("archived"), F.octet_length("text").cast("long").alias("byte_length"))
    return V.scan_dashboard(t, ["home_key"])


def v6_ids(spark, d):
    t = table(spark, d, "documents")
    good = E.content_id(F.col("text"))
    v = F.when(F.col("doc_id") % 4 == 0, F.upper(good)).when(F.col("doc_id") % 4 == 1, F.concat(good, F.lit("\n"))).otherwise(good)
    return t.groupBy("source").agg(F.count_if(E.is_sha256_id(v)).alias("good"), F.count_if(~E.is_sha256_id(v)).alias("bad"))


def v7_thread_refs(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("root"), F.when(F.col("doc_id") % 30 == 0, " ").otherwise((F.col("doc_id") - F.when(F.col("doc_id") % 40 == 20, 20).otherwise(0)).cast("string")).alias("thread_id"), F.when(F.col("doc_id") % 50 == 1, "x").otherwise(E.content_id(F.col("text"))).alias("hash"))
    return V.check_thread_refs(t)


def v8_manifests(spark, d):
    from ..operators.chunks import build_manifest

    m = build_manifest(chunk_rows(spark, d), ["id"]).withColumn("manifest_id", F.col("id")).withColumn("version", F.when(F.col("id") % 20 == 3, 3).otherwise(4)).withColumn("chunk_size", F.when(F.col("id") % 25 == 4, 200).otherwise(256))
    return V.check_chunk_manifests(m.withColumn("byte_length", F.col("byte_length") + F.when(F.col("id") % 33 == 5, 1).otherwise(0)), max_chunks=60)


def v10_lengths(spark, d):
    c = chunk_rows(spark, d)
    return V.conflicting_lengths(c.withColumn("byte_length", F.when(F.col("id") % 12 == 0, F.col("byte_length") + 1).otherwise(F.col("byte_length"))))


def v11_revisions(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        k.alias("id"), F.when(k % 90 == 0, 3).otherwise(4).alias("version"), F.when(k % 70 == 0, "x").otherwise("01890000-0000-7000-8000-000000000000").alias("namespace_id"), F.when(k % 60 == 0, "p").when(k % 2 == 0, E.content_id(k.cast("string"))).alias("parent_revision"),
        F.when(k % 50 == 0, "yesterday").when(k % 50 == 1, "2024-01-01").when(k % 50 == 2, "2024-01-01T00:00:00").when(k % 50 == 3, "2024-13-01T00:00:00Z").when(k % 50 == 4, "2024-01-01t00:00:00.5+02:00").otherwise("2024-01-01T00:00:00Z").alias("created_at"), F.when(k % 40 == 0, F.array(F.lit("a"), F.lit(" "))).when(k % 30 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("thread_ids"),
    )
    return V.check_revisions(e)


def v13_limits(spark, d):
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("whole", "chunk", "thread", "snapshot_overlay", "other"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return V.check_object_limits(table(spark, d, "orders").select(kinds.alias("kind"), F.col("o_orderkey").cast("string").alias("sha256"), (F.col("o_totalprice") * 60).cast("long").alias("byte_length")))


def v14_graph(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("root"), F.col("doc_id").alias("thread_id"), F.col("doc_id").cast("string").alias("descriptor"), F.col("doc_id").alias("id"), E.content_id(F.col("text")).alias("logical_sha256"), F.octet_length("text").alias("byte_length"))
    desc = docs.filter("id % 41 <> 0").select("descriptor", F.when(F.col("id") % 43 == 0, -1).otherwise(F.col("id")).alias("thread_id"), F.concat(F.lit("c"), "id").alias("content"), "logical_sha256", "byte_length")
    c = chunk_rows(spark, d)
    objects = c.filter("id % 9 <> 0 OR pos > 0").groupBy("sha256").agg((F.min("byte_length") + F.when(F.min("id") % 47 == 0, 1).otherwise(0)).alias("byte_length"))
    return V.check_graph(docs, desc, docs.filter("id % 37 <> 0").select(F.concat(F.lit("c"), "id").alias("content"), F.when(F.col("id") % 53 == 0, "x").otherwise(F.col("logical_sha256")).alias("logical_sha256"), (F.col("byte_length") + F.when(F.col("id") % 59 == 0, 1).otherwise(0)).alias("byte_length")), c, objects)


def v15_limits(spark, d):
    return V.check_revision_limits(chunk_rows(spark, d).select(F.col("snapshot_id").alias("revision"), F.col("id").alias("manifest"), "sha256"), 520, 49, 600)


def v16_safe_paths(spark, d):
    p = paths(spark, d)
    k = F.col("thread_id")
    v = F.when(k % 6 == 0, F.concat(F.lit("sessions/"), "path")).when(k % 6 == 1, F.concat(F.lit("sessions/../"), "path")).when(k % 6 == 2, F.concat(F.lit("/sessions/"), "path")).when(k % 6 == 3, F.concat(F.lit("archived_sessions/"), "path")).when(k % 6 == 4, F.lit("")).otherwise(F.col("path"))
    return p.groupBy("archived").agg(F.count_if(E.safe_relative_path(v)).alias("safe"), F.count_if(~E.safe_relative_path(v)).alias("unsafe"))


def v17_names(spark, d):
    c = table(spark, d, "customer")
    p = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("-")))).otherwise(F.col("c_name"))
    return c.select("c_custkey", E.clean_provider(p).alias("provider"), E.clean_display_name(F.concat(p, F.when(F.col("c_custkey") % 5 == 0, "\t.").otherwise(""))).alias("display_name"))


def v19_casts(spark, d):
    v = F.parse_json("props")
    e = table(spark, d, "events").select("event_type", E.lenient_integer(v, "$.k").alias("k"), E.lenient_bool(v, "$.k").alias("b"), E.lenient_string(v, "$.none").alias("s"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if("b").alias("b"), F.count("s").alias("s"))


def v19_fields(spark, d):
    """Values of every type, read as strings, integers and booleans."""
    k = F.col("event_id")
    kinds = ("5", '"5"', '" "', "true", '"true"', '"True"', "5.5", '"+7"', "null", "0", '"x"', '"5 "')
    e = table(spark, d, "events").select("event_id", F.parse_json(F.concat(F.lit('{"v": '), F.element_at(F.array(*map(F.lit, kinds)), (k % len(kinds) + 1).cast("int")), F.lit("}"))).alias("j"))
    v = F.col("j")
    return e.select("event_id", E.lenient_string(v, "$.v").alias("s"), E.lenient_integer(v, "$.v").alias("i"), E.lenient_bool(v, "$.v").alias("b"))


def n1_canonical_json(spark, d):
    text = F.concat(F.lit('{ "z": '), "props", F.lit(', "a": [1, null, {"y": 2, "b": null}] }'))
    return table(spark, d, "events").select("event_id", E.canonical_json(text).alias("canonical"))


def n17_snapshot_meta(spark, d):
    tags = F.array(F.concat(F.lit(" "), "lang", F.lit(" ")), F.col("source"), F.lit(""), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", E.clean_description(F.col("text")).alias("description"), F.array_join(E.clean_tags(tags), ",").alias("tags"))


def n18_format(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return o.select("o_orderkey", E.format_bytes(n).alias("size"), E.format_duration(F.col("o_orderkey")).alias("duration"), E.short_head(E.content_id(F.col("o_orderkey").cast("string"))).alias("head"))


def p17_path_rules(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        F.when(k % 90 == 0, "x").otherwise(F.format_string("01890000-0000-7000-8000-%012d", k - F.when(k % 100 == 51, 1).otherwise(0))).alias("id"), F.when(k % 80 == 0, " ").otherwise(F.col("c_name")).alias("label"),
        F.when(k % 70 == 0, "/a\tb").otherwise("/a").alias("remote_prefix"), F.when(k % 60 == 0, F.repeat(F.lit("x"), 1025)).otherwise("/b").alias("local_prefix"), F.when(k % 50 == 0, "then").when(k % 50 == 1, "2024").otherwise("2024-01-01T00:00:00Z").alias("created_at"),
    )
    return V.check_path_rules(c).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _uuid(n):
    return F.format_string("01890000-0000-7000-8000-%012d", n)


def p17_namespace_rules(spark, d):
    k = F.col("c_custkey")
    stamp = lambda m: F.when(k % m == 0, "2024-01-01").otherwise("2024-01-01T00:00:00Z")
    c = table(spark, d, "customer").select(
        F.when(k % 90 == 0, k.cast("string")).otherwise(_uuid(k - F.when(k % 100 == 51, 1).otherwise(0))).alias("id"), F.when(k % 85 == 0, "r").otherwise(_uuid(k % 3)).alias("remote_id"), F.when(k % 75 == 0, "n").otherwise(_uuid(k % 5)).alias("namespace_id"),
        F.when(k % 80 == 0, F.repeat(F.lit("x"), 129)).otherwise(F.col("c_name")).alias("label"),
        F.when(k % 4 == 0, F.when(k % 8 == 0, F.sha2(k.cast("string"), 256)).otherwise(F.concat(F.lit("hmac-sha256:"), F.sha2(k.cast("string"), 256)))).alias("fingerprint"), F.when(k % 5 == 0, F.when(k % 10 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))).alias("provider"),
        F.when(k % 7 != 0, F.when(k % 65 == 0, " ").otherwise(k.cast("string"))).alias("home_key"), stamp(50).alias("created_at"), stamp(55).alias("updated_at"),
    )
    return V.check_namespace_rules(c)


def p17_overrides(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(_uuid(k % 2).alias("remote_id"), F.when(k % 101 == 0, "n").otherwise(_uuid(k % 5)).alias("namespace_id"), F.when(k % 103 == 0, "\t").otherwise(F.col("o_custkey").cast("string")).alias("home_key"), F.when(k % 107 == 0, "never").otherwise("2024-01-01T00:00:00+01:00").alias("updated_at"))
    return V.check_overrides(rows).groupBy("remote_id", "home_key", "rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    p17_overrides,     p17_path_rules, p17_namespace_rules, p1_path_key, p2_map_paths, p3_ambiguous_rules, p4_canonical_paths, p5_reference_paths, p6_path_usage, p7_classify_paths, p8_minimal_roots, p9_path_overlap, p10_unique_names, p11_assign_projects,
    p12_explode_projects, p13_resolve_namespace, p14_dedupe_rules, p15_cleanup, p16_search_paths, v1_classify_headers, v1_odd_headers, v19_fields, v2_dedupe_threads, v3_enrich, v4_warning_counts, v5_dashboard, v6_ids, v7_thread_refs,
    v8_manifests, v10_lengths, v11_revisions, v13_limits, v14_graph, v15_limits, v16_safe_paths, v17_names, v19_casts, n1_canonical_json, n17_snapshot_meta, n18_format)}

_P = """p AS (SELECT page_id AS thread_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, page_id % 4 = 0 AS archived FROM pages),
  k AS (SELECT *, rtrim(path, '/') AS key FROM p),
  hosts AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM p WHERE path LIKE 'm%' OR path LIKE 't%'
            UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE path LIKE 't%')"""
_H = """h AS (SELECT conv_id AS k, CASE WHEN conv_id % 3 = 0 THEN 'archived_sessions/' ELSE 'sessions/' END || CAST(conv_id AS VARCHAR) AS path, conv_id % 3 = 0 AS archived,
    CASE conv_id % 11 WHEN 1 THEN 'empty_rollout' WHEN 2 THEN 'empty_rollout' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'missing_session_meta' WHEN 5 THEN 'missing_thread_id' WHEN 7 THEN 'invalid_utf8' WHEN 8 THEN 'invalid_json' WHEN 9 THEN 'invalid_json' END AS kind,
    't' || CAST(conv_id - conv_id % 2 AS VARCHAR) AS tid, '/w/' || CAST(conv_id % 5 AS VARCHAR) AS cwd FROM conversations WHERE turn = 0)"""

ORACLE_SQL = {
    "p1_path_key": f"""WITH {_P} SELECT CASE thread_id % 3 WHEN 0 THEN rtrim('c:/' || lower(path), '/') WHEN 1 THEN rtrim('//srv/' || lower(path), '/') ELSE key END AS key, count(*) AS n FROM k GROUP BY 1""",
    "p3_ambiguous_rules": f"""WITH {_P}, s AS (SELECT prefix, '/data/' || replace(prefix, '/', '_') AS l FROM hosts UNION ALL SELECT prefix, 'c:' FROM hosts WHERE prefix LIKE 'm%'),
        u AS (SELECT 'remote' AS side, prefix AS key FROM s UNION ALL SELECT 'local', l FROM s) SELECT side, key, 'repeated' AS rule FROM u GROUP BY side, key HAVING count(*) > 1""",
    "p10_unique_names": f"""WITH {_P}, u AS (SELECT DISTINCT path FROM p), n AS (SELECT lower(regexp_replace(regexp_replace(list_filter(string_split(path, '/'), lambda x: x <> '')[-1], '[<>:"|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS x FROM u)
        SELECT CASE WHEN coalesce(x, '') = '' THEN 'project' ELSE x END AS suggested, count(*) AS paths, count(*) AS names, CAST(1 AS BIGINT) AS keep, (SELECT count(*) FROM u) AS different FROM n GROUP BY 1""",
    "p11_assign_projects": f"""WITH {_P}, t AS (SELECT thread_id, rtrim(regexp_extract(path, '^[^/]+(/[^/]+)?'), '/') AS key FROM p), r AS (SELECT prefix FROM hosts WHERE prefix NOT LIKE '%/%'), used AS (SELECT key, count(*) AS n FROM t GROUP BY 1),
        own AS (SELECT key AS root FROM used WHERE n >= 2 OR NOT EXISTS (SELECT 1 FROM r WHERE key = prefix OR starts_with(key, prefix || '/'))), roots AS (SELECT prefix AS root FROM r UNION SELECT root FROM own),
        best AS (SELECT key, (SELECT root FROM roots WHERE key = root OR starts_with(key, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM used)
        SELECT thread_id, root, CASE WHEN root IN (SELECT prefix FROM r) THEN 'p-' || root ELSE 'local-' || substr(sha256(root), 1, 32) END AS project_id FROM t JOIN best USING (key) WHERE root IS NOT NULL""",
    "p15_cleanup": f"""WITH {_P}, u AS (SELECT key, sum(CASE WHEN archived THEN 0 ELSE 1 END) AS active, sum(CASE WHEN archived THEN 1 ELSE 0 END) AS archived FROM k WHERE thread_id % 2 = 0 GROUP BY 1), j AS (SELECT key, string_agg(DISTINCT 'n' || (thread_id % 3), ',' ORDER BY 'n' || (thread_id % 3)) AS projects FROM k WHERE thread_id % 5 = 0 GROUP BY 1),
        d AS (SELECT key, min(CASE WHEN thread_id % 9 = 0 THEN 'used' ELSE 'empty' END) AS state FROM k WHERE thread_id % 3 = 0 GROUP BY 1), a AS (SELECT key FROM u UNION SELECT key FROM j UNION SELECT key FROM d), c AS (SELECT prefix FROM hosts WHERE prefix LIKE '%.com'),
        x AS (SELECT a.key, coalesce(active, 0) AS active, coalesce(archived, 0) AS archived, projects, coalesce(state, 'missing') AS state, EXISTS (SELECT 1 FROM c WHERE a.key = prefix OR starts_with(a.key, prefix || '/')) AS covered, EXISTS (SELECT 1 FROM c WHERE a.key = prefix) AS itself,
          EXISTS (SELECT 1 FROM k q WHERE q.thread_id % 11 = 0 AND (q.key = a.key OR starts_with(a.key, q.key || '/') OR starts_with(q.key, a.key || '/'))) AS touched FROM a LEFT JOIN u USING (key) LEFT JOIN j USING (key) LEFT JOIN d USING (key))
        SELECT key, CAST(active AS BIGINT) AS active, CAST(archived AS BIGINT) AS archived, projects, state, covered, covered AND NOT itself AS inherited, active + archived = 0 AND NOT covered AND NOT touched AND (state = 'empty' OR (state = 'missing' AND projects IS NOT NULL)) AS eligible FROM x""",
    "p17_overrides": """WITH o AS (SELECT o_orderkey AS k, printf('01890000-0000-7000-8000-%012d', o_orderkey % 2) AS remote_id, CASE WHEN o_orderkey % 103 = 0 THEN chr(9) ELSE CAST(o_custkey AS VARCHAR) END AS home_key FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY remote_id, home_key) AS n FROM o),
        v AS (SELECT remote_id, home_key, unnest(list_filter([CASE WHEN k % 101 = 0 THEN 'namespace_id' END, CASE WHEN home_key = chr(9) THEN 'home_key' END, CASE WHEN k % 107 = 0 THEN 'updated_at' END, CASE WHEN n > 1 THEN 'repeated' END], lambda x: x IS NOT NULL)) AS rule FROM n) SELECT remote_id, home_key, rule, count(*) AS n FROM v GROUP BY ALL""",
    "n18_format": """WITH o AS (SELECT o_orderkey AS k, o_orderkey * o_orderkey * 37 AS n FROM orders)
        SELECT k AS o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824.0) ELSE printf('%.1f TiB', n / 1099511627776.0) END AS size,
          CASE WHEN k < 60 THEN k || ' s' ELSE (k // 60) || ' m ' || (k % 60) || ' s' END AS duration, substr(sha256(CAST(k AS VARCHAR)), 1, 12) AS head FROM o""",
    "p2_map_paths": f"""WITH {_P} SELECT thread_id, path, (SELECT '/data/' || replace(prefix, '/', '_') || substr(key, length(prefix) + 1) FROM hosts WHERE key = prefix OR starts_with(key, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1) AS mapped FROM k""",
    "p4_canonical_paths": f"""WITH {_P}, m AS (SELECT coalesce((SELECT '/data/' || replace(prefix, '/', '_') || substr(key, length(prefix) + 1) FROM hosts WHERE key = prefix OR starts_with(key, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1), path) AS mapped FROM k)
        SELECT mapped, count(*) AS n FROM m GROUP BY 1""",
    "p5_reference_paths": f"""WITH {_P}, r AS (SELECT thread_id - CASE WHEN thread_id % 35 = 1 THEN 1 ELSE 0 END AS id, upper(path) AS x FROM p), n AS (SELECT id, count(*) AS n, any_value(x) AS x FROM r WHERE id % 7 = 0 GROUP BY 1)
        SELECT thread_id, CASE WHEN n = 1 THEN x WHEN thread_id % 5 <> 0 THEN path ELSE '/cwd' END AS source_path, CASE WHEN n > 1 THEN 'duplicate_reference' END AS problem FROM p LEFT JOIN n ON id = thread_id""",
    "p6_path_usage": f"""WITH {_P}, t AS (SELECT thread_id, archived, regexp_extract(path, '^[^/]+/[^/]+') AS path FROM p) SELECT path AS key, path, count(*) FILTER (NOT archived) AS active, count(*) FILTER (archived) AS archived FROM t WHERE trim(path) <> '' GROUP BY path""",
    "p7_classify_paths": f"""WITH {_P}, q AS (SELECT key, thread_id FROM k UNION ALL SELECT rtrim(path || '/x', '/'), thread_id FROM p WHERE thread_id % 5 = 3), u AS (SELECT DISTINCT key FROM q), c AS (SELECT key, CASE WHEN EXISTS (SELECT 1 FROM hosts WHERE key = prefix OR starts_with(key, prefix || '/')) THEN 'mapped' WHEN key IN (SELECT key FROM q WHERE thread_id % 2 = 0) THEN 'existing' ELSE 'missing' END AS kind FROM u)
        SELECT kind, count(*) AS n, count(*) FILTER (kind = 'missing' AND NOT EXISTS (SELECT 1 FROM c x WHERE x.kind = 'missing' AND starts_with(c.key, x.key || '/'))) AS listed FROM c GROUP BY kind""",
    "p8_minimal_roots": f"""WITH {_P}, r AS (SELECT path FROM p UNION ALL SELECT regexp_extract(path, '^[^/]+/[^/]+') FROM p WHERE thread_id % 5 = 0), u AS (SELECT rtrim(path, '/') AS key, min(path) AS path FROM r GROUP BY 1)
        SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.key <> '' AND starts_with(u.key, x.key || '/'))""",
    "p9_path_overlap": f"""WITH {_P}, a AS (SELECT DISTINCT rtrim(x, '/') AS a FROM (SELECT regexp_extract(path, '^[^/]+/[^/]+') AS x FROM p WHERE thread_id % 9 = 0 UNION ALL SELECT path FROM p WHERE thread_id % 10 = 1)), b AS (SELECT DISTINCT key AS b FROM k WHERE thread_id % 4 = 0)
        SELECT a, b, CASE WHEN a = b THEN 'same' WHEN starts_with(a, b || '/') THEN 'child' ELSE 'parent' END AS relation FROM a, b WHERE a <> '' AND b <> '' AND (a = b OR starts_with(a, b || '/') OR starts_with(b, a || '/'))""",
    "p12_explode_projects": """SELECT c_custkey AS home_key, 'p' || CAST(c_custkey AS VARCHAR) AS project_id, c_name AS name, unnest(['/a/' || c_mktsegment, '/b']) AS root FROM customer UNION ALL SELECT c_custkey, 'q', 'q', '/c' FROM customer""",
    "p13_resolve_namespace": """WITH r AS (SELECT c_custkey AS id, c_custkey % 2 AS remote_id, CAST(c_custkey % 5 AS INT) AS ns, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END AS f, CASE WHEN c_custkey % 4 < 2 THEN c_mktsegment END AS p, CASE WHEN c_custkey % 5 < 2 THEN c_nationkey END AS h
          FROM customer WHERE c_custkey % 40 = 1 OR c_custkey % 55 = 2),
        s AS (SELECT c_custkey AS identity, r.id, r.ns, CASE WHEN f IS NULL THEN 0 ELSE 4 END + CASE WHEN p IS NULL THEN 0 ELSE 2 END + CASE WHEN h IS NULL THEN 0 ELSE 1 END AS score FROM customer c JOIN r ON c.c_custkey % 2 = r.remote_id
          AND (f IS NULL OR f = c_custkey % 50) AND (p IS NULL OR p = c_mktsegment) AND (h IS NULL OR h = c_nationkey) WHERE NOT (f IS NULL AND p IS NULL AND h IS NULL)),
        b AS (SELECT identity, count(DISTINCT ns) AS n, arg_min(ns, id) AS rule_ns, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS rules FROM (SELECT *, rank() OVER (PARTITION BY identity ORDER BY score DESC) AS rk FROM s) WHERE rk = 1 GROUP BY 1),
        o AS (SELECT c_custkey AS identity, CASE WHEN c_custkey % 17 = 0 THEN 'default' WHEN c_custkey % 13 = 0 THEN 'override' WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'rule' WHEN c_custkey % 3 = 0 THEN 'default' ELSE 'none' END AS kind, rule_ns, rules FROM customer LEFT JOIN b ON identity = c_custkey)
        SELECT identity, kind, CASE kind WHEN 'override' THEN 99 WHEN 'rule' THEN rule_ns WHEN 'default' THEN CASE WHEN identity % 3 = 0 THEN 7 END END AS namespace_id, CASE WHEN kind = 'ambiguous' THEN rules END AS rules FROM o""",
    "p14_dedupe_rules": f"""WITH {_P}, r AS (SELECT thread_id AS id, 'C:/' || regexp_extract(path, '^[^/]+') AS x FROM p), s AS (SELECT id, CASE WHEN id % 2 = 0 THEN upper(x) ELSE x END AS x, lower(x) AS key FROM r),
        t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id % 10, id) AS rn, (SELECT count(DISTINCT x) FROM s q WHERE q.key = s.key) AS v FROM s) SELECT id, key FROM t WHERE v = 1 OR rn = 1""",
    "p16_search_paths": f"WITH {_P} SELECT thread_id, path FROM p WHERE NOT archived AND (lower(path) LIKE '%name-1%' OR CAST(thread_id AS VARCHAR) LIKE '1%')",
    "p17_path_rules": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 90 = 0 THEN 'x' ELSE CAST(c_custkey - CASE WHEN c_custkey % 100 = 51 THEN 1 ELSE 0 END AS VARCHAR) END AS id FROM customer),
        n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM c), v AS (SELECT 'id' AS rule FROM n WHERE id = 'x' UNION ALL SELECT 'repeated_id' FROM n WHERE n > 1 UNION ALL SELECT 'label' FROM n WHERE k % 80 = 0 UNION ALL SELECT 'remote_prefix' FROM n WHERE k % 70 = 0
          UNION ALL SELECT 'local_prefix' FROM n WHERE k % 60 = 0 UNION ALL SELECT 'created_at' FROM n WHERE k % 50 < 2)
        SELECT rule, count(*) AS n FROM v GROUP BY rule""",
    "p17_namespace_rules": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 90 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE printf('01890000-0000-7000-8000-%012d', c_custkey - CASE WHEN c_custkey % 100 = 51 THEN 1 ELSE 0 END) END AS id, CASE WHEN c_custkey % 85 = 0 THEN 'r' ELSE CAST(c_custkey % 3 AS VARCHAR) END AS r,
          CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS f, CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) END AS p, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 65 = 0 THEN ' ' ELSE CAST(c_custkey AS VARCHAR) END END AS h FROM customer),
        n AS (SELECT *, count(*) OVER (PARTITION BY r, f, p, h) AS same, count(*) OVER (PARTITION BY id) AS twice FROM c)
        SELECT id, unnest(list_filter([CASE WHEN k % 90 = 0 THEN 'id' END, CASE WHEN r = 'r' THEN 'remote_id' END, CASE WHEN k % 75 = 0 THEN 'namespace_id' END, CASE WHEN twice > 1 THEN 'repeated_id' END, CASE WHEN k % 80 = 0 THEN 'label' END, CASE WHEN f IS NULL AND p IS NULL AND h IS NULL THEN 'no_condition' END,
          CASE WHEN k % 8 = 0 THEN 'fingerprint' END, CASE WHEN k % 10 = 0 THEN 'provider' END, CASE WHEN h = ' ' THEN 'home_key' END, CASE WHEN k % 50 = 0 THEN 'created_at' END, CASE WHEN k % 55 = 0 THEN 'updated_at' END, CASE WHEN same > 1 THEN 'same_conditions' END], lambda x: x IS NOT NULL)) AS rule FROM n""",
    "v1_classify_headers": f"WITH {_H} SELECT path, kind, CASE WHEN kind IS NULL THEN tid END AS thread_id, CASE WHEN kind IS NULL THEN cwd END AS cwd, CAST(NULL AS VARCHAR) AS model_provider FROM h",
    "v2_dedupe_threads": f"WITH {_H} SELECT path, tid AS thread_id, row_number() OVER (PARTITION BY tid ORDER BY archived, path) > 1 AS duplicate FROM h WHERE kind IS NULL",
    "v3_enrich": f"""WITH {_H}, i AS (SELECT 't' || CAST(conv_id AS VARCHAR) AS tid, conv_id FROM conversations WHERE turn = 0 AND conv_id % 4 = 0)
        SELECT path, CASE WHEN conv_id % 8 = 4 THEN 'Title' ELSE h.tid END AS title, CASE WHEN conv_id % 3 = 1 THEN true ELSE archived END AS archived, CASE WHEN conv_id IS NOT NULL THEN '/i' ELSE cwd END AS cwd, CASE WHEN conv_id IS NOT NULL THEN 'p' END AS model_provider, conv_id * 1000 AS updated_at_ms
        FROM h LEFT JOIN i ON h.tid = i.tid WHERE kind IS NULL""",
    "v4_warning_counts": f"WITH {_H} SELECT kind, count(*) AS n FROM h WHERE kind IS NOT NULL GROUP BY 1",
    "v5_dashboard": """WITH t AS (SELECT source AS home_key, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
        SELECT home_key, count(*) FILTER (doc_id % 4 <> 0) AS active, count(*) FILTER (doc_id % 4 = 0) AS archived, count(*) AS total, CAST(sum(n) AS BIGINT) AS bytes, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (rn <= 8) AS previews FROM t GROUP BY 1""",
    "v6_ids": "SELECT source, count(*) FILTER (doc_id % 4 > 1) AS good, count(*) FILTER (doc_id % 4 < 2) AS bad FROM documents GROUP BY 1",
    "v7_thread_refs": """WITH t AS (SELECT source AS root, CASE WHEN doc_id % 30 = 0 THEN ' ' ELSE CAST(doc_id - CASE WHEN doc_id % 40 = 20 THEN 20 ELSE 0 END AS VARCHAR) END AS thread_id, doc_id % 50 = 1 AS bad FROM documents),
        n AS (SELECT *, count(*) OVER (PARTITION BY root, thread_id) AS n FROM t) SELECT root, thread_id, 'blank_id' AS rule FROM n WHERE thread_id = ' ' UNION ALL SELECT root, thread_id, 'bad_hash' FROM n WHERE bad UNION ALL SELECT root, thread_id, 'duplicate' FROM n WHERE n > 1""",
    "v8_manifests": f"""WITH {CHUNKS_SQL}, m AS (SELECT id, list(byte_length ORDER BY pos) AS s, sum(byte_length) AS t, CASE WHEN id % 25 = 4 THEN 200 ELSE 256 END AS size FROM chunks GROUP BY id)
        SELECT id AS manifest_id, 'version' AS rule FROM m WHERE id % 20 = 3 UNION ALL SELECT id, 'chunk_length' FROM m WHERE list_max(s) > size UNION ALL SELECT id, 'short_chunk' FROM m WHERE size = 200 AND len(s) > 1
        UNION ALL SELECT id, 'total' FROM m WHERE id % 33 = 5 UNION ALL SELECT id, 'count' FROM m WHERE len(s) > 60""",
    "v10_lengths": f"WITH {CHUNKS_SQL}, c AS (SELECT sha256, byte_length + CASE WHEN id % 12 = 0 THEN 1 ELSE 0 END AS n FROM chunks) SELECT sha256, count(DISTINCT n) AS lengths, min(n) AS least FROM c GROUP BY 1 HAVING count(DISTINCT n) > 1",
    "v11_revisions": """SELECT event_id AS id, unnest(list_filter([CASE WHEN event_id % 90 = 0 THEN 'version' END, CASE WHEN event_id % 70 = 0 THEN 'namespace' END, CASE WHEN event_id % 60 = 0 THEN 'parent' END, CASE WHEN event_id % 50 < 4 THEN 'created_at' END,
        CASE WHEN event_id % 40 = 0 THEN 'blank_thread' END, CASE WHEN event_id % 40 <> 0 AND event_id % 30 = 0 THEN 'repeated_thread' END], lambda x: x IS NOT NULL)) AS rule FROM events""",
    "v13_limits": """WITH o AS (SELECT ['whole', 'chunk', 'thread', 'snapshot_overlay', 'other'][o_orderkey % 5 + 1] AS kind, CAST(o_orderkey AS VARCHAR) AS sha256, CAST(trunc(o_totalprice * 60) AS BIGINT) AS n FROM orders)
        SELECT kind, sha256, 'kind' AS rule FROM o WHERE kind = 'other' UNION ALL SELECT kind, sha256, 'size' FROM o WHERE (kind = 'chunk' AND n > 4194304) OR (kind IN ('thread', 'snapshot_overlay') AND n > 16777216) UNION ALL SELECT kind, sha256, 'local_only' FROM o WHERE kind = 'snapshot_overlay'""",
    "v14_graph": f"""WITH {CHUNKS_SQL}, o AS (SELECT sha256, min(byte_length) + CASE WHEN min(id) % 47 = 0 THEN 1 ELSE 0 END AS n FROM chunks WHERE id % 9 <> 0 OR pos > 0 GROUP BY 1)
        SELECT CAST(doc_id AS VARCHAR) AS key, 'no_descriptor' AS rule FROM documents WHERE doc_id % 41 = 0 UNION SELECT CAST(doc_id AS VARCHAR), 'descriptor_id' FROM documents WHERE doc_id % 41 <> 0 AND doc_id % 43 = 0
        UNION SELECT 'c' || CAST(doc_id AS VARCHAR), 'no_manifest' FROM documents WHERE doc_id % 41 <> 0 AND doc_id % 37 = 0
        UNION SELECT 'c' || CAST(doc_id AS VARCHAR), 'manifest_identity' FROM documents WHERE doc_id % 41 <> 0 AND doc_id % 37 <> 0 AND (doc_id % 53 = 0 OR doc_id % 59 = 0) UNION SELECT c.sha256, CASE WHEN o.sha256 IS NULL THEN 'no_chunk' ELSE 'chunk_length' END FROM chunks c LEFT JOIN o ON c.sha256 = o.sha256 WHERE o.sha256 IS NULL OR o.n <> c.byte_length""",
    "v15_limits": f"""WITH {CHUNKS_SQL}, s AS (SELECT snapshot_id AS revision, count(*) AS r, count(DISTINCT id) AS m FROM chunks GROUP BY 1)
        SELECT revision, 'references' AS rule FROM s WHERE r > 520 UNION ALL SELECT revision, 'manifests' FROM s WHERE m > 49 UNION ALL SELECT revision, 'total' FROM s WHERE r > 600""",
    "v16_safe_paths": "SELECT page_id % 4 = 0 AS archived, count(*) FILTER (page_id % 6 IN (0, 3)) AS safe, count(*) FILTER (page_id % 6 NOT IN (0, 3)) AS unsafe FROM pages GROUP BY 1",
    "v17_names": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', '-') END AS provider, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', '-') ELSE c_name END END AS display_name FROM customer""",
    "v1_odd_headers": """SELECT CAST(conv_id AS VARCHAR) AS path, CASE conv_id % 7 WHEN 0 THEN 'empty_rollout' WHEN 1 THEN 'empty_rollout' WHEN 2 THEN 'missing_thread_id' WHEN 3 THEN 'missing_thread_id' WHEN 4 THEN 'missing_thread_id' WHEN 5 THEN 'missing_session_meta' END AS kind,
        CASE WHEN conv_id % 7 = 6 THEN ' t' || conv_id END AS thread_id FROM conversations WHERE turn = 0""",
    "v19_fields": """SELECT event_id, CASE event_id % 12 WHEN 1 THEN '5' WHEN 4 THEN 'true' WHEN 5 THEN 'True' WHEN 7 THEN '+7' WHEN 10 THEN 'x' WHEN 11 THEN '5 ' END AS s,
        CAST(CASE event_id % 12 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 7 THEN 7 WHEN 9 THEN 0 END AS BIGINT) AS i, CASE event_id % 12 WHEN 0 THEN true WHEN 3 THEN true WHEN 4 THEN true WHEN 9 THEN false END AS b FROM events""",
    "v19_casts": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) <> 0) AS b, CAST(0 AS BIGINT) AS s FROM events GROUP BY 1",
    "n1_canonical_json": """SELECT event_id, '{"a":[1,null,{"b":null,"y":2}],"z":' || replace(props, ' ', '') || '}' AS canonical FROM events""",
    "n17_snapshot_meta": """SELECT doc_id, substr(trim(text), 1, 500) AS description, CASE WHEN lang < source THEN lang || ',' || source ELSE source || ',' || lang END AS tags FROM documents""",
}
