"""Queries of lines, normal forms, sources and rates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import chunks as C
from ..operators import normalize as N
from ..operators import validate as V
from ..sources import rollouts as S
from ..sources.refresh import refresh_snapshot
from ..sources.scratch import rewritten, shared_dir
from ..streaming import streams as T
from .bindings import REVISIONS_SQL, table
from .graph_queries import commit_log

#: Requests of a namespace in one batch of the commit stream, at most.
AT_ONCE = 1 << 20


def contents(spark, d):
    """A JSONL file per conversation: a header, then a record per turn; every 7th has a broken line, every 5th a nested session."""
    c = table(spark, d, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("type"), "text", "turn"))
    body = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), F.lit("bad-json")).when(
        (F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.lit('{"type": "session_meta", "payload": {"model_provider": "q", "id": "other"}}')
    ).otherwise(line)
    turns = F.array_sort(F.collect_list(F.struct("turn", body.alias("body"))))
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["body"]), "\r\n").alias("rest"))
    head = F.concat(F.lit('{"payload": {"id": "t'), "conv_id", F.lit('", "model_provider": "p'), F.col("conv_id") % 3, F.lit('", "cwd": "/home/u'), F.col("conv_id") % 4, F.lit('"}, "type": "session_meta"}'))
    return rows.select(F.concat(F.lit("sessions/rollout-t"), "conv_id", F.lit(".jsonl")).alias("file"), F.concat(F.lit("t"), "conv_id").alias("thread_id"), F.encode(F.concat(head, F.lit("\n"), "rest"), "UTF-8").alias("content"))


def _lines(spark, d):
    return S.split_lines(contents(spark, d))


def s1_rollout_files(spark, d):
    """Conversations written as files, 40 of them, some archived, and found again with their sizes and places."""
    c = table(spark, d, "conversations").withColumn("bucket", F.col("conv_id") % 40)
    root = f"{shared_dir(spark)}/home-{uuid.uuid4().hex}"
    for archived, place in ((True, "archived_sessions"), (False, "sessions")):
        rows = c.filter((F.col("bucket") % 3 == 0) == archived)
        rows.repartition("bucket").select("bucket", "text").write.partitionBy("bucket").text(f"{root}/{place}")
    files = S.read_rollout_files(spark, root, glob="part-*")
    found = files.groupBy(F.regexp_extract("path", r"bucket=(\d+)/", 1).cast("long").alias("bucket"), "archived").agg(F.sum("byte_length").alias("byte_length"))
    turns = c.groupBy("bucket").agg(F.count(F.lit(1)).alias("turns"))
    return found.join(turns, "bucket")


def s2_split_lines(spark, d):
    """Lines and endings per file, and whether they make up all of its bytes."""
    c = contents(spark, d)
    rows = S.split_lines(c).groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("ending") == "\r\n").alias("crlf"), F.count_if(F.col("ending") == "\n").alias("lf"), F.sum(F.octet_length("raw") + F.length("ending")).alias("bytes")
    )
    return rows.join(c.select("thread_id", F.octet_length("content").alias("size")), "thread_id").select("thread_id", "lines", "crlf", "lf", (F.col("bytes") == F.col("size")).alias("whole"))


def n10_chunk_lines(spark, d):
    """Chunks of 100 bytes of documents made from lines, against those made from whole contents."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("thread_id"), F.encode("text", "UTF-8").alias("content"))
    one = C.chunk_lines(S.split_lines(c), ["thread_id"], 100).select("thread_id", "pos", "byte_length", "sha256")
    two = C.chunk(c.select("thread_id", "content"), 100).select("thread_id", "pos", F.col("sha256").alias("whole"))
    both = one.join(two, ["thread_id", "pos"], "full")
    return both.groupBy("thread_id").agg(F.count_if(F.col("sha256") == F.col("whole")).alias("alike"), (F.count(F.lit(1)) - F.count_if(F.col("byte_length") == 100)).alias("short"), F.count_if(~F.col("sha256").eqNullSafe(F.col("whole"))).alias("other"))


def _odd_lines(spark, d):
    """A line per event, of every kind that the rules know: session records, broken ones, half surrogates, numbers that JSON does not have, other records."""
    k = F.col("event_id")
    head = F.concat(F.lit('{"type": "session_meta", "payload": {"id": "t'), k, F.lit('", "model_provider": "p", "z": [1, {"b": null, "a": "\\u00e9"}]}}'))
    raw = (
        F.when(k % 10 == 1, '{"type": "session_meta", "payload": {"id": "\\ud800"}}').when(k % 10 == 2, '{"type": "session_meta", "payload": {"id": "a", "n": NaN}}').when(k % 10 == 3, '{"type": "session_meta"} {}')
        .when(k % 10 == 4, '{"type": "session_meta", "payload": 3}').when(k % 10 == 5, "  ").when(k % 10 == 6, F.concat(F.lit('{"type": "event", "props": '), "props", F.lit(" }"))).when(k % 10 == 7, "[1, 2]").otherwise(head)
    )
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.concat(F.lit("t"), k - F.when(k % 10 == 9, 1).otherwise(0)).alias("thread_id"), F.when(k % 20 < 10, 0).otherwise(k).cast("long").alias("line_no"), F.encode(raw, "UTF-8").alias("raw"), F.lit("\n").alias("ending"), k.alias("k"))


def n3_normalize(spark, d):
    """Every line as it leaves, with its warning."""
    rows = _odd_lines(spark, d)
    out = N.normalize_lines(rows.withColumn("file", F.col("k").cast("string")))
    return out.select(F.col("file").cast("long").alias("k"), F.col("raw").cast("string").alias("raw"), "warning")


def n3_accepted(spark, d):
    """Threads with a broken header go as a whole."""
    n = N.accepted_lines(N.normalize_lines(S.split_lines(contents(spark, d).withColumn("thread_id", F.when(F.substring("thread_id", 2, 20).cast("long") % 6 == 0, "tx").otherwise(F.col("thread_id"))))))
    return n.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("warning") == "invalid_json").alias("invalid"), F.count_if(F.col("raw").cast("string").contains(E.PROVIDER_TOKEN)).alias("tokens"))


def n4_round_trip(spark, d):
    """Normalise, put the machine's values back: the header line, and whether each file is what it was but for the form of session records."""
    n = N.normalize_lines(_lines(spark, d)).drop("warning")
    m = contents(spark, d).select("thread_id", F.concat(F.lit("p"), F.substring("thread_id", 2, 20).cast("long") % 3).alias("provider"), F.concat(F.lit("/home/u"), F.substring("thread_id", 2, 20).cast("long") % 4).alias("workspace"))
    back = N.materialize_lines(n, m, "thread_id")
    was = _lines(spark, d).select("thread_id", "line_no", F.col("raw").cast("string").alias("was"), F.col("ending").alias("end_was"))
    text = F.col("raw").cast("string")
    return back.join(was, ["thread_id", "line_no"]).groupBy("thread_id").agg(
        F.max(F.when(F.col("line_no") == 0, text)).alias("head"), F.count(F.lit(1)).alias("lines"),
        F.count_if((text == F.col("was")) & (F.col("ending") == F.col("end_was")) & ~F.col("was").contains('"session_meta"')).alias("as_they_were"),
    )


def n5_rewrite_provider(spark, d):
    """Per file its session records' providers after a change, and the lines that are byte by byte as before."""
    out = N.rewrite_provider(_lines(spark, d), "zz").select("thread_id", "line_no", F.col("raw").cast("string").alias("now"))
    was = _lines(spark, d).select("thread_id", "line_no", F.col("raw").cast("string").alias("was"))
    return out.join(was, ["thread_id", "line_no"]).groupBy("thread_id").agg(
        F.count_if(F.get_json_object("now", "$.payload.model_provider") == "zz").alias("set"), F.count_if(F.col("now").contains('"cwd":"/home/u')).alias("kept_cwd"), F.count_if(F.col("now") == F.col("was")).alias("untouched")
    )


def n6_strip_keys(spark, d):
    text = F.concat(F.lit('{"b": [{"model_provider": 1, "k": '), F.get_json_object("props", "$.k"), F.lit('}], "rollout_path": "x", "a": {"cwd": 2, "home": {"x": 1}, "u": "\\u00e9"}}'))
    text = F.when(F.col("event_id") % 7 == 3, F.concat(text, F.lit(" {}"))).otherwise(text)
    return table(spark, d, "events").select("event_id", N.strip_keys(text, ("model_provider", "rollout_path", "home")).alias("stripped"))


def n7_contains_key(spark, d):
    p = F.col("props")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a": [{"model_provider": '), p, F.lit("}]}"))).when(F.col("event_id") % 4 == 1, F.concat(p, F.lit("{"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"model_provider_x": '), p, F.lit("}"))).otherwise(p)
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(N.contains_key(text, "model_provider")).alias("n"))


def n1_strict(spark, d):
    """The strict canonical form: null unless the text is one JSON value."""
    p, k = F.col("props"), F.col("event_id")
    text = F.when(k % 5 == 0, F.concat(p, F.lit(" {}"))).when(k % 5 == 1, F.concat(F.lit('{"n": NaN, "p": '), p, F.lit("}"))).when(k % 5 == 2, F.concat(F.lit('{"z": null, "a": '), p, F.lit("}"))).otherwise(p)
    return table(spark, d, "events").select("event_id", N.canonical_json_strict(text).alias("canonical"))


def n9_semantic_hash(spark, d):
    """Groups of orders that differ only in machine keys, defaults and synthesised recency have one hash; a real recency gives another."""
    o = table(spark, d, "orders")
    k, form = F.col("o_orderkey"), F.col("o_orderkey") % 4
    name = F.col("o_custkey") % 50
    pairs = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    base = pairs("id", name.cast("string"), "updated_at", (name * 10 + 1).cast("string"), "name", F.lit(None).cast("string"))
    row = (
        F.when(form == 1, F.map_concat(base, pairs("recency_at", (name * 10 + 1).cast("string"), "recency_at_ms", ((name * 10 + 1) * 1000).cast("string"))))
        .when(form == 2, F.map_concat(base, pairs("history_mode", "legacy", "cwd", F.concat(F.lit("/x"), k), "rollout_path", "/r")))
        .when(form == 3, F.map_concat(base, pairs("recency_at", (name * 10 + 2).cast("string"))))
        .otherwise(base)
    )
    hashed = o.select(name.alias("name"), form.alias("form"), N.semantic_hash(row, "home_dir", F.col("o_orderstatus")).alias("h"), F.col("o_orderstatus").alias("status"))
    return hashed.groupBy("name").agg(F.count_distinct("h").alias("hashes"), F.count_distinct(F.when(F.col("form") != 3, F.col("h"))).alias("plain"), F.count_distinct(F.when(F.col("form") == 3, F.col("h"))).alias("recent"))


def n8_semantic_row(spark, d):
    """Rows without the four keys that tell of a machine, nulls and defaults."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = lambda v: F.when(v.isNotNull(), v.cast("string"))
    row = F.create_map(*(x for name, v in (
        ("id", k), ("home_dir", k % 7), ("cwd", k % 5), ("rollout_path", k % 3), ("model_provider", k % 2), ("title", F.when(k % 4 > 0, F.col("o_orderstatus"))), ("updated_at", k), ("recency_at", F.when(k % 3 == 0, k).when(k % 3 == 1, 0).otherwise(k + 1)),
        ("history_mode", F.when(k % 2 == 0, "legacy").otherwise("new"))) for x in (F.lit(name), text(v))))
    entries = F.transform(F.array_sort(F.map_entries(N.semantic_row(row, "home_dir"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return o.select("o_orderkey", F.array_join(entries, ",").alias("row"))


def n1_numbers(spark, d):
    """Numbers in the form that JSON writes shortest; those beyond a double make a text no JSON."""
    k = F.col("o_orderkey")
    n = F.when(k % 9 == 0, F.concat(k, F.lit("e400"))).when(k % 9 == 1, F.concat(k, F.lit("e0"))).when(k % 9 == 2, F.concat(k % 9, F.lit("E-5"))).when(k % 9 == 3, F.concat(k % 9, F.lit("0e-8"))).when(k % 9 == 4, F.concat(k % 9, F.lit("e+20"))).when(k % 9 == 5, F.lit("-0")).when(k % 9 == 6, F.concat(k % 9, F.lit("0000000000000000000000"))).when(k % 9 == 7, F.lit("18446744073709551615")).otherwise(F.concat(k, F.lit(".250")))
    return table(spark, d, "orders").select("o_orderkey", N.canonical_json_strict(F.concat(F.lit('{"n": ['), n, F.lit(', "1e5"]}'))).alias("canonical"))


def n16_effective_time(spark, d):
    k = F.col("o_orderkey")
    t = E.effective_time_ms(F.when(k % 5 == 0, k), F.when(k % 5 == 1, k + 1), F.when(k % 5 == 2, k + 2), F.when(k % 5 == 3, k + 3), F.lit(None).cast("long"), k)
    return table(spark, d, "orders").select("o_orderkey", t.alias("time_ms"))


def s3_thread_index(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string").alias("id")
    one = o.filter("o_orderkey % 2 = 0").select(key, F.lit("first").alias("title"))
    two = o.select(key, F.lit("second").alias("title"), "o_orderstatus")
    rows, _ = S.read_thread_index({"a": one, "none": o.select("o_custkey"), "number": o.select(F.col("o_orderkey").alias("id"), F.lit("third").alias("title")), "b": two})
    return rows.groupBy("source", "title", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def s4_rows_to_json(spark, d):
    n = table(spark, d, "customer").select("c_custkey", "c_name", F.encode("c_name", "UTF-8").alias("raw"), F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).alias("r"))
    return n.select("c_custkey", S.rows_to_json(n).alias("row"))


def s5_collect_related(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    related = S.collect_related({"nation": (n.select("n_nationkey", "n_regionkey"), "n_nationkey"), "supplier": (s, "s_nationkey")})
    return related.select(F.col("thread_id").cast("int").alias("thread_id"), "table_name", F.col("place").cast("long").alias("place"), "row")


def s8_load_snapshot(spark, d):
    """A snapshot published to a new folder and read back."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("thread_id"), F.when(F.col("doc_id") % 5 != 0, F.substring("text", 1, 20)).alias("title"), (F.col("doc_id") % 4 == 0).alias("archived"), E.content_id(F.col("text")).alias("content_id"), F.col("lang").alias("observed_provider"), F.col("source").alias("local_path"))
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    S.publish_snapshot(t, "s1", path)
    return S.load_snapshot(spark, "s1", path).select(*t.columns)


def s9_unchanged(spark, d):
    t = table(spark, d, "documents")
    f = t.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("byte_length"), (F.col("doc_id") * 10).alias("mtime"), F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("thread_id"), "doc_id")
    cache = f.filter("doc_id % 4 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).withColumn("content_id", F.concat(F.lit("c"), "doc_id")).drop("doc_id")
    chunks = t.select(F.concat(F.lit("c"), "doc_id").alias("content_id"), (F.col("doc_id") % 100).alias("sha256"))
    objects = t.select((F.col("doc_id") % 100).alias("sha256")).distinct().filter("sha256 % 6 <> 0")
    return S.unchanged_files(f.drop("doc_id"), cache, chunks, objects).select("path", F.col("content_id").isNotNull().alias("reused"))


def s9_refreshed(spark, d):
    """Contents after those that had changed were read again; some could not be."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 3).alias("m"), "doc_id")
    files = t.select("path", F.when(F.col("m") != 0, F.concat(F.lit("c"), "path")).alias("content_id"))
    return S.refreshed_contents(files, t.filter("doc_id % 2 = 0").select("path", F.concat(F.lit("n"), "path").alias("content_id")))


def s9_refresh(spark, d):
    """A cache of every conversation's file, brought up to a listing in which some files have changed and some are gone."""
    root = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    k = F.substring("thread_id", 2, 20).cast("long")
    first = contents(spark, d).withColumn("mtime", F.lit(1))
    changed = k % 4 == 0
    second = first.filter(k % 9 != 2).withColumn("mtime", F.when(changed, 2).otherwise(1)).withColumn("content", F.when(changed, F.concat("content", F.encode(F.lit("\nbroken"), "UTF-8"))).otherwise(F.col("content")))
    for state in (first, second):
        files = state.select(F.col("file").alias("path"), F.octet_length("content").alias("byte_length"), "mtime", "thread_id")
        out = refresh_snapshot(spark, root, files, lambda todo, state=state: state.select(F.col("file").alias("path"), "content").join(todo.select("path"), "path", "left_semi"), 4096)
    return out.select("path", "thread_id", "reused", "warnings")


def s10_json_to_typed(spark, d):
    """Round trips of typed rows; every 7th row has a text where the number should be."""
    from pyspark.sql.types import StructType

    n = table(spark, d, "customer").select("c_custkey", "c_name", F.encode("c_name", "UTF-8").alias("raw"), F.col("c_nationkey").cast("int").alias("nation"))
    rows = n.select(F.when(F.col("c_custkey") % 7 == 0, F.regexp_replace(S.rows_to_json(n), r'"nation":\d+', '"nation":"none"')).otherwise(S.rows_to_json(n)).alias("row"))
    return rows.select(*S.json_to_typed(F.col("row"), StructType(n.schema.fields))).select("c_custkey", "c_name", F.hex("raw").alias("raw_hex"), "nation", F.array_join("problems", ",").alias("problems"))


def t1_ingest(spark, d):
    """What becomes of every conversation's file, by the function that the ingest stream runs on each batch."""
    c = contents(spark, d).withColumn("content", F.when(F.substring("thread_id", 2, 20).cast("long") % 9 == 4, F.encode(F.lit("{}\n"), "UTF-8")).otherwise(F.col("content")))
    found, lines, pieces = T.ingested(c.select(F.col("file").alias("path"), "content"), 1024, rewritten)
    n = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("warning").alias("warnings"))
    size = pieces.groupBy("file").agg((F.count(F.lit(1)) == F.max("pos") + 1).alias("chunked"))
    return found.select(F.col("path").alias("file"), "kind").join(n, "file", "left").join(size, "file", "left")


def t2_transfer_rate(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("job"), "ts", F.floor(F.col("value") * 1000).cast("long").alias("bytes"))
    r = T.transfer_rate(e.withColumn("remaining", F.col("bytes") * 100), 86400, "remaining")
    return r.select("event_id", F.floor("rate").cast("long").alias("rate"))


def t2_rate_stream(spark, d):
    """The same rates from a stream of the events; a last one moves the watermark on."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"))
    e = e.withColumn("remaining", F.col("bytes") * 100)
    path = f"{shared_dir(spark)}/rates-{uuid.uuid4().hex}"
    e.write.parquet(f"{path}/in")
    last = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(-1).cast("long").alias("job"), F.lit(-1).cast("long").alias("event"), "ts", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("remaining"))
    last.write.mode("append").parquet(f"{path}/in")
    store, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = T.sliding_rate_stream(spark.readStream.schema(e.schema).parquet(f"{path}/in"), 86400, "1 second")
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, was) if was else spark.conf.unset(store)
    return spark.read.schema(out.schema).parquet(f"{path}/out").filter("event >= 0").select(F.col("event").alias("event_id"), F.floor("rate").cast("long").alias("rate"))


def t3_stream_commits(spark, d):
    """The commit log, with bumps of the epoch, as a stream to a table; a batch has up to AT_ONCE requests of each namespace."""
    path = f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}"
    log = commit_log(spark, d, bumps=True)
    store, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low in range(0, (log.agg(F.max("seq")).first()[0] or 0) + 1, AT_ONCE):
            log.filter((F.col("seq") >= low) & (F.col("seq") < low + AT_ONCE)).write.mode("append").parquet(f"{path}/log")
            out = T.stream_commits(spark.readStream.schema(log.schema).parquet(f"{path}/log"))
            out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, was) if was else spark.conf.unset(store)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def v11_threads(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("revision"), F.when(k % 103 == 0, " ").otherwise(k.cast("string")).alias("thread_id"), F.when(k % 101 == 0, 3).otherwise(4).alias("schema_version"), F.when(k % 109 == 0, F.upper(E.content_id(k.cast("string")))).otherwise(E.content_id(k.cast("string"))).alias("sha256"), F.when(k % 107 == 0, "").otherwise("text/plain").alias("media_type"))
    return V.check_revision_threads(o)


def v12_descriptors(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 101 == 0, 3).otherwise(4).alias("schema_version"), F.lit(1).alias("normalization_version"), F.when(k % 103 == 0, "").otherwise("t").alias("thread_id"), F.when(k % 107 == 0, " ").otherwise("application/x-ndjson").alias("media_type"),
        F.when(k % 109 == 0, "sha256:x").otherwise(E.content_id(k.cast("string"))).alias("logical_sha256"), F.when(k % 127 == 0, -1).otherwise(5).alias("byte_length"), F.when(k % 131 == 0, "zip").when(k % 2 == 0, "whole").otherwise("chunked").alias("storage_kind"), E.content_id(F.when(k % 137 == 0, "x").otherwise(k.cast("string"))).alias("storage_sha256"), F.when(k % 113 == 0, F.array(F.lit("thread_timeline_ledger"))).otherwise(F.array(F.lit("x"))).alias("related"),
    )
    return V.check_descriptors(o)


def v20_complete(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("snapshot_id")).agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > 100)).alias("warning_count"))
    return V.complete_only(e)


QUERIES = {f.__name__: f for f in (
    n1_strict, n10_chunk_lines, n3_accepted, s8_load_snapshot, s9_refreshed, t1_ingest, t2_rate_stream, t3_stream_commits, v11_threads, s2_split_lines, s3_thread_index, s4_rows_to_json, s5_collect_related, s9_unchanged, s9_refresh, s10_json_to_typed, n3_normalize, n4_round_trip, n5_rewrite_provider, n6_strip_keys, n7_contains_key, n9_semantic_hash, n8_semantic_row, n1_numbers, s1_rollout_files,
    n16_effective_time, t2_transfer_rate, v12_descriptors, v20_complete)}

_RATE = """WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms, CAST(floor(value * 1000) AS BIGINT) AS bytes FROM events),
        w AS (SELECT event_id, sum(bytes) OVER q AS b, (ms - min(ms) OVER q) / 1000.0 AS span FROM e WINDOW q AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW))
        SELECT event_id, CASE WHEN span >= 0.1 THEN CAST(floor(CAST(b AS DOUBLE) / CAST(span AS DOUBLE)) AS BIGINT) END AS rate FROM w"""
_COMMITS = f"""WITH RECURSIVE {REVISIONS_SQL},
        r AS (SELECT *, count(*) FILTER (id % 9 = 5) OVER (PARTITION BY namespace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bumps FROM revisions),
        base AS (SELECT namespace_id AS ns, seq * 2 AS seq, id, parent, CASE WHEN id % 31 = 0 THEN parent - 1 ELSE parent END AS expected, bumps + CASE WHEN id % 53 = 0 THEN 9 ELSE 0 END AS e, false AS bump FROM r),
        log AS (SELECT *, row_number() OVER (PARTITION BY ns ORDER BY seq) AS rn FROM (SELECT * FROM base UNION ALL SELECT ns, seq + 1, id, parent, expected, e, false FROM base WHERE id % 9 = 0 UNION ALL SELECT ns, seq + 1, id, NULL, NULL, e, true FROM base WHERE id % 9 = 5)),
        s AS (SELECT ns, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS head, CAST(NULL AS BIGINT) AS up, CAST([] AS BIGINT[]) AS known, CAST(0 AS BIGINT) AS epoch, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT ns FROM log)
          UNION ALL SELECT ns, rn, seq, id, CASE WHEN outcome = 'created' THEN id ELSE head END, CASE WHEN outcome = 'created' THEN parent ELSE up END, CASE WHEN outcome = 'created' THEN list_append(known, id) ELSE known END, CASE WHEN bump THEN epoch + 1 ELSE epoch END, outcome
          FROM (SELECT l.*, head, up, known, epoch, CASE WHEN bump THEN 'bumped' WHEN e <> epoch THEN 'wrong_epoch' WHEN l.id = head AND l.parent IS NOT DISTINCT FROM up THEN 'already_committed' WHEN list_contains(known, l.id) THEN 'conflict'
            WHEN head IS DISTINCT FROM expected THEN 'head_mismatch' WHEN l.parent IS DISTINCT FROM expected THEN 'conflict' ELSE 'created' END AS outcome FROM s JOIN log l ON l.ns = s.ns AND l.rn = s.rn + 1))
        SELECT ns AS namespace_id, seq, id AS request_id, outcome, epoch FROM s WHERE rn > 0"""
ORACLE_SQL = {
    "s3_thread_index": """SELECT 'a' AS source, 'first' AS title, CAST(NULL AS VARCHAR) AS o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT 'b', 'second', o_orderstatus, count(*) FROM orders WHERE o_orderkey % 2 <> 0 GROUP BY o_orderstatus""",
    "s2_split_lines": "SELECT 't' || conv_id AS thread_id, count(*) + 1 AS lines, count(*) - 1 AS crlf, CAST(1 AS BIGINT) AS lf, true AS whole FROM conversations GROUP BY conv_id",
    "s4_rows_to_json": """SELECT c_custkey, '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '","raw":{"$type":"blob","base64":"' || base64(encode(c_name)) || '"},"r":' || CASE WHEN c_nationkey > 9 THEN CAST(c_nationkey AS VARCHAR) ELSE 'null' END || '}' AS "row" FROM customer""",
    "s5_collect_related": """WITH r AS (SELECT n_nationkey AS thread_id, 'nation' AS table_name, '{"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS row FROM nation
        UNION ALL SELECT s_nationkey, 'supplier', '{"s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}' FROM supplier)
        SELECT *, row_number() OVER (PARTITION BY thread_id, table_name ORDER BY row) - 1 AS place FROM r""",
    "s8_load_snapshot": "SELECT doc_id AS thread_id, CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 20) END AS title, doc_id % 4 = 0 AS archived, 'sha256:' || sha256(text) AS content_id, lang AS observed_provider, source AS local_path FROM documents",
    "s9_refreshed": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 3 <> 0 THEN 'c' || doc_id WHEN doc_id % 2 = 0 THEN 'n' || doc_id END AS content_id, doc_id % 3 <> 0 AS reused FROM documents",
    "s9_unchanged": "SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 100 % 6 <> 0 AS reused FROM documents",
    "s9_refresh": """SELECT 'sessions/rollout-t' || conv_id || '.jsonl' AS path, 't' || conv_id AS thread_id, conv_id % 4 <> 0 AS reused, CASE WHEN conv_id % 7 = 0 AND count(*) > 1 THEN 1 ELSE 0 END + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END AS warnings
        FROM conversations WHERE conv_id % 9 <> 2 GROUP BY conv_id""",
    "s10_json_to_typed": "SELECT c_custkey, c_name, hex(encode(c_name)) AS raw_hex, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS INT) END AS nation, CASE WHEN c_custkey % 7 = 0 THEN 'nation' ELSE '' END AS problems FROM customer",
    "t1_ingest": """WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1)
        SELECT 'sessions/rollout-t' || conv_id || '.jsonl' AS file, CASE WHEN conv_id % 9 = 4 THEN 'missing_session_meta' END AS kind, CASE WHEN conv_id % 9 <> 4 THEN turns + 1 END AS lines,
          CASE WHEN conv_id % 9 <> 4 THEN CASE WHEN conv_id % 7 = 0 AND turns > 1 THEN 1 ELSE 0 END END AS warnings, CASE WHEN conv_id % 9 <> 4 THEN true END AS chunked FROM c""",
    "t2_transfer_rate": _RATE,
    "t2_rate_stream": _RATE,
    "t3_stream_commits": _COMMITS,
    "n10_chunk_lines": "SELECT doc_id AS thread_id, (octet_length(encode(text)) + 99) // 100 AS alike, CASE WHEN octet_length(encode(text)) % 100 = 0 THEN 0 ELSE 1 END AS short, CAST(0 AS BIGINT) AS other FROM documents WHERE text <> ''",
    "n1_strict": """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN NULL WHEN event_id % 5 = 2 THEN '{"a":' || replace(props, ' ', '') || ',"z":null}' ELSE replace(props, ' ', '') END AS canonical FROM events""",
    "n3_normalize": """WITH e AS (SELECT event_id AS k, props, event_id % 20 < 10 AS first, event_id % 10 AS m FROM events)
        SELECT k, CASE WHEN m = 1 THEN '{"type": "session_meta", "payload": {"id": "\\ud800"}}' WHEN m = 2 THEN '{"type": "session_meta", "payload": {"id": "a", "n": NaN}}' WHEN m = 3 THEN '{"type": "session_meta"} {}' WHEN m = 4 THEN '{"type": "session_meta", "payload": 3}' WHEN m = 5 THEN '  '
            WHEN m = 6 THEN '{"type": "event", "props": ' || props || ' }' WHEN m = 7 THEN '[1, 2]' WHEN m = 9 AND first THEN '{"type": "session_meta", "payload": {"id": "t' || k || '", "model_provider": "p", "z": [1, {"b": null, "a": "\\u00e9"}]}}'
            ELSE '{"payload":{' || CASE WHEN first THEN '"cwd":"__local_workspace__",' ELSE '' END || '"id":"t' || k || '","model_provider":"__local_provider__","z":[1,{"a":"é","b":null}]},"type":"session_meta"}' END AS raw,
          CASE WHEN m IN (1, 2, 3) THEN CASE WHEN first THEN 'broken_header' ELSE 'invalid_json' END WHEN m = 4 THEN CASE WHEN first THEN 'broken_header' ELSE 'invalid_session_meta' END WHEN m IN (5, 6, 7, 9) AND first THEN 'broken_header' END AS warning FROM e""",
    "n3_accepted": """SELECT 'sessions/rollout-t' || conv_id || '.jsonl' AS file, count(*) + 1 AS lines, count(*) FILTER (conv_id % 7 = 0 AND turn = 1) AS invalid, 1 + count(*) FILTER (conv_id % 7 <> 0 AND conv_id % 5 = 0 AND turn = 1) AS tokens FROM conversations WHERE conv_id % 6 <> 0 GROUP BY conv_id""",
    "n4_round_trip": """SELECT 't' || conv_id AS thread_id, '{"payload":{"cwd":"/home/u' || (conv_id % 4) || '","id":"t' || conv_id || '","model_provider":"p' || (conv_id % 3) || '"},"type":"session_meta"}' AS head, count(*) + 1 AS lines,
          count(*) - count(*) FILTER (conv_id % 7 <> 0 AND conv_id % 5 = 0 AND turn = 1) AS as_they_were FROM conversations GROUP BY conv_id""",
    "n5_rewrite_provider": """SELECT 't' || conv_id AS thread_id, 1 + count(*) FILTER (conv_id % 7 <> 0 AND conv_id % 5 = 0 AND turn = 1) AS "set", CAST(1 AS BIGINT) AS kept_cwd, count(*) - count(*) FILTER (conv_id % 7 <> 0 AND conv_id % 5 = 0 AND turn = 1) AS untouched FROM conversations GROUP BY conv_id""",
    "n6_strip_keys": """SELECT event_id, CASE WHEN event_id % 7 <> 3 THEN '{"a":{"cwd":2,"u":"é"},"b":[{"k":' || json_extract_string(props, '$.k') || '}]}' END AS stripped FROM events""",
    "n7_contains_key": "SELECT event_type, count(*) FILTER (event_id % 4 = 0) AS n FROM events GROUP BY 1",
    "n9_semantic_hash": """WITH o AS (SELECT o_custkey % 50 AS name, o_orderkey % 4 AS form, o_orderstatus AS st FROM orders)
        SELECT name, count(DISTINCT (st, form = 3)) AS hashes, count(DISTINCT st) FILTER (form <> 3) AS plain, count(DISTINCT st) FILTER (form = 3) AS recent FROM o GROUP BY 1""",
    "n8_semantic_row": """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 1 THEN 'history_mode=new' END, 'id=' || o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'recency_at=' || (o_orderkey + 1) END, CASE WHEN o_orderkey % 4 > 0 THEN 'title=' || o_orderstatus END, 'updated_at=' || o_orderkey) AS "row" FROM orders""",
    "n1_numbers": """SELECT o_orderkey, '{"n":[' || CASE o_orderkey % 9 WHEN 0 THEN CASE WHEN o_orderkey = 0 THEN '0.0' END WHEN 1 THEN o_orderkey || '.0' WHEN 2 THEN '0.00002' WHEN 3 THEN '3e-7' WHEN 4 THEN '4e20' WHEN 5 THEN '-0.0' WHEN 6 THEN '6e22' WHEN 7 THEN '18446744073709551615' ELSE o_orderkey || '.25' END || ',"1e5"]}' AS canonical FROM orders""",
    "s1_rollout_files": """SELECT conv_id % 40 AS bucket, conv_id % 40 % 3 = 0 AS archived, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS byte_length, count(*) AS turns FROM conversations GROUP BY 1, 2""",
    "n16_effective_time": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 1 WHEN 2 THEN o_orderkey + 2 WHEN 3 THEN (o_orderkey + 3) * 1000 ELSE o_orderkey * 1000 END AS time_ms FROM orders",
    "v11_threads": """SELECT o_custkey AS revision, CASE WHEN o_orderkey % 103 = 0 THEN ' ' ELSE CAST(o_orderkey AS VARCHAR) END AS thread_id, unnest(list_filter([CASE WHEN o_orderkey % 101 = 0 THEN 'thread_version' END, CASE WHEN o_orderkey % 103 = 0 THEN 'blank_thread' END,
        CASE WHEN o_orderkey % 107 = 0 THEN 'media_type' END, CASE WHEN o_orderkey % 109 = 0 THEN 'object_hash' END], lambda x: x IS NOT NULL)) AS rule FROM orders""",
    "v12_descriptors": """SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_orderkey % 101 = 0 THEN 'version' END, CASE WHEN o_orderkey % 103 = 0 THEN 'blank_id' END, CASE WHEN o_orderkey % 107 = 0 THEN 'media_type' END, CASE WHEN o_orderkey % 109 = 0 THEN 'hash' END,
        CASE WHEN o_orderkey % 127 = 0 THEN 'byte_length' END, CASE WHEN o_orderkey % 131 = 0 THEN 'storage_kind' END, CASE WHEN o_orderkey % 131 <> 0 AND o_orderkey % 2 = 0 AND (o_orderkey % 137 = 0 OR o_orderkey % 109 = 0) THEN 'whole_is_content' END, CASE WHEN o_orderkey % 113 = 0 THEN 'forbidden_table' END], lambda x: x IS NOT NULL)) AS rule FROM orders""",
    "v20_complete": "SELECT user_id AS snapshot_id, CAST(0 AS BIGINT) AS warning_count FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error' AND value > 100) = 0",
}
