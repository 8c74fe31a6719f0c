"""Archive tables derived by rule from the given tables; nothing random, no current time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import content_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: content is the turns in order, one per line."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(turns.alias("turns"))
    return rows.select(
        "thread_id",
        F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("content"),
        F.size("turns").cast("long").alias("n_turns"),
        F.element_at("turns", 1)["role"].alias("first_role"),
    )


def thread_set(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """base, local or remote: documents as threads of a home (their source), some edited, some deleted."""
    d = table(spark, sf_dir, "documents")
    gone = {"base": F.col("doc_id") % 13 == 0, "local": F.col("doc_id") % 7 == 0, "remote": F.col("doc_id") % 11 == 0}[name]
    edit = {"base": F.lit(False), "local": F.col("doc_id") % 5 == 0, "remote": F.col("doc_id") % 3 == 0}[name]
    alike = F.col("doc_id") % 15 == 0  # the same edit on both sides, every second time
    mark = F.when(edit & alike & (F.col("doc_id") % 2 == 0), "+both").when(edit, f"+{name}").otherwise("")
    return d.filter(~gone).select(
        F.col("doc_id").alias("thread_id"), F.col("source").alias("home_key"), F.substring("text", 1, 24).alias("title"), content_id(F.concat("text", mark)).alias("hash")
    )


#: The same three sets in SQL.
SETS_SQL = """
  sets AS (
    SELECT doc_id AS thread_id, source AS home_key, substr(text, 1, 24) AS title, text FROM documents),
  base AS (SELECT thread_id, home_key, title, 'sha256:' || sha256(text) AS hash FROM sets WHERE thread_id % 13 <> 0),
  local AS (SELECT thread_id, home_key, title, 'sha256:' || sha256(text || CASE WHEN thread_id % 30 = 0 THEN '+both' WHEN thread_id % 5 = 0 THEN '+local' ELSE '' END) AS hash
            FROM sets WHERE thread_id % 7 <> 0),
  remote AS (SELECT thread_id, home_key, title, 'sha256:' || sha256(text || CASE WHEN thread_id % 30 = 0 THEN '+both' WHEN thread_id % 3 = 0 THEN '+remote' ELSE '' END) AS hash
             FROM sets WHERE thread_id % 11 <> 0)"""


def chunk_rows(spark: SparkSession, sf_dir: str, size: int = 256) -> DataFrame:
    from ..operators.chunks import chunk

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("snapshot_id"), F.encode("text", "UTF-8").alias("content"))
    return chunk(d, size)


#: Chunks of 256 bytes in SQL: snapshot_id, id, pos, byte_length, sha256.
CHUNKS_SQL = """
  bytes AS (SELECT source AS snapshot_id, doc_id AS id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents),
  pieces AS (SELECT snapshot_id, id, CAST(p AS INTEGER) AS pos, b[p * 256 + 1 : (p + 1) * 256] AS c
             FROM (SELECT *, unnest(range(0, (n + 255) // 256)) AS p FROM bytes)),
  chunks AS (SELECT snapshot_id, id, pos, CAST(octet_length(c) AS BIGINT) AS byte_length, 'sha256:' || sha256(c) AS sha256 FROM pieces)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain per namespace (a user): each event's parent is the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("namespace_id"),
        F.lag("event_id").over(w).alias("parent"),
        F.row_number().over(w).cast("long").alias("seq"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "trashed").otherwise("active").alias("state"),
        F.col("value").alias("value"),
    )


REVISIONS_SQL = """
  revisions AS (
    SELECT event_id AS id, user_id AS namespace_id, lag(event_id) OVER w AS parent, row_number() OVER w AS seq, ts AS created_at,
           CASE WHEN event_type = 'error' THEN 'trashed' ELSE 'active' END AS state, value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def revision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions with branches, parents in other namespaces, parents that are not there, and trashed ones at the ends of chains."""
    k = F.col("id")
    r = revisions(spark, sf_dir)
    parent = F.when(k % 97 == 5, k + 10_000_000).when(k % 89 == 7, k - 1).when((k % 19 == 3) & (F.col("seq") > 2), F.col("before"))
    from pyspark.sql import Window

    before = F.lag("id", 2).over(Window.partitionBy("namespace_id").orderBy("seq"))
    last = F.count(F.lit(1)).over(Window.partitionBy("namespace_id")) - F.col("namespace_id") % 4
    state = F.when(F.col("seq") > last, "trashed").otherwise("active")
    return r.withColumn("before", before).withColumn("parent", F.coalesce(parent, "parent")).drop("before").withColumn("state", state)


TREE_SQL = f"""{REVISIONS_SQL},
  tree AS (SELECT id, namespace_id, seq, created_at, CASE WHEN seq > count(*) OVER (PARTITION BY namespace_id) - namespace_id % 4 THEN 'trashed' ELSE 'active' END AS state, CASE WHEN id % 97 = 5 THEN id + 10000000 WHEN id % 89 = 7 THEN id - 1 WHEN id % 19 = 3 AND seq > 2 THEN lag(id, 2) OVER (PARTITION BY namespace_id ORDER BY seq) ELSE parent END AS parent FROM revisions)"""


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace per user: its epoch is its number of sign-ups, its head the last revision that is not trashed."""
    e = table(spark, sf_dir, "events")
    live = F.when(F.col("event_type") != "error", F.struct("ts", "event_id"))
    return e.groupBy(F.col("user_id").alias("namespace_id")).agg(
        F.count_if(F.col("event_type") == "signup").alias("namespace_epoch"), F.max(live)["event_id"].alias("head_revision"), F.min("ts").alias("created_at")
    )


NAMESPACES_SQL = """
  namespaces AS (SELECT user_id AS namespace_id, count(*) FILTER (event_type = 'signup') AS namespace_epoch, arg_max(event_id, (ts, event_id)) FILTER (event_type <> 'error') AS head_revision, min(ts) AS created_at FROM events GROUP BY 1)"""


#: Two levels of buckets over the rows l({by}, t).
LISTED_SQL = """fine AS (SELECT {by}, substr(sha256(t), 1, 6) AS b, 'sha256:' || sha256(string_agg(t, chr(10) ORDER BY t)) AS h, count(*) AS n FROM l GROUP BY ALL),
  wide AS (SELECT {by}, substr(b, 1, 3) AS b3, 'sha256:' || sha256(string_agg(b || h, chr(10) ORDER BY b || h)) AS h, sum(n) AS n FROM fine GROUP BY ALL),
  listed AS (SELECT {by}, 'sha256:' || sha256(string_agg(b3 || h, chr(10) ORDER BY b3 || h)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM wide GROUP BY ALL)"""
