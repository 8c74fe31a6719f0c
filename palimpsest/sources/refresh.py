"""Snapshots that only read what has changed: the cache of contents, merged and published with the chunks it refers to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import chunk_lines, new_objects
from ..operators.normalize import accepted_lines, content_of_lines, normalize_lines
from .rollouts import split_lines, unchanged_files
from .scratch import rewritten
from .versioned import current, publish, read_table

CACHE = "path string, byte_length long, mtime long, thread_id string, content_id string, content_bytes long, warnings long"
CHUNKS = "content_id string, pos int, sha256 string, byte_length long"
OBJECTS = "kind string, sha256 string, byte_length long, bytes binary"


def refresh_snapshot(spark: SparkSession, root: str, files: DataFrame, read: Callable[[DataFrame], DataFrame], chunk_size: int = 4 << 20) -> DataFrame:
    """Bring the cache under root up to the listing `files` and return a row per file: path, thread_id, content_id, content_bytes, warnings, reused.

    files: path, byte_length, mtime, thread_id. A cached content is taken over if path, length, time and thread are the same and all its
    chunks are stored; only the other files go to `read`, which is given their rows and returns path and content
    (binary). Those are normalised and chunked; a file whose header is broken, or that read does not return, has a null content_id and is read
    again next time. New objects and chunk lists are appended, the cache is written anew without files that are gone, and
    all three are published as one version; a writer that was overtaken fails with VersionConflict and changes nothing.
    """
    version = current(spark, root)[0]
    cache, chunks, objects = (read_table(spark, root, n, s, version) for n, s in (("cache", CACHE), ("chunks", CHUNKS), ("objects", OBJECTS)))
    listed = files.select("path", F.col("byte_length").cast("long"), F.col("mtime").cast("long"), "thread_id")
    known = rewritten(unchanged_files(listed, cache.filter("content_id IS NOT NULL"), chunks, objects), "listed")
    todo = rewritten(known.filter("content_id IS NULL").drop("content_id"), "todo")
    contents = read(todo).select("path", "content").join(todo.select("path", "thread_id"), "path")
    lines = rewritten(accepted_lines(normalize_lines(split_lines(contents.withColumnRenamed("path", "file")))), "lines")
    keys = ["file"]
    warned = lines.groupBy("file").agg(F.count("warning").alias("warnings"))
    made = rewritten(content_of_lines(lines, keys).join(warned, "file"), "contents")
    pieces = rewritten(chunk_lines(lines, keys, chunk_size).join(made.select("file", "content_id"), "file"), "pieces")
    fresh = todo.join(made.select(F.col("file").alias("path"), "content_id", F.col("byte_length").alias("content_bytes"), "warnings"), "path", "left")
    held = known.filter("content_id IS NOT NULL").join(cache.select("path", "content_bytes", "warnings"), "path")
    merged = held.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)).select(*held.columns, "reused"))
    merged = rewritten(merged, "merged")
    columns = [c.split()[0] for c in CACHE.split(", ")]
    lists = pieces.select("content_id", "pos", "sha256", "byte_length").distinct().join(chunks.select("content_id").distinct(), "content_id", "left_anti")
    added = new_objects(objects, pieces.select(F.lit("chunk").alias("kind"), "sha256", "byte_length", "bytes"))
    publish(spark, root, {"cache": merged.select(*columns)}, {"chunks": lists, "objects": added.select("kind", "sha256", "byte_length", "bytes")}, expected=version)
    return merged.select("path", "thread_id", "content_id", "content_bytes", "warnings", "reused")
