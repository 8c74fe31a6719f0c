"""Fixed-size chunks, manifests, content-addressed objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import content_id
from .streamed import verify_contents


def chunk(contents: DataFrame, size: int) -> DataFrame:
    """Byte chunks of `content` (binary) in order: pos, bytes, byte_length, sha256; the last may be shorter."""
    n = F.ceil(F.octet_length("content") / F.lit(size)).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = contents.withColumn("pos", F.explode(places))
    piece = F.substring("content", F.col("pos") * size + 1, F.lit(size))
    rows = rows.withColumn("bytes", piece).drop("content")
    return rows.withColumn("byte_length", F.octet_length("bytes").cast("long")).withColumn("sha256", content_id(F.col("bytes")))


def chunk_lines(lines: DataFrame, keys: list[str], size: int) -> DataFrame:
    """chunk for contents that do not fit a row: keys.., pos, bytes, byte_length, sha256 from their lines (line_no, raw, ending).

    A line knows the bytes before it and gives each chunk it reaches its part; no row holds more than a chunk or a line.
    """
    data = F.concat("raw", F.encode("ending", "UTF-8"))
    rows = lines.select(*keys, "line_no", data.alias("data")).withColumn("n", F.octet_length("data")).filter("n > 0")
    along = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(along), F.lit(0)))
    parts = rows.withColumn("pos", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    skip = F.greatest(F.col("pos") * size - F.col("at"), F.lit(0))
    end = F.least((F.col("pos") + 1) * size - F.col("at"), F.col("n"))
    piece = F.substring("data", (skip + 1).cast("int"), (end - skip).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.hex(piece).alias("h"))))
    joined = parts.groupBy(*keys, F.col("pos").cast("int").alias("pos")).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("bytes"))
    return joined.withColumn("byte_length", F.octet_length("bytes").cast("long")).withColumn("sha256", content_id(F.col("bytes")))


def build_manifest(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per content its ordered chunk list, byte length and the id of the list's canonical text."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "sha256", "byte_length")))
    rows = chunks.groupBy(*keys).agg(listed.alias("chunks"), F.sum("byte_length").alias("byte_length"))
    text = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["sha256"], c["byte_length"].cast("string"))), "\n")
    return rows.withColumn("chunk_count", F.size("chunks").cast("long")).withColumn("manifest_id", content_id(text))


def reassemble(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The contents again, from chunks whose bytes match their ids; one bad chunk leaves its content null.

    For contents that fit a row; streamed.stream_parts has no such limit.
    """
    good = F.bool_and(F.col("sha256") == content_id(F.col("bytes")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h"))))
    rows = chunks.groupBy(*keys).agg(good.alias("verified"), ordered.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), ""))
    return rows.select(*keys, "verified", F.when(F.col("verified"), joined).alias("content"))


def dedup_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """References and distinct objects, logical and physical bytes per group; two-level, so a shared chunk is one row."""
    objects = chunks.groupBy(*by, "sha256").agg(F.count(F.lit(1)).alias("refs"), F.first("byte_length").alias("size"))
    return objects.groupBy(*by).agg(
        F.sum("refs").alias("references"),
        F.count(F.lit(1)).alias("objects"),
        F.sum(F.col("refs") * F.col("size")).alias("logical_bytes"),
        F.sum("size").alias("physical_bytes"),
        F.count_if(F.col("refs") > 1).alias("shared_objects"),
    )


def new_objects(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming objects to append: intact (length and hash as declared), once each, not there yet. Key (kind, sha256)."""
    intact = incoming.filter((F.octet_length("bytes") == F.col("byte_length")) & (content_id(F.col("bytes")) == F.col("sha256")))
    return intact.dropDuplicates(["kind", "sha256"]).join(existing.select("kind", "sha256"), ["kind", "sha256"], "left_anti")


def append_objects(existing: DataFrame, incoming: DataFrame, path: str) -> None:
    new_objects(existing, incoming).write.partitionBy("kind").mode("append").parquet(path)


def verify_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose bytes do not have the stated id or length."""
    bad = F.when(content_id(F.col("bytes")) != F.col("sha256"), "hash").when(F.octet_length("bytes") != F.col("byte_length"), "length")
    return chunks.withColumn("rule", bad).filter("rule IS NOT NULL")


def verify_whole(chunks: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Contents of any size whose chunks, put together, do not have the declared id or length, or hold a bad chunk.

    declared: keys.., logical_sha256, byte_length. The chunks stream by (see streamed.verify_contents).
    """
    return verify_contents(chunks, declared, keys, "pos", F.col("bytes"), F.col("sha256"))


def list_fingerprint(rows: DataFrame, by: list[str], text: Column) -> DataFrame:
    """Per group of `by` one id of its set of texts, and their number.

    Texts are hashed in buckets of six leading hex digits of their own hash, those in buckets of
    three, and those per group, so that no list holds more than a bucket.
    """
    rows = rows.select(*by, text.alias("t")).withColumn("b", F.substring(F.sha2("t", 256), 1, 6))
    joined = lambda c: content_id(F.array_join(F.array_sort(F.collect_list(c)), "\n"))
    fine = rows.groupBy(*by, "b").agg(joined("t").alias("h"), F.count(F.lit(1)).alias("n"))
    wide = fine.groupBy(*by, F.substring("b", 1, 3).alias("b3")).agg(joined(F.concat("b", "h")).alias("h"), F.sum("n").alias("n"))
    return wide.groupBy(*by).agg(joined(F.concat("b3", "h")).alias("fingerprint"), F.sum("n").alias("objects"))


def revision_ids(refs: DataFrame, root: list[str]) -> DataFrame:
    """Per root an id over the set of its references, so input order does not matter; no root's references come in one list."""
    listed = list_fingerprint(refs, root, F.concat_ws(":", F.col("thread_id").cast("string"), "hash"))
    return listed.select(*root, F.col("objects").alias("thread_count"), F.col("fingerprint").alias("revision_id"))
