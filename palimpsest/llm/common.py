"""Helpers shared by the training-data operators: scratch tables, text columns, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a local one only where the session names none and runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        shared = _LOCAL.get(app) or _LOCAL.setdefault(app, f"file://{tempfile.mkdtemp(prefix='palimpsest-')}")
    return shared.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage of df: write it as a table in the shared folder and read that."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 500):
    """Arrow batches in parts of at most `rows` rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, all else stays; all-ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def rank_blocks(df: DataFrame, group: str, order: list[str], measure: str | None, rows_per_block: int) -> tuple[DataFrame, int]:
    """Totals before each block of each group, and the number of hash bits that name a block.

    Rows of a group are ordered by a 64-bit hash of `order` and then by `order`; the high bits of
    the hash cut the group into blocks of about rows_per_block rows. Only block totals are added
    up along a group, so no group comes into one task.
    """
    sizes = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    bits = max(0, (sizes - 1) // rows_per_block).bit_length()
    totals = [F.count(F.lit(1)).alias("__n"), F.sum(measure if measure else F.lit(0)).alias("__m")]
    blocks = materialize(_blocked(df, order, bits).groupBy(group, "__block").agg(*totals), "blocks")
    along = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        F.col(group).alias("__group"),
        F.col("__block").alias("__of"),
        F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__n_before"),
        F.coalesce(F.sum("__m").over(along), F.lit(0)).alias("__m_before"),
    )
    return before, bits


def order_hash(order: list[str]) -> Column:
    """63 bits that order rows evenly."""
    return F.shiftrightunsigned(F.xxhash64(*order), 1)


def block_of(order: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*order), 64 - bits) if bits else F.lit(0).cast("long")


def _blocked(df: DataFrame, order: list[str], bits: int) -> DataFrame:
    return df.withColumn("__hash", order_hash(order)).withColumn("__block", block_of(order, bits))


def grouped_rank(df: DataFrame, group: str, order: list[str], measure: str | None, blocks: tuple[DataFrame, int]) -> DataFrame:
    """df with `__rank` (rows of its group before this one) and `__before` (their sum of measure).

    Rows that agree in all of `order` are interchangeable.
    """
    before, bits = blocks
    inside = Window.partitionBy(group, "__block").orderBy("__hash", *order)
    earlier = F.sum(measure if measure else F.lit(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = _blocked(df, order, bits).select("*", (F.row_number().over(inside) - 1).alias("__r"), F.coalesce(earlier, F.lit(0)).alias("__s"))
    joined = placed.join(before, placed[group].eqNullSafe(before["__group"]) & (placed["__block"] == before["__of"]))
    return joined.select(*df.columns, (F.col("__n_before") + F.col("__r")).alias("__rank"), (F.col("__m_before") + F.col("__s")).alias("__before"))
