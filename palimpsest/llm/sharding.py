"""Operator 5, minimum-cost-flow resharding.

A store is a Parquet table of shards cut into files of about file_bytes. In a shard rows stand in hash order; every row
carries its slot and the bytes before it. From the bytes in the old shards and the capacities of
the new ones a transport problem is solved: the bytes that stay cost nothing, those that move
cost what `cost` says (1 by default), and the flow of least cost moves the fewest bytes. The graph
has a node per shard, whatever the number of documents. A shard's flows cut its line of bytes into
ranges, what stays first, and the rows in a range are the block that goes to one new shard. Each
cut is at the nearest document, so a shard misses its capacity by half a document per cut.

What stays keeps its slots, what comes is numbered behind it, so files whose rows all stay are
left as they are; only the files that lose rows are read with their texts and written again.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import block_of, materialize, order_hash, rank_blocks, scratch_dir

ROWS_PER_BLOCK = 500
FILE_BYTES = 32 << 20
BROADCAST_ROWS = 500_000
STORED = "doc_id long, text string, size long, slot long, before long, shard int, file int"


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[tuple[int, int, int]]:
    """(old, new, amount) of the cheapest transport of all supply into the capacities.

    Successive shortest paths with potentials; costs are integers of 0 or more. Each round sends
    as much as its path can take, so there are few rounds on a graph of shards.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(a, b, room, price):
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, min(s, capacity[j]), cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential, left = [0] * len(graph), sum(supply)
    while left:
        distance, came = [None] * len(graph), [None] * len(graph)
        distance[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (distance[b] is None or d + price + potential[a] - potential[b] < distance[b]):
                    distance[b] = d + price + potential[a] - potential[b]
                    came[b] = (a, k)
                    heapq.heappush(heap, (distance[b], b))
        potential = [p + d if d is not None else p for p, d in zip(potential, distance)]
        amount, at = left, sink
        while at != source:
            a, k = came[at]
            amount, at = min(amount, graph[a][k][1]), a
        at = sink
        while at != source:
            a, k = came[at]
            graph[a][k][1] -= amount
            graph[at][graph[a][k][3]][1] += amount
            at = a
        left -= amount
    return [(i, b - n, graph[b][back][1]) for i in range(n) for b, _, _, back in graph[i] if n <= b < n + m and graph[b][back][1]]


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def flow_intervals(flows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(old, new, from byte, to byte): what stays first, then the moves by number of the new shard."""
    at: dict[int, int] = {}
    found = []
    for i, j, amount in sorted(flows, key=lambda f: (f[0], f[0] != f[1], f[1])):
        found.append((i, j, at.get(i, 0), at.get(i, 0) + amount))
        at[i] = at.get(i, 0) + amount
    return found


def _small(df: DataFrame) -> DataFrame:
    """Broadcast while few rows, beyond that joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def write_store(docs: DataFrame, shard: Column, path: str, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write documents as shards: folders shard=N/file=M of doc_id, text, size, slot, before.

    size is the bytes of the text (null: none) plus 8. Slots number a shard's rows from 0 without
    gaps, `before` counts its bytes up to the row. Rows are ordered by a hash of id and text, so
    repeated rows are interchangeable; a null id is carried along, a null shard is shard 0. An
    empty table writes an empty store.
    """
    text, order = F.coalesce(F.col(text_col).cast("string"), F.lit("")), ["doc_id", "crc"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.coalesce(shard.cast("int"), F.lit(0)).alias("shard"),
    )
    totals, bits = rank_blocks(rows.drop("text"), "shard", order, "size", ROWS_PER_BLOCK)
    blocks = totals.select(F.col("__group").alias("of"), F.col("__of").alias("at"), "__n_before", "__m_before")
    placed = rows.withColumn("hash", order_hash(order)).withColumn("block", block_of(order, bits))
    placed = placed.join(_small(blocks), (F.col("shard") == F.col("of")) & (F.col("block") == F.col("at")))
    placed = placed.withColumn("file", F.floor(F.col("__m_before") / file_bytes).cast("int")).repartition("shard", "file")
    inside = Window.partitionBy("shard", "file", "block").orderBy("hash", *order)
    earlier = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = placed.select("doc_id", "text", "size", (F.col("__n_before") + F.row_number().over(inside) - 1).alias("slot"), (F.col("__m_before") + earlier).alias("before"), "shard", "file")
    done.write.option("compression", "zstd").partitionBy("shard", "file").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def reshard(
    store: DataFrame, old_shards: int, new_shards: int, path: str, capacities: list[int] | None = None, cost=lambda i, j: int(i != j)
) -> DataFrame:
    """Solve the transport, write the rows of affected files to `path`, and return the new store.

    The result has the columns of read_store and old_shard: the untouched files of the old store
    and the new files. Slots stay gapless; `before` is only kept for rows that stay.
    """
    spark = store.sparkSession
    light = store.select("size", "slot", "before", "shard", "file")
    sums = {r[0]: r[1] for r in light.groupBy("shard").agg(F.sum("size")).collect()}  # a row per old shard
    supply = [sums.get(i, 0) for i in range(old_shards)]
    intervals = flow_intervals(min_cost_flow(supply, capacities or even_capacities(sum(supply), new_shards), cost))
    cuts = F.broadcast(spark.createDataFrame(intervals or [(0, 0, 0, 0)], "cut_old int, to int, low long, high long"))  # a row per flow
    middle = F.col("before") + F.col("size") / 2
    sent = light.join(cuts, (F.col("shard") == F.col("cut_old")) & (middle >= F.col("low")) & (middle < F.col("high")))
    flows = sorted((r["to"], r["shard"] != r["to"], r["shard"], r["first"], r["n"]) for r in sent.groupBy("shard", "to").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    bases, held = [], {}
    for to, _, old, first, n in flows:  # what stays comes first and keeps its slots
        bases.append((old, to, held.get(to, 0) - first))
        held[to] = held.get(to, 0) + n
    shifts = F.broadcast(spark.createDataFrame(bases or [(0, 0, 0)], "base_old int, base_to int, shift long"))
    files = materialize(sent.groupBy("shard", "file").agg(F.bool_or(F.col("to") != F.col("shard")).alias("touched")), "files")
    touched = store.join(_small(files.filter("touched").select("shard", "file")), ["shard", "file"], "left_semi")
    moved = touched.join(cuts, (F.col("shard") == F.col("cut_old")) & (middle >= F.col("low")) & (middle < F.col("high")))
    moved = moved.join(shifts, (F.col("shard") == F.col("base_old")) & (F.col("to") == F.col("base_to")))
    new = moved.select("doc_id", "text", "size", (F.col("slot") + F.col("shift")).alias("slot"), F.when(F.col("to") == F.col("shard"), F.col("before")).alias("before"), F.col("shard").alias("old_shard"), "file", F.col("to").alias("shard"))
    new.repartition("shard", "old_shard", "file").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    written = spark.read.schema("doc_id long, text string, size long, slot long, before long, old_shard int, file int, shard int").parquet(path)
    kept = store.join(_small(files.filter("NOT touched").select("shard", "file")), ["shard", "file"], "left_semi").withColumn("old_shard", F.col("shard"))
    return kept.unionByName(written)


def shard_digest(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the old store, reshard it, and describe each document from the files of the new one."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_store(docs, old_shard, f"{path}/old", file_bytes)
    rows = reshard(read_store(spark, f"{path}/old"), old_shards, new_shards, f"{path}/new")
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
