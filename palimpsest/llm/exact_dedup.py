"""Operator 10, exact dedup: tree-merge of sorted digest runs.

Documents are dealt into runs by a hash of their id, about RUN_ROWS to a run. A run is sorted by
digest and holds one row per digest: how many documents have it and which id it keeps. Runs then
merge in rounds along a tree: in a round FAN_IN neighbouring runs exchange their rows, each taking
one part of their digests (the next digit of the digest), and merge what they receive: Spark's
sort merges the sorted pieces, and one pass over them joins neighbours whose digest, length and
second hash all agree. So a group of copies, however large, is one row per run at first and one row at last, and after the
last round each digest stands in one run only. The decision goes back down the same way: last
level -> first runs -> documents, so copies of one text meet their group in as many tasks as there are runs.

A digest is the SHA-256 of the whole normalised text; the length and a 64-bit hash of another kind
verify it at every level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

RUN_ROWS = 500_000
FAN_IN = 8
BROADCAST_ROWS = 1_000_000
SAME = ["__digest", "__len", "__check"]
_ROW = "__run long, __slot long, __digest binary, __len int, __check long, __keep long, __size long"


def tree_rounds(rows: int, run_rows: int = RUN_ROWS, fan_in: int = FAN_IN) -> int:
    """Rounds of a tree whose FAN_IN ** rounds runs hold about run_rows rows each; 1 at least."""
    rounds = 1
    while fan_in**rounds * run_rows < rows:
        rounds += 1
    return rounds


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    normal = ascii_lower(raw)
    return docs.select(
        F.col(id_col).cast("long").alias("__id"),
        F.xxhash64(raw).alias("__raw"),
        F.unhex(F.sha2(normal, 256)).alias("__digest"),
        F.octet_length(normal).alias("__len"),
        F.xxhash64(normal).alias("__check"),
    )


def _merge(keep: str):
    """Rows in order of run, slot, digest, length and check: equal neighbours become one. A null id gives way to any other."""
    worst = np.iinfo(np.int64).min if keep == "max" else np.iinfo(np.int64).max
    best = np.maximum if keep == "max" else np.minimum

    def merge(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _ROW.split(", ")]
        held = None  # the last group so far: more of it may come

        def out(columns):
            run, slot, digest, size, check, kept, n = columns
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            fixed = [pa.array(c.tolist() if k == pa.binary() else c, k) for c, k in zip((run, slot, digest, size, check), kinds)]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(kept, pa.int64(), mask=kept == worst), pa.array(n, pa.int64())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            run, slot, size, check, n = (batch.column(c).to_numpy() for c in ("__run", "__slot", "__len", "__check", "__size"))
            kept = batch.column("__keep").fill_null(worst).to_numpy()
            digest = np.array(batch.column("__digest").to_pylist(), object)
            columns = [run, slot, digest, size, check, kept, n]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            new = np.ones(len(columns[0]), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:5]])
            first = np.flatnonzero(new)
            columns = [*(c[first] for c in columns[:5]), best.reduceat(columns[5], first), np.add.reduceat(columns[6], first)]
            held = [c[-1:] for c in columns]
            if len(first) > 1:
                yield out([c[:-1] for c in columns])
        if held is not None:
            yield out(held)

    return merge


def merge_runs(rows: DataFrame, rounds: int, fan_in: int = FAN_IN, keep: str = "max") -> tuple[DataFrame, DataFrame]:
    """First runs and the last level of the tree: digest, length, check, kept id and size of every group.

    rows: __run and the columns of _digests.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = (fan_in - 1).bit_length()
    head = F.conv(F.hex(F.substring("__digest", 1, 7)), 16, 10).cast("long")  # 56 bits

    def merged(level: DataFrame) -> DataFrame:
        exchanged = level.repartition(n, "__run", "__slot").sortWithinPartitions("__run", "__slot", *SAME)
        return exchanged.mapInArrow(_merge(keep), _ROW)

    level = rows.select("__run", F.lit(0).cast("long").alias("__slot"), *SAME, F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size"))
    first = level = materialize(merged(level), "runs")
    for k in range(1, rounds + 1):
        digit = F.shiftright(head, 56 - bits * k).bitwiseAND(F.lit((1 << bits) - 1))
        level = merged(level.withColumn("__slot", F.col("__slot") * (1 << bits) + digit).withColumn("__run", F.floor(F.col("__run") / fan_in)))
    return first, level.select(*SAME, "__keep", "__size")


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str, run_rows: int, fan_in: int) -> DataFrame:
    """A row per document: __id, __raw, the digest and whether it stays, its group's __keep and __size."""
    digests = materialize(_digests(docs, id_col, text_col), "digests")
    rounds = tree_rounds(digests.count(), run_rows, fan_in)
    rows = digests.withColumn("__run", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(fan_in**rounds)).cast("long"))
    first, last = merge_runs(rows, rounds, fan_in, keep)
    down = first.select("__run", *SAME).join(last, SAME)
    found = rows.join(down, ["__run", *SAME])
    copies = Window.partitionBy("__run", *SAME, "__id").orderBy("__raw")
    return found.withColumn("__kept", F.col("__id").eqNullSafe(F.col("__keep")) & (F.row_number().over(copies) == 1))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", run_rows: int = RUN_ROWS, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and empty
    texts are copies of each other. The row with the largest id stays (keep="min": smallest);
    rows repeated with one id are copies too and one of them stays. A null id never beats
    another. An empty table gives an empty result; other columns are not read.
    """
    rows = _decided(docs, id_col, text_col, keep, run_rows, fan_in)
    return rows.select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; the rules are those of exact_duplicates.

    Only ids and hashes of what goes travel to the documents, not these to the groups. Rows that
    repeat an id and a text are told apart by number, where there are any.
    """
    rows = materialize(_decided(docs, id_col, text_col, keep, RUN_ROWS, FAN_IN).select("__id", "__raw", "__kept"), "decided")
    named = rows.groupBy("__id", "__raw").agg(F.bool_or("__kept").alias("__stays"), F.count(F.lit(1)).alias("__times"))
    odd = materialize(named.filter("NOT __stays OR __times > 1"), "going")
    n = odd.count()
    going = odd.filter("NOT __stays").select(F.col("__id").alias("__gone"), F.col("__raw").alias("__of"))
    raw = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    match = docs[id_col].cast("long").eqNullSafe(F.col("__gone")) & (raw == F.col("__of"))
    left = docs.join(F.broadcast(going) if n <= BROADCAST_ROWS else going, match, "left_anti")
    twice = odd.filter("__stays AND __times > 1").select(F.col("__id").alias("__two"), F.col("__raw").alias("__of"))
    if not twice.limit(1).count():
        return left
    # Few rows: of each such id and text one stays.
    again = left.select(F.struct(*(left[c] for c in left.columns)).alias("__row"), left[id_col].cast("long").alias("__id"), F.xxhash64(F.coalesce(left[text_col].cast("string"), F.lit(""))).alias("__raw"))
    same = F.col("__id").eqNullSafe(F.col("__two")) & (F.col("__raw") == F.col("__of"))
    one = Window.partitionBy("__id", "__raw").orderBy("__id")
    single = again.join(twice, same, "left_semi").withColumn("__n", F.row_number().over(one)).filter("__n = 1").select("__row.*")
    return again.join(twice, same, "left_anti").select("__row.*").unionByName(single)
