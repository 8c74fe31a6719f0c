"""Operator 7, mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order, form blocks of `block_docs`. With integer weights a_s of sum
A, block k of a source is released at slot floor(k A / a_s) and due at ceil((k + 1) A / a_s);
earliest-deadline-first places every block in its window, so after any number of slots a source
has had its share to within less than one block. The schedule repeats after A slots, so one
period is simulated and every block finds its slot by arithmetic. The integers are the target
weights in parts of PERIOD, so a share is off its target by half a part at most.

When a source's blocks run out, the rest share its slots by their own weights: a new phase with a
new period. Sources of weight 0 come when all others are used up. There are no more phases than
sources, and no row is dropped or repeated. Of a phase that is shorter than a period only its own slots are
simulated. With so many sources that the phases could have more than SLOTS slots in sum, blocks get as many documents
as keep all blocks within SLOTS; so what the driver works out and sends is bounded, whatever the numbers of sources and documents.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_rank, rank_blocks

BLOCK_DOCS = 32
PERIOD = 10_000
#: Slots up to which the schedule is broadcast; a longer one is joined by shuffle.
BROADCAST_SLOTS = 2_000_000
#: Most slots that are simulated.
SLOTS = 4_000_000
ROWS_PER_BLOCK = 1_000


def schedule(order, weights: list[int], total: int, n: int, left=None) -> dict[int, list[int]]:
    """The first n slots, earliest deadline first, or those up to the first source that has its `left` blocks: each source's own slots, of those that have any.

    order: the sources, largest weight first, which is the order of their first deadlines; total: the weights' sum. Ties go to the
    larger weight, then to the first source.
    """
    slots: dict[int, list[int]] = {}
    release: list[tuple] = []
    ready: list[tuple] = []
    first = 0
    for t in range(n):
        while release and release[0][0] <= t:
            _, s = heapq.heappop(release)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), -weights[s], s))
        s = int(order[first]) if first < len(order) else None
        if s is None or ready and ready[0] < (-(-total // weights[s]), -weights[s], s):
            _, _, s = heapq.heappop(ready)
        else:
            slots[s] = []
            first += 1
        slots[s].append(t)
        if left is not None and len(slots[s]) == left[s]:
            break
        heapq.heappush(release, (len(slots[s]) * total // weights[s], s))
    return slots


def period_of(weights: list[int]) -> list[list[int]]:
    """Slots of each source in one period of sum(weights) slots."""
    order = sorted((s for s, w in enumerate(weights) if w), key=lambda s: (-weights[s], s))
    slots = schedule(order, weights, sum(weights), sum(weights))
    return [slots.get(s, []) for s in range(len(weights))]


def phases_of(blocks: list[int], weights: list[int]):
    """Phases in order: (base slot, sum of weights, rows), a row (source, weight, first block, blocks, slots) for each source that has blocks in it.

    A phase runs whole periods and then the part of one that uses up the first source to end.
    """
    size, weight = np.array(blocks, np.int64), np.array(weights, np.int64)
    first, base = np.zeros(len(size), np.int64), 0
    for group in (np.flatnonzero((weight > 0) & (size > 0)), np.flatnonzero((weight == 0) & (size > 0))):
        w = np.maximum(weight, 1)
        plain = w.tolist()
        order = group[np.lexsort((group, -w[group]))]
        while len(order):
            left, total = size - first, int(w[order].sum())
            slots = schedule(order, plain, total, total, left)
            ended = [own[-1] + 1 for s, own in slots.items() if len(own) == left[s]]  # else the period is whole and no source has run out in it
            end = ended[0] if ended else min((int(left[s]) - 1) // plain[s] * total + own[(int(left[s]) - 1) % plain[s]] + 1 for s, own in slots.items())
            rows = []
            for s, own in slots.items():
                count = len(own) if ended else end // total * plain[s] + bisect.bisect_left(own, end % total)
                if count:
                    rows.append((s, plain[s], int(first[s]), count, own))
                    first[s] += count
            yield base, total, rows
            base += end
            order = order[first[order] < size[order]]


def target_weights(counts: dict, weights: dict | None, alpha: float, period: int) -> dict:
    """Integer weights of about `period` in sum: those given, else counts ** alpha; 1 at least, but 0 where 0 is given."""
    raw = {s: weights.get(s, None) if weights else c**alpha for s, c in counts.items()}
    total = sum(w or 0.0 for w in raw.values()) or 1.0
    return {s: 0 if w == 0 else max(1, round((w or 0.0) / total * max(period, 4 * len(raw)))) for s, w in raw.items()}


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    id_col: str = "doc_id",
    source_col: str = "source",
    extra: list[str] | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, weight, block, phase, released, due, slot, place.

    weights names the sources' target shares; by default a source of n documents weighs
    n ** alpha, and a source that weights does not name gets the least one. `slot` is the block's
    turn, `place` the document's in its block; (slot, place) orders the mixture. A source's last
    block may be shorter. A null source is a source of its own; repeated rows are ordered like
    any others; an empty table gives no rows. `extra` columns are carried under their names.
    """
    spark = docs.sparkSession
    carried = [F.struct(*(docs[c] for c in extra)).alias("__row")] if extra else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), *carried)
    named = rows.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), *(["__row"] if extra else []))
    counts = {r[0]: r[1] for r in named.groupBy("key").count().collect()}  # a row per source
    keys = sorted(counts)
    given = {f"s{s}" if s is not None else "": w for s, w in weights.items()} if weights else None
    share = target_weights(counts, given, alpha, period)
    documents = sum(counts.values())
    if len(keys) * max(period, 4 * len(keys)) > SLOTS:
        block_docs = max(block_docs, -(-documents // max(1, SLOTS - len(keys))))
    phases = phases_of([-(-counts[k] // block_docs) for k in keys], [share[k] for k in keys])
    table = [(keys[s], p, base, total, weight, first, first + n, slots) for p, (base, total, rows_) in enumerate(phases) for s, weight, first, n, slots in rows_]
    kind = "p_key string, phase int, base long, total long, weight long, first long, last long, slots array<long>"
    plan = spark.createDataFrame(table or [("", 0, 0, 1, 1, 0, 0, [0])], kind)  # sources x phases rows, `period` slots a phase
    light = named.select("doc_id", "key")
    ranked = grouped_rank(named, "key", ["doc_id"], None, rank_blocks(light, "key", ["doc_id"], None, ROWS_PER_BLOCK))
    blocks = ranked.withColumn("block", F.floor(F.col("__rank") / block_docs)).withColumn("place", F.pmod("__rank", F.lit(block_docs)))
    slots = sum(len(r[-1]) for r in table)
    joined = blocks.join(F.broadcast(plan) if slots <= BROADCAST_SLOTS else plan, (F.col("key") == F.col("p_key")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    k = F.col("block") - F.col("first")
    turn = F.floor(k / F.col("weight")) * F.col("total") + F.element_at("slots", (F.pmod(k, F.col("weight")) + 1).cast("int"))
    return joined.select(
        "doc_id",
        F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source"),
        "weight",
        "block",
        "phase",
        (F.col("base") + F.floor(k * F.col("total") / F.col("weight"))).alias("released"),
        (F.col("base") + F.ceil((k + 1) * F.col("total") / F.col("weight"))).alias("due"),
        (F.col("base") + turn).alias("slot"),
        F.col("place").cast("int").alias("place"),
        *(["__row"] if extra else []),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, range-sorted in the order of the mixture."""
    spark = docs.sparkSession
    rows = mix(docs, extra=docs.columns, **options)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("__row.*")
