"""Linked lists in tables: where each ends and what stands between, in rounds that grow with the logarithm of the length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import rewritten


def rank_lists(links: DataFrame, weights: list[str]) -> DataFrame:
    """node, end (the last node of its list) and each weight summed from the node to that end, both included.

    links: node (any type that can be compared, unique), to (the node after it, null at the end), the weights. By pointer
    jumping: a round follows three pointers, so paths grow fourfold; nodes that know their end are not written
    again. A `to` that is no node ends its list before it. Nodes of a circle have a null end.
    """
    nodes = links.select(F.col("node").alias("__node"))
    held = links.join(nodes, F.col("to") == F.col("__node"), "left").withColumn("to", F.col("__node")).drop("__node")
    first = held.select("node", "to", F.when(F.col("to").isNull(), F.col("node")).alias("end"), *weights)
    at = rewritten(first, "list")
    done, moving, n = at.filter("end IS NOT NULL"), at.filter("end IS NULL"), None
    reach = 1
    while moving.limit(1).count():
        n = n or moving.count()
        if reach > n + 1:  # only circles are left
            break
        known = done.unionByName(moving)
        step = moving
        for _ in range(3):
            ahead = known.select(F.col("node").alias("__node"), F.col("to").alias("__to"), F.col("end").alias("__end"), *(F.col(w).alias(f"__{w}") for w in weights))
            step = step.join(ahead, F.col("to") == F.col("__node"), "left").select("node", F.col("__to").alias("to"), F.coalesce("end", "__end").alias("end"), *((F.col(w) + F.coalesce(F.col(f"__{w}"), F.lit(0))).alias(w) for w in weights))
        at = rewritten(step, "list")
        done, moving, reach = done.unionByName(at.filter("end IS NOT NULL")), at.filter("end IS NULL"), reach * 4
    return done.unionByName(moving).select("node", "end", *weights)


#: Sequence numbers of a group that one window holds.
SPAN = 1 << 16


def as_of(rows: DataFrame, by: list[str], order: str, value: Column, inclusive: bool = False, span: int = SPAN) -> DataFrame:
    """rows with `__last`: the last value that is not null of the rows of its group before it (or with it).

    Windows hold a stretch of `span` numbers of `order` of a group; only the last values of stretches are carried on along the
    group, so a group may be as large as it likes.
    """
    cut = rows.withColumn("__value", value).withColumn("__stretch", F.floor(F.col(order) / span))
    told = F.col("__value").isNotNull()
    ends = cut.filter(told).groupBy(*by, "__stretch").agg(F.max_by("__value", order).alias("__end"))
    stretches = cut.select(*by, "__stretch").distinct().join(ends, [*by, "__stretch"], "left")
    along = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(*by, "__stretch", F.last("__end", True).over(along).alias("__carried"))
    inside = Window.partitionBy(*by, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    placed = cut.withColumn("__near", F.last("__value", True).over(inside))
    joined = placed.join(carried, [*by, "__stretch"])
    return joined.select(*rows.columns, F.coalesce("__near", "__carried").alias("__last"))


def counted(rows: DataFrame, by: list[str], order: str, value: Column, span: int = SPAN) -> DataFrame:
    """rows with `__sum`: value summed over the rows of its group up to and with it, by stretches as in as_of."""
    cut = rows.withColumn("__value", value).withColumn("__stretch", F.floor(F.col(order) / span))
    sums = cut.groupBy(*by, "__stretch").agg(F.sum("__value").alias("__all"))
    along = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "__stretch", F.coalesce(F.sum("__all").over(along), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(*by, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("__near", F.sum("__value").over(inside))
    return placed.join(carried, [*by, "__stretch"]).select(*rows.columns, (F.col("__carried") + F.col("__near")).alias("__sum"))


def following(steps: DataFrame, span: int = SPAN) -> DataFrame:
    """grp, seq, needs, gives and `next`: the first later step of the group that needs what this one gives; null needs follow nothing.

    A step meets the steps that need its value in the stretch of its own number; beyond that the first of each later stretch is enough.
    """
    cut = steps.withColumn("__stretch", F.floor(F.col("seq") / span))
    asks = cut.filter("needs IS NOT NULL").select("grp", F.col("needs").alias("v"), "__stretch", "seq", F.col("seq").alias("ask"))
    gives = cut.select("grp", F.col("gives").alias("v"), "__stretch", "seq", F.lit(None).cast("long").alias("ask"))
    both = asks.unionByName(gives)
    first = both.groupBy("grp", "v", "__stretch").agg(F.min("ask").alias("__first"))
    later = Window.partitionBy("grp", "v").orderBy("__stretch").rowsBetween(1, Window.unboundedFollowing)
    beyond = first.select("grp", "v", "__stretch", F.min("__first").over(later).alias("__beyond"))
    after = Window.partitionBy("grp", "v", "__stretch").orderBy("seq", F.col("ask").isNull()).rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("__near", F.min("ask").over(after)).filter("ask IS NULL").drop("ask")
    found = near.join(beyond, ["grp", "v", "__stretch"]).select("grp", "seq", F.coalesce("__near", "__beyond").alias("next"))
    return steps.join(found, ["grp", "seq"], "left")
