"""Operator 8, exact top-k search: a Voronoi kNN join on the integer inner product.

Pivots, about sqrt(n) vectors and PIVOTS at most, first by a hash of their id, divide the space into cells.
Every query is sure of the k-th best score that it has with a sample of SAMPLE other vectors; the
least of these in a cell of queries is the cell's `reach`. For a vector v at distance b from its
pivot p, q.v <= q.p + |q| b, so from the summaries (a row per pair of cells: the largest q.p, the
longest q, the reach) follows the distance that a vector of one cell must have to matter to the
queries of another. Neighbouring cells of queries form groups of about BLOCK_QUERIES queries, and
a vector is sent once to each group in which it could be a hit. A group that has more queries is
dealt into blocks, the vectors sent to it into slices; each pair is solved locally, and the
slices' best are ranked once more. Distances and bounds are floating-point with a margin for
rounding; scores are integers.

A slice answers only with hits that reach the query's own bound. Where there are more than BOUND_STEPS times SAMPLE vectors the
bounds are raised first, by searches among ever larger parts of the vectors, each BOUND_STEPS times the one before: a
search then finds about BOUND_STEPS times k hits for a query, however many slices there are.

The sample and the pivots are bounded and only steer the work; every vector is placed and every
one that could be a hit is scored. Where vectors lie evenly in many dimensions no bound excludes
any, and each is sent to every group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOTS, SAMPLE = 1_024, 4_096
SLICE_ROWS = 8_000
BLOCK_QUERIES = 8_192
BOUND_STEPS = 16
#: Parts of the vectors are taken by so many bits of a hash of their ids.
PART_BITS = 40
MARGIN = 1e-6


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale x) of every component, without null vectors and null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.filter(v.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Lists padded with zeros to width."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _placed(width: int, pivots: np.ndarray):
    def place(batches):
        import pyarrow as pa

        for batch in batches:
            v = _matrix(batch.column("v").to_pylist(), width)
            x = v.astype(float)
            cell = ((pivots * pivots).sum(1)[None] - 2 * x @ pivots.T).argmin(1)
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) * (1 + MARGIN) + MARGIN
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cell, pa.int32()), pa.array(away), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "cell", "away", "v"]
            )

    return place


def _query_summary(width: int, pivots: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int):
    """Per cell of queries and pivot: the largest product; per cell its longest query, reach and number (in the rows of pivot 0 and on)."""

    def summary(batches):
        import pandas as pd

        for b in batches:
            q = np.frombuffer(b"".join(b["v"]), np.int64).reshape(-1, width).astype(float)
            long = np.sqrt((q * q).sum(1)) * (1 + MARGIN)
            scores = q @ sample.T
            scores[b["vec_id"].to_numpy()[:, None] == sample_ids[None]] = -np.inf
            reach = np.partition(scores, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k] if len(sample_ids) >= k else np.full(len(q), -np.inf)
            dots = q @ pivots.T
            for cell in np.unique(b["cell"]):
                own = (b["cell"] == cell).to_numpy()
                yield pd.DataFrame({"cell": cell, "pivot": range(len(pivots)), "high": dots[own].max(0), "long": long[own].max(), "reach": reach[own].min(), "n": int(own.sum())})

    return summary


def _own_bounds(width: int, sample: np.ndarray, sample_ids: np.ndarray, k: int):
    """Each query with a score that k of its hits reach at least."""

    def bounds(batches):
        least = np.iinfo(np.int64).min
        for b in batches:
            q = np.frombuffer(b"".join(b["v"]), np.int64).reshape(-1, width).astype(float)
            scores = q @ sample.T
            scores[b["vec_id"].to_numpy()[:, None] == sample_ids[None]] = -np.inf
            reach = np.partition(scores, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k] if len(sample_ids) >= k else np.full(len(q), -np.inf)
            low = np.floor(reach - MARGIN * np.abs(reach)) - 1
            yield b.assign(bound=np.where(np.isfinite(low), low, float(least)).astype(np.int64))

    return bounds


def _groups(cells: np.ndarray, asked: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell of queries (-1: no queries): a walk from cell to nearest cell, cut where `most` queries are reached."""
    group, number, held = np.full(len(asked), -1), 0, 0
    left = list(cells)
    at = left.pop(0) if left else None
    while at is not None:
        if held and held + asked[at] > most:
            number, held = number + 1, 0
        group[at], held = number, held + asked[at]
        at = left.pop(int(((pivots[left] - pivots[at]) ** 2).sum(1).argmin())) if left else None
    return group


def _local(width: int, k: int):
    def local(q, d):
        import pandas as pd

        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        queries, asked, bounds = np.frombuffer(b"".join(q["v"]), np.int64).reshape(-1, width), q["vec_id"].to_numpy(), q["bound"].to_numpy()
        d = d.sort_values("vec_id", kind="stable")
        data, ids = np.frombuffer(b"".join(d["v"]), np.int64).reshape(-1, width), d["vec_id"].to_numpy()
        # Sums under 2**53 are exact in floating point, which has the fast product.
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * width < 2**53
        flat = data.T.astype(float) if exact else data.T
        least = np.iinfo(np.int64).min
        found: list[tuple] = []
        for at in range(0, len(queries), 64):
            own = asked[at : at + 64]
            scores = ((queries[at : at + 64].astype(float) if exact else queries[at : at + 64]) @ flat).astype(np.int64)
            scores[own[:, None] == ids[None]] = least  # a vector is no hit of its own id
            edges = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), least)
            for query, s, edge, bound in zip(own, scores, edges, bounds[at : at + 64]):
                near = np.flatnonzero((s > edge) & (s >= bound))
                if len(near) < k and edge > least and edge >= bound:
                    near = np.concatenate([near, np.flatnonzero(s == edge)[: k - len(near)]])  # the smallest ids
                found.append((np.full(len(near), query), ids[near], s[near]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    return local


def top_k(vectors: DataFrame, query_every: int = 100, k: int = 10, n_pivots: int | None = None, counts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each query.

    vectors: vec_id and v, as integer_vectors gives. Queries are the ids divisible by
    query_every. Ties go to the smaller id. A shorter vector counts as padded with zeros; rows
    repeated under one id are candidates each, but one query, and never hits of their own id;
    different vectors under one query's id share its k places. Fewer than k other vectors give as many rows; no vectors, none. Components must keep sums
    within 64 bits. `counts` receives the numbers of vectors, groups and rows sent to groups.
    """
    spark = vectors.sparkSession
    width, rows = vectors.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = width or 1
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample, sample_ids = _matrix([r["v"] for r in drawn], width).astype(float), np.array([r["vec_id"] for r in drawn])
    m = n_pivots or min(PIVOTS, max(16, int(rows**0.5)))
    pivots = np.unique(sample[:m], axis=0)
    m = len(pivots)
    placed = materialize(vectors.mapInArrow(_placed(width, pivots), "vec_id long, cell int, away double, v binary"), "placed")
    queries = placed.filter(F.col("vec_id") % query_every == 0)

    # Summaries: at most a row per pair of pivots.
    seen = queries.mapInPandas(_query_summary(width, pivots, sample, sample_ids, k), "cell int, pivot int, high double, long double, reach double, n long")
    seen = seen.groupBy("cell", "pivot").agg(F.max("high"), F.max("long"), F.min("reach"), F.sum("n")).collect()
    high, long, reach, asked = np.zeros((m, m)), np.zeros(m), np.full(m, -np.inf), np.zeros(m, int)
    for cell, pivot, h, le, re, n in seen:
        high[cell, pivot], long[cell], reach[cell], asked[cell] = h, le, re, n
    slack = MARGIN * (np.abs(reach[np.isfinite(reach)]).max(initial=0) + np.abs(high).max(initial=0)) + 1
    group = _groups(np.flatnonzero(asked), asked, pivots, BLOCK_QUERIES)
    n_groups = int(group.max()) + 1
    needed = np.full((n_groups, m), np.inf)  # the distance from its pivot that a vector must have
    for cell in np.flatnonzero(asked):
        short = reach[cell] - slack - high[cell]
        needed[group[cell]] = np.minimum(needed[group[cell]], np.where(short <= 0, 0.0, short / max(long[cell], MARGIN)))
    blocks = {g: -(-int(asked[group == g].sum()) // BLOCK_QUERIES) for g in range(n_groups)}

    def wanted(b):
        cell, away = b["cell"].to_numpy(), b["away"].to_numpy()
        for g in range(n_groups):
            hits = np.flatnonzero(away >= needed[g, cell])
            if len(hits):
                yield g, hits

    def count(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(g, len(hits)) for g, hits in wanted(b)], columns=["to", "n"])

    per_group = {r[0]: r[1] for r in placed.select("cell", "away").mapInPandas(count, "to int, n long").groupBy("to").agg(F.sum("n")).collect()}
    if counts is not None:
        counts.update(vectors=rows, groups=n_groups, cells=m, sent=sum(n * blocks[g] for g, n in per_group.items()))

    parts = []  # shares of the vectors in which better bounds are found
    while rows * BOUND_STEPS ** -(len(parts) + 1) > SAMPLE:
        parts.append(BOUND_STEPS ** -(len(parts) + 1))

    def sends(slices: dict):
        def send(batches):
            import pandas as pd

            for b in batches:
                ids, v = b["vec_id"].to_numpy(), b["v"].to_numpy()
                for g, hits in wanted(b):
                    one = pd.DataFrame({"to": g, "slice": (ids[hits] * 2654435761 >> 7) % slices[g], "vec_id": ids[hits], "v": v[hits]})
                    for block in range(blocks[g]):
                        yield one.assign(block=block)[["to", "block", "slice", "vec_id", "v"]]

        return send

    def deals(slices: dict):
        def deal(batches):
            import pandas as pd

            for b in batches:
                for g, own in b.groupby(group[b["cell"].to_numpy()]):
                    block = (own["vec_id"].to_numpy() // query_every) % blocks[int(g)]
                    for s in range(slices[int(g)]):
                        yield pd.DataFrame({"to": int(g), "block": block, "slice": s, "vec_id": own["vec_id"], "v": own["v"], "bound": own["bound"]})

        return deal

    kind, keys = "to int, block long, slice long, vec_id long, v binary", ["to", "block", "slice"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def search(data: DataFrame, asked: DataFrame, share: float = 1) -> DataFrame:
        slices = {g: max(1, math.ceil(per_group.get(g, 0) * share / SLICE_ROWS)) for g in range(n_groups)}
        sent, dealt = data.mapInPandas(sends(slices), kind), asked.mapInPandas(deals(slices), kind + ", bound long")
        met = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_local(width, k), "query_id long, vec_id long, score long")
        return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked_rows = queries.dropDuplicates(["vec_id", "v"]).mapInPandas(_own_bounds(width, sample, sample_ids, k), "vec_id long, cell int, away double, v binary, bound long")
    for share in reversed(parts):
        part = placed.filter(F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(7)), 64 - PART_BITS) < int(share * (1 << PART_BITS)))
        asked_rows = materialize(asked_rows, "bounds")
        raised = search(part, asked_rows, share).filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("reached"))
        asked_rows = asked_rows.join(materialize(raised, "raised"), F.col("vec_id") == F.col("of"), "left").withColumn("bound", F.greatest("bound", "reached")).drop("of", "reached")
    return search(placed, asked_rows)
