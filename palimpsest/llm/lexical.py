"""Operator 12, ranked lexical search: Block-Max MaxScore over shards of an inverted index.

The index is a table. A shard holds neighbouring documents of one input partition, cut where it has POSTINGS
postings or TERMS terms; texts are read once and not shuffled. It has a row that lists its documents (term null)
and a row per term with its postings: numbers of documents as differences, and counts, as variable bytes, in
blocks of BLOCK postings. A list of several blocks keeps of each block its last document and, for four classes
of counts, the largest count and the shortest document; so the highest score that a block can give is known for
any corpus statistics, without its bytes, and an index can be built before those statistics are known.

Search takes the lists of the queries' terms, shard by shard. For a query the lists are ordered by the most they
can give (global bounds). Lists are read whole from the top while what is left could still reach the threshold,
the k-th best score so far: these are the essential ones. The rest only add to candidates: a candidate whose
score so far, block maximum and remaining bounds stay below the threshold is rejected before the block is
unpacked, and blocks without candidates are never unpacked. A task carries its k best of every query from shard
to shard; where there are many shards, a few of them are searched first and give all others their thresholds.
The heaps of the tasks are merged by Spark.

Queries are taken in blocks of at most QUERY_TERMS terms, which is what bounds the broadcasts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

BLOCK = 128
POSTINGS = 2_000_000
TERMS = 400_000
QUERY_TERMS = 100_000
SEEDS = 16
#: Bytes that belong to no term become spaces, A-Z become a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20
#: Counts 1, 2 to 3, 4 to 7, and more.
CLASSES = (1, 2, 4, 8, 1 << 62)
_INDEX = "shard long, term binary, df int, top_tf int, low_n int, heads binary, data binary, doc_ids array<bigint>, lengths array<int>"
_HITS = "query int, item_id long, doc_id long, score long"


def terms_of(text: bytes):
    """The terms of a text, in lists of about PIECE bytes of it."""
    if len(text) <= PIECE:
        yield text.translate(TABLE).split()
        return
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(TABLE)
        if at + PIECE < len(text):
            cut = piece.rfind(b" ")
            if cut < 0:  # a term longer than a piece
                rest = text[at:].translate(TABLE)
                cut = rest.find(b" ")
                piece = rest if cut < 0 else rest[: cut + 1]
            else:
                piece = piece[: cut + 1]
        yield piece.split()
        at += len(piece)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values (0 or more) as variable bytes, seven bits each, low ones first, and the number of bytes of each."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        part = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[has] + k] = part.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    """The values that pack() wrote."""
    last = data < 128
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(data) else np.zeros(0, np.int64)
    if len(first) == len(data):
        return data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def damping(n, docs: int, total: int):
    """What the length n of a document puts into its scores."""
    return 25 + (75 * docs * np.asarray(n, np.int64)) // total


class _Shard:
    """Postings gathered in memory until they are a shard."""

    def __init__(self):
        self.vocabulary = {}
        self.keys, self.counts, self.postings, self.ids, self.lengths = [], [], 0, [], []

    def add(self, docs: list) -> None:
        """docs: (doc_id, text as bytes or None)."""
        number, tokens, of = self.vocabulary, [], []
        for id_, text in docs:
            n = 0
            for piece in terms_of(text or b""):
                tokens.append(piece)
                of.append(np.full(len(piece), len(self.ids), np.int64))
                n += len(piece)
            if n:
                self.ids.append(id_)
                self.lengths.append(n)
        for piece in tokens:
            for t in piece:
                if t not in number:
                    number[t] = len(number)
        terms = np.fromiter((number[t] for piece in tokens for t in piece), np.int64, sum(map(len, tokens)))
        if len(terms):
            keys, counts = np.unique(terms << 32 | np.concatenate(of), return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.postings += len(keys)

    def table(self, shard: int):
        """The shard's rows as Arrow batches, its documents first."""
        import pyarrow as pa

        names = [x.split()[0] for x in _INDEX.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        rows = lambda columns: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)
        yield rows([[shard], [None], [len(self.ids)], [None], [None], [None], [None], [self.ids], [self.lengths]])
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")  # a document in pieces has a posting of a term from each
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, tf = keys[new], np.add.reduceat(counts, new)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(first, len(term)))
        place = np.arange(len(term)) - np.repeat(first, df)
        gap = np.where(place == 0, doc, doc - np.concatenate([[0], doc[:-1]]))
        data, size = pack(np.stack([gap, tf], 1).ravel())
        end = np.concatenate([[0], np.cumsum(size.reshape(-1, 2).sum(1))])  # bytes before each posting
        n = np.array(self.lengths, np.int64)[doc]
        # Heads of lists with several blocks: last document, first byte, and a count and a length for each class.
        cut = np.flatnonzero((place % BLOCK == 0) & (np.repeat(df, df) > BLOCK))
        heads, blocks_of = np.zeros((len(cut), 2 + 2 * (len(CLASSES) - 1)), "<u4"), np.zeros(len(first), np.int64)
        if len(cut):
            sure = np.flatnonzero(np.repeat(df, df) > BLOCK)
            at = np.searchsorted(sure, cut)
            lists = np.searchsorted(first, cut, "right") - 1
            blocks_of = np.bincount(lists, minlength=len(first))
            heads[:, 0] = doc[sure][np.append(at[1:], len(sure)) - 1]
            heads[:, 1] = end[cut] - end[first[lists]]
            for c in range(len(CLASSES) - 1):
                inside = (tf[sure] >= CLASSES[c]) & (tf[sure] < CLASSES[c + 1])
                heads[:, 2 + 2 * c] = np.maximum.reduceat(np.where(inside, np.minimum(tf[sure], 0xFFFFFFFF), 0), at)
                heads[:, 3 + 2 * c] = np.minimum.reduceat(np.where(inside, np.minimum(n[sure], 0xFFFFFFFF), 0xFFFFFFFF), at)
        top, low = np.maximum.reduceat(tf, first), np.minimum.reduceat(n, first)
        words = list(self.vocabulary)
        data, heads, width = data.tobytes(), heads.tobytes(), heads.shape[1] * 4
        spans, block_ends = end[np.append(first, len(term))], np.concatenate([[0], np.cumsum(blocks_of)])
        for a in range(0, len(first), 20_000):
            k = range(a, min(a + 20_000, len(first)))
            yield rows([
                [shard] * len(k), [words[term[first[i]]] for i in k], df[a : k.stop], np.minimum(top[a : k.stop], 0x7FFFFFFF), np.minimum(low[a : k.stop], 0x7FFFFFFF),
                [heads[width * block_ends[i] : width * block_ends[i + 1]] or None for i in k], [data[spans[i] : spans[i + 1]] for i in k], [None] * len(k), [None] * len(k),
            ])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS, terms: int = TERMS) -> DataFrame:
    """The index of all terms of whole texts, written to the shared folder.

    Terms are maximal runs of ASCII letters and digits and of all characters outside ASCII; only A-Z are
    lower-cased. Documents without terms (null and empty texts too) are not in it; repeated rows are documents of their own; a null
    id stays null. An empty table gives an empty index. Other columns are not read.
    """

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        shard = _Shard()
        for batch in slices(batches, 200):
            todo, size = [], 0
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                todo.append((id_, text))
                size += len(text or b"")
                if size > 4 * PIECE:
                    shard.add(todo)
                    todo, size = [], 0
            shard.add(todo)
            if shard.postings >= postings or len(shard.vocabulary) >= terms:
                yield from shard.table(number)
                shard, number = _Shard(), number + 1
        if shard.postings:
            yield from shard.table(number)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialize(texts.mapInArrow(build, _INDEX), "lexical-index", "zstd")


def index_size(index: DataFrame) -> tuple[int, int, int]:
    """Documents with terms, all their terms, and shards."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    row = index.filter("term IS NULL").select(F.col("df").cast("long").alias("n"), total.alias("l")).agg(F.sum("n"), F.sum("l"), F.count(F.lit(1))).first()
    return row[0] or 0, row[1] or 0, row[2]


class _List:
    """A term's postings in a shard."""

    def __init__(self, row, m, low_m):
        self.df, self.data, heads = row["df"], np.frombuffer(row["data"], np.uint8), row["heads"]
        self.m, self.most, self.whole = m, int(impact(row["top_tf"], low_m(row["low_n"]))), None
        self.last = self.start = self.block_most = None
        if heads is not None:
            h = np.frombuffer(heads, "<u4").astype(np.int64).reshape(-1, 2 + 2 * (len(CLASSES) - 1))
            self.last, self.start = h[:, 0], np.append(h[:, 1], len(self.data))
            tf, n = h[:, 2::2], h[:, 3::2]
            self.block_most = np.where(tf > 0, impact(np.maximum(tf, 1), low_m(n)), 0).max(1)
            self.most = int(self.block_most.max())

    def all(self):
        """Documents and impacts of the whole list, unpacked once."""
        if self.whole is None:
            v = unpack(self.data)
            docs = np.cumsum(v[::2])
            self.whole = docs, impact(v[1::2], self.m[docs])
        return self.whole

    def some(self, blocks):
        """Those of some blocks."""
        data = np.concatenate([self.data[self.start[b] : self.start[b + 1]] for b in blocks])
        v = unpack(data)
        gap, tf = v[::2], v[1::2]
        n = np.where(blocks == len(self.last) - 1, (self.df - 1) % BLOCK + 1, BLOCK)
        first = np.cumsum(n) - n
        run = np.cumsum(gap)
        before = np.where(blocks == 0, 0, self.last[blocks - 1])
        docs = run + np.repeat(before - (run[first] - gap[first]), n)
        return docs, impact(tf, self.m[docs])


def _kth(scores, k, floor):
    """The k-th largest of scores, if that is above floor."""
    return max(floor, int(np.partition(scores, -k)[-k])) if len(scores) >= k else floor


def best_in_shard(lists: list, size: int, threshold: int, k: int, seen: dict | None = None):
    """(documents, scores) of a shard that may be among a query's k best of at least `threshold`.

    lists: (weight, _List) per term, a term's repeats in its weight; seen counts blocks that were unpacked and passed over.
    """
    lists = sorted(((w * p.most, w, p) for w, p in lists if w * p.most > 0), key=lambda x: -x[0])
    left = sum(x[0] for x in lists)
    score, threshold = np.zeros(size, np.int64), max(threshold, 1)
    at = 0
    while at < len(lists) and left >= threshold:  # essential lists
        most, w, p = lists[at]
        docs, impacts = p.all()
        score[docs] += w * impacts
        left -= most
        at += 1
        threshold = _kth(score, k, threshold)
    found = np.flatnonzero(score + left >= threshold)
    found = found[score[found] > 0]
    for most, w, p in lists[at:]:
        left -= most
        if not len(found):
            break
        if p.last is None or p.whole is not None:
            docs, impacts = p.all()
            hit = np.searchsorted(docs, found)
            hit[hit == len(docs)] = 0
            score[found] += np.where(docs[hit] == found, w * impacts[hit], 0)
        else:
            block = np.searchsorted(p.last, found)
            inside = block < len(p.last)
            more = np.where(inside, w * p.block_most[np.minimum(block, len(p.last) - 1)], 0)
            stay = score[found] + more + left >= threshold
            found, block, inside = found[stay], block[stay], inside[stay]
            blocks = np.unique(block[inside])
            if seen is not None:
                seen["unpacked"] += len(blocks)
                seen["passed"] += len(p.last) - len(blocks)
            if len(blocks):
                docs, impacts = p.some(blocks)
                hit = np.searchsorted(docs, found)
                hit[hit == len(docs)] = 0
                score[found] += np.where(docs[hit] == found, w * impacts[hit], 0)
        threshold = _kth(score[found], k, threshold)
        found = found[score[found] + left >= threshold]
    found = found[score[found] >= threshold]
    return found, score[found]


def _order(hit):
    score, id_ = hit
    return -score, id_ is None, id_ or 0


def _search(queries, k: int, docs: int, total: int):
    """queries: a broadcast list of (item_id, [(term, weight)], threshold)."""

    def search(batches):
        import pyarrow as pa

        best = [[] for _ in queries.value]  # (score, doc_id), at most k
        low_m = lambda n: damping(n, docs, total)
        shard, ids, m, lists = None, None, None, {}

        def done():
            if not lists:
                return
            for q, (_, terms, floor) in enumerate(queries.value):
                mine = [(w, lists[t]) for t, w in terms if t in lists]
                if not mine:
                    continue
                held = best[q]
                found, scores = best_in_shard(mine, len(ids), max(floor, held[-1][0] if len(held) == k else 0), k)
                if len(found):
                    best[q] = sorted([*held, *((int(s), ids[d]) for s, d in zip(scores, found))], key=_order)[:k]

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    done()
                    shard, lists = row["shard"], {}
                if row["term"] is None:
                    ids, m = row["doc_ids"], low_m(row["lengths"])
                else:
                    lists[row["term"]] = _List(row, m, low_m)
        done()
        out = [(q, queries.value[q][0], id_, score) for q, held in enumerate(best) for score, id_ in held]
        for at in range(0, len(out), 10_000):
            columns = zip(*out[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], [x.split()[0] for x in _HITS.split(", ")])

    return search


def _query_blocks(queries: DataFrame, id_col: str, text_col: str, most: int):
    """Lists of (item_id, counts of its terms) of at most `most` terms, or of one query."""
    block, size = [], 0
    for id_, text in queries.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")).toLocalIterator():
        counts = Counter()
        for piece in terms_of(bytes(text or b"")):
            counts.update(piece)
        if block and size + len(counts) > most:
            yield block
            block, size = [], 0
        block.append((id_, counts))
        size += len(counts)
    if block:
        yield block


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", query_terms: int = QUERY_TERMS, seeds: int = SEEDS
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every query, of scores above 0.

    index: build_index's. A score sums, over a query's terms with repeats, weight * ((10^9 * tf) div (1000 * tf + 8 * m)) with
    m = 25 + ((75 * n * N) div L) and weight floor(1000 * ln((2N + 2) / (2df + 1))). Equal scores go by ascending doc_id, null last.
    Queries without terms that occur (null and empty ones too) have no rows; rows that repeat an item_id are ranked each.
    """
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs, total, shards = index_size(index)
    found = []
    for block in _query_blocks(queries, id_col, text_col, query_terms) if docs else ():
        asked = spark.createDataFrame([(bytearray(t),) for t in sorted(set().union(*(c for _, c in block)))], "term binary")
        lists = materialize(index.join(F.broadcast(asked), "term", "left_semi").select(*index.columns), "lexical-lists")
        weight = {bytes(t): math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for t, df in lists.groupBy("term").agg(F.sum(F.col("df").cast("long"))).collect()}
        weighed = [(id_, [(t, weight[t] * c) for t, c in counts.items() if weight.get(t)]) for id_, counts in block]
        rows = index.filter("term IS NULL").unionByName(lists)

        def hits(part, floors, rows=rows, weighed=weighed):
            shared = spark.sparkContext.broadcast([(i, t, floors.get(q, 0)) for q, (i, t) in enumerate(weighed)])
            dealt = rows.filter(part).repartition(n, "shard").sortWithinPartitions("shard", F.col("term").isNotNull())
            return dealt.mapInArrow(_search(shared, k, docs, total), _HITS)

        group = F.pmod(F.xxhash64("shard"), F.lit(max(1, shards // seeds)))
        if shards > 4 * seeds:
            first = materialize(hits(group == 0, {}), "lexical-seeds")
            w = Window.partitionBy("query").orderBy(F.desc("score"))
            floors = dict(first.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("query", "score").collect())
            own = first.unionByName(hits(group != 0, floors))
        else:
            own = hits(F.lit(True), {})
        w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found.append(materialize(ranked.select("item_id", "rank", "doc_id", "score"), "lexical-hits"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    paths = found[0]
    for more in found[1:]:
        paths = paths.unionByName(more)
    return paths
