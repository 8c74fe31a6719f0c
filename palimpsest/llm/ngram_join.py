"""Operator 2, n-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles ("tokens"), as 64-bit hashes.

Counting. Chunks of documents send their distinct tokens to ranges of the hash space, where the
documents of each token are counted, however many there are; a range answers every chunk. A set
most of whose tokens stand in no other set can have no partner: such documents are done after the
first count. What is left is reduced to its different sets ("nodes", by a 128-bit digest) and
counted again among those.

Order and classes. Tokens are ordered by class, count and hash. Class 1 are tokens of at most
CLASS_LIMITS[0] sets, class 2 of at most CLASS_LIMITS[1], class 3 the rest. Two tokens whose
shortened hashes agree count as one; that moves both in the order, for all sets alike.

Prefixes. A set of n tokens that must share t with a partner may miss n - t of its own. Tokens of
class k are dealt by hash into groups, and a group of m tokens of a prefix is sure of a shared
k-combination once it misses fewer than m - k + 1. So the prefix is extended until these credits
reach n - t + 1, and its k-combinations inside the groups are indexed: single tokens of class 1,
pairs of class 2, triples of class 3. Similar sets then share a key in both their prefixes. The
number of groups belongs to a size level (powers of two); a set is indexed at the level of every
partner that is not larger, so keys grow in proportion to a set. Tokens of one set make no key.

Reach. Sets that share a token of class 1 meet under it. Those that meet under a pair or a triple only share none of their
f tokens of class 1, so at most n - f tokens in all, and that bounds the sizes of the partners that can be similar:
texts of one template with enough words of their own reach no partner of their size. A set has no pairs and triples
for levels it does not reach. Under a key of many sets the larger set of a pair asks at the sizes (in steps of some
13 %) that it reaches, and the smaller one stands at its own size, if it reaches any larger one; so near misses do not even meet.

Candidates share a key, have sizes that can reach the similarity, and parity vectors (one bit per
hash value, flipped by each token) that differ in no more bits than the sets may differ in
tokens: none of these tests loses a link. What is left is verified on the full sets with integers.

Groups. The answer is each document's connected component, so a group of near copies is not
expanded into its pairs. First every set meets only a few others under a key: those before it when
the key's sets stand in an order of least hashes, which puts similar sets together (keys of many
sets are cut along that order), and of all those only some, the nearest by parity and others by hash. The links found join sets into components.
Then, under keys that still hold several components, the sets outside a key's largest component
meet all those of other components; any link not in the first round's components is found here.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import release

#: Most sets that hold a token of class 1 and of class 2.
CLASS_LIMITS = (64, 1_024)
CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 60_000
RANGE_BYTES, RANGE_TOKENS = 4 << 20, 1 << 19
MANY = 0xFFFF
SHIFT = np.uint64(28)
PARITY_LONGS = 4
SALT_SETS = 4_096
ORDERS = 8
NEIGHBOURS = 8
#: Keys before a key, in a set's order, under which a pair is looked for before it is made again.
KEYS_BEFORE = 12
#: Pairs of the nearest parities, and as many by hash, that a set enters in the first round; what they leave unlinked is for the second.
FIRST_PAIRS = 16
BROADCAST_ROWS = 1_000_000
WIDE_BITS = 2_048
#: Rows of a key above which sets meet by sizes they reach, in steps of a factor of e ** (1 / SIZE_STEPS).
PLAIN_ROWS = 64
SIZE_STEPS = 8

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


_MULTIPLIERS = (np.arange(1, ORDERS + 1, dtype=np.uint64) * _ODD[0] ^ _ODD[4]) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Distinct word shingles of whole texts, hashed; A-Z lower-cased, words between ASCII white space."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.hash = words, xxhash.xxh64_intdigest

    def tokens(self, text: str | None) -> np.ndarray:
        """Sorted hashes; fewer words than a shingle has make one token; no words, none."""
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.hash, found), np.uint64, len(found))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h + w[i : len(w) - k + 1 + i]) * _ODD[i % 7]
        return np.unique(_mix(h))


def _signed(h) -> np.ndarray:
    return np.asarray(h, np.uint64).view(np.int64)


def distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of a chunk in order of their hashes: their places, which are new, and the new ones' numbers of times.

    The last SHIFT bits do not count.
    """
    order = np.sort((tokens >> SHIFT << SHIFT) | np.arange(len(tokens), dtype=np.uint64))
    head, places = order >> SHIFT, (order & np.uint64((1 << int(SHIFT)) - 1)).astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = head[1:] != head[:-1]
    return places, new, np.diff(np.append(np.flatnonzero(new), len(order)))


def cut_by_range(tokens: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges that hold some of the ordered tokens."""
    of = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
    return list(zip(of[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(of)]))


_DEALT = "range long, chunk long, tokens binary, with binary, ids array<long>, sizes array<int>, sets binary"


def _deal(words: int, ranges: int, with_sets: bool):
    """Per chunk of documents a row for each range that holds some of its distinct tokens, and one for its documents.

    `with` has two bytes for each token: the document in the chunk (MANY: several), or with_sets
    the documents of the chunk that have it. The documents' row goes along with one of the ranges.
    """

    def deal(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        get, chunk = Shingler(words).tokens, TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = [x.split()[0] for x in _DEALT.split(", ")]
        ids, sets, held = [], [], 0

        def flush():
            nonlocal chunk, ids, sets, held
            sizes, all_tokens = np.array([len(s) for s in sets], np.int32), np.concatenate(sets)
            places, new, times = distinct(all_tokens)
            first = places[new]
            tokens = all_tokens[first]
            if with_sets:
                extra = np.minimum(times, MANY)
            else:
                extra = np.where(times > 1, MANY, np.repeat(np.arange(len(sizes)), sizes)[first])
            short, extra = (tokens >> SHIFT).astype("<u4"), extra.astype("<u2")
            rows = [(r, chunk, short[a:b].tobytes(), extra[a:b].tobytes(), None, None, None) for r, a, b in cut_by_range(tokens, ranges)]
            rows.append((chunk % ranges, chunk, None, None, ids, sizes.tolist(), all_tokens.tobytes() if with_sets else None))
            chunk, ids, sets, held = chunk + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        release()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc)
                sets.append(get(text.as_py()))
                held += len(sets[-1])
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield flush()
        if ids:
            yield flush()

    return deal


def _ranges_of(batches):
    """The tokens' rows of one range after another, as (range, chunks, tokens, with); documents' rows as they come."""
    now, rows = None, []
    for batch in slices(batches, 64):
        for of, chunk, tokens, extra, ids, sizes, sets in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if of != now and rows:
                yield now, rows
                rows = []
            now = of
            if tokens is None:
                yield None, (of, chunk, None, None, ids, sizes, sets)
            else:
                rows.append((chunk, np.frombuffer(tokens, "<u4"), np.frombuffer(extra, "<u2")))
    if rows:
        yield now, rows


def _equal_tokens(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows' tokens in order of the tokens, and which are new there."""
    tokens = np.concatenate([t for _, t, _ in rows]).astype(np.uint64)
    order = np.sort(tokens << np.uint64(32) | np.arange(len(tokens), dtype=np.uint64))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] >> np.uint64(32) != order[:-1] >> np.uint64(32)
    return (order & np.uint64(0xFFFFFFFF)).astype(np.int64), new


def _answer(rows: list, chunk_rows) -> list[tuple]:
    bounds = np.cumsum([0, *(len(t) for _, t, _ in rows)]).tolist()
    return [(chunk, *chunk_rows(a, b)) for (chunk, _, _), a, b in zip(rows, bounds, bounds[1:])]


def _single(rows: list) -> list[tuple]:
    """Per chunk: the documents with tokens that no other document has, and how many of them."""
    places, new = _equal_tokens(rows)
    owner = np.concatenate([x for _, _, x in rows])
    alone = np.zeros(len(owner), bool)
    alone[places] = new & np.append(new[1:], True)
    alone &= owner != MANY

    def of(a, b):
        docs, times = np.unique(owner[a:b][alone[a:b]], return_counts=True)
        return docs.astype("<u2").tobytes(), times.astype("<u4").tobytes()

    return _answer(rows, of)


#: Codes of counts: themselves up to 128, then eight to a doubling; the last one has no upper end.
_EDGES = np.unique(np.concatenate([np.arange(1, 129), np.ceil(128 * 2.0 ** (np.arange(1, 127) / 8))]).astype(np.int64))


def code_of(counts: np.ndarray) -> np.ndarray:
    """One byte that orders counts; equal counts have equal codes, and a code of 1 is a count of 1."""
    return np.searchsorted(_EDGES, counts, "right").astype(np.uint8)


def count_of(codes: np.ndarray) -> np.ndarray:
    """The least count of each code (a code of 0 counts as 1)."""
    return _EDGES[np.maximum(codes.astype(np.int64), 1) - 1]


def _counted(rows: list) -> list[tuple]:
    """Per chunk: the codes of its tokens' counts, in the order of its tokens."""
    places, new = _equal_tokens(rows)
    times = np.concatenate([x for _, _, x in rows]).astype(np.int64)[places]
    sums = np.add.reduceat(times, np.flatnonzero(new))
    codes = np.zeros(len(places), np.uint8)
    codes[places] = code_of(sums)[np.cumsum(new) - 1]
    return _answer(rows, lambda a, b: (codes[a:b].tobytes(), None))


_ANSWERED = "chunk long, range long, one binary, two binary, ids array<long>, sizes array<int>, sets binary"


def _in_ranges(answer):
    """Rows of _DEALT ordered by range: what `answer` makes of each range's rows, a row per chunk, and the documents' rows (range -1)."""

    def count(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = [x.split()[0] for x in _ANSWERED.split(", ")]
        for of, rows in _ranges_of(batches):
            found = [(rows[1], -1, *rows[2:])] if of is None else [(chunk, of, one, two, None, None, None) for chunk, one, two in answer(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return count


def _answers(rows: DataFrame, words: int, ranges: int, with_sets: bool) -> DataFrame:
    """The ranges' answers brought together by chunk, the documents' row first and then ranges in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_deal(words, ranges, with_sets), _DEALT).repartition(n, "range").sortWithinPartitions("range")
    answered = dealt.mapInArrow(_in_ranges(_counted if with_sets else _single), _ANSWERED)
    return answered.repartition(n, "chunk").sortWithinPartitions("chunk", "range")


def _by_chunk(batches):
    """(documents' row, answers' rows) of each chunk, as tuples of one, two, ids, sizes, sets."""
    now, rows = None, []
    for batch in slices(batches, 16):
        for chunk, _, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if chunk != now and rows:
                yield rows[0], rows[1:]
                rows = []
            now = chunk
            rows.append(row)
    if rows:
        yield rows[0], rows[1:]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _alone(percent: int):
    """Per document: doc_id, n, and whether too many of its tokens are in no other document for it to have a partner."""

    def alone(batches):
        import pyarrow as pa

        for (_, _, ids, sizes, _), answers in _by_chunk(batches):
            single = np.zeros(len(ids), np.int64)
            for docs, times, *_ in answers:
                single[np.frombuffer(docs, "<u2")] += np.frombuffer(times, "<u4")
            n = np.array(sizes, np.int64)
            done = n - single < -(-percent * n // 100)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(done)], ["doc_id", "n", "alone"])

    return alone


def _describe(words: int):
    """The rows with the size, a 128-bit digest and the wide parity of their sets."""

    def describe(batches):
        import pyarrow as pa
        import xxhash

        get = Shingler(words).tokens
        for batch in slices(batches):
            sets = [get(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([parity(s, WIDE_BITS).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *columns], ["doc_id", "text", "n", "digest", "wide"])

    return describe


def group_count(level: int, percent: int) -> int:
    """Groups of a class at a size level (sets of 2 ** level tokens or more); 0 where combinations cannot be sure to meet."""
    n = 1 << level
    must = least_overlap(n, percent)
    return min(max(1, (n - must + 1) // 2), (must - 1) // 3)


def levels_of(n: int, percent: int) -> range:
    """The levels of all partners that are not larger."""
    return range(max(1, least_overlap(n, percent)).bit_length() - 1, n.bit_length())


def index_keys(tokens: np.ndarray, codes: np.ndarray, percent: int, limits: tuple[int, int] = CLASS_LIMITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys under which a set is indexed, about how many sets have the tokens of each, and whether it is a single token.

    tokens: sorted hashes; codes: of the number of sets that hold each.
    """
    n = len(tokens)
    must = least_overlap(n, percent)
    if n * 100 < percent * (n + 1):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)  # only an equal set can be that similar
    need = n - must + 1
    order = np.lexsort((tokens, codes))
    tokens, counts = tokens[order], count_of(codes[order])
    kind = 1 + (counts > limits[0]) + (counts > limits[1])
    found, sizes, single = [], [], 0
    reached = largest_partner(n, n - int((kind == 1).sum()), percent)
    for level in levels_of(n, percent):
        groups = group_count(level, percent)
        if not groups:
            single = need
            continue
        if kind[min(need, n) - 1] == 1:
            single = max(single, need)
            continue
        if reached < max(must, 1 << level):
            single = max(single, int((kind == 1).sum()))
            continue
        group = np.where(kind == 1, 0, kind * groups + (_mix(tokens ^ _ODD[5]) % np.uint64(groups)).astype(np.int64))
        at = np.argsort(group, kind="stable")
        start = np.append(True, group[at][1:] != group[at][:-1])
        rank = np.empty(n, np.int64)
        rank[at] = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
        credit = np.cumsum(rank >= kind - 1)
        end = int(np.searchsorted(credit, need)) + 1
        single = max(single, int((kind[:end] == 1).sum()))
        for k in (2, 3):
            own = at[(at < end) & (kind[at] == k)]
            for members in np.split(own, np.flatnonzero(np.diff(group[own])) + 1):
                if len(members) >= k:
                    members = members[np.argsort(tokens[members])]
                    chosen = members[np.array(list(combinations(range(len(members)), k)))]
                    key = np.full(len(chosen), level * 4 + k, np.uint64)
                    for i in range(k):
                        key = (key + tokens[chosen[:, i]]) * _ODD[i + 2]
                    found.append(_mix(key))
                    sizes.append(counts[chosen].min(1))
    combined = sum(map(len, found))
    if single:
        shared = counts[:single] > 1
        found.append(tokens[:single][shared])
        sizes.append(counts[:single][shared])
    keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return keys, np.concatenate(sizes) if found else np.zeros(0, np.int64), np.arange(len(keys)) >= combined


def largest_partner(n: int, most: int, percent: int) -> int:
    """The size of the largest set that is similar enough to one of n tokens and shares at most `most` of them; under it, none is."""
    return (100 + percent) * most // percent - n


def similarity_ranks(tokens: np.ndarray) -> np.ndarray:
    """ORDERS sort keys, each of the least hashes under six functions: similar sets come near each other."""
    least = [int((tokens * m).min() >> np.uint64(44)) & 1023 for m in _MULTIPLIERS]
    ranks = []
    for i in range(ORDERS):
        rank = 0
        for j in range(6):
            rank = rank << 10 | least[(i + 3 * j) % ORDERS]
        ranks.append(rank)
    return np.array(ranks, np.int64)


def parity(tokens: np.ndarray, bits: int = 64 * PARITY_LONGS) -> np.ndarray:
    """One bit per hash value, flipped by each token; two sets differ in at least as many tokens as bits."""
    odd = np.bincount((_mix(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


_PARITY = [f"parity{i}" for i in range(PARITY_LONGS)]
_INDEX = ["key", "salt", "rank", "n", "most", "single", "id", *_PARITY]
_KIND = "key long, salt int, rank long, n int, most int, single boolean, id long, " + ", ".join(f"{p} long" for p in _PARITY)


def _index(percent: int, limits: tuple[int, int]):
    """The index rows of the sets that come with the codes of their tokens' counts."""

    def index(batches):
        import pyarrow as pa

        for (_, _, ids, sizes, sets), answers in _by_chunk(batches):
            tokens = np.frombuffer(sets, np.uint64)
            places, new, _ = distinct(tokens)
            codes = np.zeros(len(tokens), np.uint8)
            if len(tokens):
                codes[places] = np.frombuffer(b"".join(a[0] for a in answers), np.uint8)[np.cumsum(new) - 1]
            bounds, found = np.cumsum([0, *sizes]).tolist(), []
            for doc, a, b in zip(ids, bounds, bounds[1:]):
                own = tokens[a:b]
                keys, seen, single = index_keys(own, codes[a:b], percent, limits)
                if len(keys):
                    keys, first = np.unique(keys, return_index=True)
                    seen, single = seen[first], single[first]
                    most = np.where(single, b - a, b - a - int((count_of(codes[a:b]) <= limits[0]).sum()))
                    ranks = similarity_ranks(own)[(keys % np.uint64(ORDERS)).astype(np.int64)]
                    parts = 1 + seen // SALT_SETS
                    salts = np.where(parts > 1, 1 + ((ranks >> 30) * parts >> 30), 0)
                    found.append((_signed(keys), salts.astype(np.int32), ranks, np.full(len(keys), b - a, np.int32), most.astype(np.int32), single, np.full(len(keys), doc, np.int64), *np.broadcast_to(parity(own)[:, None], (PARITY_LONGS, len(keys)))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], _INDEX)

    return index


def _stars(percent: int):
    """Rows sorted by key, salt, rank and id: each with the ids it is to be compared with, and the bits in which parities differ.

    Those are the NEIGHBOURS rows before it under its key and salt, where size and parity allow a
    link. Rows that are alone under a key of few sets (salt 0) go. The last row of a batch waits for the next.
    """

    def near(rows: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = np.zeros(len(i), np.int64)
        for p in _PARITY:
            differ += np.bitwise_count(rows[p][i] ^ rows[p][j])
        a, b = rows["n"][i].astype(np.int64), rows["n"][j].astype(np.int64)
        most = np.minimum(rows["most"][i], rows["most"][j]).astype(np.int64)
        fits = (np.maximum(a, b) * percent <= np.minimum(a, b) * 100) & (differ * (100 + percent) <= (a + b) * (100 - percent))
        return (i != j) & fits & ((a + b) * percent <= most * (100 + percent)), differ

    def stars(batches):
        import pyarrow as pa

        held, joined = None, False  # the waiting row, and whether one before it has its key

        def compared(rows: dict, last: bool):
            n = len(rows["key"])
            new = np.ones(n, bool)
            new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["salt"][1:] != rows["salt"][:-1])
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, 0))
            alone = new.copy()
            alone[0] = not joined
            alone[:-1] &= new[1:]
            i = np.flatnonzero((~alone | (rows["salt"] > 0)) & (at < n - (not last)))
            meets = np.stack([np.maximum(at - steps, start)[i] for steps in range(1, NEIGHBOURS + 1)], 1)
            fits, differ = (x.reshape(meets.shape) for x in near(rows, np.repeat(i, NEIGHBOURS), meets.ravel()))
            fits[:, 1:] &= meets[:, 1:] != meets[:, :-1]
            bounds = np.concatenate([[0], np.cumsum(fits.sum(1))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(rows["id"][meets[fits]]), pa.array(differ[fits].astype(np.int32))], ["id", "differ"])
            lists = pa.ListArray.from_arrays(pa.array(bounds), pairs)
            done = pa.RecordBatch.from_arrays([*(pa.array(rows[c][i]) for c in _INDEX), lists], [*_INDEX, "meets"])
            return done, n > 1 and not new[-1] or n == 1 and joined

        for batch in batches:
            if batch.num_rows:
                rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _INDEX}
                if held is not None:
                    rows = {c: np.concatenate([held[c], rows[c]]) for c in _INDEX}
                done, joined = compared(rows, False)
                held = {c: rows[c][-1:] for c in _INDEX}
                yield done
        if held is not None:
            yield compared(held, True)[0]

    return stars


def _verify(words: int, percent: int, kept: int = 64):
    """Pairs with their whole texts, in the order of b: those similar enough, by their full sets."""

    def verify(batches):
        import pyarrow as pa

        get, sets = Shingler(words).tokens, {}

        def tokens(doc: int, text) -> np.ndarray:
            if doc not in sets:
                if len(sets) >= kept:
                    sets.clear()
                sets[doc] = get(text.as_py())
            return sets[doc]

        for batch in batches:
            linked = []
            for i, x, j, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("b").to_pylist(), batch.column("text_b")):
                s, t = tokens(i, x), tokens(j, y)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(s) + len(t) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return verify


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to BROADCAST_ROWS rows of ids; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest id of its connected component) for the ends of links (a, b).

    Every node points at its least neighbour if that is less than itself; pointers only fall, so
    they make trees, and pointing at what the pointer's end points at flattens them in log2 of their height
    rounds. Links between different trees then join trees in the same way, until none is left.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    trees = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "trees")
    while True:
        ends = trees.select(F.col("node").alias("component"), F.col("component").alias("end"))
        flat = materialize(trees.join(ends, "component").select("node", F.col("end").alias("component"), (F.col("end") != F.col("component")).alias("moved")), "trees")
        trees = flat.select("node", "component")
        if not flat.filter("moved").limit(1).count():
            break
    at = lambda c: trees.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    across = edges.join(at("u"), "u").join(at("v"), "v").filter("of_u <> of_v").select(F.col("of_u").alias("a"), F.col("of_v").alias("b")).distinct()
    across = materialize(across, "across")
    if not across.limit(1).count():
        return trees
    joined = components(across).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return trees.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _possible(percent: int):
    """Pairs whose wide parities do not differ in more bits than the sets may differ in tokens."""

    def possible(batches):
        import pyarrow as pa

        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("wide_a", "wide_b")]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            size = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = pa.array(differ * (100 + percent) <= size * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return possible


def _linked(near: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar enough.

    Wide parities (256 bytes a set) go first: they tell apart large sets, which the index'
    short ones cannot, and spare most false candidates the way of their texts. Texts travel to the pairs, not sets: compressed, a text is half as large as its hashes.
    """
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "n_a", "wide_a", "b", "n_b", "wide_b")
    pairs = materialize(pairs.mapInArrow(_possible(percent), "a long, b long"), "possible")
    ends = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ends")
    texts = near.select("doc_id", "text").join(_small(ends, ends.count()), "doc_id", "left_semi")
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    second = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(second.select("a", "text_a", "b", "text_b").mapInArrow(_verify(words, percent), "a long, b long"), "links")


_MEETS = ", meets array<struct<id: long, differ: int>>"


def _some_pairs(stars: DataFrame) -> DataFrame:
    """Pairs (a, b) of what each set is to be compared with: FIRST_PAIRS of the nearest parities and as many by hash."""
    met = stars.select(F.explode("meets").alias("m"), F.col("id").alias("b")).select(F.col("m.id").alias("a"), "b", "m.differ").distinct()
    near_first, any_first = (F.row_number().over(Window.partitionBy("b").orderBy(*order)) for order in (("differ", "a"), (F.xxhash64("a", "b"), "a")))
    return met.select("a", "b", near_first.alias("i"), any_first.alias("j")).filter((F.col("i") <= FIRST_PAIRS) | (F.col("j") <= FIRST_PAIRS)).select("a", "b")


def _met(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components under a key that may be similar enough.

    Keys of one component are left out. Of a key's components the one with the most rows meets
    the others' rows, never its own. A pair that shares one of the KEYS_BEFORE keys of the same kind before this
    one, in each set's order of the keys that are left, is found under that key and not again here. Under keys of more than
    PLAIN_ROWS rows sets meet by the sizes they reach.
    """
    held = index.groupBy("key", "label").count().groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("rows"), F.max_by("label", F.struct("count", "label")).alias("largest"))
    mixed = index.join(held.filter("parts > 1").select("key", "rows", "largest"), "key")
    before = Window.partitionBy("id", "single").orderBy("key").rowsBetween(-KEYS_BEFORE, -1)
    mixed = materialize(mixed.withColumn("before", F.collect_list("key").over(before)), "mixed")
    differ = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in _PARITY), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    sized = (F.col("x.n") * percent <= F.col("y.n") * 100) & (F.col("y.n") * percent <= F.col("x.n") * 100)
    fits = (differ * (100 + percent) <= both * (100 - percent)) & (both * percent <= F.least("x.most", "y.most") * (100 + percent))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & sized & fits & ~F.arrays_overlap("x.before", "y.before")
    few, many = mixed.filter(F.col("rows") <= PLAIN_ROWS), mixed.filter(F.col("rows") > PLAIN_ROWS)
    once = (F.col("y.label") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id"))
    met = [few.filter("label <> largest").alias("x").join(few.alias("y"), apart & once)]
    step = lambda size: F.floor(F.log(size.cast("double")) * SIZE_STEPS)
    reached = F.floor((F.col("most") * (100 + percent)) / percent) - F.col("n")
    least, largest = F.ceil(F.col("n") * percent / 100), F.least("n", reached)
    # Only rows outside the largest component are dealt to the sizes they reach, those of smaller and of larger partners.
    few_of = many.filter("label <> largest")
    down = few_of.filter(largest >= least).withColumn("step", F.explode(F.sequence(step(least), step(largest))))
    up = few_of.filter(reached >= F.col("n")).withColumn("step", F.explode(F.sequence(step(F.col("n")), step(F.least(reached, F.floor(F.col("n") * 100 / percent))))))
    own = many.withColumn("step", step(F.col("n")))
    larger = (F.col("x.step") == F.col("y.step")) & ((F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))))
    met.append(down.alias("x").join(own.filter(reached >= F.col("n")).alias("y"), apart & larger))
    met.append(own.filter("label = largest").filter(largest >= least).alias("x").join(up.alias("y"), apart & larger))
    return reduce(DataFrame.union, (m.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")) for m in met)).distinct()


def similar_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", class_limits: tuple[int, int] = CLASS_LIMITS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets. component_id is
    the smallest id reachable by links. Texts without words, empty and null ones have no shingles and link with nothing.
    Every row has the group of its own set: repeated rows share one, different texts under one id
    need not (sets whose smallest id is the same are linked by it), and a row with a null id has
    that of the documents of its set, else none (null). An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    first = _answers(rows, words, 1 + size // RANGE_BYTES, False)
    about = materialize(first.mapInArrow(_alone(percent), "doc_id long, n long, alone boolean"), "counted")
    open_ids = materialize(about.filter("NOT alone AND n > 0").select(F.col("doc_id").alias("open_id")).distinct(), "open")
    still = _small(open_ids, open_ids.count())
    is_open = F.col("doc_id").eqNullSafe(F.col("open_id"))
    near = materialize(rows.join(still, is_open, "left_semi").mapInArrow(_describe(words), "doc_id long, text string, n long, digest binary, wide binary"), "near")

    nodes = materialize(near.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("wide").alias("wide")), "nodes")
    named = nodes.filter("node IS NOT NULL").select(F.col("digest").alias("of"), "node")
    once = near.join(named, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("node")), "left_semi")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    index = _answers(once.select("doc_id", "text"), words, 1 + total // RANGE_TOKENS, True).mapInArrow(_index(percent, class_limits), _KIND)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "rank", "id")
    shared = materialize(dealt.mapInArrow(_stars(percent), _KIND + _MEETS), "index")
    named_nodes = nodes.filter("node IS NOT NULL")
    links = _linked(near, named_nodes, materialize(_some_pairs(shared), "pairs"), words, percent)
    labels = components(links)
    labels = materialize(labels.select(F.col("node").alias("of"), F.col("component").alias("label")), "labels")
    index = shared.drop("meets").join(_small(labels, labels.count()), F.col("id") == F.col("of"), "left").withColumn("label", F.coalesce("label", "id")).drop("of")
    links = links.unionByName(_linked(near, named_nodes, materialize(_met(index, percent), "pairs"), words, percent))

    grouped = components(links).select(F.col("node").alias("at"), "component")
    labelled = nodes.join(grouped, F.col("node") == F.col("at"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"))
    full = near.select("doc_id", "n", "digest").filter("n > 0").join(labelled, F.col("digest") == F.col("d"))
    none = near.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    done = about.join(still, is_open, "left_anti").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(none).unionByName(done)


def keep_one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose group has a smaller id; all columns, whatever their names.

    Documents without words, and those with null ids that are like no other, stay; repeated rows
    stay or go together; an empty table stays empty.
    """
    groups = similar_groups(docs, words, percent)
    gone = materialize(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(_small(gone, gone.count()), docs["doc_id"] == F.col("__gone"), "left_anti")
