"""Ranked lexical search against a plain version."""

import collections
import math
import random
import re

import numpy as np
import pytest

from palimpsest.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, queries, k=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    N, L = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c, n in counts:
            m = 25 + 75 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)] + ["É", "über", "x1", "naïve", "漢字"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize("postings, seeds", [(lexical.POSTINGS, 16), (300, 2)])
def test_search(spark, postings, seeds):
    rng = random.Random(12)
    docs = corpus(rng, 900) + [(2000, None), (2001, ""), (2002, " .,; "), (None, "w1 w2 w299"), (5, "w3 w3"), (5, "w3 w3"), (2003, "W7-ÉÉ É É w7_" * 50), *((3000 + i, "same text w250 w251") for i in range(40))]
    queries = [(q, " ".join(rng.choices(docs, k=1)[0][1].split()[:25]) if docs[q][1] else "") for q in range(30)]
    queries += [(90, None), (91, ""), (92, "nothing-known"), (93, "same w250 w250 W251"), (93, "É w7"), (None, "w299 w2"), (94, "w0")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, term int").repartition(4)
    index = lexical.build_index(df, postings=postings)
    assert lexical.index_size(index)[:2] == (len([1 for _, t in docs if terms(t)]), sum(len(terms(t)) for _, t in docs))
    asked = spark.createDataFrame([(*q, 1) for q in queries], "item_id long, text string, score int")
    got = lexical.search(index, asked, query_terms=60, seeds=seeds)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, queries)


def test_empty(spark):
    none = lexical.build_index(spark.createDataFrame([], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, asked).collect() == []
    one = lexical.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert lexical.search(one, asked.limit(0)).collect() == []


def test_blocks_are_passed_over():
    """Lists of many blocks: the best are found, and blocks that cannot matter stay packed."""
    rng = np.random.default_rng(3)
    size = 30_000
    lengths = rng.integers(5, 400, size)
    m = lexical.damping(lengths, size, int(lengths.sum()))
    shard = lexical._Shard()
    shard.lengths, shard.ids = lengths.tolist(), list(range(size))
    shard.vocabulary = {b"rare": 0, b"common": 1, b"often": 2}
    want, parts = np.zeros(size, np.int64), []
    weights = {b"rare": 9000, b"common": 300, b"often": 700}
    for k, (word, share) in enumerate(((b"rare", 0.001), (b"common", 0.9), (b"often", 0.5))):
        docs = np.flatnonzero(rng.random(size) < share)
        tf = rng.geometric(0.4, len(docs))
        parts.append((np.int64(k) << 32 | docs, tf))
        want[docs] += weights[word] * lexical.impact(tf, m[docs])
    shard.keys, shard.counts = [p[0] for p in parts], [p[1] for p in parts]
    rows = [r for b in shard.table(7) for r in b.to_pylist()]
    low_m = lambda n: lexical.damping(n, size, int(lengths.sum()))
    lists = [(weights[r["term"]], lexical._List(r, m, low_m)) for r in rows if r["term"] is not None]
    for _, p in lists:
        if p.last is not None:
            assert all((p.some(np.array([b]))[1] <= p.block_most[b]).all() for b in range(len(p.last)))
    seen = {"unpacked": 0, "passed": 0}
    found, scores = lexical.best_in_shard(lists, size, 0, 10, seen)
    assert sorted(scores)[-10:] == sorted(want)[-10:] and (want[found] == scores).all()
    assert 5 * seen["unpacked"] < seen["passed"]


def test_variable_bytes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << rng.integers(1, 50, 4000), 4000)
    assert (lexical.unpack(lexical.pack(values)[0]) == values).all() and len(lexical.unpack(np.zeros(0, np.uint8))) == 0


@pytest.mark.parametrize("text", [b"a" * 3_000_000, b"ab " * 900_000, b"q " + b"r" * 2_500_000 + b" s", b""])
def test_terms_of_long_texts(text):
    assert [t for piece in lexical.terms_of(text) for t in piece] == text.split()
