"""Spelling variants against a plain version."""

import collections
import itertools
import random
import re
import zlib

import pytest

from palimpsest.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(docs):
    n = collections.Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            w = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(n):
    close = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus(rng):
    stems = ["".join(rng.choices("abcé", k=rng.randint(6, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "Überzeugt", "x×y÷zzzz", "q" * 70, "q" * 71, "q" * 30 + "r" + "q" * 40]
    pool = []
    for s in stems:
        times = rng.choice([5, 6, 40, 300])
        pool += [s] * times
        for _ in range(rng.randint(0, 4)):
            k, c = rng.randrange(len(s)), rng.choice("abcé")
            pool += [rng.choice([s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + c + s[k + 1 :]])] * rng.choice([1, 5, 8])
    pool += ["chainone"] * 160 + ["chainome"] * 31 + ["chaimome"] * 6 + ["schaimome"] * 5
    rng.shuffle(pool)
    seps = [" ", ", ", "\n", "1", "Δ", "\U0001f600", "_", " "]
    docs, at = [], 0
    while at < len(pool):
        size = rng.choice([1, 20, 200])
        docs.append((len(docs) * 7, "".join(rng.choice([w, w.upper() if w.isascii() else w]) + rng.choice(seps) for w in pool[at : at + size])))
        at += size
    return docs + [(1, None), (2, ""), (3, "short words go by"), (None, "abababab " * 9), (9, "abababab"), (9, "abababab"), (-4, "Banana " * 12 + "BANANE " * 3 + "banane banane")]


@pytest.mark.parametrize("most, words", [(spelling.GROUP, spelling.WORDS), (3, 50)])
def test_spelling_groups(spark, most, words):
    docs = corpus(random.Random(13))
    n = words_of(docs)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").repartition(3)
    got = spelling.spelling_groups(df, most=most, words=words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(n)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(1 for r in want if r[1]) > 20 and any(r[1] and r[1] != r[2] for r in want)
    assert spelling.spelling_groups(df.limit(0)).collect() == []


def test_groups_are_bounded_and_pairs_met_once(spark):
    """A stem that all words share: groups are cut until they are small, and no pair is lost or doubled."""
    words = ["prefix" + "".join(x) + "suffix" for r in (3, 4) for x in itertools.product("abcd", repeat=r)]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    cut = spelling.groups(df, most=30)
    sizes = [r["count"] for r in cut.groupBy("a", "lo", "hi", "last", "text").count().collect()]
    assert max(sizes) <= 30
    got = {r.word: r.n_near for r in spelling.near_words(df, most=30).collect()}
    assert got == {w: c for w in words if (c := sum(near(w, v) for v in words))}


def test_typed_is_the_rule():
    n = collections.Counter(spelling.typed(i, b"spelling", 199).decode() for i in range(4000))
    assert n == collections.Counter(next(iter(words_of([(i, "spelling " * 5)]))) for i in range(4000)) and 5 < len(n) <= 9


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w20" for w, _ in chain}
