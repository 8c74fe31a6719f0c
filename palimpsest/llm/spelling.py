"""Operator 13, spelling variants: a bit-sliced position index over the vocabulary.

Words are counted inside the tasks, a dictionary of at most WORDS words at a time, and summed by Spark. Two words
one edit apart agree on a first or a last part of the shorter one, so every word stands under keys of its
length and of the length below: its first half and its last half. A group (the words of one key) holds words of length a and
a + 1 that differ in a middle of s and s + 1 letters. Groups of more than GROUP words are cut again by
the halves of that middle, until they are small or the middle is one letter; then the alphabet bounds them. A pair
that agrees on the first part is looked for there alone, so every pair is met under exactly one key, and no
pair that is not near leaves a group.

Inside a group there is a bitset over its words for each (position, letter) of the middle. A word of length a
walks over its letters once, for all words of its group at a time: E are the words that agree so far, S those
with one letter replaced, I those with one more letter, whose letters are read a position further on:
    I = (I | E) & bits[i + 1][c]      S = (S & bits[i][c]) | (E & ~bits[i][c])      E = E & bits[i][c]
Deletions are the insertions of the other word. What leaves a group is a row per word: how many near words
it has there and the most frequent of them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

SHORTEST = 6
LEAST = 5
RATIO = 5
EVERY = 199
WORDS = 400_000
GROUP = 2048
#: Letters by their Latin-1 byte, A-Z as a-z; other bytes become spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_KEY = ["a", "lo", "hi", "last", "text"]


def typed(id_, word: bytes, every: int) -> bytes:
    """word, without one letter if the checksum of id and word says so."""
    utf8 = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(utf8, zlib.crc32(b"%d:" % id_ if id_ is not None else b":"))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY, words: int = WORDS) -> DataFrame:
    """word, n: the words of whole texts with `shortest` letters and `least` occurrences, written to the shared folder.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; in one (document, word) of about `every` a letter
    is left out (see typed). A null id counts as an empty one.
    """

    def count(batches):
        import pyarrow as pa

        def rows():
            found = list(totals.items())
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part]), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        totals = Counter()
        crc32 = zlib.crc32
        for batch in slices(batches, 200):
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                head = crc32(b"%d:" % id_ if id_ is not None else b":")
                for word, n in Counter(text.encode("latin-1", "replace").translate(TABLE).split()).items():
                    size = len(word)
                    if size < shortest:
                        continue
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
                    if h % every == 0:
                        at = h % size
                        word = word[:at] + word[at + 1 :]
                        if size == shortest:
                            continue
                    totals[word] += n
            if len(totals) >= words:
                yield from rows()
                totals = Counter()
        yield from rows()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.filter(F.col("n") >= least), "vocabulary")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: under the first and under the last half of its middle as well."""
    m = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int") + F.col("lo")
    a = F.col("a")
    part = lambda lo, hi, last: F.struct(lo.alias("lo"), hi.alias("hi"), last.alias("last"))
    both = rows.withColumn("p", F.explode(F.array(part(m, F.col("hi"), F.col("last")), part(F.col("lo"), m, F.lit(True)))))
    size, tail = F.char_length("word"), a - F.col("p.hi")
    text = F.concat(F.substring(F.col("word"), F.lit(1), F.col("p.lo")), F.substring(F.col("word"), size - tail + 1, tail))
    return both.select("word", "n", "a", "p.lo", "p.hi", "p.last", text.alias("text"))


def groups(words: DataFrame, shortest: int = SHORTEST, most: int = GROUP) -> DataFrame:
    """word, n and the key of each of its groups of two words and more, and of at most `most` unless the middle is one letter.

    a: length of the shorter words; lo, hi: where their middle begins and ends; last: the words of a pair
    must not agree on all of the shorter one's middle followed by another letter.
    """
    size = F.char_length("word")
    start = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda x: x >= shortest)).alias("a"))
    rows = _halves(start.select("word", "n", "a", F.lit(0).alias("lo"), F.col("a").alias("hi"), F.lit(False).alias("last")))
    done = None
    while True:
        rows = materialize(rows, "spelling-keys")
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.char_length("word") == F.col("a")).alias("short")).filter("size > 1 AND short > 0")
        known = materialize(rows.join(sizes, _KEY), "spelling-groups")
        large = (F.col("size") > most) & (F.col("hi") - F.col("lo") > 1)
        small = known.filter(~large).select("word", "n", *_KEY)
        done = small if done is None else done.unionByName(small)
        over = known.filter(large)
        if not over.limit(1).count():
            return done
        rows = _halves(over.select("word", "n", *_KEY))


def near_in_group(middles: list[str], s: int, last: bool):
    """(i, j) of words one edit apart, i of s letters, j of s or s + 1; i < j where both have s."""
    bits: list[dict] = [{} for _ in range(s + 1)]
    short = 0
    for k, word in enumerate(middles):
        one = 1 << k
        for at, c in zip(bits, word):
            at[c] = at.get(c, 0) | one
        if len(word) == s:
            short |= one
    everything = (1 << len(middles)) - 1
    for k, word in enumerate(middles):
        if len(word) != s:
            continue
        equal, replaced, longer = everything, 0, 0
        for i, c in enumerate(word):
            here = bits[i].get(c, 0)
            longer = (longer | equal) & bits[i + 1].get(c, 0)
            replaced = (replaced & here) | (equal & ~here)
            equal &= here
        more = (longer & ~equal if last else longer | equal) & ~short
        found = (replaced & short) >> (k + 1) << (k + 1) | more
        while found:
            low = found & -found
            yield k, low.bit_length() - 1
            found ^= low


def _near(batches):
    import pyarrow as pa

    names, kinds = ["word", "n_near", "best_n", "best"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
    key, held, out = None, [], []

    def group():
        a, lo, hi, last, _ = key
        tail = a - hi
        if len(held) < 2:
            return
        middles = [w[lo : len(w) - tail] for w, _ in held]
        count, best = {}, {}
        for pair in near_in_group(middles, hi - lo, last):
            for i, j in (pair, pair[::-1]):
                count[i] = count.get(i, 0) + 1
                word, n = held[j]
                if i not in best or (-n, word) < best[i]:
                    best[i] = (-n, word)
        out.extend((held[i][0], c, -best[i][0], best[i][1]) for i, c in count.items())

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("word", "n", *_KEY)]
        for word, n, *now in zip(*columns):
            if now != key:
                if key is not None:
                    group()
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out.clear()
                key, held = now, []
            held.append((word, n))
    if key is not None:
        group()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def near_words(words: DataFrame, shortest: int = SHORTEST, most: int = GROUP) -> DataFrame:
    """word, n_near, best, best_n: how many words are one edit away, and the most frequent of them (ties: first in code-point order)."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups(words, shortest, most).repartition(n, *_KEY).sortWithinPartitions(*_KEY)
    found = dealt.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def roots(forms: DataFrame, ratio: int = RATIO, largest: int = 1 << 62) -> DataFrame:
    """word, root: where following word -> form ends. forms: word, form (not null).

    Paths double in length with each join; as a form is `ratio` times as frequent, none is longer than log(largest).
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max(1, math.ceil(math.log(max(largest, 2), ratio))).bit_length() + 1):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not at.join(ahead, "root", "left_semi").limit(1).count():
            break
        at = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = GROUP, words: int = WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    near: one letter inserted, left out or replaced. form: the most frequent near word, if it is at least RATIO
    times as frequent; form_n its frequency. root: where the forms lead. Null and empty texts have no words;
    repeated rows are counted each; an empty table gives an empty result. Other columns are not read.
    """
    known = vocabulary(docs, id_col, text_col, words=words)
    near = near_words(known, most=most)
    is_form = F.col("best_n") >= F.col("n") * RATIO
    rows = known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    rows = materialize(rows, "spelling-forms")
    led = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
