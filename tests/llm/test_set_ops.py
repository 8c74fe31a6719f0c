"""Dedup, near copies, packing, sharding, mixing, search and the pipeline against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import exact_dedup, knn, mixing, ngram_join, packing, sharding
from palimpsest.llm.queries import op5_sharding, tokenizer_path

DOCS = "doc_id long, text string"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_exact_duplicates(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", None, "a", "A", "É", "é", "x" * 9000, f"t{i % 40}"])) for i in range(600)] + [(7, "same"), (7, "same"), (None, "same"), (None, "null")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS + ", run int, __keep string")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t or "")].append(i)
    got = exact_dedup.exact_duplicates(df).collect()
    assert len(got) == len(rows)
    deep = exact_dedup.exact_duplicates(df, run_rows=5, fan_in=4)  # four rounds
    assert sorted(map(str, deep.collect())) == sorted(map(str, got)) and exact_dedup.tree_rounds(len(rows), 5, 4) == 4
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [keep]
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns
    kept = collections.Counter((r.doc_id, ascii_lower(r.text or "")) for r in left.collect())
    assert kept == {(max((i for i in ids if i is not None), default=None), t): 1 for t, ids in groups.items()}
    plain = df.filter("doc_id IS NOT NULL AND doc_id <> 7")  # without repeated rows
    assert exact_dedup.drop_exact_duplicates(plain).count() == plain.selectExpr("lower(coalesce(text, ''))").distinct().count() + 1  # lower() joins \xc9 and \xe9
    assert exact_dedup.exact_duplicates(df.limit(0)).collect() == []


def plain_groups(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {(i, len(sets[i]), top(i)) for i in ids}


def family(rng, n, words, start):
    """Texts that differ from one another in a few words, so that chains of links occur."""
    text = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    for k in range(n):
        yield start + k, " ".join(text)
        for _ in range(rng.choice([0, 1, 1, 2])):
            text = list(text)
            text[rng.randrange(len(text))] = f"w{rng.randint(0, 400)}"


@pytest.mark.parametrize("words, percent, limits", [(3, 90, ngram_join.CLASS_LIMITS), (3, 90, (0, 0)), (5, 80, (0, 10**9)), (5, 80, (3, 9))])
def test_similar_groups(spark, words, percent, limits):
    rng = random.Random(words)
    rows = [*family(rng, 60, 60, 0), *family(rng, 40, 170, 100), *family(rng, 30, 12, 200), *family(rng, 25, 140, 300)]
    rows += [(400, ""), (401, None), (402, " \n"), (403, "one"), (404, "ONE"), (405, "one two"), (406, "One\ttwo"), (407, "x " * 5000), (408, "x " * 4000), (409, "É a b c d e"), (410, "é a b c d e")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", key int").repartition(5)
    assert {tuple(r) for r in ngram_join.similar_groups(df, words, percent, class_limits=limits).collect()} == plain_groups(rows, words, percent)


def template(rng, n, own, shared=300):
    """n documents of one template, each with words of its own at one place: near misses of each other, but for some that are nearer."""
    words = [f"t{i}" for i in range(shared)]
    for i in range(n):
        mine = [f"p{i // 2}x{j}" if i % 10 < 2 else f"d{i}x{j}" for j in range(own + i % 3)]
        at = rng.randrange(shared)
        yield i, " ".join(words[:at] + mine + words[at:])


def test_near_misses_of_a_template_do_not_meet(spark, monkeypatch):
    """Documents that share a template and miss the similarity: the pairs that are made grow with the documents, not with their square."""
    made, plain = [], ngram_join._met
    monkeypatch.setattr(ngram_join, "_met", lambda index, percent: made.append(plain(index, percent)) or made[-1])
    pairs = {}
    for n in (100, 200, 1600):
        rows = list(template(random.Random(n), n, 24))
        got = {tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(rows, DOCS).repartition(4), 3, 90, class_limits=(4, 16)).collect()}
        if n <= 200:
            assert got == plain_groups(rows, 3, 90)
        assert sum(1 for i, _, c in got if i != c) == n // 10
        pairs[n] = made[-1].count()
    assert pairs[200] <= 400 and pairs[1600] <= 8 * max(pairs[200], 100)


def test_template_with_links_and_misses(spark):
    """Own parts of all lengths, so that some pairs just reach the similarity and others just miss it."""
    rng = random.Random(4)
    words = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(90):
        mine, at = [f"d{i}x{j}" for j in range(rng.randrange(14))], rng.randrange(150)
        rows.append((i, " ".join(words[:at] + mine + words[at:] + [f"e{i % 7}x{j}" for j in range(i % 4)])))
    for limits in ((2, 6), (4, 60), (64, 1024)):
        got = {tuple(r) for r in ngram_join.similar_groups(spark.createDataFrame(rows, DOCS).repartition(3), 3, 90, class_limits=limits).collect()}
        assert got == plain_groups(rows, 3, 90)


def test_similar_groups_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (7, text + " more"), (None, "alone by itself here"), (9, "quite other words"), (9, text), (None, None), (3, "")]
    got = ngram_join.similar_groups(spark.createDataFrame([(*r, "k") for r in rows], DOCS + ", digest string"))
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got.collect()))) == sorted(map(str, [(5, 5)] * 2 + [(None, 5), (7, 5), (None, None), (9, 9), (9, 5), (None, None), (3, 3)]))


@pytest.mark.parametrize("percent", [50, 80, 90])
@pytest.mark.parametrize("limits", [(0, 10**9), (0, 0), (4, 12), (64, 1024)])
def test_similar_sets_share_a_key(percent, limits):
    """Any two sets that are similar enough, whatever the classes and sizes."""
    rng = np.random.default_rng(percent)
    tokens = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64))
    codes = ngram_join.code_of(rng.integers(1, 30, len(tokens)))
    compared = 0
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 33, 64, 100, 127, 129, 300, 700] * 6:
        first = np.sort(rng.choice(len(tokens), size, replace=False))
        drop, add = rng.integers(0, 1 + size * (100 - percent) // 150, 2)
        second = np.unique(np.concatenate([rng.permutation(first)[drop:], rng.choice(len(tokens), add)]))
        common = len(np.intersect1d(first, second))
        if len(second) and not np.array_equal(first, second) and 100 * common >= percent * (size + len(second) - common):
            codes[np.intersect1d(first, second)] = np.maximum(codes[np.intersect1d(first, second)], 2)
            keys = [ngram_join.index_keys(tokens[s], codes[s], percent, limits)[0] for s in (first, second)]
            assert len(np.intersect1d(*keys))
            compared += 1
    assert compared > 10


def test_counts_of_ranges():
    rng = np.random.default_rng(1)
    rows = [(c, np.unique(rng.integers(0, 300, 90)).astype("<u4")) for c in range(7)]
    counted = [(c, t, rng.integers(1, 5, len(t)).astype("<u2")) for c, t in rows]
    sums = collections.Counter()
    for _, t, x in counted:
        for a, b in zip(t.tolist(), x.tolist()):
            sums[a] += b
    for (_, t, _), (_, codes, _) in zip(counted, ngram_join._counted(counted)):
        assert list(codes) == ngram_join.code_of(np.array([sums[a] for a in t.tolist()])).tolist()
    owned = [(c, t, np.where(rng.random(len(t)) < 0.1, ngram_join.MANY, rng.integers(0, 9, len(t))).astype("<u2")) for c, t in rows]
    seen = collections.Counter(a for _, t, _ in owned for a in t.tolist())
    for (_, t, x), (_, docs, times) in zip(owned, ngram_join._single(owned)):
        want = collections.Counter(d for a, d in zip(t.tolist(), x.tolist()) if seen[a] == 1 and d != ngram_join.MANY)
        assert dict(zip(np.frombuffer(docs, "<u2").tolist(), np.frombuffer(times, "<u4").tolist())) == want


def test_similar_groups_of_nothing(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    up = {x: x for ab in links for x in ab}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(tuple(r) for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got.get(x, x) == c for x, c in up.items())


def test_hilbert_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1).max() == 1


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect())] + [(900, None), (901, ""), (902, "a b " * 9000)]
    out = packing.pack_documents(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", key int"), tokenizer_path("word_bpe_49k.json"), partitions=3).collect()
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_documents(spark.createDataFrame([], DOCS), tokenizer_path("word_bpe_49k.json")).collect() == []


def test_packing_of_odd_rows(spark):
    rows = [(None, "a b", "s", 1), (7, "one two", None, 2), (7, "one two", None, 2), (8, None, "s", 3), (9, "", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int")
    for source in (None, "source"):
        out = packing.pack_documents(df, tokenizer_path("word_bpe_49k.json"), source_col=source).collect()
        assert sorted(map(str, (r.doc_id for r in out if r.start == 0))) == ["7", "7", "8", "9", "None"]
        assert sum(r.length for r in out) == sum({"a b": 3, "one two": 3}.get(r[1], 1) for r in rows)


def test_min_cost_flow_is_least():
    rng = random.Random(3)
    for _ in range(20):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        supply = [rng.randint(0, 30) for _ in range(n)]
        capacity = sharding.even_capacities(sum(supply) + rng.randint(0, 5), m)
        flows = sharding.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert all(sum(a for i, _, a in flows if i == k) == s for k, s in enumerate(supply))
        assert all(sum(a for _, j, a in flows if j == k) <= c for k, c in enumerate(capacity))
        stay = sum(min(s, c) for s, c in zip(supply, capacity))  # no plan can keep more in place
        assert sum(a for i, j, a in flows if i != j) == sum(supply) - stay


def test_sharding(spark):
    rows = op5_sharding(spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(text)
    shards = collections.defaultdict(list)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(24))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    sizes, largest = [sum(r.size for r in s) for s in shards.values()], max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    old = collections.Counter()
    for r in rows:
        old[r.old_shard] += r.size
    mean = sum(sizes) / 24
    least = sum(sizes) - sum(min(v, mean) for v in old.values())
    assert moved <= least + 24 * largest


def test_sharding_of_odd_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "y" * 50_000)], DOCS)
    for d in (df, df.limit(0)):
        got = sharding.shard_digest(d, F.pmod("doc_id", F.lit(2)), 2, 3).collect()
        assert sorted(r.size for r in got) == sorted(len(r.text or "") + 8 for r in d.collect())


def test_resharding_leaves_files_alone(spark, tmp_path):
    """From 4 shards to 6: files whose rows all stay are not written again, and no more bytes move than must."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 900)) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS + ", slot int, old_shard string")
    sharding.write_store(df, F.pmod("doc_id", F.lit(4)), str(tmp_path / "old"), file_bytes=30_000)
    store = sharding.read_store(spark, str(tmp_path / "old"))
    was = {r.doc_id: (r.shard, r.slot, r.file) for r in store.collect()}
    assert {i: w[0] for i, w in was.items()} == {i: i % 4 for i, _ in rows}
    got = sharding.reshard(store, 4, 6, str(tmp_path / "new")).collect()
    assert sorted((r.doc_id, len(r.text)) for r in got) == [(i, len(t)) for i, t in rows]
    shards, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        shards[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert r.old_shard == was[r.doc_id][0]
        if r.shard == r.old_shard:
            assert r.slot == was[r.doc_id][1]
    assert sorted(shards) == list(range(6)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(size.values()) - min(size.values()) <= 4 * 908
    written = {r.doc_id for r in spark.read.parquet(str(tmp_path / "new")).select("doc_id").collect()}
    lost = {was[r.doc_id][::2] for r in got if r.shard != r.old_shard}
    assert written == {i for i, w in was.items() if w[::2] in lost} and 0 < len(written) < 0.6 * len(rows)
    old = collections.Counter()
    for i, t in rows:
        old[i % 4] += len(t) + 8
    moved = sum(r.size for r in got if r.shard != r.old_shard)
    assert moved <= sum(old.values()) - sum(min(v, sum(old.values()) / 6) for v in old.values()) + 12 * 908


def test_mixing(spark):
    counts = {"a": 700, "b": 90, None: 33, "c": 1}
    rows = [(i, s) for i, (s, n) in enumerate((s, k) for s, n in counts.items() for k in range(n))]
    df = spark.createDataFrame([(i, s, "x", 5) for i, s in rows], "doc_id long, source string, slot string, phase int")
    got = mixing.mix(df, block_docs=4, period=50).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    blocks = {(r.source, r.block): (r.slot, r.released, r.due, r.phase, r.weight) for r in got}
    assert len({b[0] for b in blocks.values()}) == len(blocks) == max(b[0] for b in blocks.values()) + 1
    assert all(released <= slot < due for slot, released, due, _, _ in blocks.values())
    for phase in {b[3] for b in blocks.values()}:
        order = sorted((b[0], s) for (s, _), b in blocks.items() if b[3] == phase)
        weight = {s: b[4] for (s, _), b in blocks.items() if b[3] == phase}
        had = collections.Counter()
        for t, (_, s) in enumerate(order, 1):
            had[s] += 1
            assert all(abs(had[x] - t * w / sum(weight.values())) < 1 for x, w in weight.items())
    mixed = mixing.mixed_documents(df, block_docs=4, period=50)
    assert mixed.columns == df.columns and sorted((r.doc_id, r.source) for r in mixed.collect()) == sorted(rows)
    assert mixing.mix(df.limit(0)).collect() == []
    assert {r.weight for r in mixing.mix(df, {"a": 3, "b": 1}).collect() if r.source == "a"} == {7500}


def test_mixing_of_odd_weights(spark, monkeypatch):
    """Weight 0 comes last, repeated rows and null ids are placed like others, a long schedule is joined by shuffle."""
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    rows = [(i, s) for s, n in (("a", 300), ("b", 100), ("z", 50)) for i in range(n)] + [(7, "a"), (7, "a"), (None, "b"), (None, "z")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, source string, key string")
    got = mixing.mix(df, {"a": 0.7, "b": 0.3, "z": 0.0}, block_docs=2, period=10).collect()
    assert sorted(map(str, ((r.doc_id, r.source) for r in got))) == sorted(map(str, rows))
    assert min(r.slot for r in got if r.source == "z") > max(r.slot for r in got if r.source != "z")
    assert mixing.target_weights({"a": 5, "b": 5, "c": 5}, {"a": 1.0, "b": 0.0}, 0.5, 100) == {"a": 100, "b": 0, "c": 1}


def test_pfair_windows():
    rng = random.Random(6)
    for _ in range(30):
        weights = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        total, slots = sum(weights), mixing.period_of(weights)
        assert sorted(t for s in slots for t in s) == list(range(total))
        assert all(k * total // w <= t < -(-(k + 1) * total // w) for w, s in zip(weights, slots) for k, t in enumerate(s))


def test_a_slice_answers_only_what_reaches_the_bound():
    import pandas as pd

    rng = np.random.default_rng(5)
    data, query = rng.integers(-50, 50, (400, 6)), rng.integers(-50, 50, 6)
    scores = data @ query
    bound = int(np.sort(scores)[-4])
    q = pd.DataFrame({"vec_id": [1000], "v": [query.tobytes()], "bound": [bound]})
    d = pd.DataFrame({"vec_id": range(400), "v": [r.tobytes() for r in data]})
    got = knn._local(6, 10)(q, d)
    assert sorted(got["score"]) == sorted(scores[scores >= bound])
    assert len(knn._local(6, 10)(q.assign(bound=np.iinfo(np.int64).min), d)) == 10


def test_phases_against_a_plain_simulation():
    """Slot by slot with all live sources, a new period whenever one has run out."""
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randint(1, 7)
        blocks, weights = [rng.choice([0, 1, 2, 5, 60]) for _ in range(n)], [rng.choice([0, 1, 2, 9]) for _ in range(n)]
        left, want, base = list(blocks), [], 0
        while any(left):
            live = [w if b else 0 for w, b in zip(weights, left)]
            live = live if any(live) else [int(b > 0) for b in left]
            slots, total, done = mixing.period_of(live), sum(live), [0] * n
            owner = {t: s for s, own in enumerate(slots) for t in own}
            t = 0
            while all(d < b for d, b, w in zip(done, left, live) if w):
                done[owner[t % total]] += 1
                want.append(owner[t % total])
                t += 1
            left, base = [b - d for b, d in zip(left, done)], base + t
        got = {}
        for base, total, rows in mixing.phases_of(blocks, weights):
            for s, w, first, count, slots in rows:
                got |= {base + k // w * total + slots[k % w]: s for k in range(count)}
        assert [got[t] for t in sorted(got)] == want and sorted(got) == list(range(len(want)))


def test_many_sources():
    """10,000 sources of many sizes: no phase simulates more than it runs, and all blocks have a slot."""
    import time

    rng = random.Random(3)
    counts = {f"s{i}": rng.randint(1, 40) for i in range(10_000)}
    share = mixing.target_weights(counts, None, 0.5, mixing.PERIOD)
    began, blocks = time.time(), list(counts.values())
    phases = list(mixing.phases_of(blocks, [share[k] for k in counts]))
    assert sum(n for _, _, rows in phases for *_, n, _ in rows) == sum(blocks) and sum(len(own) for _, _, rows in phases for *_, own in rows) <= 2 * sum(blocks) + mixing.PERIOD * 5
    assert time.time() - began < 60


def plain_top(rows, k):
    out = []
    for i, q in rows:
        if i % 100 == 0:
            width = len(q)
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
            assert width
    return sorted(out)


@pytest.mark.parametrize("hot, sample", [(False, knn.SAMPLE), (True, knn.SAMPLE), (False, 25), (True, 25)])
def test_top_k(spark, monkeypatch, hot, sample):
    """With few vectors in the sample, bounds are raised among parts of the vectors first."""
    monkeypatch.setattr(knn, "SAMPLE", sample)
    monkeypatch.setattr(knn, "BOUND_STEPS", 4)
    monkeypatch.setattr(knn, "SLICE_ROWS", 100)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 900)] + 0.3 * rng.normal(size=(900, 8))
    if hot:
        v[rng.random(900) < 0.4] = centres[0]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    bad = [(9000, None), (9100, [float("nan")] * 8), (9200, [1.0] * 7 + [float("inf")]), (9300, [1.0, None] + [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, cell int").repartition(4)
    got = sorted(tuple(r) for r in knn.top_k(knn.integer_vectors(df)).collect())
    assert got == plain_top([(i, [int(np.floor(1024 * x)) for x in r]) for i, r in rows], 10)


def test_top_k_sends_clustered_vectors_to_few_groups(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = 4 * rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 8000)] + 0.2 * rng.normal(size=(8000, 16))
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(np.floor(1024 * v))]
    counts = {}
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), counts=counts).collect()
    assert sorted(tuple(r) for r in got) == plain_top(rows, 10)
    assert counts["groups"] >= 4 and counts["sent"] < counts["vectors"] * counts["groups"] / 2


def test_top_k_of_repeated_rows(spark):
    """Copies of a query under its own id are never its hits; shorter vectors count as padded."""
    rows = [(100, [9, 9])] * 20 + [(i, [i % 7, -i]) for i in range(1, 40)] + [(50, [8]), (51, [8, 0])]
    want = [(q, r, j, s) for q, r, j, s in plain_top([rows[0]] + [(i, v + [0] * (2 - len(v))) for i, v in rows[20:]], 10)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>")).collect()
    assert sorted(tuple(r) for r in got) == want


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [0.5, 0.5]), (3, [2.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in knn.top_k(knn.integer_vectors(df)).collect()) == plain_top([(0, [1024, 2048]), (100, [512, 512]), (3, [2048, -1024])], 10)
    assert knn.top_k(knn.integer_vectors(df.limit(0))).collect() == []


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    after = [docs.cache()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after.append(stage(spark, after[-1], data).cache())
        if k < 4:
            assert after[-1].columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").distinct().collect()} for x in after]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    wrong = [i for i in ids[0] if i in labels and (i in ids[1]) != bool(labels[i])]
    assert len(wrong) <= 2
    text = {r.doc_id: r.text for r in after[1].collect()}
    last = {ascii_lower(t): i for i, t in sorted(text.items())}
    assert ids[2] == set(last.values())
    assert ids[3] == {c for _, n, c in plain_groups([(i, text[i]) for i in ids[2]], 5, 80)}
    assert ids[4] == ids[3] == ids[5] and after[4].count() == len(ids[3])


def test_sequences_follow_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_SLOTS", 4)
    words = {"a": "the cat sat on the mat", "b": "numbers 1 2 3 4 5 6"}
    rows = [(i, words[s], "en", s, 20) for i, s in enumerate("a" * 1600 + "b" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    pieces = corpus_pipeline.pack_sequences(spark, corpus_pipeline.mix_sources(spark, docs, ""), "").filter("start = 0").collect()
    order = [rows[r.doc_id][3] for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    assert len(order) == 2000
    for n in range(128, 1153, 128):  # until the smaller source runs out it has a third, by the square roots of 1600 and 400
        assert abs(order[:n].count("b") - n / 3) <= mixing.BLOCK_DOCS


def test_pipeline_of_odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, an empty table and columns whose names the operators use."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, label int, key int, score double, component_id long, slot int"
    text = "The cat sat on the mat and it was the best of all the times that we had, so they said to us at the end of it."
    rows = [(1, text), (2, text.upper()), (2, text.upper()), (3, text + " So."), (4, None), (5, ""), (None, "Quite another line of text that is here for the reader to see."), (6, " \n ")]
    extra = ("en", None, 1, 0, 1, 0.5, 9, 3)
    full = spark.createDataFrame([(*r, *extra) for r in rows], kind)
    data = "/root/testdata/sf0.001"
    for docs in (full, full.limit(0)):
        after = docs
        for name, stage in corpus_pipeline.STAGES[1:4]:
            after = stage(spark, after, data)
            assert after.columns == docs.columns, name
        ids = sorted(map(str, (r.doc_id for r in after.collect())))
        assert ids == (["2", "5", "6", "None"] if docs is full else [])
        packed = corpus_pipeline.STAGES[4][1](spark, after, data).collect()
        assert sorted(map(str, (r.doc_id for r in packed if r.start == 0))) == ids
        assert corpus_pipeline.STAGES[0][1](spark, docs, data).columns == docs.columns
