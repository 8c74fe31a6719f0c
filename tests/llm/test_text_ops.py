"""Quality, HTML, tokens, edit counts and token files against plain versions and round trips."""

import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import edit_counts, html_text, quality, token_files, tokens
from palimpsest.llm.common import materialize
from palimpsest.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"
ODD = [
    "", " ", "\n", "a  b", "\n\nb", "a\n\n", "a \t b\x1c!x \x85\xa0y", "\x00a b", " a b\n", "<|endoftext|> hi <|startoftext|>it's", "é x́ ́a ΑΣ Σa İi", "日本 語　x", "a\x1cb c", "a\t b",
    "x​ y's'S don't 12 34", "\x1c \x1da", "word. Word,\nNext*** line's end!!", "A" * 5000, "ab " * 3000,
]


def brute_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(spark, name):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for size in (40, 100_000):  # tables that overflow and tables that do not
        e = tokens.PieceEncoder(tokenizer_path(name), size=size)
        assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == brute_ids(name, texts)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 7, 4096, 9001):
        ids = rng.integers(0, [2, 50_000, 2**32 - 1][seed % 3], n, dtype=np.uint64).astype(np.uint32)
        ids[rng.random(n) < 0.01] = 2**32 - 1
        data, starts = token_files.encode_blocks(ids)
        back = [token_files.decode_block(data, s) for s in starts]
        assert len(starts) == -(-n // token_files.BLOCK_IDS)
        assert np.array_equal(np.concatenate(back) if back else np.zeros(0, np.uint32), ids)


def test_token_files(spark):
    rows = [(i * 7 % 23, t) for i, t in enumerate(ODD)] + [(100, None), (100, None)]
    got = sorted(tuple(r) for r in token_files.token_file_digest(spark.createDataFrame(rows, DOCS + "").repartition(3), tokenizer_path("byte_bpe_50k.json")).collect())
    start, want = 0, []
    for (i, t), ids in sorted(zip(rows, brute_ids("byte_bpe_50k.json", [t or "" for _, t in rows])), key=lambda x: x[0][0]):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_file_digest(spark.createDataFrame([], DOCS), tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("fan_out", [4, 32])
def test_edit_trees(monkeypatch, fan_out):
    monkeypatch.setattr(edit_counts, "FAN_OUT", fan_out)
    e = tokens.PieceEncoder(tokenizer_path("byte_bpe_50k.json"), added_tokens=True)
    cut, count = edit_counts._leaves(e)
    rng, parts = random.Random(5), ["the", " ", "\n", "  ", "abc", "'s", "\t", "\x1c", "é", "12", "!", " word", "\n\n", "<|endoftext|>"]
    text = lambda n: "".join(rng.choices(parts, k=n))
    states, trees = [], []
    for _ in range(150):
        s = text(rng.choice([0, 1, 5, 200, 900]))
        tree = edit_counts.CountTree(cut, count, s)
        for _ in range(5):
            a = rng.randint(0, len(s) + 2)
            b, new = a + rng.choice([0, 1, 5, 60, 2000]), text(rng.choice([0, 1, 3, 100]))
            tree.edit(a, b, new)
            s = s[:a] + new + s[b:]
            assert edit_counts.text_between(tree.root, 0, len(s)) == s
            states.append(s)
            trees.append(tree.total)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert trees == [(len(s), len(x.ids)) for s, x in zip(states, plain.encode_batch(states, add_special_tokens=False))]


def test_an_edit_makes_few_nodes():
    """One edit near the front of a long text makes nodes of the order of the tree's height, whatever its length."""
    cut, count = edit_counts._leaves(tokens.PieceEncoder(tokenizer_path("byte_bpe_50k.json")))
    made = []
    for words in (2_000, 20_000, 200_000):
        tree = edit_counts.CountTree(cut, count, "word " * words)
        before, tree.encoded = edit_counts.Node.made, 0
        tree.edit(12, 14, "xy z")
        made.append(edit_counts.Node.made - before)
        assert tree.encoded < 30 and tree.total[0] == 5 * words + 2
    assert made[2] <= 2 * made[0] + 6 and max(made) < 40


def test_token_files_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    rows = [(3, "ab " * 300), (1, "x y"), (2, "word " * 90), (None, "null id")]
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], DOCS + ", seg int, part string")
    got = sorted(tuple(r) for r in token_files.token_file_digest(df, tokenizer_path("byte_bpe_50k.json")).collect() if r.doc_id is not None)
    ids = dict(zip([i for i, _ in rows], brute_ids("byte_bpe_50k.json", [t for _, t in rows])))
    start = len(ids[None]) + 1  # null ids come first
    for i, at, n, crc in got:
        assert (at, n, crc) == (start, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 2], "<u4").tobytes()))
        start += n
    assert [g[0] for g in got] == [1, 2, 3]


def test_edited_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, None), (0, "")], DOCS)
    script = edit_counts.scripted_edits(docs).collect()
    clashing = edit_counts.scripted_edits(docs).selectExpr("*", "1 sizes", "'c' counts", "2 leaves")
    assert edit_counts.edited_counts(clashing, tokenizer_path("byte_bpe_50k.json")).count() == len(script)
    got = sorted((tuple(r) for r in edit_counts.edited_counts(edit_counts.scripted_edits(docs), tokenizer_path("byte_bpe_50k.json")).collect()), key=repr)
    before, after = [], []
    for r in script:
        s = r.text
        before.append(s)
        for x in r.edits:
            s = s[: x.start] + x.new + s[max(x.start, x.end) :] if x.start <= len(s) else s + x.new
        after.append(s)
    b, a = brute_ids("byte_bpe_50k.json", before), brute_ids("byte_bpe_50k.json", after)
    want = sorted(((r.doc_id, len(s), len(i), len(t), len(j)) for r, s, i, t, j in zip(script, before, b, after, a)), key=repr)
    assert [g[:5] for g in got] == want and all(g[7] < 60 for g in got)
    long = next(g for g in got if g[0] == len(ODD) - 1)
    assert long[5] < long[3] / 3  # a long text is not encoded again as a whole


@pytest.mark.parametrize("fan_out", [2, 32])
def test_batches_of_edits_on_kept_trees(spark, monkeypatch, fan_out):
    """Three batches of edits, each on the table that the last one wrote: texts, counts and sums are those of the text encoded afresh."""
    monkeypatch.setattr(edit_counts, "FAN_OUT", fan_out)
    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(9)
    texts = dict(enumerate([t or "" for t in ODD] + ["many words go by " * 400]))
    trees = edit_counts.build_trees(spark.createDataFrame(list(texts.items()), DOCS), path)
    for _ in range(3):
        script = {}
        for i, s in texts.items():
            script[i] = [(a := rng.randrange(len(s) + 1), a + rng.randrange(30), rng.choice(["", " new", "x", "one two ", "\n\n", "é"])) for _ in range(rng.randrange(4))]
            for start, end, new in script[i]:
                s = s[:start] + new + s[max(start, end) :] if start <= len(s) else s + new
            texts[i] = s
        edits = spark.createDataFrame(list(script.items()), "of long, edits array<struct<start: long, end: long, new: string>>")
        kept = materialize(edit_counts.edit_trees(trees.join(edits, trees.doc_id == edits.of).drop("of"), path, keep=True), "kept")
        trees = kept.select(*edit_counts._NAMES)
        got = {r.doc_id: r for r in kept.collect()}
        assert {i: r.text for i, r in got.items()} == texts
        ids = brute_ids("byte_bpe_50k.json", list(texts.values()))
        assert [(got[i].chars_after, got[i].n_after) for i in texts] == [(len(s), len(x)) for s, x in zip(texts.values(), ids)]
        for r in got.values():
            sums = np.frombuffer(r.sums, "<u4").reshape(-1, 3)
            assert tuple(sums.sum(0)) == (len(edit_counts._unpacked(r.sizes)), r.chars_after, r.n_after) and edit_counts._unpacked(r.counts).sum() == r.n_after
    assert got[len(texts) - 1].chars_encoded < 400


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies for you and that is what it is for</div>
<div class="content with-ads"><h2>Title &amp; more</h2><p>The cat sat on the mat and it was the best of all the times that we had, so they said. <a href=x>And a link</a> that goes on for the reader.</p><p>Short
 one.<br>Next<p>Another of the paragraphs that we have in this text for the reader, who is there to see it and be with it at the end of the day.</div>
<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><section class="comments"><p>First! I think that the article is good and it was so nice to be here with you all.</p></section>
<form><p>Subscribe to the list and get the best of it in the mail for all of you</p><input></form><script>if (a < b) x("</p>")</script><footer>(c) 2020</footer></body></html>"""
TEXT = (
    "Title & more The cat sat on the mat and it was the best of all the times that we had, so they said. And a link that goes on for the reader. Short one. Next "
    "Another of the paragraphs that we have in this text for the reader, who is there to see it and be with it at the end of the day."
)


def test_pages(spark):
    marked = "<nav>Menu</nav><article><header><h1>Head</h1></header><p>One<p>Two &lt;b&gt; <b>x</b>y<aside>Side</aside></article><div class=ad>Buy the best of it now and be happy with it</div>"
    rows = [(1, PAGE), (2, marked), (3, None), (4, ""), (5, "plain &amp; simple"), (6, "<p>" * 2000 + "deep and the end of it"), (6, "<script>only")]
    df = spark.createDataFrame([(i, f"u{i}" if i % 2 else None, h, 1) for i, h in rows], "page_id long, url string, html string, text int")
    assert {(r.page_id, r.url) for r in html_text.extract_main_text(df).collect()} == {(i, f"u{i}" if i % 2 else None) for i, _ in rows}
    assert html_text.extract_main_text(df.limit(0)).collect() == []
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.extract_main_text(df).collect()}
    texts = {(1, TEXT), (2, "Head One Two <b> xy"), (3, ""), (4, ""), (5, "plain & simple"), (6, "deep and the end of it"), (6, "")}
    assert got == {(i, t, len(t)) for i, t in texts}


def test_a_tag_with_an_open_quote_is_a_tag():
    prose = "The cat sat on the mat and it was the best of all the times that we had, so they said to us at the end of it."
    assert html_text.main_text(f"<p>{prose} <a href=x title='y>and</a> on <b>we</b> go.</p>") == f"{prose} and on we go."


def test_marks_and_names_do_not_override_the_rules():
    prose = "The cat sat on the mat and it was the best of all the times that we had, so they said to us at the end of it."
    teasers = "".join(f"<article><a href={i}>Card {i} of the list</a><p>Short teaser {i}</p></article>" for i in range(6))
    assert html_text.main_text(f"<div><p>{prose}</p><p>{prose}</p></div>{teasers}").startswith(f"{prose} {prose}")
    aside = "<p>Tags of today</p>"
    assert html_text.main_text(f"<article><p>{prose}</p><p>In short.</p></article><div>{aside}</div>") == f"{prose} In short."
    assert html_text.main_text(f"<article><p>{prose}</p></article><div><p>{prose}</p></div>") == f"{prose} {prose}"
    comments = f"<div class=comments><p>First! {prose}</p></div>"
    assert html_text.main_text(f"<div class='social page'><p>{prose}</p><p>{prose}</p>{comments}</div><footer>(c)</footer>") == f"{prose} {prose}"
    assert html_text.main_text(f"<p>{prose}</p>{comments}") == prose


def test_generated_pages(spark):
    """All pages with their marks; nine of ten when the marks are ordinary elements, where the rules are alone."""
    import html
    import re

    pages, alone = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect(), 0
    for r in pages:
        article = re.split(r"</article>|<footer", r.html[r.html.index("<article>") + 9 :])[0]
        article = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))
        text = " ".join(html.unescape(article).split())
        assert html_text.main_text(r.html) == text
        alone += html_text.main_text(re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", r.html)) == text
    assert alone >= 0.9 * len(pages)


def test_rules_decide_without_any_names(spark, monkeypatch):
    """With no name of a class, no name of an element and no mark of an article, length, links, stop words and neighbours still find 19 of 20 articles."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    with_names = {r.page_id: html_text.main_text(r.html) for r in pages}
    for name in ("NAMED", "AROUND", "MAIN"):
        monkeypatch.setattr(html_text, name, frozenset())
    same = sum(html_text.main_text(r.html) == with_names[r.page_id] for r in pages)
    assert same >= 0.95 * len(pages)


def test_stop_words_tell_prose_from_lists(monkeypatch):
    """A long list of terms in a container of its own is no article; by length alone it would be the article."""
    prose = "The cat sat on the mat and it was the best of all the times that we had, so they said to us at the end of it. " * 3
    terms = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega " * 12
    page = f"<body><div><p>{prose}</p></div><div><p>{terms}</p></div></body>"
    assert html_text.main_text(page) == " ".join(prose.split())
    monkeypatch.setattr(html_text, "STOP_WORDS", frozenset())
    assert html_text.main_text(page) == " ".join(terms.split())


def test_neighbours_inside_a_container_come_first():
    prose = "The cat sat on the mat and it was the best of all the times that we had, so they said to us at the end of it. " * 3
    links = "".join(f"<li><a href={i}>Part {i}</a></li>" for i in range(5))
    page = f"<ul>{links}</ul><div>Buy now and save</div><section><p>First.</p><p>Second.</p><p>{prose}</p><p>Last.</p></section><ul>{links}</ul><div>&copy; A company of the town</div>"
    assert html_text.main_text(page) == " ".join(f"First. Second. {prose} Last.".split())
    assert html_text.main_text("<p>Only this.<p>And <b>that<p>is here.") == "Only this. And that is here."


def brute_chain(unary, pairs):
    import itertools

    total, good = 0.0, np.zeros(len(unary))
    for labels in itertools.product((0, 1), repeat=len(unary)):
        w = np.exp(sum(u for u, y in zip(unary, labels) if y) + sum(pairs[a][b] for a, b in zip(labels, labels[1:])))
        total += w
        good += w * np.array(labels)
    return good / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    pairs = rng.normal(size=(2, 2))
    text = "The first line of it.\nBUY!! NOW!! ###\n\nThe third one and the last of them, so.\nx"
    chain = quality.LineChain(rng.normal(size=quality.FEATURES), pairs)
    features, size = quality.line_features(text)
    marginals = brute_chain(features @ chain.weights, pairs)
    assert abs(chain.score(text) - (marginals * size).sum() / size.sum()) < 1e-9
    padded = np.zeros((1, 7))
    padded[0, :4] = features @ chain.weights
    good, _, _ = quality._forward_backward(padded, pairs, np.arange(7)[None] < 4)
    assert np.allclose(good[0, :4], marginals)


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the likelihood over all labellings."""
    import itertools

    rng = np.random.default_rng(4)
    documents, labels = [rng.normal(size=(m, quality.FEATURES)) for m in (1, 2, 3, 5, 4)], [1, 0, 1, 1, 0]
    w, pairs = rng.normal(size=quality.FEATURES) / 3, rng.normal(size=(2, 2))

    def likelihood(w, pairs):
        total = 0.0
        for x, y in zip(documents, labels):
            score = lambda ls: sum(u for u, l in zip(x @ w, ls) if l) + sum(pairs[a, b] for a, b in zip(ls, ls[1:]))  # noqa: B023, E731
            every = [score(ls) for ls in itertools.product((0, 1), repeat=len(x))]
            total += (score((y,) * len(x)) - np.logaddexp.reduce(every)) / len(x)
        return total / len(documents)

    slope, pair_slope = quality._gradient(quality._padded(documents, labels), w, pairs)
    for i in range(0, quality.FEATURES, 7):
        step = 1e-5 * (np.arange(quality.FEATURES) == i)
        assert abs((likelihood(w + step, pairs) - likelihood(w - step, pairs)) / 2e-5 - slope[i]) < 1e-6
    for i in range(4):
        step = 1e-5 * (np.arange(4) == i).reshape(2, 2)
        assert abs((likelihood(w, pairs + step) - likelihood(w, pairs - step)) / 2e-5 - pair_slope.ravel()[i]) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "\n\n"), (None, "x"), (1, "")], DOCS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in quality.quality_scores(odd, labels.limit(0)).collect())
    kept = quality.keep_good(docs.withColumnRenamed("lang", "score"), quality.train(docs, labels))
    assert kept.columns == ["doc_id", "text", "score", "source", "n_chars"]


def test_training_reads_past_the_first_lines(spark):
    word = lambda i, j: f"Line {'abcdefghij'[i % 10]}{'klmnopqrst'[j % 10]}{'uvwxyz'[j // 10]} of the text that is here for the reader."
    head = lambda i: [word(i, j) for j in range(40)]
    tail = {1: lambda i: head(i + 1), 0: lambda i: [f"### $$$ {i} %%% @@@ {j}" for j in range(40)]}
    rows = [(i, "\n".join(head(i) + tail[i % 2](i))) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    chain = quality.train(docs, labels)
    assert chain.score("\n".join(head(3) + tail[1](3))) > chain.score("\n".join(head(3) + tail[0](3))) + 0.2  # the first lines alone give 0.02


def test_training_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(50))) for i in range(60)], DOCS)
    monkeypatch.setattr(quality, "LONGEST", 80)
    x = quality.training_features("\n".join(f"line {j}" for j in range(400)))
    assert len(x) == 80 and x[0, 3 * quality.OWN] == x[-1, 3 * quality.OWN + 1] == 1
    got = []
    monkeypatch.setattr(quality, "SAMPLE_LINES", 1000)
    monkeypatch.setattr(quality.LineChain, "fit", classmethod(lambda cls, documents, labels: got.extend(documents)))
    quality.train(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int"))
    assert sum(map(len, got)) == 1000 and {len(x) for x in got} == {50}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_have_their_own_ids(name):
    from tokenizers import Tokenizer

    texts = [*ODD, "end of page<|endoftext|>next", "a  <|endoftext|>\n<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "x \n<|endoftext|> it's"]
    plain, e = Tokenizer.from_file(tokenizer_path(name)), tokens.PieceEncoder(tokenizer_path(name), added_tokens=True)
    assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_queries_give_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from palimpsest.llm.queries import op4_token_files, op9_edit_counts

    text = "end of page<|endoftext|>next"
    spark.createDataFrame([(1, text)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    ids = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert op4_token_files(spark, str(tmp_path)).first().ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    assert op9_edit_counts(spark, str(tmp_path)).first().n_before == len(ids)
