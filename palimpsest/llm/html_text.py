"""Operator 6, HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, each block by itself: one with many links, a short one with
links, or one with a copyright sign is bad; a long one with many stop words, and a shorter one that is dense with them, is good; all others are open, as
short blocks and blocks in words of another kind tell too little. One more feature counts like links: that
the elements around a block (menus, footers, forms, containers named as adverts, notices, sidebars or comments; for open blocks also that they are outside
a marked article that holds most of the good text) say that it stands beside the article. Second pass: an open block takes the label of the nearest decided blocks, where
near means first of all inside the same container: it climbs from its own element outwards until a container holds
decided blocks, and takes the nearer one of those before and behind it (at a tie, good); a heading takes the next one's, and a
long block with hardly a stop word none from outside the container it stands in: it is bad there. Blocks
that only their elements put beside the article tell nothing about their neighbours, so they count as decided only where there is no other.

A page without any good block gets one: in the element that holds most open text, the open block with the most stop words. A name
does not count against an element beside which hardly any text is left.

The scan is one pass of a regular expression over the whole text; state is the stack of open
elements. Unclosed tags end with their parent, an unclosed paragraph with the next block.
"""

from __future__ import annotations

import heapq
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters under which a block is short, and over which it is long.
SHORT, LONG = 70, 200
#: Shares of stop words from which a long block, and one that is neither long nor short, read like prose.
STOP_LEAST, STOP_DENSE = 0.15, 0.5
#: Share under which a long block beside an article's container is no prose.
STOP_FEW = 0.05
LINKS_MOST = 0.33
#: A named element is dropped only if the text beside such elements is at least this share of its own.
BESIDE = 0.1

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in is it its more not of on or she so than that the "
    "their them there they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in "
    "ist ja kein man mit nach nicht noch nur oder sich sie sind über um und uns von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par pas pour qu que "
    "qui sa se ses son sont sur tout un une vous y "
    "al algo como con cuando de del desde donde el ella ellos en entre era es esta este ha hay la las le lo los más me mi muy no o para "
    "pero por que se ser si sin sobre su sus también te tiene un una y ya".split()
)
#: Elements whose content is never text of the page.
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video select textarea button head title option datalist".split())
#: Of those, elements whose content holds no tags.
RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title".split()
)
#: Words of a class, id or role that name what surrounds an article.
NAMED = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-share comment commentlist comments consent cookie cookies "
    "dialog disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promoted related replies reply respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget widgets complementary contentinfo search".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: "content with-sidebar", "has-ads": such a name tells of something beside the element.
_HAS = re.compile(r"\b(?:with|has|no|without)[\s_\-]+[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _named(attributes: str, main: bool) -> bool:
    for found in _NAMES.finditer(attributes):
        value = _HAS.sub(" ", (found[1] or found[2] or found[3] or "").lower())
        words = set(re.split(r"[\s_\-:]+", value))
        if main:
            words -= {"header"}  # the article's own head
        if not NAMED.isdisjoint(words):
            return True
    return False


class Page:
    """blocks in page order; around: the named element around each named element (by their places; -1: none); up: the element around each element.

    A block: (text, characters in links, is a heading, in the marked article, in a boilerplate element, named element around it, its element).
    """

    def __init__(self, blocks: list, around: dict[int, int], up: list[int]):
        self.blocks, self.around, self.up = blocks, around, up


def blocks_of(page: str) -> Page:
    out, words, linked = [], [], 0
    up = [-1]  # elements, the page first
    stack: list[tuple[str, bool, bool, int, int]] = []  # name, boilerplate, in the article, named element, element
    element = 0
    bad = main = heading = False
    named, around = -1, {}
    links = at = 0

    def text(begin: int, end: int) -> None:
        nonlocal linked
        if end > begin:
            part = html.unescape(page[begin:end])
            words.append(part)
            linked += len("".join(part.split())) if links else 0

    def close() -> None:
        nonlocal words, linked
        joined = " ".join("".join(words).split()) if words else ""
        if joined:
            out.append((joined, linked, heading, main, bad, named, element))
        words, linked = [], 0

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, len(page))
            close()
            return Page(out, around, up)
        text(at, m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close()
            if not m[1] and name != "br":  # a block ends an open paragraph
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] not in BLOCKS:
                    depth -= 1
                if depth >= 0 and stack[depth][0] == "p":
                    links -= sum(n[0] == "a" for n in stack[depth:])
                    del stack[depth:]
                    bad, main, named, element = stack[-1][1:] if stack else (False, False, -1, 0)
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    links -= sum(n[0] == "a" for n in stack[depth:])
                    del stack[depth:]
                    break
            bad, main, named, element = stack[-1][1:] if stack else (False, False, -1, 0)
            heading = any(n[0] == "h" and n[1:].isdigit() for n, *_ in stack[-3:])
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
            bad, main, named, element = stack[-1][1:] if stack else (False, False, -1, 0)
        in_main = main or name in MAIN
        inside = name in AROUND and not (name == "header" and main) or name in DROPPED
        if name not in ("html", "body") and name not in MAIN:
            inside = inside or bool(_HIDDEN.search(m[3]))
            if _named(m[3], main):
                around[m.start()], named = named, m.start()
        bad, main = bad or inside, in_main
        if name in BLOCKS:
            up.append(element)
            element = len(up) - 1
        stack.append((name, bad, main, named, element))
        links += name == "a"
        heading = name[0] == "h" and name[1:].isdigit() or heading and name not in BLOCKS


def _stop_words(text: str) -> tuple[int, float]:
    """How many of its words are stop words, and their share."""
    words = _WORD.findall(text.lower())
    n = sum(w in STOP_WORDS for w in words)
    return n, n / max(1, len(words))


def _verdict(text: str, linked: int, heading: bool) -> str:
    """good, bad or open, by length, links and stop words."""
    size = max(1, len("".join(text.split())))
    if linked / size > LINKS_MOST or "\u00a9" in text and len(text) <= LONG:
        return "bad"
    if len(text) < SHORT:
        return "bad" if linked and not heading else "open"
    return "good" if _stop_words(text)[1] >= (STOP_LEAST if len(text) > LONG else STOP_DENSE) else "open"


def _kept_names(blocks: list, verdicts: list[str], around: dict[int, int]) -> set[int]:
    """The named elements that leave hardly any text beside them, from the outside in; -1 for the page is one of them."""
    own = dict.fromkeys((-1, *around), 0)
    for b, v in zip(blocks, verdicts):
        own[b[5]] += len(b[0]) if v != "bad" else 0
    size, inner = dict(own), {x: [] for x in own}
    for x in sorted(around, reverse=True):  # inner ones start later
        size[around[x]] += size[x]
        inner[around[x]].append(x)
    kept, beside = {-1}, own[-1]
    ready = [(-size[x], x) for x in inner[-1]]
    heapq.heapify(ready)
    while ready and beside < BESIDE * -ready[0][0]:
        _, x = heapq.heappop(ready)
        kept.add(x)
        beside += own[x]
        for y in inner[x]:
            heapq.heappush(ready, (-size[y], y))
    return kept


def _labels(page: Page) -> tuple[list[str], list[bool]]:
    """The first pass: good, bad or open; and which blocks are bad only for what their elements say."""
    own = [_verdict(*b[:3]) for b in page.blocks]
    labels = ["bad" if b[4] else x for b, x in zip(page.blocks, own)]
    kept = _kept_names(page.blocks, labels, page.around)  # from the outside in: what is around a kept one is kept
    beside = [b[4] or b[5] not in kept for b in page.blocks]
    labels = ["bad" if o else x for o, x in zip(beside, labels)]
    if "good" not in labels and "open" in labels:
        still = [i for i, x in enumerate(labels) if x == "open"]
        held = dict.fromkeys((page.up[page.blocks[i][6]] for i in still), 0)
        for i in still:
            held[page.up[page.blocks[i][6]]] += len(page.blocks[i][0])
        most = max(held.values())
        best = max((i for i in still if held[page.up[page.blocks[i][6]]] == most), key=lambda i: (not page.blocks[i][2], _stop_words(page.blocks[i][0])[0], len(page.blocks[i][0]), -i))
        labels[best] = "good"
    marked = sum(len(b[0]) for b, x in zip(page.blocks, labels) if x == "good" and b[3])
    if 2 * marked >= sum(len(b[0]) for b, x in zip(page.blocks, labels) if x == "good") > 0:
        beside = [o or x == "open" and not b[3] for b, o, x in zip(page.blocks, beside, labels)]
        labels = ["bad" if o else x for o, x in zip(beside, labels)]
    return labels, [o and x != "bad" for o, x in zip(beside, own)]


def _spans(page: Page) -> tuple[list[int], list[int]]:
    """The first block of each element, and the one behind its last."""
    n = len(page.blocks)
    first, behind = [n] * len(page.up), [0] * len(page.up)
    for i, b in enumerate(page.blocks):
        first[b[6]], behind[b[6]] = min(first[b[6]], i), i + 1
    for e in range(len(page.up) - 1, 0, -1):  # an element stands behind the one around it
        u = page.up[e]
        first[u], behind[u] = min(first[u], first[e]), max(behind[u], behind[e])
    return first, behind


def main_text(html_text: str | None) -> str:
    """The article of a page: its good blocks in order, joined by one space; empty if there are none."""
    if not html_text:
        return ""
    page = blocks_of(html_text)
    labels, beside = _labels(page)
    first, behind = _spans(page)
    decided = [x != "open" and not o for x, o in zip(labels, beside)]
    if not any(decided):
        decided = [x != "open" for x in labels]
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if decided[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if decided[i + 1] else after[i + 1]
    final = list(labels)
    for i, label in enumerate(labels):
        if label != "open":
            continue
        e = page.blocks[i][6]
        while e > 0 and before[i] < first[e] and after[i] >= behind[e]:
            e = page.up[e]
        low, high = (0, n) if e <= 0 else (first[e], behind[e])
        near = [(i - before[i], labels[before[i]] != "good")] if before[i] >= low else []
        near += [(after[i] - i, labels[after[i]] != "good")] if after[i] < high else []
        if page.blocks[i][2] and after[i] < high:
            near = near[-1:]
        alone = e not in (page.blocks[i][6], page.up[page.blocks[i][6]])
        listed = alone and len(page.blocks[i][0]) > LONG and _stop_words(page.blocks[i][0])[1] < STOP_FEW
        final[i] = "bad" if listed or near and min(near)[1] else "good"
    return " ".join(b[0] for b, x in zip(page.blocks, final) if x == "good")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    A null or empty page has an empty text. Ids and urls, null or repeated, are carried along; an
    empty table gives no rows; other columns are not read.
    """

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
