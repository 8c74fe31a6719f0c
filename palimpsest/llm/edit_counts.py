"""Operator 9, edit-aware token counts: a segment tree over the pre-tokens of each document.

A leaf is a word with the white space before it and the marks behind it: the library never joins
what stands on both sides of the step from a visible character to white space. A leaf knows its
characters and ids; leaves stand in blocks of up to FAN_OUT, blocks in nodes of up to FAN_OUT, and
each node knows the sums of what is below it. Trees are kept as a table: the text, two
arrays with the characters and ids of its leaves, and the sums of its blocks. A tree read from it stands on those sums; a block
looks into the arrays only when an edit comes to it. Edited trees go back into such a table with their texts, ready for the next edits.

An edit finds its first and last leaf by descending the sums, takes as much context as a safe step
needs on either side, encodes that region, splits the tree at both its ends and joins the
pieces with a tree of the new leaves. Only the nodes on the two paths are made anew, a
number of the order of the tree's height; what the edit does not touch is neither read nor encoded again. A
stretch without white space is one leaf, as what the library makes of it may depend on all of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import SEPARATORS, SPACE, encoder

FAN_OUT = 32
_WHITE = frozenset(SPACE)


class Block:
    """Up to FAN_OUT leaves: their text, and the characters and ids of each."""

    __slots__ = ("text", "sizes", "counts", "chars", "ids")
    height = 0

    def __init__(self, text: str, sizes: list[int], counts: list[int]):
        self.text, self.sizes, self.counts = text, sizes, counts
        self.chars, self.ids = len(text), sum(counts)


class Stored(Block):
    """A block of a tree that was read from a table, known by its sums until it is looked at."""

    __slots__ = ("source", "at", "leaf", "leaves")

    def __init__(self, source: tuple, at: int, leaf: int, leaves: int, chars: int, ids: int):
        self.source, self.at, self.leaf, self.leaves, self.chars, self.ids = source, at, leaf, leaves, chars, ids

    text = property(lambda self: self.source[0][self.at : self.at + self.chars])
    sizes = property(lambda self: self.source[1][self.leaf : self.leaf + self.leaves].tolist())
    counts = property(lambda self: self.source[2][self.leaf : self.leaf + self.leaves].tolist())


class Node:
    """Up to FAN_OUT blocks or nodes of one height, and their sums."""

    __slots__ = ("kids", "height", "chars", "ids")
    made = 0

    def __init__(self, kids: list):
        Node.made += 1
        self.kids, self.height = kids, kids[0].height + 1
        self.chars, self.ids = sum(k.chars for k in kids), sum(k.ids for k in kids)


def _over(kids: list):
    """The tree of kids of one height, 2 * FAN_OUT at most."""
    if not kids:
        return None
    if len(kids) == 1:
        return kids[0]
    if len(kids) <= FAN_OUT:
        return Node(kids)
    half = len(kids) // 2
    return Node([Node(kids[:half]), Node(kids[half:])])


def grow(text: str, sizes: list[int], counts: list[int]):
    """The tree of a text's leaves; None for no leaves."""
    level, at = [], 0
    for i in range(0, len(sizes), FAN_OUT):
        own = sizes[i : i + FAN_OUT]
        end = at + sum(own)
        level.append(Block(text[at:end], own, counts[i : i + FAN_OUT]))
        at = end
    while len(level) > 1:
        level = [Node(level[i : i + FAN_OUT]) for i in range(0, len(level), FAN_OUT)]
    return level[0] if level else None


def blocks_of(tree):
    """The blocks of a tree in order."""
    todo = [tree] if tree is not None else []
    while todo:
        x = todo.pop()
        if x.height:
            todo.extend(reversed(x.kids))
        else:
            yield x


def join(a, b):
    """The tree of all of a and then all of b: one path of the taller tree is made anew."""
    if a is None or b is None:
        return a or b
    if a.height == b.height:
        if a.height == 0 and len(a.sizes) + len(b.sizes) <= FAN_OUT:
            return Block(a.text + b.text, a.sizes + b.sizes, a.counts + b.counts)
        return _over(a.kids + b.kids) if a.height and len(a.kids) + len(b.kids) <= FAN_OUT else Node([a, b])
    if a.height > b.height:
        last = join(a.kids[-1], b)
        return _over(a.kids[:-1] + ([last] if last.height < a.height else last.kids))
    first = join(a, b.kids[0])
    return _over(([first] if first.height < b.height else first.kids) + b.kids[1:])


def split(tree, place: int):
    """The trees of what stands before and behind `place`, the start of a leaf or the end of the text."""
    if tree is None or place <= 0:
        return None, tree
    if place >= tree.chars:
        return tree, None
    if tree.height == 0:
        text, sizes, counts = tree.text, tree.sizes, tree.counts
        k = before = 0
        while before < place:
            before += sizes[k]
            k += 1
        return Block(text[:before], sizes[:k], counts[:k]), Block(text[before:], sizes[k:], counts[k:])
    k = before = 0
    while before + tree.kids[k].chars <= place:
        before += tree.kids[k].chars
        k += 1
    left, right = split(tree.kids[k], place - before)
    return join(_over(tree.kids[:k]), left), join(right, _over(tree.kids[k + 1 :]))


def leaf_at(tree, place: int) -> tuple[int, str]:
    """Start and text of the leaf that holds the character at `place`; the last leaf for the end."""
    before = 0
    while tree.height:
        k = 0
        while k < len(tree.kids) - 1 and before + tree.kids[k].chars <= place:
            before += tree.kids[k].chars
            k += 1
        tree = tree.kids[k]
    sizes = tree.sizes
    k, at = 0, 0
    while k < len(sizes) - 1 and before + at + sizes[k] <= place:
        at += sizes[k]
        k += 1
    return before + at, tree.text[at : at + sizes[k]]


def text_between(tree, start: int, end: int) -> str:
    """The characters start..end, from the blocks that hold them."""
    if tree is None or start >= end:
        return ""
    if tree.height == 0:
        return tree.text[start:end]
    out, before = [], 0
    for kid in tree.kids:
        if before < end and before + kid.chars > start:
            out.append(text_between(kid, max(0, start - before), min(kid.chars, end - before)))
        before += kid.chars
    return "".join(out)


class CountTree:
    """The tree of one document. `leaves` gives the leaves of a text, `count` the ids of each of them."""

    def __init__(self, leaves, count, text: str | None):
        self.cut, self.count, self.encoded = leaves, count, 0
        self.root = self._encode(text) if text is not None else None

    @classmethod
    def stored(cls, leaves, count, text: str, sizes: bytes, counts: bytes, sums: bytes):
        """The tree of a row of build_trees; see packed."""
        tree = cls(leaves, count, None)
        source, n = (text, _unpacked(sizes), _unpacked(counts)), np.frombuffer(sums, "<u4").reshape(-1, 3).astype(np.int64)
        starts = np.cumsum(n, 0) - n
        level = [Stored(source, at, leaf, *own) for (leaf, at, _), own in zip(starts.tolist(), n.tolist())]
        while len(level) > 1:
            level = [Node(level[i : i + FAN_OUT]) for i in range(0, len(level), FAN_OUT)]
        tree.root = level[0] if level else None
        return tree

    def packed(self) -> tuple[str, bytes, bytes, bytes]:
        """text, sizes, counts, sums (leaves, characters and ids of each block), as build_trees gives them."""
        own = list(blocks_of(self.root))
        part = lambda b, i: b.source[i][b.leaf : b.leaf + b.leaves] if isinstance(b, Stored) else (b.sizes if i == 1 else b.counts)
        joined = [_packed(np.concatenate([np.asarray(part(b, i), np.int64) for b in own]) if own else []) for i in (1, 2)]
        sums = [(b.leaves if isinstance(b, Stored) else len(b.sizes), b.chars, b.ids) for b in own]
        return "".join(b.text for b in own), *joined, np.array(sums, "<u4").tobytes()

    def _encode(self, text: str):
        found = self.cut(text)
        self.encoded += len(text)
        return grow(text, [len(x) for x in found], self.count(found))

    @property
    def total(self) -> tuple[int, int]:
        return (self.root.chars, self.root.ids) if self.root else (0, 0)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end (clipped to the text) by `new`."""
        size = self.total[0]
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        low = high = 0
        if self.root:
            low, _ = leaf_at(self.root, start)
            at, last = leaf_at(self.root, max(start, end - 1))
            high = at + len(last)
        region = text_between(self.root, low, start) + new + text_between(self.root, end, high)
        # A region may begin where white space stands after a visible character, and end where white space follows one.
        while low > 0 and not (region and region[0] in _WHITE):
            low, leaf = leaf_at(self.root, low - 1)
            region = leaf + region
        while high < size and not (region and region[-1] not in _WHITE):
            at, leaf = leaf_at(self.root, high)
            high, region = at + len(leaf), region + leaf
        left, rest = split(self.root, low)
        right = split(rest, high - low)[1]
        self.root = join(join(left, self._encode(region)), right)


def scripted_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edits: three edits per document, made from its id and text.

    Places are hashes of the id within the text: a deletion of up to 40 characters, a replacement
    of up to 12 by the text's first 24 in upper case, an insertion of the id between spaces.
    Places count characters of the text as the edits before left it, and may lie past its end.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.char_length("text")
    place = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(size, F.lit(1))).cast("long")
    edit = lambda at, n, new: F.struct(at.alias("start"), (at + n).alias("end"), new.alias("new"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn(
        "edits",
        F.array(
            edit(place(1), F.pmod(F.xxhash64("doc_id"), F.lit(41)), F.lit("")),
            edit(place(2), F.pmod(F.xxhash64("doc_id"), F.lit(13)), F.upper(F.substring("text", 1, 24))),
            edit(place(3), F.lit(0).cast("long"), F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "))),
        ),
    )


def _leaves(e):
    """The leaves of a text and the numbers of their ids, by an encoder; an added token is in its leaf."""
    width = e.dtype.itemsize

    def count(leaves: list[str]) -> list[int]:
        if e.marked("".join(leaves)):
            return [len(e.encode(x)) // width for x in leaves]
        return [n // width for n in map(len, map(e.known.__getitem__, leaves))]

    return e.whole_pieces, count


_TREE = "doc_id long, text string, sizes binary, counts binary, sums binary"


_NAMES = [x.split()[0] for x in _TREE.split(", ")]
_EDITED = ["doc_id", "chars_before", "n_before", "chars_after", "n_after", "chars_encoded", "leaves", "nodes_made"]


def build_trees(docs: DataFrame, tokenizer: str, added_tokens: bool = False) -> DataFrame:
    """doc_id, text, sizes, counts (one byte or four for each leaf: the first byte of each array tells), sums (of the blocks) and the edits, if docs has them.

    Null texts count as empty and have no leaves; repeated rows have a tree each; an empty table gives no rows.
    """
    keeps = "edits" in docs.columns

    def build(batches):
        import pyarrow as pa

        cut, count = _leaves(encoder(tokenizer, added_tokens=added_tokens))
        for batch in slices(batches):
            texts = [t.as_py() or "" for t in batch.column("text")]
            trees = [CountTree(cut, count, t).packed() for t in texts]
            columns = [batch.column("doc_id"), pa.array(texts, pa.string()), *(pa.array([t[i] for t in trees], pa.binary()) for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column("edits")] if keeps else [])], [*_NAMES, *(["edits"] if keeps else [])])

    edits = ", edits " + docs.schema["edits"].dataType.simpleString() if keeps else ""
    return docs.select("doc_id", "text", *(["edits"] if keeps else [])).mapInArrow(build, _TREE + edits)


def _packed(values) -> bytes:
    x = np.asarray(values, np.int64)
    width = 1 if x.max(initial=0) < 256 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def edit_trees(trees: DataFrame, tokenizer: str, added_tokens: bool = False, keep: bool = False) -> DataFrame:
    """One row per tree of build_trees with its edits: doc_id, chars_before, n_before, chars_after, n_after, chars_encoded, leaves, nodes_made.

    edits: start, end, new; applied in order, each on the text the last one left. The n count ids
    by the tokenizer without special tokens; chars_encoded is what the edits made it encode,
    nodes_made the inner nodes they made. Null edits count as none, places outside the text are
    clipped, a null replacement deletes. With keep the edited tree is there as well (text, sizes, counts, sums), so that the
    table written of it takes the place of the one before.
    """
    more = _NAMES[1:] if keep else []

    def edit(batches):
        import pyarrow as pa

        cut, count = _leaves(encoder(tokenizer, added_tokens=added_tokens))
        kinds = [pa.int64()] * len(_EDITED) + [pa.string(), pa.binary(), pa.binary(), pa.binary()][: len(more)]
        for batch in slices(batches):
            out = []
            for doc, *stored, edits in zip(*(batch.column(c).to_pylist() for c in (*_NAMES, "edits"))):
                tree = CountTree.stored(cut, count, *stored)
                before, made = tree.total, Node.made
                for x in edits or []:
                    if x:
                        tree.edit(x["start"] or 0, x["end"] if x["end"] is not None else x["start"] or 0, x["new"] or "")
                made = Node.made - made
                leaves = (len(stored[1]) - 1) // stored[1][0]
                out.append((doc, *before, *tree.total, tree.encoded, leaves, made, *(tree.packed() if keep else ())))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*_EDITED, *more])

    kind = ", ".join(f"{c} long" for c in _EDITED) + ("," + _TREE.split(",", 1)[1] if keep else "")
    return trees.mapInArrow(edit, kind)


def edited_counts(docs: DataFrame, tokenizer: str, added_tokens: bool = False) -> DataFrame:
    """Keep the trees of docs (doc_id, text, edits) as a table, then edit them; see build_trees and edit_trees. Other columns are not read."""
    return edit_trees(materialize(build_trees(docs.select("doc_id", "text", "edits"), tokenizer, added_tokens), "trees", "zstd"), tokenizer, added_tokens)


assert not _WHITE & set(SEPARATORS)
