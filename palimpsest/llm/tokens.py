"""Encoding with a public tokenizer file, one encoder per Python worker.

The library splits a text before it merges, and it never joins what stands on both sides of the
step from a visible character to white space. So a text is cut at such steps and the ids of a
piece are looked up; the library encodes pieces not seen lately. The ids are exactly
those of encoding the text in one call (tests/llm/test_text_ops.py compares them). With added_tokens a
text is first cut at the tokenizer's added tokens, which get their own ids, as the library does
at its default settings; without, they are text like any other.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Entries of one generation of a worker's tables by piece and by word, some 200 bytes each; two
#: generations are kept, some 250 MB at most. Longer pieces are not kept.
PIECES, WORDS, LONGEST = 550_000, 120_000, 64
#: The characters that the tokenizers' patterns call white space.
SPACE = " \n\t\r\x0b\x0c\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What Python's split() takes for white space as well.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A Latin-1 word, a space or line end before it and ASCII marks but no apostrophe after it.
_PLAIN = re.compile(r"([ \n]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ["Word", " word", "\nWord.", " \xc9t\xe9,", " \xdcber***", "\n\xdfa&&&", " a|", "B!!"]
_UNPLAIN = [*SPACE[2:], "  ", "\n\n", " \n", "\n ", "\0"]


class Generations(dict):
    """A table filled by `make`, of bounded size: what is used again moves on to the new generation."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceEncoder:
    """Ids of whole texts as little-endian bytes of `dtype`."""

    def __init__(self, path: str, dtype: str = "<u4", size: int = PIECES, added_tokens: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        added = t.get_added_tokens_decoder() if added_tokens else {}
        if any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError(f"{path}: an added token is not matched as plain text")
        self.dtype = np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.markers = {x.content: np.array([i], self.dtype).tobytes() for i, x in added.items()}
        self.marker = re.compile("(" + "|".join(map(re.escape, sorted(self.markers, key=len, reverse=True))) + ")")
        if t.get_vocab_size() > np.iinfo(self.dtype).max:
            raise ValueError(f"{path}: ids do not fit {dtype}")
        self.blind = not t.encode(" \n ", add_special_tokens=False).ids  # white space has no ids
        self.tokenize = t.model.tokenize
        self.words = Generations(self._word, max(1, size * WORDS // PIECES))
        self.known = Generations(self._piece, size)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        lower = bool(t.normalizer) and t.normalizer.normalize_str("A") == "a"
        self.lower = lower
        self.letters = {c: level.pre_tokenize_str(chr(c).lower() if lower else chr(c))[0][0] for c in range(32, 256)}
        self.gap = {"": "", " ": "" if self.blind else self.letters[32]}
        self.line = b"" if self.blind else self._split("\n")
        self.plain = all(self._plain(x) == self._split(x) for x in _PROBES)

    def _word(self, word: str) -> bytes:
        """A pre-token: what the library merges by itself."""
        return array(self.code, [x.id for x in self.tokenize(word)]).tobytes()

    def _plain(self, piece: str) -> bytes | None:
        """By the rule of _PLAIN: gap and word merge, the line end and the marks stand alone."""
        m = _PLAIN.fullmatch(piece)
        if not m:
            return None
        gap, word, marks = m.groups()
        word = (word.lower() if self.lower else word) if word.isascii() else word.translate(self.letters)
        ids = self.line + self.words[word] if gap == "\n" else self.words[self.gap[gap] + word]
        return ids + self.words[marks] if marks else ids

    def _piece(self, piece: str) -> bytes:
        ids = self._plain(piece) if self.plain else None
        return self._split(piece) if ids is None else ids

    def _split(self, piece: str) -> bytes:
        t = self.tokenizer
        normal = t.normalizer.normalize_str(piece) if t.normalizer else piece
        return b"".join([self.words[w] for w, _ in t.pre_tokenizer.pre_tokenize_str(normal)])

    def pieces(self, text: str) -> list[str]:
        if self.blind:
            return _PIECE.findall(text) if any(x in text for x in SEPARATORS) else text.split()
        if any(x in text for x in _UNPLAIN):
            return _PIECE.findall(text)
        found = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")  # no two spaces meet: each starts a piece
        return found if found[0] else found[1:]

    def marked(self, text: str) -> bool:
        return any(x in text for x in self.markers)

    def whole_pieces(self, text: str) -> list[str]:
        """The text cut at the steps from a visible character to white space; put together they are the text."""
        return _PIECE.findall(text) if self.blind or any(x in text for x in _UNPLAIN) else self.pieces(text)

    def encode(self, text: str) -> bytes:
        if self.marked(text):
            return b"".join([self.markers[s] if s in self.markers else self._stretch(s) for s in self.marker.split(text) if s])
        return self._stretch(text)

    def _stretch(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


_RESIDENT: dict = {}


def resident(key, make):
    """The one large object that this Python worker keeps between tasks; another kind takes its place."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def encoder(path: str, dtype: str = "<u4", added_tokens: bool = False) -> PieceEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return resident((path, dtype, added_tokens), lambda: PieceEncoder(path, dtype, added_tokens=added_tokens))


def release() -> None:
    """Give up the resident object: work that does not encode needs the memory."""
    _RESIDENT.clear()
