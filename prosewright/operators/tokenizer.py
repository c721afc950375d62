"""Texts cut into tokens by arrays over whole Arrow batches: no shuffle, and no loop over characters or tokens.

All texts of a batch lie in one array of code points. Pieces, which tile the texts, start where the kind of character
changes; byte, UTF-16 and line offsets are running sums over that array, and strings are slices of its bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from prosewright import config

OTHER, WORD, BLANK = 0, 1, 2
ENDS, CLOSERS = ".!?…", "\"')]»”"
#: Characters that are worked through at once, in whole texts.
AT_ONCE = 1 << 20
#: Break rules of a language, in order: whether they break, and the patterns before and after the place.
Breaks = dict[str, list[tuple[bool, str, str]]]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point: words are letters, numbers, non-spacing marks and the apostrophe."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        name = unicodedata.category(chr(c))
        if name[0] in "LN" or name == "Mn" or c == 39:
            out[c] = WORD
        elif name[0] == "Z" or c in (9, 10, 11, 12, 13, 0x85):
            out[c] = BLANK
    return out


@lru_cache(maxsize=256)
def pattern(before: str, after: str) -> regex.Pattern:
    return regex.compile(f"(?<=(?:{before}))(?=(?:{after}))" if before else f"(?=(?:{after}))")


def srx_borders(text: str, rules: list[tuple[bool, str, str]]) -> list[int]:
    """Where sentences begin within a text: at a place, the first rule that fits decides (TOK-1)."""
    decided: dict[int, bool] = {}
    for breaks, before, after in rules:
        for m in pattern(before, after).finditer(text):
            decided.setdefault(m.start(), breaks)
    return sorted(k for k, yes in decided.items() if yes and 0 < k < len(text))


def elisions(text: str, clitics: tuple[str, ...]) -> list[int]:
    """Where a token is cut behind leading clitics, ASCII case ignored (TOK-4)."""
    out, at = [], 0
    while True:
        k = text.find("'", at)
        if k <= at or k + 1 >= len(text) or config.ascii_lower(text[at : k + 1]) not in clitics:
            return out
        at = k + 1
        out.append(at)


def isin(x: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(x, np.array([ord(c) for c in chars], np.uint32))


class Tiles:
    """The pieces of some texts. Arrays over pieces: at and end (characters), owner (text), kind. With plain, all that is
    not white space is of one kind (PRJ-13)."""

    def __init__(self, texts: pa.Array, langs: list[str | None], breaks: Breaks | None = None, elide: bool = False, plain: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
        self.chars = np.frombuffer(self.raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        wide = 1 + (self.chars >= 0x80).astype(np.int64) + (self.chars >= 0x800) + (self.chars >= 0x10000)
        self.byte = np.concatenate(([0], np.cumsum(wide)))
        self.doc = np.searchsorted(self.byte, offsets - offsets[0])
        self.langs = langs
        self.new = np.zeros(len(self.chars) + 1, bool)  # where a text begins
        self.new[self.doc[:-1][np.diff(self.doc) > 0]] = True
        kind = kinds()[self.chars]
        kind = np.where(kind == BLANK, BLANK, WORD) if plain else kind
        self.starts = self.new[:-1].copy()
        if len(kind):
            self.starts[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == OTHER)
        self.kind_of = kind
        self.cut()
        self.border = self.new[:-1].copy()  # where a sentence begins
        self.border[self.borders()] = True
        for d, lang in enumerate(langs):
            if breaks and lang in breaks:
                a, b = self.doc[d], self.doc[d + 1]
                self.border[a + 1 : b] = False
                self.border[a + np.array(srx_borders(self.text(a, b), breaks[lang]), np.int64)] = True
        self.starts |= self.border
        if elide:
            self.elide()
        self.cut()
        self.sentence = np.cumsum(self.border)

    def text(self, a: int, b: int) -> str:
        return self.raw[self.byte[a] : self.byte[b]].decode("utf-8", "surrogatepass")

    def cut(self) -> None:
        self.at = np.flatnonzero(self.starts)
        self.end = np.append(self.at[1:], len(self.chars))[: len(self.at)]
        self.owner = np.searchsorted(self.doc, self.at, side="right") - 1
        self.kind = self.kind_of[self.at]

    def borders(self) -> np.ndarray:
        """The places behind white space that ends a sentence: it holds a line feed, or follows terminal punctuation and
        closing marks, unless a full stop follows a known abbreviation (TOK-1)."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        c, one = self.chars[self.at], self.end - self.at == 1
        stop, closer = one & isin(c, ENDS), one & isin(c, CLOSERS)
        same = np.append(False, self.owner[1:] == self.owner[:-1])
        before = lambda x: same & np.append(False, x[:-1])
        ends = before(stop) | before(closer & before(stop))
        lines = np.add.reduceat(self.chars == 10, self.at) > 0
        blank = self.kind == BLANK
        for k in np.flatnonzero(blank & ends & ~lines & before(one & (c == ord(".")))):
            if k >= 2 and self.owner[k - 2] == self.owner[k] and self.text(self.at[k - 2], self.end[k - 2]).lower() in config.ABBREVIATIONS:
                ends[k] = False
        places = self.end[blank & (lines | ends)]
        return places[(places < len(self.chars)) & ~self.new[places]]

    def elide(self) -> None:
        marked = np.flatnonzero((np.add.reduceat(self.chars == 39, self.at) > 0) & (self.kind == WORD)) if len(self.at) else []
        for k in marked:
            lang = config.LANGS.get(self.langs[self.owner[k]])
            if lang and lang.clitics:
                self.starts[self.at[k] + np.array(elisions(self.text(self.at[k], self.end[k]), lang.clitics), np.int64)] = True

    def strings(self) -> pa.Array:
        """The pieces, and an empty string behind them."""
        offsets = np.append(self.byte[self.at], [len(self.raw)] * 2 if len(self.at) else [0, 0]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.raw))

    def sums(self, at: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        """Of places: UTF-16 offset, line and column from 1, within their texts."""
        first = self.doc[owner]
        astral = np.concatenate(([0], np.cumsum(self.chars >= 0x10000)))
        feeds = np.concatenate(([0], np.cumsum(self.chars == 10)))
        behind = np.concatenate(([-1], np.maximum.accumulate(np.where(self.chars == 10, np.arange(len(self.chars)), -1))))
        return {
            "utf16": (at - first) + astral[at] - astral[first],
            "line": feeds[at] - feeds[first] + 1,
            "col": at - np.maximum(behind[at] + 1, first) + 1,
        }

    def tokens(self, sentinels: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """The owners of all tokens in order, and columns; with sentinels, an empty token opens each sentence. gap is the
        white space between a token and the one before it."""
        which = np.flatnonzero(self.kind != BLANK)
        at, end, piece, mark = self.at[which], self.end[which], which, np.zeros(len(which), bool)
        if sentinels:
            opens = np.flatnonzero(self.border)
            at, end = np.append(opens, at), np.append(opens, end)
            piece, mark = np.append(np.full(len(opens), len(self.at)), piece), np.append(np.ones(len(opens), bool), mark)
            order = np.lexsort((~mark, at))
            at, end, piece, mark = at[order], end[order], piece[order], mark[order]
        owner = np.searchsorted(self.doc, at, side="right") - 1
        first = np.append(True, owner[1:] != owner[:-1])[: len(at)]
        sent = self.sentence[at] if len(at) else np.zeros(0, np.int64)
        base = self.sentence[self.doc[owner]] if len(at) else sent
        number = np.arange(len(at))
        tok = number - np.maximum.accumulate(np.where(first, number, 0)) if len(at) else number
        spaced = first | np.append(True, at[1:] > end[:-1])[: len(at)]
        last = np.append(sent[1:] != sent[:-1], True)[: len(at)] | np.append(first[1:], True)[: len(at)]
        start = self.byte[self.doc[owner]]
        cols = {"sent": sent - base, "tok": tok, "s": self.byte[at] - start, "e": self.byte[end] - start, "spaced": spaced, "last": last, "sentinel": mark, **self.sums(at, owner)}
        out = {k: pa.array(v if v.dtype == bool else v.astype(np.int64)) for k, v in cols.items()}
        strings = self.strings()
        out["text"] = strings.take(pa.array(piece)).cast(pa.string())
        behind = np.append(0, end[:-1])[: len(at)]
        gap = ~first & (at > behind)
        out["gap"] = strings.take(pa.array(np.where(gap, np.searchsorted(self.at, behind), len(self.at)))).cast(pa.string())
        return owner, out

    def sentences(self) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """The owners of all sentences in order, and their numbers and byte ranges, which tile the texts (TOK-1)."""
        at = np.flatnonzero(self.border)
        end = np.append(at[1:], len(self.chars))[: len(at)]
        owner = np.searchsorted(self.doc, at, side="right") - 1
        start = self.byte[self.doc[owner]]
        sent = self.sentence[at] - self.sentence[self.doc[owner]] if len(at) else at
        cols = {"sent": sent, "s": self.byte[at] - start, "e": self.byte[end] - start}
        out = {k: pa.array(v.astype(np.int64)) for k, v in cols.items()}
        pieces = np.append(self.byte[at], len(self.raw)).astype(np.int64)
        out["text"] = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(pieces.tobytes()), pa.py_buffer(self.raw)).cast(pa.string())
        return owner, out


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of some AT_ONCE bytes in all."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + AT_ONCE, side="right")))
        yield start, stop
        start = stop


def cutter(view: str, columns: tuple[str, ...], breaks: Breaks | None = None, elide: bool = False, sentinels: bool = False, plain: bool = False):
    """A batch function: doc_id and lang repeated for each token or sentence (view), with the columns asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for a, b in groups(texts):
                tiles = Tiles(texts.slice(a, b - a), langs.slice(a, b - a).to_pylist(), breaks, elide, plain)
                owner, cols = tiles.tokens(sentinels) if view == "tokens" else tiles.sentences()
                owner = pa.array(owner + a)
                fixed = {"doc_id": batch.column("doc_id").take(owner), "lang": langs.take(owner)}
                yield pa.RecordBatch.from_arrays([(fixed | cols)[c] for c in columns], list(columns))

    return run


def counter(breaks: Breaks | None = None):
    """A batch function: (lang, text, n) of the distinct tokens of some texts at a time, clitics apart, without sentinels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for a, b in groups(texts):
                tiles = Tiles(texts.slice(a, b - a), langs.slice(a, b - a).to_pylist(), breaks, elide=True)
                which = np.flatnonzero(tiles.kind != BLANK)
                words = tiles.strings().take(pa.array(which)).cast(pa.string())
                counted = pa.table({"lang": langs.take(pa.array(tiles.owner[which] + a)), "text": words}).group_by(["lang", "text"]).aggregate([([], "count_all")])
                yield from counted.select(["lang", "text", "count_all"]).rename_columns(["lang", "text", "n"]).combine_chunks().to_batches()

    return run
