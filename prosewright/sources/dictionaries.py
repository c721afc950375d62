"""Binary dictionaries: two automaton formats, read whole from files and enumerated into lexicon rows (SRC-3 to SRC-9)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\\fsa"
#: Fixed values of the formats: version bytes, flag bits of an arc, and the bit of numbered nodes.
FSA5, CFSA2 = 0x05, 0xC6
FINAL5, LAST5, NEXT5 = 1, 2, 4
NEXT2, LAST2, FINAL2, LABEL2, NUMBERS2 = 0x80, 0x40, 0x20, 0x1F, 1 << 8


class Broken(ValueError):
    """The bytes are not a dictionary."""


def _at(data: bytes, k: int) -> int:
    if not 0 <= k < len(data):
        raise Broken(f"offset {k} of {len(data)}")
    return data[k]


def _vint(data: bytes, k: int) -> tuple[int, int]:
    """A little-endian number of seven bits a byte, and the place after it."""
    value, shift = 0, 0
    while True:
        b = _at(data, k)
        k += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, k
        if shift > 63:
            raise Broken("number too long")


class Fsa5:
    """Arcs of a label byte and a goto of fixed width whose low bits are flags."""

    def __init__(self, data: bytes):
        self.arcs, size = data[8:], _at(data, 7)
        self.width, self.extra = size & 0x0F, size >> 4

    def read(self, k: int) -> tuple[int, bool, bool, int, int]:
        """label, final, last, target and the next arc's place."""
        label, flags = _at(self.arcs, k), _at(self.arcs, k + 1)
        if flags & NEXT5:
            return label, bool(flags & FINAL5), bool(flags & LAST5), k + 2, k + 2
        end = k + 1 + self.width
        _at(self.arcs, end - 1)
        return label, bool(flags & FINAL5), bool(flags & LAST5), int.from_bytes(self.arcs[k + 1 : end], "little") >> 3, end

    def first(self, node: int) -> int:
        return node + self.extra

    def root(self) -> int:
        skipped = self.read(self.first(0))[4]
        return self.read(self.first(skipped))[3]


class Cfsa2:
    """Arcs of a flag byte with an index of frequent labels, and variable-length targets."""

    def __init__(self, data: bytes):
        flags = _at(data, 5) << 8 | _at(data, 6)
        self.numbers, count = bool(flags & NUMBERS2), _at(data, 7)
        self.labels, self.arcs = data[8 : 8 + count], data[8 + count :]

    def read(self, k: int) -> tuple[int, bool, bool, int, int]:
        flags = _at(self.arcs, k)
        at, index = k + 1, flags & LABEL2
        if index:
            label = _at(self.labels, index)
        else:
            label, at = _at(self.arcs, at), at + 1
        if flags & NEXT2:
            return label, bool(flags & FINAL2), bool(flags & LAST2), -1, at
        target, at = _vint(self.arcs, at)
        return label, bool(flags & FINAL2), bool(flags & LAST2), target, at

    def first(self, node: int) -> int:
        return _vint(self.arcs, node)[1] if self.numbers else node

    def after(self, k: int) -> int:
        """The node behind the last arc of the node that the arc at k belongs to."""
        while True:
            _, _, last, _, k = self.read(k)
            if last:
                return k

    def root(self) -> int:
        k = self.first(0)
        target = self.read(k)[3]
        return self.after(k) if target < 0 else target


def entries(data: bytes) -> Iterator[bytes]:
    """All accepted byte strings, depth first in the order of arcs."""
    if data[:4] != MAGIC or len(data) < 8 or data[4] not in (FSA5, CFSA2):
        raise Broken("no dictionary of a known version")
    fsa = Fsa5(data) if data[4] == FSA5 else Cfsa2(data)
    root = fsa.root()
    stack: list[tuple[int, bytes]] = [(fsa.first(root), b"")] if root else []
    while stack:
        at, prefix = stack.pop()
        if len(prefix) > 1 << 16:
            raise Broken("the automaton has a cycle")
        label, final, last, target, following = fsa.read(at)
        word = prefix + bytes([label])
        if not last:
            stack.append((following, prefix))
        if target < 0:
            target = fsa.after(at)
        if target:
            stack.append((fsa.first(target), word))
        if final:
            yield word


def decode(field: bytes, charset: str) -> str | None:
    """Text of a field; invalid bytes give none (SRC-9)."""
    try:
        return field.decode(charset)
    except (UnicodeDecodeError, LookupError):
        return None


def info(text: str) -> dict[str, str]:
    """key=value lines, comments and blanks aside; the separator and the encoder have defaults (SRC-8)."""
    pairs = (x.partition("=") for x in text.splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {"fsa.dict.separator": "+", "fsa.dict.encoder": "SUFFIX"} | {k.strip(): v.strip() for k, _, v in pairs}


def triples(data: bytes, meta: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """(surface, lemma, tag) of every entry; the code's first letter says how many bytes to cut, the rest follows."""
    separator, charset = meta["fsa.dict.separator"].encode()[:1], meta.get("fsa.dict.encoding", "utf-8")
    if meta["fsa.dict.encoder"].upper() != "SUFFIX":
        raise Broken(f"encoder {meta['fsa.dict.encoder']}")
    for entry in entries(data):
        surface, _, rest = entry.partition(separator)
        code, _, tag = rest.partition(separator)
        if meta.get("fsa.dict.frequency-included") == "true" and separator in tag:
            tag = tag.rpartition(separator)[0]
        if code:
            cut = max(0, code[0] - ord("A"))
            got = [decode(x, charset) for x in (surface, surface[: max(0, len(surface) - cut)] + code[1:], tag)]
            if None not in got:
                yield tuple(got)  # type: ignore[misc]


def lexicon(spark: SparkSession, path: str, meta: dict[str, str], lang: str) -> DataFrame:
    """(lang, surface, ord, lemma, tag) of the dictionaries under a path, ord being an entry's place in its file; each
    file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                numbered = enumerate(triples(data, meta))
                while rows := [(lang, s, k, lemma, tag) for k, (s, lemma, tag) in islice(numbered, 10_000)]:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "surface", "ord", "lemma", "tag"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "lang string, surface string, ord int, lemma string, tag string")
