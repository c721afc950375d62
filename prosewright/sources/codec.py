"""A compact binary form of sorted count tables: variable-length numbers and differences of keys (SNK-8, SNK-9, FN-6).

Every read is bounds-checked: truncated or random bytes raise Broken and never read past the end.
"""

from __future__ import annotations

import struct

from prosewright.sources.dictionaries import Broken

HEADER, LONGEST = b"PWC1", 10


def put_number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def put_text(s: str) -> bytes:
    raw = s.encode()
    return put_number(len(raw)) + raw


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise Broken("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        value = 0
        for k in range(LONGEST):
            b = self.take(1)[0]
            value |= (b & 0x7F) << 7 * k
            if b < 0x80:
                return value
        raise Broken("number too long")

    def u32(self) -> int:
        if (n := self.number()) > 0xFFFFFFFF:
            raise Broken("number too large")
        return n

    def text(self) -> str:
        try:
            return self.take(self.number()).decode()
        except UnicodeDecodeError as e:
            raise Broken("text is not UTF-8") from e


def put_triples(rows: list[tuple[int, int, int]]) -> bytes:
    """Rows (a, b, n) by a, then b; b restarts from 0 whenever a changes."""
    out, a, b = [put_number(len(rows))], 0, 0
    for x, y, n in sorted(rows):
        b = b if x == a else 0
        out += [put_number(x - a), put_number(y - b), put_number(n)]
        a, b = x, y
    return b"".join(out)


def get_triples(r: Reader) -> list[tuple[int, int, int]]:
    out, a, b = [], 0, 0
    for _ in range(r.number()):
        step = r.u32()
        b = 0 if step else b
        a, b = a + step, b + r.u32()
        if a > 0xFFFFFFFF or b > 0xFFFFFFFF:
            raise Broken("key too large")
        out.append((a, b, r.u32()))
    return out


def encode(vocab: list[str], pairs: list[tuple[str, str, float, bool]], unigrams: list[tuple[int, int]], tables: list[list[tuple[int, int, int]]]) -> bytes:
    """The vocabulary, the confusable pairs, the unigrams (id, n) and any number of pair tables (id, id, n)."""
    out = [HEADER, put_number(len(vocab)), *map(put_text, vocab), put_number(len(pairs))]
    out += [put_text(a) + put_text(b) + struct.pack("<f?", f, s) for a, b, f, s in pairs]
    out += [put_triples([(0, k, n) for k, n in unigrams]), put_number(len(tables)), *map(put_triples, tables)]
    return b"".join(out)


def decode(data: bytes) -> tuple[list[str], list[tuple[str, str, float, bool]], list[tuple[int, int]], list[list[tuple[int, int, int]]]]:
    r = Reader(data)
    if r.take(4) != HEADER:
        raise Broken("another format")
    vocab = [r.text() for _ in range(r.number())]
    pairs = []
    for _ in range(r.number()):
        a, b = r.text(), r.text()
        factor, flag = struct.unpack("<fB", r.take(5))
        pairs.append((a, b, factor, bool(flag)))
    unigrams = [(k, n) for _, k, n in get_triples(r)]
    tables = [get_triples(r) for _ in range(r.number())]
    if r.at != len(data):
        raise Broken("bytes after the end")
    return vocab, pairs, unigrams, tables
