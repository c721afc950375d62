"""BPE encoding and decoding by speculation and verification.

A text splits at ASCII white space into chunks, and a chunk's ids depend on nothing outside it. Each new chunk of a
batch is split into pretokens and each pretoken proposed by greedy longest match over the vocabulary. A proposal is
the true encoding exactly if it is so for each adjacent pair of tokens (and a lone token encodes to itself); those
checks run vectorised against a table of known pairs, and only pretokens with a failing pair are merged exactly.

Defined results: a null text counts as empty, with no ids and an empty decoded text; the strings of special tokens
encode to their ids, as in the tokenizers library. Memory is bounded: the memo of chunks holds MEMO_BYTES at most,
in two generations, and a chunk longer than MEMO_CHUNK bytes is never stored. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from prosewright.llm.common import documents, lean, small_batches

TOKENIZER = "word_bpe_49k.json"
#: Bytes of the memo, of a chunk in it, and what an entry takes besides its bytes; known pairs; symbols of a short word.
MEMO_BYTES, MEMO_CHUNK, ENTRY, PAIRS, SHORT, NONE = 112 << 20, 256, 240, 1 << 19, 80, 1 << 62
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes that byte-level vocabularies use, by character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordBpe:
    """The encoder of a lower-casing BPE vocabulary whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t.encode() for t, i in [*model["vocab"].items(), *specials.items()]}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token in specials:
                continue
            ends = token.endswith(end)
            raw = bytes(letters[c] for c in (token[: -len(end)] if ends else token))
            (self.final if ends else self.inner)[raw] = i
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.raw = {i: (b, False) for b, i in self.inner.items()} | {i: (b, True) for b, i in self.final.items()}
        self.inner_byte = [self.inner[bytes([k])] for k in range(256)]
        self.final_byte = [self.final[bytes([k])] for k in range(256)]
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.specials = {s.encode(): i for s, i in specials.items()}
        self.special = re.compile(b"(" + b"|".join(map(re.escape, self.specials)) + b")")
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.ascii = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")
        self.good: set[int] = set()  # pairs of tokens that encode to themselves, as first << 32 | second
        self.bad: set[int] = set()
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}
        self.size = 0

    # exact merging

    def symbols(self, word: bytes) -> list[int]:
        return [*map(self.inner_byte.__getitem__, word[:-1]), self.final_byte[word[-1]]]

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left."""
        if len(ids) > SHORT:
            return self.merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(x << 32 | y, NONE) for x, y in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NONE:
            k = ranks.index(low)
            ids[k : k + 2] = [made[low]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], NONE)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, by a heap over linked places."""
        n, ids, get = len(ids), list(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (r := get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    # speculation

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; every byte has a token, so it always ends."""
        inner, final, longest = self.inner, self.final, self.longest
        n = len(word)
        if n <= longest and word in final:
            return [final[word]]
        out, at = [], 0
        while True:
            if n - at <= longest and (i := final.get(word[at:] if at else word)) is not None:
                out.append(i)
                return out
            to = min(n - 1, at + longest)
            while (i := inner.get(word[at:to])) is None:
                to -= 1
            out.append(i)
            at = to

    def holds(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        (x, _), (y, ends) = self.raw[a], self.raw[b]
        both = x + y
        ids = self.symbols(both) if ends else [*map(self.inner_byte.__getitem__, both)]
        return self.merge(ids) == [a, b]

    def verify(self, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The owners of proposals with an adjacent pair of tokens that doesn't hold."""
        inside = owner[1:] == owner[:-1]
        pairs = (flat[:-1][inside] << 32) | flat[1:][inside]
        kinds, back = np.unique(pairs, return_inverse=True)
        if len(self.good) + len(self.bad) > PAIRS:
            self.good, self.bad = set(), set()
        for p in kinds.tolist():
            if p not in self.good and p not in self.bad:
                (self.good if self.holds(p) else self.bad).add(p)
        fails = np.fromiter(map(self.bad.__contains__, kinds.tolist()), bool, len(kinds))
        return np.unique(owner[1:][inside][fails[back]])

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum()))
        for k in self.verify(flat, np.repeat(np.arange(len(found)), sizes)).tolist():
            found[k] = self.merge(self.symbols(words[k]))
        return found

    # chunks and texts

    def pretokens(self, chunk: bytes) -> Iterator[bytes | int]:
        """Normalised words of a chunk as bytes, and the ids of special tokens."""
        for part in self.special.split(chunk) if b"<|" in chunk else [chunk]:
            if part in self.specials:
                yield self.specials[part]
            elif part.isascii():
                low = part.lower()
                yield from [low] if low.isalpha() else self.ascii.findall(low)
            else:
                text = unicodedata.normalize("NFC", part.decode("utf-8", "surrogatepass"))
                low = text.replace("Σ", "σ").lower()  # by character: a final sigma has no form of its own here
                yield from (w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(low))

    def encode_chunks(self, chunks: list[bytes]) -> Iterator[tuple[bytes, tuple[bytes, bytes]]]:
        """The little-endian ids and the decoded bytes of each chunk."""
        parts = [[low] if (low := c.lower()).isalpha() else list(self.pretokens(c)) for c in chunks]
        words = list({w for p in parts for w in p if w.__class__ is bytes})
        text, pack = self.text, PACK
        known = {}
        for word, ids in zip(words, self.encode_words(words), strict=True):
            n = len(ids)
            known[word] = (pack[n](*ids) if n < len(pack) else struct.pack(f"<{n}I", *ids), b" ".join([text[i] for i in ids]))
        for chunk, part in zip(chunks, parts, strict=True):
            if len(part) == 1 and part[0].__class__ is bytes:
                yield chunk, known[part[0]]
            else:
                got = [known[w] if w.__class__ is bytes else (struct.pack("<I", w), text[w]) for w in part]
                yield chunk, (b"".join([g[0] for g in got]), b" ".join([g[1] for g in got]))

    def learn(self, texts: Iterable[list[bytes]]) -> dict[bytes, tuple[bytes, bytes]]:
        """Puts the chunks of the texts into the memo; what it doesn't store is returned for this call only.

        The memo has two generations: when the young one is full it becomes the old one, whose used entries return.
        """
        if self.size > MEMO_BYTES // 2:
            self.old, self.memo, self.size = self.memo, {}, 0
        memo, old = self.memo, self.old
        new, extra = [], {}
        for chunk in {c for t in texts for c in t}.difference(memo):
            if (got := old.get(chunk)) is not None:
                memo[chunk] = got
                self.size += ENTRY + len(chunk) + len(got[0]) + len(got[1])
            else:
                new.append(chunk)
        for chunk, got in self.encode_chunks(new):
            if len(chunk) > MEMO_CHUNK:
                extra[chunk] = got
            else:
                memo[chunk] = got
                self.size += ENTRY + len(chunk) + len(got[0]) + len(got[1])
        return extra

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text: its ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        extra = self.learn(split)
        get = (self.memo | extra if extra else self.memo).__getitem__
        for chunks in split:
            got = list(map(get, chunks))
            yield b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])

    def decode(self, ids: Iterable[int]) -> str:
        return b" ".join(map(self.text.__getitem__, ids)).decode()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder for each Python worker and vocabulary."""
    return WordBpe(path)


def small(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with about so many characters in all, at least one text each."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the outputs asked for: ids (array) and decoded (string)."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(TOKENIZER)
    more = {"ids": "array<int>", "decoded": "string"}
    more = {k: more[k] for k in more if k in outputs}
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), hashlib.sha256
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in small(texts):
                got = list(bpe.encode(texts[a:b]))
                cols = [batch.column("doc_id").slice(a, b - a), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([sha(i).hexdigest() for i, _ in got]), pa.array([sha(d).hexdigest() for _, d in got])]
                if "ids" in outputs:
                    cols.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got], pa.list_(pa.int32())))
                if "decoded" in outputs:
                    cols.append(pa.array([d.decode("utf-8", "surrogatepass") for _, d in got]))
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {v}" for k, v in more.items())
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def op10_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), outputs=())
