"""Layers 1 and 3 while texts stay where they are: what a word, or a confusable word between its neighbours, gives is
found once for all its occurrences, and only occurrences that give something leave the texts.

A word and a context are named by a key, in which white space parts what tokens can't hold: the layer, the tokens, and
the language, if any. A filter of bits over the CRC-32 of all keys goes to the texts; it is of MOST_BITS at most, so what
passes it meets the keys themselves in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright import scratch
from prosewright.functions.text import is_word
from prosewright.operators import analysis, confusion, spelling, tokenizer

#: Bits of the filter, and how many it has for each key below that; bits that one row of the bitmap functions holds.
MOST_BITS, BITS_A_KEY, BUCKET = 1 << 27, 64, 1 << 15
#: A bound on the bytes of a row of what is found.
ROW_BYTES = 256
WORD, CONTEXT = "1", "3"


class Coded:
    """The tokens of some texts as numbers: words and langs are what code and lang point to."""

    def __init__(self, texts: pa.Array, langs: pa.Array, breaks: tokenizer.Breaks | None):
        tiles = tokenizer.Tiles(texts, langs.to_pylist(), breaks, elide=True)
        self.owner, self.cols = tiles.tokens(True)
        text = self.cols["text"].dictionary_encode()
        self.words, self.code = text.dictionary.to_pylist(), text.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.langs = list(dict.fromkeys(tiles.langs))
        number = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in tiles.langs], np.int64)[self.owner]
        same = self.owner[1:] == self.owner[:-1]
        self.prev, self.next = np.full((2, len(self.code)), -1)
        self.prev[1:][same], self.next[:-1][same] = self.code[:-1][same], self.code[1:][same]

    def spoken(self) -> np.ndarray:
        """The tokens that are no sentinels."""
        return np.flatnonzero(~self.cols["sentinel"].to_numpy(zero_copy_only=False))

    def among(self, words: set[str]) -> np.ndarray:
        return np.flatnonzero(np.array([w.lower() in words for w in self.words], bool)[self.code])

    def told(self, code: int) -> str | None:
        return self.words[code] if code >= 0 else None


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of columns of numbers from -1, and the number of each row's."""
    ids = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        ids = np.unique(ids * (c.max(initial=0) + 2) + c + 1, return_inverse=True)[1]
    _, first, number = np.unique(ids, return_index=True, return_inverse=True)
    return first, number


def coded(batches: Iterator[pa.RecordBatch], breaks: tokenizer.Breaks | None) -> Iterator[tuple[pa.Array, Coded]]:
    for batch in batches:
        texts, langs, ids = (batch.column(c) for c in ("text", "lang", "doc_id"))
        for a, b in tokenizer.groups(texts):
            got = Coded(texts.slice(a, b - a), langs.slice(a, b - a), breaks)
            if len(got.code):
                yield ids.slice(a, b - a), got


def inputs(docs: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit("en")
    return docs.select("doc_id", lang.alias("lang"), "text")


def counts(docs: DataFrame, words: set[str], breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """(lang, text, prev, next, n): the distinct tokens without sentinels, where prev is null, and the distinct contexts
    of those that are among words when lower-cased. In a context a sentinel is the empty token; next is null at the end
    of a document. They are counted where texts are cut, so that distinct ones shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in coded(batches, breaks):
            for at, sides in ((got.spoken(), ()), (got.among(words), (got.prev, got.next))):
                first, number = distinct(got.lang[at], *(x[at] for x in (got.code, *sides)))
                own = at[first]
                cols = [[got.langs[k] for k in got.lang[own]], [got.words[k] for k in got.code[own]], *([got.told(k) for k in x[own]] for x in sides)]
                cols = [*(pa.array(c, pa.string()) for c in cols), *(pa.nulls(len(own), pa.string()) for _ in range(4 - len(cols)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.bincount(number, minlength=len(own)))], ["lang", "text", "prev", "next", "n"])

    rows = inputs(docs).mapInArrow(run, "lang string, text string, prev string, next string, n bigint")
    return rows.groupBy("lang", "text", "prev", "next").agg(F.sum("n").alias("n"))


def bigrams(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """confusion.bigrams of the tokens whose contexts are found: a pair of two confusable words counts at the second."""
    members = F.broadcast(confusion.word_set(pairs))
    low = found.select(F.lower("prev").alias("p"), F.lower("text").alias("t"), F.lower("next").alias("x"), "n").join(members.withColumnRenamed("w", "t"), "t", "left_semi")
    back = low.filter(is_word(F.col("p")) & is_word(F.col("t"))).select(F.col("p").alias("w1"), F.col("t").alias("w2"), "n")
    ahead = low.filter(is_word(F.col("t")) & is_word(F.col("x"))).select(F.col("t").alias("w1"), F.col("x").alias("w2"), "n")
    ahead = ahead.join(members.withColumnRenamed("w", "w2"), "w2", "left_anti").select("w1", "w2", "n")
    return back.unionByName(ahead).groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def first_tags(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, text, tag) of distinct tokens; the empty one is a sentinel."""
    rows = words.withColumns({"last": F.lit(False), "sentinel": F.col("text") == ""})
    return analysis.structural(analysis.lookup(rows, entries)).select("lang", "text", F.element_at("tags", 1).alias("tag"))


def with_tags(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds pp and np, the first tags of prev and next."""
    words = rows.select("lang", F.explode(F.array("prev", "next")).alias("text")).filter("text is not null").distinct()
    tags = first_tags(words, entries)
    for side, name in (("prev", "pp"), ("next", "np")):
        own = tags.select(F.col("lang").alias("t_lang"), F.col("text").alias("t_text"), F.col("tag").alias(name))
        rows = rows.join(own, rows["lang"].eqNullSafe(own["t_lang"]) & (rows[side] == own["t_text"]), "left").drop("t_lang", "t_text")
    return rows


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds what confusion asks of the texts of a context."""
    rows = rows.withColumns({"low": F.lower("text"), "pl": F.lower("prev"), "nl": F.lower("next")})
    return rows.withColumns({"lw": F.when(is_word(F.col("pl")), F.col("pl")), "rw": F.when(is_word(F.col("nl")), F.col("nl"))})


def key(layer: str, *tokens: str, lang: str = "lang") -> Column:
    """Of a token that is null, white space stands in the key."""
    parts = [F.coalesce(F.col(t), F.lit("\n")) for t in tokens]
    return F.concat(F.lit(layer), *(x for p in parts for x in (F.lit(" "), p)), F.coalesce(F.concat(F.lit(" "), F.col(lang)), F.lit("")))


def key_of(layer: str, tokens: tuple[str | None, ...], lang: str | None) -> str:
    """The same as key()."""
    return " ".join([layer, *("\n" if t is None else t for t in tokens), *([] if lang is None else [lang])])


class Filter:
    """The bits of the CRC-32 of keys."""

    def __init__(self, keys: DataFrame, n: int):
        size = BUCKET
        while size < min(n * BITS_A_KEY, MOST_BITS):
            size *= 2
        place = F.crc32(F.col("key").cast("binary")) % size + 1  # the functions count bits from 1
        rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        bits = np.zeros(size // 8 + BUCKET // 8, np.uint8)
        for r in rows.collect():
            at = (r.k - 1) * (BUCKET // 8)
            bits[at : at + BUCKET // 8] = np.frombuffer(bytes(r.bits), np.uint8)
        self.size, self.bits = size, keys.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, size: int, keys: list[str]) -> np.ndarray:
    at = np.fromiter((zlib.crc32(k.encode("utf-8", "surrogatepass")) for k in keys), np.int64, len(keys)) % size
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def small(rows: int) -> bool:
    return rows * ROW_BYTES <= scratch.BROADCAST_BYTES


def placed(docs: DataFrame, found: DataFrame, words: set[str], breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """The occurrences in docs of what is found, a written table by key: doc_id, s, e and its columns. words are those
    whose contexts are among the keys."""
    n = found.count()
    filter = Filter(found, n)
    shared, size = filter.bits, filter.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for ids, got in coded(batches, breaks):
            for layer, at, sides in ((WORD, got.spoken(), (got.code,)), (CONTEXT, got.among(words), (got.code, got.prev, got.next))):
                if not len(at):
                    continue
                first, number = distinct(got.lang[at], *(x[at] for x in sides))
                own = at[first]
                names = [key_of(layer, tuple(got.told(x[k]) for x in sides), got.langs[got.lang[k]]) for k in own]
                ok = may_hold(bits, size, names)[number]
                owner, at, which = (pa.array(x) for x in (got.owner[at[ok]], at[ok], number[ok]))
                cols = [ids.take(owner), got.cols["s"].take(at), got.cols["e"].take(at), pa.array(names, pa.string()).take(which)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "s", "e", "key"])

    rows = inputs(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, s bigint, e bigint, key string")
    side = F.broadcast(found) if small(n) else found.hint("merge")
    return rows.join(side, "key").drop("key")


def layers_1_and_3(docs: DataFrame, lexicon: Callable[[DataFrame], DataFrame], pairs: DataFrame, evidence: int, table: Callable[[DataFrame, str], DataFrame], breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """The diagnostics of spelling and confusion over docs, with the lexicon of their word_counts. table writes a
    DataFrame under a name."""
    shown = ("code", "message", "suggestions", "source", "surface")
    members = {r.w for r in confusion.word_set(pairs).collect()}
    both = table(counts(docs, members, breaks), "counts")
    words, met = both.filter("prev is null").select("lang", "text", "n"), both.filter("prev is not null")
    entries = lexicon(words)
    spelt = spelling.misspelt(words, entries).select(key(WORD, "text").alias("key"), *shown)
    grams = table(bigrams(met, pairs), "bigrams")
    left, right = confusion.context_counts(grams, confusion.word_set(pairs), analysis.primary_tags(entries))
    rows = neighbours(met.drop("n")).withColumn("nt", F.col("next"))
    seen = confusion.evident(rows, pairs, grams, evidence, small(grams.count())).drop("low", "pl", "nl", "nt", "lw", "rw")
    seen = neighbours(table(seen, "evident"))
    fired = confusion.weighed(with_tags(seen, entries), pairs, confusion.unigrams(words), left, right)
    best = confusion.best_of(fired, "lang", "text", "prev", "next")
    judged = best.select(key(CONTEXT, "text", "prev", "next").alias("key"), *confusion.described())
    return placed(docs, table(spelt.unionByName(judged), "found"), members, breaks)
