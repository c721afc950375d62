"""Compound words: the longest known prefix first, with linking elements, by backtracking (CMP-1 to CMP-3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright import config, scratch
from prosewright.functions.text import capitalize_first, is_word

MOST_PARTS, LEAST_BYTES = 8, 3
#: The linking elements of the languages that compound.
LINKS = {x.code: x.links for x in config.LANGS.values() if x.links}


def parts_of(word: str, known: set[str], links: tuple[str, ...]) -> list[str]:
    """Two parts or more that make up the lower-cased word, or none. The head comes last and takes no link."""
    low = word.lower()
    if low in known and len(low.encode()) >= LEAST_BYTES:
        return []  # one part already makes up the word
    stack: list[tuple[int, tuple[str, ...]]] = [(0, ())]
    while stack:
        at, parts = stack.pop()
        rest = low[at:]
        if parts and rest in known and len(rest.encode()) >= LEAST_BYTES:
            return [*parts, rest]
        if len(parts) + 1 >= MOST_PARTS:
            continue
        options = []
        for end in range(len(low) - 1, at, -1):
            part = low[at:end]
            if len(part.encode()) >= LEAST_BYTES and part in known:
                options += [(end + len(x), (*parts, part)) for x in ("", *links) if low.startswith(x, end) and end + len(x) < len(low)]
        stack += reversed(options)
    return []


def known_parts(lexicon: DataFrame) -> DataFrame:
    """(lang, part): lower-cased words that a lexicon has as they are or capitalised, in languages that compound."""
    low = F.lower("surface")
    own = lexicon.filter(F.col("lang").isin(*LINKS)).filter((F.col("surface") == low) | (F.col("surface") == capitalize_first(low)))
    return own.select("lang", low.alias("part")).filter(F.octet_length("part") >= LEAST_BYTES).distinct()


def found(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, word, parts) of those of the distinct (lang, word) that split, in languages with linking elements (CMP-3).

    The words' substrings meet the known parts in a join, where they are cut while the known parts are few. A word that is longer than
    MOST_PARTS of the longest part and link has no split; that bounds the substrings.
    """
    words = words.filter(F.col("lang").isin(*LINKS)).select("lang", F.lower("word").alias("low"), "word")
    known = known_parts(lexicon)
    seen = known.agg(F.max(F.char_length("part")).alias("longest"), F.count("*").alias("n")).first()
    longest = seen.longest or 0
    most = MOST_PARTS * (longest + max(len(x) for links in LINKS.values() for x in links))
    n = F.char_length("low")
    ends = lambda i: F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), n - i + 1))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(ends(i), lambda k: F.substring(F.col("low"), i, k))))
    short = words.filter((n > 0) & (n <= most)).select("lang", "low").distinct()
    parts = short.select("lang", "low", F.explode(F.array_distinct(cut)).alias("part")).filter(F.octet_length("part") >= LEAST_BYTES)
    have = parts.join(scratch.by_size(known, seen.n), ["lang", "part"]).groupBy("lang", "low").agg(F.collect_set("part").alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "low", "known")), strict=True)
            got = [parts_of(w, set(ks), LINKS[lang]) for lang, w, ks in rows]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("low"), pa.array(got, pa.list_(pa.string()))], ["lang", "low", "parts"])

    made = have.mapInArrow(run, "lang string, low string, parts array<string>").filter(F.size("parts") > 1)
    return words.join(made, ["lang", "low"]).select("lang", "word", "parts")


def head_analyses(parts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, word, head_tags): the tags of the head, as it is or else capitalised, in dictionary order (CMP-2)."""
    heads = parts.select("lang", "word", F.element_at("parts", -1).alias("head"))
    both = heads.select("lang", "word", F.posexplode(F.array(F.col("head"), capitalize_first(F.col("head")))).alias("way", "surface"))
    met = both.join(lexicon.select("lang", "surface", "ord", "tag"), ["lang", "surface"])
    tags = met.groupBy("lang", "word", "way").agg(F.array_sort(F.collect_set(F.struct("ord", "tag"))).alias("a"))
    best = tags.groupBy("lang", "word").agg(F.min(F.struct("way", "a")).alias("b"))
    return best.select("lang", "word", F.array_distinct("b.a.tag").alias("head_tags"))


def with_heads(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct words (lang, text, tags, lemmas) of analysis.lookup: those without tags that split take their head's
    tags, and themselves as lemma (CMP-2)."""
    bare = words.filter((F.size("tags") == 0) & is_word(F.col("text"))).select("lang", F.col("text").alias("word"))
    heads = head_analyses(found(bare, lexicon), lexicon).withColumnRenamed("word", "text")
    none = F.col("head_tags").isNull()
    tags, lemmas = F.when(none, F.col("tags")).otherwise(F.col("head_tags")), F.when(none, F.col("lemmas")).otherwise(F.array("text"))
    return words.join(heads, ["lang", "text"], "left").select("lang", "text", tags.alias("tags"), lemmas.alias("lemmas"))
