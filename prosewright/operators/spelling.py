"""Layer 1: unknown words and suggestions at edit distance 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright import config, scratch
from prosewright.functions.text import recase, strip_marks
from prosewright.operators import analysis, compounds

SHORTEST, SUGGESTIONS = 3, 5


def checkable(text: Column, lang: Column) -> Column:
    """Three characters or more besides marks, all of the language's alphabet (PRD-1)."""
    low = F.lower(strip_marks(text))
    out = F.lit(False)
    for x in config.LANGS.values():
        out = F.when(lang == x.code, low.rlike(rf"\A[{x.alphabet}]{{{SHORTEST},}}\z")).otherwise(out)
    return out


def surfaces(lexicon: DataFrame) -> DataFrame:
    """(lang, surface) of a lexicon, once each; what they are taken from need not shuffle while they are few."""
    known = lexicon.select("lang", "surface").distinct()
    return scratch.by_size(known, known.count())


def unknown_words(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, word, n): checkable lower-cased words outside the lexicon, by exact or lower-cased surface (JON-2), that are
    no compounds of known words either (CMP-3). toks are tokens or their word_counts."""
    words = toks.filter(checkable(F.col("text"), F.col("lang"))).groupBy("lang", strip_marks(F.col("text")).alias("surface")).agg(analysis.occurrences(toks).alias("n"))
    known = surfaces(lexicon)
    left = words.join(known, ["lang", "surface"], "left_anti").withColumn("word", F.lower("surface"))
    left = left.join(known.withColumnRenamed("surface", "word"), ["lang", "word"], "left_anti")
    left = left.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return left.join(compounds.found(left, lexicon).select("lang", "word"), ["lang", "word"], "left_anti")


def _signatures(words: DataFrame, name: str) -> DataFrame:
    """Every word under itself and each of its single deletions."""
    n = F.char_length(name)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(F.col(name), F.lit(1), i - 1), F.substring(F.col(name), i + 1, n)))
    return words.select("lang", name, F.explode(F.array_distinct(F.array_union(F.array(name), cut))).alias("sig"))


def _swapped(a: str, b: str) -> Column:
    n = F.char_length(a)
    return F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring(F.col(a), F.lit(1), i - 1), F.substring(F.col(a), i + 1, F.lit(1)), F.substring(F.col(a), i, F.lit(1)), F.substring(F.col(a), i + 2, n)) == F.col(b))


def candidates(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, word, candidate): lexicon words at one delete, transpose, replace or insert (JON-3).

    Both sides meet on deletion signatures, a join on keys, instead of all edits of a word being looked up.
    """
    known = lexicon.select("lang", F.col("surface").alias("candidate")).filter(F.col("candidate") == F.lower("candidate")).distinct()
    ok = F.lit(False)
    for x in config.LANGS.values():
        ok = F.when(F.col("lang") == x.code, F.col("candidate").rlike(rf"\A[{x.alphabet}]+\z")).otherwise(ok)
    met = _signatures(words.select("lang", "word"), "word").join(_signatures(known.filter(ok), "candidate"), ["lang", "sig"]).select("lang", "word", "candidate").distinct()
    near = F.levenshtein("word", "candidate")
    return met.filter((near == 1) | ((near == 2) & (F.char_length("word") == F.char_length("candidate")) & _swapped("word", "candidate")))


def suggestions(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, word, suggestions): the first SUGGESTIONS candidates in byte order (SRT-3)."""
    return candidates(words, lexicon).groupBy("lang", "word").agg(F.slice(F.array_sort(F.collect_set("candidate")), 1, SUGGESTIONS).alias("suggestions"))


def diagnostics(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """SPELL diagnostics (§ L1): doc_id, s, e, code, message, suggestions, source, surface."""
    return misspelt(toks, lexicon).select("doc_id", "s", "e", "code", "message", "suggestions", "source", "surface")


def misspelt(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The tokens, or words of word_counts, that are misspelt, with the columns of a diagnostic."""
    words = unknown_words(toks, lexicon)
    known = words.join(suggestions(words, lexicon), ["lang", "word"], "left").select("lang", "word", "suggestions")
    rows = toks.filter(checkable(F.col("text"), F.col("lang"))).withColumns({"surface": strip_marks(F.col("text")), "word": F.lower(strip_marks(F.col("text")))})
    rows = rows.join(known, ["lang", "word"]).join(surfaces(lexicon), ["lang", "surface"], "left_anti")
    message = F.lit(config.LANGS["en"].spell_message)
    for x in config.LANGS.values():
        message = F.when(F.col("lang") == x.code, x.spell_message).otherwise(message)
    cased = F.transform(F.coalesce("suggestions", F.array().cast("array<string>")), lambda c: recase(F.col("text"), c))
    return rows.select(*toks.columns, F.lit("SPELL").alias("code"), message.alias("message"), cased.alias("suggestions"), F.lit("Spelling").alias("source"), F.col("text").alias("surface"))
