"""Inspections of lexicons, and comparisons of two analyses of the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.functions.text import is_word, strip_marks
from prosewright.operators.evaluation import percent


def keys(words: DataFrame) -> DataFrame:
    """(lang, surfaces, marked, lower_case, longest, alphabet) of the distinct (lang, surface) (AGG-12): how many bear
    combining marks, and the letters of all without their marks, lower-cased and sorted."""
    words = words.select("lang", "surface").distinct()
    letters = words.select("lang", F.explode(F.array_distinct(F.split(F.lower(strip_marks(F.col("surface"))), ""))).alias("c")).distinct()
    alphabet = letters.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("c")), "").alias("alphabet"))
    counts = words.groupBy("lang").agg(F.count("*").alias("surfaces"), F.count_if(F.col("surface").rlike(r"\p{Mn}")).alias("marked"), F.count_if(F.col("surface") == F.lower("surface")).alias("lower_case"), F.max(F.char_length("surface")).cast("bigint").alias("longest"))
    return counts.join(alphabet, "lang")


def top_tags(entries: DataFrame) -> DataFrame:
    """(lang, top, n): what comes before the first colon of each tag (AGG-12)."""
    return entries.groupBy("lang", F.split_part("tag", F.lit(":"), F.lit(1)).alias("top")).agg(F.count("*").alias("n"))


def compared(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Each reference token with the candidate's tags on the same span and text, or null (JON-16)."""
    keys = ["doc_id", "s", "e", "text"]
    both = reference.select(*keys, F.col("tags").alias("own")).join(candidate.select(*keys, F.col("tags").alias("other")), keys, "left")
    return both.withColumn("lacks", F.array_except("own", "other"))


def tally(both: DataFrame) -> DataFrame:
    """One row (AGG-14): tokens, spans that agree, of those equal tag sets, and of words those whose tags the candidate
    all has, with percentages."""
    found, word = F.col("other").isNotNull(), is_word(F.col("text"))
    counts = {
        "tokens": F.lit(True), "spans": found, "tags": found & (F.array_sort("own") == F.array_sort("other")),
        "lexical": found & word, "lexical_tags": found & word & (F.size("lacks") == 0),
    }
    row = both.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()))
    share = lambda part, whole: percent(F.col(part), F.col(whole)).alias(part.rstrip("s") + "_pct")
    return row.select("*", share("spans", "tokens"), share("tags", "spans"), share("lexical_tags", "lexical"))


def missing(both: DataFrame) -> DataFrame:
    """(tag, n): tags that the candidate lacks where spans agree (AGG-14)."""
    return both.filter("other is not null").select(F.explode("lacks").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
