"""Readers of the text formats that feed the dimension tables. Lines come as DataFrames with a column value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files (SRC-1)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def confusion_sets(lines: DataFrame) -> DataFrame:
    """(a, b, factor, symmetric): `a; b; f` both ways, `a -> b; f` one way, # comments, words of one token only (SRC-13)."""
    bare = F.trim(F.regexp_replace("value", "#.*$", ""))
    arrow = bare.contains("->")
    parts = F.transform(F.split(F.regexp_replace(bare, r"\s*->\s*", ";"), ";"), lambda x: F.trim(F.regexp_extract(x, r"^([^|]*)", 1)))
    rows = lines.select(parts.alias("p"), (~arrow).alias("symmetric")).filter(F.size("p") >= 3)
    rows = rows.select(F.lower(F.get("p", F.lit(0))).alias("a"), F.lower(F.get("p", F.lit(1))).alias("b"), F.get("p", F.lit(2)).try_cast("float").alias("factor"), "symmetric")
    return rows.filter("a <> '' AND b <> '' AND factor IS NOT NULL AND a NOT LIKE '% %' AND b NOT LIKE '% %'")


def triples(lines: DataFrame) -> DataFrame:
    """(surface, lemma, tag) of tab-separated lines; comments and lines without surface or tag drop out (SRC-14, PRD-14)."""
    p = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(F.trim(F.get(p, F.lit(0))).alias("surface"), F.trim(F.get(p, F.lit(1))).alias("lemma"), F.trim(F.get(p, F.lit(2))).alias("tag"))
    return rows.filter("surface <> '' AND tag <> ''")


def ngrams(lines: DataFrame) -> DataFrame:
    """(gram, n) of `gram<tab>count` lines; bad counts drop out (SRC-15)."""
    p = F.split("value", "\t")
    return lines.select(F.get(p, F.lit(0)).alias("gram"), F.get(p, F.lit(1)).try_cast("bigint").alias("n")).filter("gram <> '' AND n IS NOT NULL")


def ngram_faults(lines: DataFrame) -> DataFrame:
    """One row: lines, untabbed, uncounted; a usable file has lines and no faults (SRC-16)."""
    p = F.split("value", "\t")
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.size(p) < 2).alias("untabbed"), F.count_if(F.get(p, F.lit(1)).try_cast("bigint").isNull()).alias("uncounted"))


def corpus_sentences(lines: DataFrame) -> DataFrame:
    """(id, k, word, tag) of `id<tab>sentence` lines with word|TAG tokens (SRC-17)."""
    p = F.split("value", "\t", 2)
    rows = lines.select(F.get(p, F.lit(0)).alias("id"), F.posexplode(F.filter(F.split(F.coalesce(F.get(p, F.lit(1)), F.lit("")), r"\s+"), lambda x: x != "")).alias("k", "t"))
    return rows.select("id", "k", F.regexp_extract("t", r"^(.*?)(?:\|[^|]*)?$", 1).alias("word"), F.regexp_extract("t", r"\|([^|]*)$", 1).alias("tag"))


def verb_forms(lines: DataFrame) -> DataFrame:
    """(word, tags, form) of `w1_w2:T1_T2` lines; the first line of a (word, tags) wins. Needs a column n for order (SRC-23)."""
    pattern = r"^([^_:]+)_([^_:]+):([A-Z]+_[A-Z]+)$"
    rows = lines.select("n", *(F.regexp_extract("value", pattern, k).alias(c) for k, c in ((1, "word"), (3, "tags"), (2, "form")))).filter("word <> ''")
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("word", "tags").orderBy("n"))).filter("rn = 1").select("word", "tags", "form")


def suffix_base(inflected, code):
    """The base form: the code's first letter says how many characters to trim (A none), the rest is appended (FN-5)."""
    trim = F.greatest(F.ascii(code) - F.lit(ord("A")), F.lit(0))
    keep = F.greatest(F.char_length(inflected) - trim, F.lit(0))
    return F.concat(F.substring(inflected, F.lit(1), keep), code.substr(F.lit(2), F.char_length(code)))


def decoded_entries(lines: DataFrame, separator: str = "+") -> DataFrame:
    """(surface, lemma, tag) of dictionary entries `surface<sep>code<sep>tag` (SRC-7)."""
    p = F.split("value", F.lit("\\" + separator), 3)
    rows = lines.select(F.get(p, F.lit(0)).alias("surface"), F.get(p, F.lit(1)).alias("code"), F.get(p, F.lit(2)).alias("tag")).filter("code <> ''")
    return rows.select("surface", suffix_base(F.col("surface"), F.col("code")).alias("lemma"), F.coalesce("tag", F.lit("")).alias("tag"))


def m2_edits(text: str) -> list[dict]:
    """Gold edits of annotator 0 from an M2 file; no-ops are left out (SRC-24)."""
    out, sent = [], -1
    for line in text.splitlines():
        if line.startswith("S "):
            sent += 1
            words = line[2:].split(" ")
        elif line.startswith("A "):
            span, kind, fix, _, _, annotator = line[2:].split("|||")
            a, b = map(int, span.split(" "))
            if annotator == "0" and kind != "noop":
                out.append({"sent": sent, "start": a, "end": b, "kind": kind, "fix": fix, "old": " ".join(words[a:b])})
    return out
