"""Small reports and helpers around the diagnostics: inspections, version slices, manifests and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncate(x: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if any went (FN-9)."""
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def tail(x: Column, n: int) -> Column:
    """The last n characters (FN-9)."""
    return F.when(F.char_length(x) > n, F.right(x, F.lit(n))).otherwise(x)


def title_case(x: Column) -> Column:
    """Each word with a capital, the rest as it is (FN-9)."""
    words = F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.char_length(w))))
    return F.array_join(words, " ")


def strip_ansi(x: Column) -> Column:
    """Text without terminal colour codes (FN-9)."""
    return F.regexp_replace(x, "\x1b\\[[0-9;]*[A-Za-z]", "")


def number_after(x: Column, label: str) -> Column:
    """The first whole number behind a label, or null (FN-9); null too where it is beyond 64 bits."""
    found = F.regexp_extract(x, rf"(?s)\A(?>.*?{label})[^0-9]*+([0-9]+)", 1)  # from the first label on: linear in long texts
    return F.when(found != "", found.try_cast("bigint"))


def top(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value (SRT-4, SRT-6)."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def between_versions(rows: DataFrame, order: DataFrame, first: str, last: str) -> DataFrame:
    """rows (version, …) from first to last in the order (version, at), both included (SRT-7)."""
    ends = order.agg(F.max(F.when(F.col("version") == first, F.col("at"))).alias("low"), F.max(F.when(F.col("version") == last, F.col("at"))).alias("high"))
    return rows.join(F.broadcast(order), "version").join(F.broadcast(ends)).filter("at between low and high").drop("low", "high")


def lifted_manifest(lines: DataFrame) -> DataFrame:
    """(name, gzip_bytes, brotli_bytes) of JSON entries in the old shape (flat, gzip only) or the new one (PRJ-23)."""
    new = F.from_json("value", "name string, gzip struct<bytes:bigint>, brotli struct<bytes:bigint>")
    old = F.from_json("value", "name string, bytes bigint")
    rows = lines.select(new.alias("v2"), old.alias("v1"))
    return rows.select(F.col("v1.name").alias("name"), F.coalesce("v2.gzip.bytes", "v1.bytes").alias("gzip_bytes"), F.col("v2.brotli.bytes").alias("brotli_bytes"))


def tag_references(lines: DataFrame) -> DataFrame:
    """(tag, n): how often rule files name each tag (AGG-13)."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit('postag="([^"]*)"'), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a markdown table (SNK-13)."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |")).alias("line"))
