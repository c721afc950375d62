"""Rules, lexicons and count tables as Parquet tables, and reports as JSON: what is built once and loaded by checkers."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.operators.disambiguation import Action, TagRule
from prosewright.operators.rules import Group, Ref, Rule, Test, TextRule, Token, skip_reasons

KINDS = {c.__name__: c for c in (Test, Token, Group, Ref, Rule, TextRule, Action, TagRule)}


def packed(x: object) -> object:
    """Rule objects as plain values that JSON can hold; fields that have their defaults are left out."""
    if is_dataclass(x):
        return {"is": type(x).__name__} | {f.name: packed(getattr(x, f.name)) for f in fields(x) if getattr(x, f.name) != f.default}
    return [packed(y) for y in x] if isinstance(x, tuple) else x


def unpacked(x: object) -> object:
    if isinstance(x, dict):
        return KINDS[x["is"]](**{k: unpacked(v) for k, v in x.items() if k != "is"})
    return tuple(map(unpacked, x)) if isinstance(x, list) else x


def rule_table(spark: SparkSession, rules: list) -> DataFrame:
    """(no, id, kind, body) of rules of any kind, in order (SNK-6)."""
    return spark.createDataFrame([(k, r.id, type(r).__name__, json.dumps(packed(r), ensure_ascii=False)) for k, r in enumerate(rules)], "no int, id string, kind string, body string")


def rules_from(table: DataFrame) -> list:
    """The rules of a rule table, in order (SRC-20). Packs have some thousands of rules and travel with the tasks."""
    return [unpacked(json.loads(r.body)) for r in table.orderBy("no").collect()]


def write_rules(spark: SparkSession, rules: list, path: str) -> None:
    rule_table(spark, rules).coalesce(1).write.mode("overwrite").parquet(path)


def read_rules(spark: SparkSession, path: str) -> list:
    return rules_from(spark.read.parquet(path))


def conversion_report(spark: SparkSession, rules: list[Rule], opaque: list[tuple[str, str]]) -> DataFrame:
    """One row: total, opaque, fraction that can run (1 of no rules), and the reasons by count (AGG-6). opaque are rules
    that the reader of the source could not express."""
    reasons = [why for _, ok, why in skip_reasons(rules) if not ok] + [why for _, why in opaque]
    total = len(rules) + len(opaque)
    counts = {why: reasons.count(why) for why in sorted(set(reasons))}
    return spark.createDataFrame([(total, len(reasons), (total - len(reasons)) / total if total else 1.0, counts)], "total int, opaque int, fraction double, reasons map<string,int>")


def write_lexicon(entries: DataFrame, path: str) -> None:
    """A lexicon with ord, by language and sorted by surface, so that readers prune (SNK-7)."""
    entries.repartition("lang", F.xxhash64("surface") % 16).sortWithinPartitions("lang", "surface", "ord").write.mode("overwrite").partitionBy("lang").parquet(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("surface string, ord int, lemma string, tag string, lang string").parquet(path).select("lang", "surface", "ord", "lemma", "tag")


MODEL = ("pairs", "uni", "bi", "lpos", "rpos")


def write_model(tables: dict[str, DataFrame], folder: str) -> None:
    """The count tables of layer 3."""
    for name in MODEL:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in MODEL}


def write_counts(counts: DataFrame, path: str) -> None:
    """(gram, n) as lines `gram<tab>n` (SNK-10)."""
    counts.select(F.concat("gram", F.lit("\t"), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON line (SNK-4)."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def diagnostics_json(found: DataFrame) -> DataFrame:
    """(doc_id, json): a document's diagnostics in order as a JSON array of objects with start, end, code, message,
    suggestions and source (SNK-5)."""
    one = F.struct("rank", F.col("s").alias("start"), F.col("e").alias("end"), "code", "message", "suggestions", "source")
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("d"))
    return rows.select("doc_id", F.to_json(F.transform("d", lambda x: x.dropFields("rank"))).alias("json"))


def manifest(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """(key, sha256, bytes) of the files under a path (SNK-11, FN-8); evaluation.drift compares two of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select((F.substring_index("path", "/", -1) if name is None else name).alias("key"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def label_list(text: str) -> list[str]:
    """The edit tags of a tagger by index, from JSON: a list, or an object of tags and their indices (SRC-22)."""
    found = json.loads(text)
    return found if isinstance(found, list) else [t for t, _ in sorted(found.items(), key=lambda kv: kv[1])]


def tagger_meta(text: str) -> dict:
    """The settings of a tagger from JSON, with the decoder's defaults where they say nothing (SRC-22)."""
    return {"keep_bias": 0.2, "least": 0.66, "passes": 5} | {k: v for k, v in json.loads(text).items() if v is not None}
