"""Checkers: an engine that analyses documents, and layers that find diagnostics on what it gives."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright import scratch
from prosewright.operators import analysis, cascade, compounds, confusion, neural, rules, spelling
from prosewright.sources import artifacts


class Engine(Protocol):
    """EXT-1."""

    def analyze(self, docs: DataFrame) -> DataFrame:
        """Tokens with tags and lemmas of documents (doc_id, lang, text)."""

    def known(self, words: DataFrame) -> DataFrame:
        """Those of the distinct (lang, word) that the engine knows."""


class GrammarChecker(Protocol):
    """EXT-2."""

    source: str

    def diagnose(self, tokens: DataFrame, docs: DataFrame) -> DataFrame:
        """Diagnostics in cascade.COLUMNS."""


@dataclass(frozen=True)
class NativeEngine:
    """Layer 0 over a lexicon with ord, with break rules and disambiguation rules if there are any."""

    entries: DataFrame
    breaks: dict | None = None
    tag_rules: list = field(default_factory=list)

    def analyze(self, docs: DataFrame) -> DataFrame:
        return analysis.analyze(docs, self.entries, self.breaks, self.tag_rules)

    def known(self, words: DataFrame) -> DataFrame:
        surfaces = self.entries.select("lang", F.col("surface").alias("word")).distinct()
        by_low = words.withColumn("own", F.col("word")).withColumn("word", F.lower("word")).join(surfaces, ["lang", "word"], "left_semi").select("lang", F.col("own").alias("word"))
        split = compounds.found(words, self.entries).select("lang", "word")
        return words.join(surfaces, ["lang", "word"], "left_semi").unionByName(by_low).unionByName(split).distinct()


@dataclass(frozen=True)
class Spelling:
    entries: DataFrame
    source: str = "Spelling"

    def diagnose(self, tokens: DataFrame, docs: DataFrame) -> DataFrame:
        return spelling.diagnostics(tokens, self.entries)


@dataclass(frozen=True)
class Grammar:
    """With native, tokens are those of NativeEngine with breaks, so rules that ask for no tags run in the texts."""

    pack: list
    source: str = "Grammar"
    native: bool = False
    breaks: dict | None = None

    @property
    def in_texts(self) -> bool:
        """Whether no rule needs the analysis."""
        return self.native and all(isinstance(r, rules.TextRule) or rules.of_text(r) for r in self.pack)

    def diagnose(self, tokens: DataFrame | None, docs: DataFrame) -> DataFrame:
        return rules.first_hits(rules.hits_over(docs, self.pack, lambda: tokens, self.breaks) if self.native else rules.hits(tokens, docs, self.pack))


@dataclass(frozen=True)
class Confusion:
    tables: dict[str, DataFrame]
    evidence: int = confusion.EVIDENCE
    source: str = "Statistical"

    def diagnose(self, tokens: DataFrame, docs: DataFrame) -> DataFrame:
        t = self.tables
        return confusion.diagnostics(confusion.scored(tokens, t["pairs"], t["bi"], t["uni"], t["lpos"], t["rpos"], self.evidence))


@dataclass(frozen=True)
class Neural:
    """A tagger is any function from words to (tag, edit, keep and error probability); it runs in the Python workers."""

    predict: neural.Predictor
    decoding: neural.Decoding = neural.Decoding()
    source: str = "Neural"

    def diagnose(self, tokens: DataFrame, docs: DataFrame) -> DataFrame:
        return neural.diagnostics(docs, self.predict, self.decoding)


@dataclass(frozen=True)
class Checker:
    """An engine with additive layers (EXT-4)."""

    engine: Engine
    layers: tuple[GrammarChecker, ...] = ()

    def with_layer(self, layer: GrammarChecker) -> Checker:
        return Checker(self.engine, (*self.layers, layer))

    def analyzed(self, docs: DataFrame) -> DataFrame:
        """The analysis, written once for all layers."""
        return scratch.table(self.engine.analyze(docs), "analysis")

    def diagnosed(self, docs: DataFrame) -> list[DataFrame]:
        """The diagnostics of each layer; the analysis is made if one of them needs it."""
        tokens = None if all(getattr(x, "in_texts", False) for x in self.layers) else self.analyzed(docs)
        return [x.diagnose(tokens, docs) for x in self.layers]

    def check(self, docs: DataFrame) -> DataFrame:
        if not self.layers:
            tokens = self.analyzed(docs)
            return cascade.check([tokens.limit(0).select(*(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", dict(docs.dtypes)["doc_id"]), ("s", "bigint"), ("e", "bigint"), ("code", "string"), ("message", "string"), ("suggestions", "array<string>"), ("source", "string"), ("surface", "string"))))])
        return cascade.check(self.diagnosed(docs))


def build(spark: SparkSession, folder: str, layers: tuple[str, ...] = ("spelling", "grammar", "confusion"), predict: neural.Predictor | None = None, breaks: dict | None = None) -> Checker:
    """A checker from a folder of tables (EXT-6, SRC-20): lexicon, and rules, tag_rules and model where layers need them.
    A layer whose table isn't there is an error; tag_rules may be missing."""
    entries = artifacts.read_lexicon(spark, f"{folder}/lexicon")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tag_rules")
    has_tags = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    engine = NativeEngine(entries, breaks, artifacts.read_rules(spark, f"{folder}/tag_rules") if has_tags else [])
    make: dict[str, Callable[[], GrammarChecker]] = {
        "spelling": lambda: Spelling(entries),
        "grammar": lambda: Grammar(artifacts.read_rules(spark, f"{folder}/rules"), native=True, breaks=breaks),
        "confusion": lambda: Confusion(artifacts.read_model(spark, f"{folder}/model")),
        "neural": lambda: Neural(predict),
    }
    return Checker(engine, tuple(make[x]() for x in layers))


class Pool:
    """At most so many checkers, by key; the one used longest ago goes first (STR-5)."""

    def __init__(self, make: Callable[[str], Checker], most: int = 3):
        self.make, self.most, self.held = make, most, OrderedDict()

    def get(self, key: str) -> Checker:
        if key not in self.held:
            self.held[key] = self.make(key)
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]
