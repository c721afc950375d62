"""Command line.

python -m prosewright check PATH --tables FOLDER [--lang en] [--layers spelling,grammar,confusion] [--json]
python -m prosewright tokens TEXT [--tables FOLDER] [--lang en]
python -m prosewright build-lexicon FILE --out FOLDER --lang en [--info FILE]     a binary dictionary, or lines of surface, lemma, tag
python -m prosewright convert GRAMMAR_XML --out FOLDER [--disambiguation XML]     rules into tables, with a report
python -m prosewright build-confusion SETS UNIGRAMS BIGRAMS --tables FOLDER       the model of layer 3
python -m prosewright score GRAMMAR_XML --tables FOLDER [--lang en] [--json]      the rules against their own examples
python -m prosewright audit PATH --tables FOLDER [--lang en]                      how often rules fire, and rules that change nothing
python -m prosewright inspect --tables FOLDER                                     keys, alphabets and top-level tags of the lexicon
python -m prosewright manifest PATH [--against FILE]                              hashes of files as JSON lines, or what changed
python -m prosewright query NAME SF_DIR | list                                    the named queries

FOLDER holds the tables lexicon, rules, tag_rules and model. --srx FILE gives the break rules of --lang.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright import engine
from prosewright.operators import analysis, cascade, confusion, evaluation, inspection
from prosewright.plans import base, catalog
from prosewright.session import local_session
from prosewright.sources import artifacts, dictionaries, readers, rule_xml


def arguments(args: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="prosewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    by = top.add_subparsers(dest="command", required=True)

    def command(name: str, *plain: str, **named: object) -> None:
        p = by.add_parser(name)
        for x in plain:
            p.add_argument(x)
        for x, default in named.items():
            p.add_argument(f"--{x}", action="store_true") if default is False else p.add_argument(f"--{x}", default=default, required=default is ...)

    command("check", "path", tables=..., lang="en", layers="spelling,grammar", srx=None, json=False)
    command("tokens", "text", tables=None, lang="en", srx=None)
    command("build-lexicon", "file", out=..., lang="en", info=None)
    command("convert", "grammar", out=..., disambiguation=None)
    command("build-confusion", "sets", "unigrams", "bigrams", tables=...)
    command("score", "grammar", tables=..., lang="en", json=False)
    command("audit", "path", tables=..., lang="en", srx=None)
    command("inspect", tables=...)
    command("manifest", "path", against=None)
    command("query", "name", "sf_dir")
    command("list")
    return top.parse_args(args)


def documents(spark: SparkSession, path: str, lang: str) -> DataFrame:
    return readers.whole_files(spark, path).select(F.xxhash64("path").alias("doc_id"), F.lit(lang).alias("lang"), "text", "path")


def breaks_of(a: argparse.Namespace) -> dict | None:
    return {a.lang: rule_xml.segmentation(Path(a.srx).read_text(), a.lang)} if a.srx else None


def show(rows: DataFrame) -> None:
    for r in artifacts.as_json(rows).toLocalIterator():
        print(r.json)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = documents(spark, a.path, a.lang)
    found = engine.build(spark, a.tables, tuple(a.layers.split(",")), breaks=breaks_of(a)).check(docs)
    if a.json:
        for r in artifacts.diagnostics_json(found).orderBy("doc_id").toLocalIterator():
            print(r.json)
        return
    for r in cascade.printed(docs, found, F.col("path")).orderBy("doc_id", "rank").toLocalIterator():
        print(r.line)


def tokens(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.createDataFrame([(0, a.lang, a.text)], "doc_id bigint, lang string, text string")
    entries = artifacts.read_lexicon(spark, f"{a.tables}/lexicon") if a.tables else spark.createDataFrame([], base.ENTRY)
    full = analysis.analyze(docs, entries, breaks_of(a))
    show(full.orderBy("tok").select("text", "s", "e", "tags", "lemmas"))


def build_lexicon(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.info:
        entries = dictionaries.lexicon(spark, a.file, dictionaries.info(Path(a.info).read_text()), a.lang)
    else:
        lines = readers.triples(spark.read.text(a.file))
        entries = lines.select(F.lit(a.lang).alias("lang"), "surface", F.monotonically_increasing_id().cast("int").alias("ord"), "lemma", "tag")
    artifacts.write_lexicon(entries, f"{a.out}/lexicon")


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    path = Path(a.grammar)
    parsed = rule_xml.grammar(path.read_text(), path.parent)
    artifacts.write_rules(spark, [*parsed.rules, *parsed.text_rules], f"{a.out}/rules")
    if a.disambiguation:
        other = Path(a.disambiguation)
        tag_rules, _ = rule_xml.disambiguation(other.read_text(), other.parent)
        artifacts.write_rules(spark, tag_rules, f"{a.out}/tag_rules")
    show(artifacts.conversion_report(spark, parsed.rules, parsed.unsupported))


def build_confusion(spark: SparkSession, a: argparse.Namespace) -> None:
    sets = readers.confusion_sets(spark.read.text(a.sets))
    pairs = sets.withColumn("ord", F.monotonically_increasing_id().cast("int")).select("a", "b", "ord", "factor", "symmetric")
    grams = readers.ngrams(spark.read.text(a.bigrams)).select(F.split("gram", " ").alias("g"), "n").filter(F.size("g") == 2)
    grams = grams.groupBy(F.lower(F.col("g")[0]).alias("w1"), F.lower(F.col("g")[1]).alias("w2")).agg(F.sum("n").alias("n"))
    words = confusion.word_set(pairs)
    some = lambda w: grams.join(words.withColumnRenamed("w", w), w, "left_semi")
    grams = some("w1").unionByName(some("w2")).distinct()
    counts = readers.ngrams(spark.read.text(a.unigrams)).groupBy(F.lower("gram").alias("w")).agg(F.sum("n").alias("n"))
    left, right = confusion.context_counts(grams, words, analysis.primary_tags(artifacts.read_lexicon(spark, f"{a.tables}/lexicon")))
    artifacts.write_model({"pairs": pairs, "uni": counts, "bi": grams, "lpos": left, "rpos": right}, f"{a.tables}/model")


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    path = Path(a.grammar)
    examples = [(k, a.lang, x["text"], x["rule_id"], x["corrections"]) for k, x in enumerate(rule_xml.grammar(path.read_text(), path.parent).examples)]
    rows = spark.createDataFrame(examples, "doc_id bigint, lang string, text string, rule_id string, corrections array<string>")
    found = engine.build(spark, a.tables, ("grammar",)).check(rows.select("doc_id", "lang", "text")).withColumnRenamed("doc_id", "ex")
    report = evaluation.reproduced(rows.select(F.col("doc_id").alias("ex"), "rule_id", "corrections"), found)
    if a.json:
        show(report)
    else:
        r = report.first()
        print(f"reproduced {r.reproduced}/{r.positives} ({r.reproduced_pct:.1f}%); false positives {r.false_positives}/{r.negatives} ({r.false_positive_pct:.1f}%)")


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = documents(spark, a.path, a.lang)
    checker = engine.build(spark, a.tables, ("grammar",), breaks=breaks_of(a))
    full = checker.analyzed(docs)
    found = checker.layers[0].diagnose(full, docs)
    sentence = full.filter("text <> ''").select("doc_id", "s", F.concat_ws(":", "doc_id", "sent").alias("sentence"))
    rates = evaluation.firing_rates(found.join(sentence, ["doc_id", "s"]), full.filter("sentinel").count())
    show(rates.orderBy(F.desc("sentences"), "code").limit(30))
    show(evaluation.noop_rules(found, F.col("surface")).orderBy(F.desc("n"), "code"))


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    entries = artifacts.read_lexicon(spark, f"{a.tables}/lexicon")
    show(inspection.keys(entries).orderBy("lang"))
    show(inspection.top_tags(entries).orderBy("lang", F.desc("n"), "top"))


def manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    now = artifacts.manifest(spark, a.path)
    show((evaluation.drift(spark.read.json(a.against), now).filter("status <> 'SAME'") if a.against else now).orderBy("key"))


COMMANDS = {"check": check, "tokens": tokens, "build-lexicon": build_lexicon, "convert": convert, "build-confusion": build_confusion, "score": score, "audit": audit, "inspect": inspect, "manifest": manifest}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    a = arguments(args)
    if a.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = spark or local_session()
    if a.command == "query":
        show(catalog.queries()[a.name](spark, a.sf_dir).limit(50))
    else:
        COMMANDS[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
