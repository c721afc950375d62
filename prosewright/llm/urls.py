"""URL filters: rules by host and path, and beyond them words in hosts scored by naive Bayes.

Rules come first; the longest that fits a url decides. For all other urls, each label of the host is segmented into
words by a unigram Viterbi search, and a multinomial naive Bayes model scores those words with the words of the path.

The unigram counts are those of all words in the pages' own text, over the whole table. Where a page's text holds a
label of the page's own host as a word, that occurrence doesn't count: a name must not become a word by its site. A
count reaches a label only by a join on the label's own substrings, so neither the word table nor the labels are
gathered anywhere.

Naive Bayes learns from the urls that the rules decide: the segmented words of every distinct host, and the words of
every distinct path, count once for each verdict that the rules give to urls with it, so a hot host weighs no more
than any other. The prior is the share of hosts by verdict. Without urls of both verdicts there is nothing to learn and
the method's verdict is allow.

Defined results: a null url or one without :// has an empty host and path and no words; a url
without a word that the model knows is allowed, whatever the prior; a port or user part stays in the host, as the contract cuts at / ? # only; words are runs of letters, and a
run of over WORD letters is no dictionary word, though it may be a label or a token; repeated rows each get the same
verdict; a null page_id is judged like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch, join_groups

#: The contract's rules, as verdict and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Pseudo-counts of words in naive Bayes, and of hosts in the prior; the letters of the longest dictionary word.
SMOOTH, WORD = 0.5, 63
#: Characters of a long label whose substrings one row gives.
STRETCH = 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    on_host = (F.col("host") == host) | F.col("host").endswith("." + host)
    return on_host & F.col("path").startswith("/" + path)


def ruled(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The rule that decides and its verdict; longest rule first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule, verdict = F.when(rule_fits(text), F.lit(text)).otherwise(rule), F.when(rule_fits(text), F.lit(what)).otherwise(verdict)
    return rule, verdict


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the whole table: words of the pages' text, less the labels of a page's own host."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = pages.select(letters(F.col("host")).alias("own"), F.explode(letters(text)).alias("word"))
    return words.filter((F.char_length("word") <= WORD) & ~F.array_contains("own", F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: float) -> list[str]:
    """The most likely segmentation; an unknown word of length k costs as if seen 10^-k times. Ties: fewer, then longer first words."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - WORD), end):
            word = label[start:end]
            n = counts.get(word, 0)
            cost = -math.log(n / total) if n else math.log(total) + (end - start) * math.log(10)
            options.append((best[start][0] + cost, best[start][1] + 1, start))
        best.append(min(options))
    out, end = [], len(label)
    while end:
        out.append(label[best[end][2] : end])
        end = best[end][2]
    return out[::-1]


def substrings(labels: DataFrame) -> DataFrame:
    """(label, word): the distinct substrings of at most WORD letters. A long label is taken in stretches, so a row is small."""
    starts = F.explode(F.sequence(F.lit(1), F.char_length("label"), F.lit(STRETCH)))
    parts = labels.select("label", starts.alias("from"))
    parts = parts.select("label", F.substring("label", F.col("from"), F.lit(STRETCH + WORD - 1)).alias("part"))
    ends = lambda i: F.sequence(F.lit(1), F.least(F.lit(WORD), F.char_length("part") - i + 1))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.char_length("part"))), lambda i: F.transform(ends(i), lambda k: F.substring(F.col("part"), i, k))))
    return parts.select("label", F.explode(F.array_distinct(cut)).alias("word"))


def segment(labels: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, words) of distinct labels."""
    total = float(max(1, counts.agg(F.sum("n")).first()[0] or 0))
    parts = substrings(labels)
    wanted = parts.select("word").distinct()
    known = scratch.table(counts.join(wanted.hint("merge"), "word", "left_semi"), "known")
    found = parts.join(known.hint("merge"), "word").groupBy("label").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("label").to_pylist()
            known = batch.column("known").to_pylist()
            words = [viterbi(x, {k["word"]: k["n"] for k in ks or []}, total) for x, ks in zip(names, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return scratch.table(labels.join(found.hint("merge"), "label", "left").select("label", "known").mapInArrow(run, "label string, words array<string>"), "segments")


class Bayes(NamedTuple):
    prior: float  # log odds of block
    weight: DataFrame  # (word, w): log odds of block for each word


def learn(decided: DataFrame, host_words: DataFrame, scratch: Scratch) -> Bayes:
    """From (host, path, verdict) of urls that rules decide, and (host, word) of all hosts."""
    by_host = scratch.table(decided.groupBy("host", "verdict").agg(F.count("*").alias("n")).select("host", "verdict"), "decided-hosts")
    by_path = decided.groupBy("path", "verdict").agg(F.count("*").alias("n")).select("verdict", F.explode(letters(F.col("path"))).alias("word"))
    kinds = {r.verdict: r.n for r in by_host.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    words = by_host.join(host_words.hint("merge"), "host").select("verdict", "word").unionByName(by_path)
    counts = words.groupBy("word").agg(*(F.sum(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)).alias(v) for v in ("block", "allow")))
    counts = scratch.table(counts, "counts")
    if len(kinds) < 2:
        return Bayes(-math.inf, counts.select("word", F.lit(0.0).alias("w")).limit(0))
    s = counts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count("*").alias("v")).first()
    b, a = (s.b or 0.0) + SMOOTH * ((s.v or 0) + 1), (s.a or 0.0) + SMOOTH * ((s.v or 0) + 1)
    weight = counts.select("word", (F.log((F.col("block") + SMOOTH) / b) - F.log((F.col("allow") + SMOOTH) / a)).alias("w"))
    return Bayes(math.log((kinds["block"] + SMOOTH) / (kinds["allow"] + SMOOTH)), scratch.table(weight, "weights"))


def odds(bags: DataFrame, weight: DataFrame, key: str) -> DataFrame:
    """(key, odds): the sum of the weights of a bag's words; words that the model doesn't know say nothing. The weights
    are rounded to 2^-30 and summed as integers, so the sum doesn't hang on the order of the rows."""
    whole = F.round(F.col("w") * float(1 << 30)).cast("bigint")
    return bags.join(weight.hint("merge"), "word").groupBy(key).agg((F.sum(whole) / float(1 << 30)).alias("odds"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, and the block probability and host words of the method."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules)
    rows = scratch.table(pages.drop("html").withColumn("rule", rule).withColumn("verdict", verdict), "urls")
    n = rows.count()
    counts = scratch.table(word_counts(pages), "words")
    hosts = scratch.table(rows.groupBy("host").agg(F.count("*").alias("size")), "hosts")
    labels = scratch.table(hosts.select("host", F.posexplode(letters(F.col("host"))).alias("k", "label")), "labels")
    segments = segment(labels.select("label").distinct(), counts, scratch)
    words = labels.join(segments.hint("merge"), "label").select("host", "k", F.posexplode("words").alias("j", "word"))
    words = scratch.table(words, "host-words")
    bayes = learn(rows.filter("verdict is not null"), words.select("host", "word"), scratch)
    by_host = odds(words, bayes.weight, "host").withColumnRenamed("odds", "host_odds")
    shown = words.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "j", "word"))), lambda x: x["word"]), " ").alias("host_words"))
    named = scratch.table(hosts.join(by_host.hint("merge"), "host", "left").join(shown.hint("merge"), "host", "left"), "judged")
    paths = scratch.table(rows.groupBy("path").agg(F.count("*").alias("paths")), "paths")
    by_path = odds(paths.select("path", F.explode(letters(F.col("path"))).alias("word")), bayes.weight, "path").withColumnRenamed("odds", "path_odds")
    scored = scratch.table(paths.join(by_path.hint("merge"), "path", "left"), "scored")
    met = join_groups(rows, named, ["host"], "size", n, width=F.char_length("host") * 4 + F.coalesce(F.char_length("host_words"), F.lit(0)) * 4)
    met = join_groups(met, scored, ["path"], "paths", n, width=F.char_length("path") * 4)
    block = 1 / (1 + F.exp(-(F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)) + F.lit(bayes.prior))))
    return met.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when((block >= 0.5) & F.coalesce("host_odds", "path_odds").isNotNull(), "block").otherwise("allow")).alias("verdict"), block.alias("block_probability"), "host_words")


def op1_url_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
