"""Layer 4: edit tags from a sequence tagger, applied to words and turned into diagnostics.

The tagger itself is pluggable: any function from words to predictions. No model weights are part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosewright.operators import analysis


@dataclass(frozen=True)
class Decoding:
    keep_bias: float = 0.2
    least: float = 0.66
    passes: int = 5


def words(docs: DataFrame) -> DataFrame:
    """Words by white space with byte spans (PRJ-13): doc_id, word_idx, word, s, e."""
    rows = analysis.cut(docs, "tokens", ("doc_id", "tok", "text", "s", "e"), plain=True)
    return rows.withColumnsRenamed({"tok": "word_idx", "text": "word"})


def gated(predictions: DataFrame, decoding: Decoding = Decoding()) -> DataFrame:
    """The label that applies to each word, or null (PRD-13): the sentence needs a word that is likely wrong, and the
    edit must beat keeping it by the bias."""
    most = F.max("error_prob").over(W.partitionBy("doc_id"))
    apply = (most >= decoding.least) & (F.col("edit_prob") > F.col("keep_prob") + F.lit(decoding.keep_bias)) & (F.col("edit_prob") >= decoding.least)
    return predictions.withColumn("tag", F.when(apply, F.col("tag")))


def edited(word: Column, tag: Column, form: Column) -> Column:
    """The words that replace a word under its tag (PRJ-10, PRJ-11, PRJ-12); form is its verb form, if known (JON-14)."""
    arg = F.array_remove(F.split(F.regexp_extract(tag, r"^\$[A-Z]+_(.*)$", 1), r"\s+"), "")
    rest = word.substr(F.lit(2), F.char_length(word))
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.char_length(x))))
    return (
        F.when(tag.isNull() | (tag == "$KEEP"), F.array(word))
        .when(tag == "$DELETE", F.array().cast("array<string>"))
        .when(tag.startswith("$APPEND_"), F.concat(F.array(word), arg))
        .when(tag.startswith("$REPLACE_"), arg)
        .when(tag == "$TRANSFORM_CASE_LOWER", F.array(F.lower(word)))
        .when(tag == "$TRANSFORM_CASE_UPPER", F.array(F.upper(word)))
        .when(tag == "$TRANSFORM_CASE_CAPITAL", F.array(capital(word)))
        .when(tag == "$TRANSFORM_CASE_CAPITAL_1", F.array(F.concat(F.substring(word, 1, 1), capital(rest))))
        .when(tag == "$TRANSFORM_AGREEMENT_PLURAL", F.array(F.concat(word, F.lit("s"))))
        .when(tag == "$TRANSFORM_AGREEMENT_SINGULAR", F.array(F.substring(word, F.lit(1), F.char_length(word) - 1)))
        .when(tag == "$TRANSFORM_SPLIT_HYPHEN", F.split(word, "-"))
        .when(tag.startswith("$TRANSFORM_VERB_"), F.array(F.coalesce(form, word)))
        .otherwise(F.array(word))
    )


def apply_edits(rows: DataFrame, verbs: DataFrame, decoding: Decoding = Decoding()) -> DataFrame:
    """(doc_id, word_idx, sub_idx, word) after one pass over rows (doc_id, word_idx, word, tag and probabilities)."""
    marked = gated(rows, decoding).withColumn("verb", F.regexp_extract("tag", r"^\$TRANSFORM_VERB_(.*)$", 1))
    forms = verbs.select(F.col("word").alias("v_word"), F.col("tags").alias("v_tags"), "form")
    met = marked.join(forms, (F.col("word") == F.col("v_word")) & (F.col("verb") == F.col("v_tags")), "left")
    return met.select("doc_id", "word_idx", F.posexplode(edited(F.col("word"), F.col("tag"), F.col("form"))).alias("sub_idx", "word"))


def best_label(logits: Column, keep: int) -> Column:
    """Softmax of one word's logits (AGG-18): the best label besides keep, the first of equals, with both probabilities."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    ranked = F.transform(e, lambda x, i: F.struct(F.when(i == keep, F.lit(-1.0)).otherwise(x).alias("p"), (-i).alias("i")))
    best = F.array_max(ranked)
    return F.struct((-best["i"]).alias("edit_label"), (best["p"] / total).alias("edit_prob"), (F.element_at(e, keep + 1) / total).alias("keep_prob"))


# decoding and differences (PRJ-14)


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, found along furthest-reaching diagonals."""
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for d in range(n + m + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    pairs, x, y = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        k, old = x - y, trail[d]
        down = k == -d or (k != d and old.get(k - 1, -1) < old.get(k + 1, -1))
        px = old.get(k + 1 if down else k - 1, 0)
        py = px - (k + 1 if down else k - 1)
        while x > max(px, 0) and y > max(py, 0) and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        x, y = px, py
    return pairs[::-1]


def differences(spans: list[tuple[int, int]], old: list[str], new: list[str]) -> list[tuple[int, int, str]]:
    """Edits (s, e, replacement): changed runs; an insertion joins the word before it, or the first word at the start.
    Edits that put what is there are left out."""
    out, i, j = [], 0, 0
    for x, y in [*common(old, new), (len(old), len(new))]:
        gone, put = old[i:x], new[j:y]
        if gone:
            if put != gone:
                out.append((spans[i][0], spans[x - 1][1], " ".join(put)))
        elif put and i:
            out.append((*spans[i - 1], " ".join([old[i - 1], *put])))
        elif put and old:
            out.append((*spans[0], " ".join([*put, old[0]])))
        i, j = x + 1, y + 1
    return out


Predictor = Callable[[list[str]], list[tuple[str, float, float, float]]]


def decode(tokens: list[str], predict: Predictor, edit: Callable[[str, str], list[str]], decoding: Decoding = Decoding()) -> list[str]:
    """Passes until nothing changes or the limit; predict gives (tag, edit, keep, error) for each word."""
    now = list(tokens)
    for _ in range(decoding.passes):
        got = predict(now)
        if max((g[3] for g in got), default=0.0) < decoding.least:
            return now
        after = [w for word, (tag, p, keep, _) in zip(now, got, strict=True) for w in (edit(word, tag) if p > keep + decoding.keep_bias and p >= decoding.least else [word])]
        if after == now:
            return now
        now = after
    return now


def edit_word(word: str, tag: str, verbs: dict[tuple[str, str], str] | None = None) -> list[str]:
    """The same edits as edited(), on one word."""
    head, _, arg = tag.partition("_")
    if tag == "$DELETE":
        return []
    if head == "$APPEND":
        return [word, *arg.split()]
    if head == "$REPLACE":
        return arg.split()
    if head != "$TRANSFORM":
        return [word]
    if arg.startswith("VERB_"):
        return [(verbs or {}).get((word, arg[5:]), word)]
    return {
        "CASE_LOWER": [word.lower()], "CASE_UPPER": [word.upper()], "CASE_CAPITAL": [word[:1].upper() + word[1:].lower()], "CASE_CAPITAL_1": [word[:1] + word[1:2].upper() + word[2:].lower()],
        "AGREEMENT_PLURAL": [word + "s"], "AGREEMENT_SINGULAR": [word[:-1]], "SPLIT_HYPHEN": word.split("-"),
    }.get(arg, [word])


def diagnostics(docs: DataFrame, predict: Predictor, decoding: Decoding = Decoding()) -> DataFrame:
    """NEURAL diagnostics of every document; the predictor runs in the Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"\S+")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = list(word.finditer(text or ""))
                size = lambda k: len((text or "")[:k].encode("utf-8", "surrogatepass"))
                old = [m[0] for m in found]
                new = decode(old, predict, edit_word, decoding)
                if new != old:
                    spans = [(size(m.start()), size(m.end())) for m in found]
                    raw = text.encode("utf-8", "surrogatepass")
                    rows += [(doc, s, e, "NEURAL", "Possible grammatical error.", [put], "Neural", raw[s:e].decode("utf-8", "replace")) for s, e, put in differences(spans, old, new)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "s", "e", "code", "message", "suggestions", "source", "surface"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, s bigint, e bigint, code string, message string, suggestions array<string>, source string, surface string")
