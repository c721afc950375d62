"""Tag disambiguation: rules in order over each sentence, with four actions on the tags of marked tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.operators.rules import Group, Rule, Token, _regex, match_at, prepare, suppressed


def replaced(tags: Column, to: Column) -> Column:
    """Narrows to the wanted tags where any is present, else adds them (DIS-3)."""
    return F.when(F.arrays_overlap(tags, to), F.filter(tags, lambda t: F.array_contains(to, t))).otherwise(F.array_union(tags, to))


def added(tags: Column, more: Column) -> Column:
    """DIS-4."""
    return F.array_union(tags, more)


def removed(tags: Column, pattern: str, literal: bool) -> Column:
    """DIS-5: tags equal to the pattern, or that it matches as a whole."""
    return F.filter(tags, lambda t: (t != pattern) if literal else ~t.rlike(rf"\A(?:{pattern})\z"))


def filtered(tags: Column, keep: Column) -> Column:
    """DIS-6: only the given tags; an empty list changes nothing."""
    return F.when(F.size(keep) == 0, tags).otherwise(F.filter(tags, lambda t: F.array_contains(keep, t)))


@dataclass(frozen=True)
class Action:
    kind: str  # replace, add, remove or filter
    tags: tuple[str, ...] = ()
    lemmas: tuple[str, ...] = ()
    tag_regexp: bool = False


@dataclass(frozen=True)
class TagRule:
    id: str
    pattern: tuple[Token | Group, ...]
    action: Action
    antipatterns: tuple[tuple[Token | Group, ...], ...] = field(default=())


def act(action: Action, tok: dict) -> None:
    tags, lemmas = tok["tags"], tok["lemmas"]
    is_one = lambda t: any(_regex(p, False).fullmatch(t) for p in action.tags) if action.tag_regexp else t in action.tags
    if action.kind == "replace":
        tok["tags"] = [t for t in tags if is_one(t)] or tags + [t for t in action.tags if t not in tags]
        if action.lemmas:
            tok["lemmas"] = [x for x in lemmas if x in action.lemmas] or lemmas + list(action.lemmas)
    elif action.kind == "add":
        tok["tags"] = tags + [t for t in dict.fromkeys(action.tags) if t not in tags]
        tok["lemmas"] = lemmas + [x for x in dict.fromkeys(action.lemmas) if x not in lemmas]
    elif action.kind == "remove":
        tok["tags"] = [t for t in tags if not is_one(t)]
        tok["lemmas"] = [x for x in lemmas if x not in action.lemmas]
    elif action.kind == "filter" and action.tags:
        tok["tags"] = [t for t in tags if is_one(t)]


def apply_rule(rule: TagRule, toks: list[dict]) -> None:
    """Finds all hits without overlap first, then changes the marked tokens (DIS-2)."""
    at, hits = 0, []
    as_rule = Rule(rule.id, rule.pattern, (("x",),), antipatterns=rule.antipatterns)
    while at < len(toks):
        m = match_at(rule.pattern, toks, at)
        if m is None or m[0] <= at or suppressed(as_rule, toks, at, m[0]):
            at += 1
            continue
        marked = [c for c, e in zip(m[1], rule.pattern, strict=True) if e.marked and c] or [c for c in m[1] if c]
        hits += [k for a, b in marked for k in range(a, b)]
        at = m[0]
    for k in hits:
        act(rule.action, toks[k])


def disambiguate(sentences: DataFrame, rules: list[TagRule]) -> DataFrame:
    """sentences: doc_id, sent, toks (array of tok, text, tags, lemmas, spaced, s, e). Each rule sees what the rules
    before it changed, so a sentence is worked through in one place (DIS-1)."""
    ready = [r for r, (ok, _) in zip(rules, prepare([Rule(r.id, r.pattern, (("x",),), antipatterns=r.antipatterns) for r in rules]), strict=True) if ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for toks in batch.column("toks").to_pylist():
                for rule in ready:
                    apply_rule(rule, toks)
                out.append(toks)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sent"), pa.array(out, batch.schema.field("toks").type)], ["doc_id", "sent", "toks"])

    return sentences.select("doc_id", "sent", "toks").mapInArrow(run, sentences.select("doc_id", "sent", "toks").schema)


def disambiguated(toks: DataFrame, rules: list[TagRule], runs: bool = False) -> DataFrame:
    """Analysed tokens with the tags and lemmas that the rules leave (DIS-1); a sentence is one row meanwhile. With runs,
    toks are rows of rules.window_tokens, and a run within a sentence is one: no other tokens lie in a rule's reach."""
    rest = [c for c in toks.columns if c not in ("doc_id", "sent", "run" if runs else "tok", "tok", "text", "tags", "lemmas", "spaced", "s", "e")]
    one = F.struct("tok", "text", "tags", "lemmas", "spaced", "s", "e", *rest)
    by = toks.groupBy("doc_id", "sent", *(["run"] if runs else [])).agg(F.array_sort(F.collect_list(one)).alias("toks"))
    return disambiguate(by, rules).select("doc_id", "sent", F.inline("toks")).select(*(c for c in toks.columns if not runs or c != "run"))
