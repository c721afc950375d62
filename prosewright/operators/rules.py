"""Layer 2: the rule language, its compilation to columns, and a matcher for rules of variable length.

A rule is a sequence of elements. Rules that can lie over the following tokens in few ways compile to columns; all
others, and packs of very many rules, run in the matcher, per document. Rules that ask for no tags or lemmas need no
analysis: they run where texts are cut into tokens. All give the same hits, whose first per (span, id) in the order
(start token, general before literal, rule number) stays. Rules over the whole text come last.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosewright.functions.text import apply_case, ascii_fold, distinct_nonempty
from prosewright.operators import tokenizer

UNBOUNDED = 64
#: Of a rule in columns: the ways it can lie, and the tokens it spans. Rules in one projection, and in columns at all.
MOST_WAYS, MOST_TOKENS, AT_ONCE, IN_COLUMNS = 24, 16, 40, 200
#: The start of hits by rules over the text, which come after all others.
TEXT_START = 1 << 62


@dataclass(frozen=True)
class Test:
    """Conditions on one token: text and tag, each literal or an anchored regex (PRD-2 to PRD-6)."""

    text: str | None = None
    regexp: bool = False
    tag: str | None = None
    tag_regexp: bool = False
    negate: bool = False
    inflected: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class Token:
    """One element: a test, its exceptions on the same token (PRD-7), spacing (PRD-8), repetition and gap (PAT-5)."""

    test: Test = Test()
    exceptions: tuple[Test, ...] = ()
    spaced: bool | None = None
    min: int | None = None
    max: int | None = None
    skip: int | None = None
    marked: bool = False

    @property
    def bounds(self) -> tuple[int, int, int]:
        least = 1 if self.min is None else self.min
        most = least if self.max is None else UNBOUNDED if self.max < 0 else self.max
        gap = 0 if self.skip is None else UNBOUNDED if self.skip < 0 else self.skip
        return min(least, UNBOUNDED), max(min(most, UNBOUNDED), max(least, 1) if self.max is None else least), min(gap, UNBOUNDED)


@dataclass(frozen=True)
class Group:
    """Any or all of several tokens at one position; their own repetition is ignored (PRD-9)."""

    kind: str
    tokens: tuple[Token, ...]
    marked: bool = False
    bounds = (1, 1, 0)


@dataclass(frozen=True)
class Ref:
    """The surface of a pattern element (1-based), with an optional regex replacement and then a case (PRJ-3, PRJ-4)."""

    no: int
    case: str = "keep"
    match: str | None = None
    put: str = ""


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: tuple[Token | Group, ...]
    suggestions: tuple[tuple[str | Ref, ...], ...]
    message: str = ""
    antipatterns: tuple[tuple[Token | Group, ...], ...] = field(default=())


# the dialect (PAT-8)


def accepted(pattern: str) -> bool:
    """Whether a pattern stays within the regular dialect: no look-around, back-reference, atomic or possessive part."""
    bare = re.sub(r"\\\\|\\[pPx]\{\^?\w+\}|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+", bare):
        return False
    try:
        regex.compile(pattern)
    except regex.error:
        return False
    return True


def tests_of(e: Token | Group) -> Iterator[Test]:
    for t in e.tokens if isinstance(e, Group) else (e,):
        yield t.test
        yield from t.exceptions


def compilable(t: Test) -> bool:
    return (not t.regexp or t.text is None or accepted(t.text)) and (not t.tag_regexp or t.tag is None or accepted(t.tag))


def prepare(rules: list[Rule]) -> list[tuple[Rule | None, str]]:
    """Each rule as it can run, with the reason where it can't: bad exceptions and antipatterns drop out alone."""
    out: list[tuple[Rule | None, str]] = []
    for rule in rules:
        def own(e: Token | Group) -> Token | Group:
            if isinstance(e, Group):
                return replace(e, tokens=tuple(own(t) for t in e.tokens))
            return replace(e, exceptions=tuple(x for x in e.exceptions if compilable(x)))

        pattern = tuple(map(own, rule.pattern))
        anti = tuple(tuple(map(own, p)) for p in rule.antipatterns if all(compilable(t.test) for e in p for t in (e.tokens if isinstance(e, Group) else (e,))))
        kept = tuple(s for s in rule.suggestions if s and all(not isinstance(p, Ref) or (1 <= p.no <= len(pattern) and (p.match is None or accepted(p.match))) for p in s))
        if not pattern:
            out.append((None, "empty pattern"))
        elif not all(compilable(t.test) for e in pattern for t in (e.tokens if isinstance(e, Group) else (e,))):
            out.append((None, "regex outside the dialect"))
        elif not kept:
            out.append((None, "no suggestion to render"))
        else:
            out.append((replace(rule, pattern=pattern, antipatterns=anti, suggestions=kept), ""))
    return out


def fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def first_literal(rule: Rule) -> str | None:
    """The folded literal that the first element asks for, if it is a plain one (PAT-3)."""
    e = rule.pattern[0]
    t = e.test if isinstance(e, Token) else None
    if t is None or t.text is None or t.regexp or t.tag is not None or t.negate or t.inflected:
        return None
    return fold(t.text)


# columns


def java(pattern: str, folded: bool) -> str:
    return rf"(?{'iu' if folded else ''}U)\A(?:{pattern})\z"


def test_column(t: Test, tok: Column) -> Column:
    ok = F.lit(True)
    if t.text is not None:
        if t.regexp:
            ok = tok["text"].rlike(java(t.text, not t.case_sensitive))
        else:
            want = F.lit(t.text if t.case_sensitive else fold(t.text))
            same = lambda x: (x if t.case_sensitive else ascii_fold(x)) == want
            ok = F.exists(tok["lemmas"], same) if t.inflected else (tok["text"] if t.case_sensitive else tok["fold"]) == want
    if t.tag is not None:
        ok = ok & (F.exists(tok["tags"], lambda x: x.rlike(java(t.tag, False))) if t.tag_regexp else F.array_contains(tok["tags"], t.tag))
    return ~ok if t.negate else ok


def element_column(e: Token | Group, tok: Column) -> Column:
    if isinstance(e, Group):
        parts = [element_column(t, tok) for t in e.tokens]
        return reduce((lambda a, b: a | b) if e.kind == "or" else (lambda a, b: a & b), parts)
    ok = test_column(e.test, tok)
    for x in e.exceptions:
        ok = ok & ~test_column(x, tok)
    if e.spaced is not None:
        ok = ok & (tok["spaced"] == F.lit(e.spaced))
    return ok


def render(parts: tuple[str | Ref, ...], surface) -> Column:
    """Null as soon as a referred element is missing (PRJ-1)."""
    cols = []
    for p in parts:
        if isinstance(p, str):
            cols.append(F.lit(p))
        else:
            x = surface(p.no)
            cols.append(apply_case(F.regexp_replace(x, F.lit(p.match), F.lit(p.put)) if p.match is not None else x, p.case))
    return F.concat(*cols)


def render_message(message: str, n: int, surface) -> Column:
    r"""\N becomes the surface of element N; other numbers stay as they are (PRJ-6)."""
    parts = [surface(int(p[1:])) if re.fullmatch(r"\\\d+", p) and 1 <= int(p[1:]) <= n else F.lit(p) for p in re.split(r"(\\\d+)", message) if p]
    return F.concat(*parts) if parts else F.lit("")


def ways(pattern: tuple) -> list[list[tuple[int, int] | None]] | None:
    """All ways in which a pattern of bounded repetitions and gaps can lie over the following tokens, in the order of the
    matcher's preference: of each element its (start, stop), or None where it is left out. None if there are too many."""
    out: list[list[tuple[int, int] | None]] = []

    def lay(k: int, at: int, so_far: list) -> bool:
        if k == len(pattern):
            out.append(so_far)
            return len(out) <= MOST_WAYS and at <= MOST_TOKENS
        least, most, gap = pattern[k].bounds
        if most == UNBOUNDED or gap == UNBOUNDED:
            return False
        last = k + 1 == len(pattern)
        return all(lay(k + 1, at + c + g, [*so_far, (at, at + c) if c else None]) for c in range(least, most + 1) for g in range(1 if last else gap + 1))

    # a match of no tokens ends the search without a hit, which columns don't say
    return out if pattern[0].bounds[0] > 0 and lay(0, 0, []) else None


def in_columns(rule: Rule) -> bool:
    return all(e.bounds == (1, 1, 0) for p in rule.antipatterns for e in p) and ways(rule.pattern) is not None


def hits_by_columns(toks: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Hits of rules for which in_columns holds, in the columns of HIT: each rule is one expression over a token and those
    that follow. toks has text, fold, tags, lemmas, spaced, s, e, gap and tok. Antipatterns are flags of their first
    tokens, looked for around a match by windows over the same rows."""
    laid = {number: ways(rule.pattern) for number, rule in rules}
    longest = max([w[-1][1] if w[-1] else max(x[1] for x in w if x) for ws in laid.values() for w in ws] + [len(p) for _, r in rules for p in r.antipatterns], default=1)
    by = W.partitionBy("doc_id").orderBy("tok")
    one = F.struct("text", "fold", "tags", "lemmas", "spaced", "s", "e", "gap")
    ahead = [F.lead(one, i).over(by).alias(f"t{i}") if i else one.alias("t0") for i in range(longest)]
    rows = toks.select("doc_id", "tok", *ahead)
    flags = {}
    for number, rule in rules:
        for j, p in enumerate(rule.antipatterns):
            ok = reduce(lambda a, b: a & b, (element_column(e, F.col(f"t{i}")) for i, e in enumerate(p)))
            flags[f"a{number}_{j}"] = F.coalesce(ok, F.lit(False))
    rows = rows.withColumns(flags) if flags else rows

    def surface(span: tuple[int, int]) -> Column:
        a, b = span
        return F.concat(F.col(f"t{a}")["text"], *(x for i in range(a + 1, b) for x in (F.col(f"t{i}")["gap"], F.col(f"t{i}")["text"])))

    around = {}
    found = []
    for number, rule in rules:
        cases = None
        for way in laid[number]:
            stop = max(x[1] for x in way if x)
            ok = reduce(lambda a, b: a & b, (element_column(e, F.col(f"t{i}")) for e, x in zip(rule.pattern, way, strict=True) if x for i in range(*x)))
            marked = [x for x, e in zip(way, rule.pattern, strict=True) if e.marked and x]
            if marked or not any(e.marked for e in rule.pattern):
                a, b = (min(x[0] for x in marked), max(x[1] for x in marked)) if marked else (0, stop)
                part = lambda k, way=way: surface(way[k - 1]) if way[k - 1] else F.lit(None).cast("string")
                named = lambda k, way=way: surface(way[k - 1]) if way[k - 1] else F.lit(f"\\{k}")
                hit = F.struct(
                    F.lit(number).alias("rule"), F.lit(stop).alias("n"), F.lit(0 if first_literal(rule) is None else 1).alias("literal"), F.lit(rule.id).alias("id"),
                    F.col(f"t{a}")["s"].alias("s"), F.col(f"t{b - 1}")["e"].alias("e"), render_message(rule.message, len(way), named).alias("message"),
                    distinct_nonempty(F.array(*(render(p, part) for p in rule.suggestions))).alias("suggestions"), surface((a, b)).alias("surface"),
                )
                for j, p in enumerate(rule.antipatterns):
                    name = f"w{number}_{j}_{stop}"
                    around[name] = F.max(f"a{number}_{j}").over(by.rowsBetween(1 - len(p), stop - 1))
                    hit = F.when(~F.col(name), hit)
            else:
                hit = F.lit(None)
            ok = F.coalesce(ok, F.lit(False))
            cases = F.when(ok, hit) if cases is None else cases.when(ok, hit)
        found.append(cases)
    rows = rows.withColumns(around) if around else rows
    hits = rows.select("doc_id", "tok", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("h"))
    return hits.select("doc_id", F.col("tok").alias("start"), (F.col("tok") + F.col("h.n")).alias("stop"), "h.rule", "h.literal", "h.id", "h.s", "h.e", "h.message", "h.suggestions", "h.surface").filter(F.size("suggestions") > 0)


def first_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each (span, id) in push order (PAT-2, WIN-7): token rules by start, general before literal ones,
    then rules over the text. In the columns of diagnostics, with start."""
    order = W.partitionBy("doc_id", "s", "e", "id").orderBy("start", "literal", "rule")
    kept = hits.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    more = [c for c in hits.columns if c == "sent"]
    return kept.select("doc_id", "s", "e", F.col("id").alias("code"), "message", "suggestions", F.lit("Grammar").alias("source"), "surface", "start", *more)


# the matcher


@lru_cache(maxsize=10_000)
def _regex(pattern: str, folded: bool):
    return regex.compile(pattern, regex.IGNORECASE if folded else 0)


def test_token(t: Test, tok: dict) -> bool:
    ok = True
    if t.text is not None:
        if t.regexp:
            ok = _regex(t.text, not t.case_sensitive).fullmatch(tok["text"]) is not None
        else:
            own = (lambda s: s) if t.case_sensitive else fold
            ok = own(t.text) in map(own, tok["lemmas"] if t.inflected else [tok["text"]])
    if ok and t.tag is not None:
        ok = any(_regex(t.tag, False).fullmatch(x) for x in tok["tags"]) if t.tag_regexp else t.tag in tok["tags"]
    return ok != t.negate


def element_token(e: Token | Group, tok: dict) -> bool:
    if isinstance(e, Group):
        return (any if e.kind == "or" else all)(element_token(t, tok) for t in e.tokens)
    return test_token(e.test, tok) and not any(test_token(x, tok) for x in e.exceptions) and (e.spaced is None or e.spaced == tok["spaced"])


def match_at(pattern: tuple, toks: list[dict], start: int) -> tuple[int, list[tuple[int, int] | None]] | None:
    """The end and the captures of the first match in lazy order: fewest repetitions, then the shortest gap (PAT-1).
    Whether the rest of a pattern matches from a place doesn't hang on what came before, so failures are remembered."""
    failed: set[tuple[int, int]] = set()
    caught: list[tuple[int, int] | None] = [None] * len(pattern)

    def go(k: int, at: int) -> int | None:
        if k == len(pattern):
            return at
        if (k, at) in failed:
            return None
        least, most, gap = pattern[k].bounds
        for c in range(min(most, len(toks) - at) + 1):
            if c and not element_token(pattern[k], toks[at + c - 1]):
                break
            if c >= least:
                for g in range(min(gap, len(toks) - at - c) + 1):
                    if (end := go(k + 1, at + c + g)) is not None:
                        caught[k] = (at, at + c) if c else None
                        return end
        failed.add((k, at))
        return None

    end = go(0, start)
    return None if end is None else (end, caught)


def spans_of(pattern: tuple, toks: list[dict]) -> list[tuple[int, int]]:
    """All matches of an antipattern, one from each place."""
    return [(k, m[0]) for k in range(len(toks)) if (m := match_at(pattern, toks, k)) and m[0] > k]


def suppressed(rule: Rule, toks: list[dict], start: int, end: int, seen: dict | None = None) -> bool:
    """Whether an antipattern overlaps [start, end) (PAT-4). seen holds a document's matches by antipattern, found once."""
    seen = {} if seen is None else seen
    for p in rule.antipatterns:
        if id(p) not in seen:
            seen[id(p)] = spans_of(p, toks)
        if any(k < end and start < stop for k, stop in seen[id(p)]):
            return True
    return False


def surface_of(caught, no: int, toks: list[dict], raw: bytes) -> str | None:
    if not 1 <= no <= len(caught) or caught[no - 1] is None:
        return None
    a, b = caught[no - 1]
    return raw[toks[a]["s"] : toks[b - 1]["e"]].decode("utf-8", "replace")


def cased(x: str, case: str) -> str:
    return {"keep": x, "upper": x.upper(), "lower": x.lower(), "start_upper": x[:1].upper() + x[1:]}[case]


def hit_at(number: int, rule: Rule, toks: list[dict], raw: bytes, start: int, seen: dict) -> dict | None:
    m = match_at(rule.pattern, toks, start)
    if m is None:
        return None
    end, caught = m
    if suppressed(rule, toks, start, end, seen):
        return None
    spans = [c for c, e in zip(caught, rule.pattern, strict=True) if e.marked and c]
    if any(e.marked for e in rule.pattern) and not spans:
        return None
    a, b = (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else (start, end)
    if a >= b:
        return None

    def surface(no: int) -> str | None:
        return surface_of(caught, no, toks, raw)

    out = []
    for parts in rule.suggestions:
        texts = []
        for p in parts:
            x = p if isinstance(p, str) else surface(p.no)
            if isinstance(p, Ref) and x is not None:
                x = cased(_regex(p.match, False).sub(p.put.replace("$", "\\"), x) if p.match is not None else x, p.case)
            texts.append(x)
        if None not in texts and (t := "".join(texts)) and t not in out:
            out.append(t)
    if not out:
        return None
    message = re.sub(r"\\(\d+)", lambda g: g[0] if (x := surface(int(g[1]))) is None else x, rule.message)
    return {"start": start, "stop": end, "rule": number, "literal": 0 if first_literal(rule) is None else 1, "id": rule.id, "s": toks[a]["s"], "e": toks[b - 1]["e"], "message": message, "suggestions": out, "surface": raw[toks[a]["s"] : toks[b - 1]["e"]].decode("utf-8", "replace")}


def by_text(e: Token | Group) -> bool:
    """Whether an element asks for nothing but a token's text."""
    return all(t.tag is None and not t.inflected for t in tests_of(e)) and all(t.spaced is None for t in (e.tokens if isinstance(e, Group) else (e,)))


class Index:
    """Which rules can begin at a token (PAT-3): those with its word as first literal and, of the others, those whose
    first element accepts it. That depends on the token's text alone or on its text, tags, lemmas and spacing; what was
    found is kept for the texts, and the kinds of tokens, met last."""

    def __init__(self, rules: list[tuple[int, Rule]]):
        self.by_word: dict[str, list[tuple[int, Rule]]] = {}
        self.texts, self.kinds = [], []
        for number, rule in rules:
            word = first_literal(rule)
            first = rule.pattern[0]
            (self.by_word.setdefault(word, []) if word is not None else self.texts if first.bounds[0] and by_text(first) else self.kinds).append((number, rule))
        self.kept: dict[object, list[tuple[int, Rule]]] = {}
        # most first elements are one regex over the text: those are tried without the detour of a test
        plain = lambda e: isinstance(e, Token) and not e.exceptions and e.test.regexp and e.test.text is not None and not e.test.negate
        self.plain = [(_regex(r.pattern[0].test.text, not r.pattern[0].test.case_sensitive).fullmatch, (n, r)) for n, r in self.texts if plain(r.pattern[0])]
        # most words fit none of them, which one alternation tells
        self.any = [_regex("|".join(f"(?:{t.text})" for t in some), folded) for folded in (True, False) if (some := [r.pattern[0].test for _, r in self.texts if plain(r.pattern[0]) and r.pattern[0].test.case_sensitive != folded])]
        self.texts = [(n, r) for n, r in self.texts if not plain(r.pattern[0])]

    def found(self, key: object, rules: list[tuple[int, Rule]], tok: dict) -> list[tuple[int, Rule]]:
        got = self.kept.get(key)
        if got is None:
            got = [(n, r) for n, r in rules if not r.pattern[0].bounds[0] or element_token(r.pattern[0], tok)]
            if len(self.kept) >= 100_000:
                self.kept.clear()
            self.kept[key] = got
        return got

    def rules_at(self, tok: dict) -> list[tuple[int, Rule]]:
        text = tok["text"]
        general = self.kept.get(text)
        if general is None:
            general = self.found(text, self.texts, tok)
            if any(x.fullmatch(text) for x in self.any):
                general += [x for match, x in self.plain if match(text)]
            general.sort(key=lambda x: x[0])
        if self.kinds:
            general = sorted(general + self.found((tok["text"], tuple(tok["tags"]), tuple(tok["lemmas"]), tok["spaced"]), self.kinds, tok), key=lambda x: x[0])
        return general + self.by_word.get(fold(tok["text"]), [])


def match_document(index: Index, toks: list[dict], text: str) -> list[dict]:
    """All hits of a document, in push order."""
    raw, seen = text.encode("utf-8", "surrogatepass"), {}
    return [hit for start, tok in enumerate(toks) for number, rule in index.rules_at(tok) if (hit := hit_at(number, rule, toks, raw, start, seen))]


HIT = "start bigint, stop bigint, rule int, literal int, id string, s bigint, e bigint, message string, suggestions array<string>, surface string"


def gathered(toks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text, toks (in order). A document's tokens come from its own row, so no group is
    larger than one text."""
    one = F.struct("tok", "text", "tags", "lemmas", "spaced", "s", "e")
    return toks.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("toks")).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")


def rows_of_hits(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"doc_id": kind, "rule": pa.int32(), "literal": pa.int32(), "id": pa.string(), "message": pa.string(), "suggestions": pa.list_(pa.string()), "surface": pa.string()}
    names = ["doc_id", *(x.split(" ")[0] for x in HIT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names], names)


def hits_by_matcher(toks: DataFrame, docs: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """The same hits for rules of any form and number, by the matcher on whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            for at in range(batch.num_rows):  # as Python objects, one document at a time
                doc, toks, whole = (batch.column(c)[at].as_py() for c in ("doc_id", "toks", "whole"))
                rows = [{"doc_id": doc} | h for h in match_document(index, toks, whole)]
                if rows:
                    yield rows_of_hits(rows, batch.schema.field("doc_id").type)

    return gathered(toks, docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {HIT}")


def parts_of(toks: DataFrame, docs: DataFrame, ready: list[tuple[int, Rule]]) -> list[DataFrame]:
    """The hits of prepared rules, by columns and by the matcher."""
    flat = [x for x in ready if in_columns(x[1])] if len(ready) <= IN_COLUMNS else []
    free = [x for x in ready if x not in flat]
    return [hits_by_columns(toks, flat[k : k + AT_ONCE]) for k in range(0, len(flat), AT_ONCE)] + ([hits_by_matcher(toks, docs, free)] if free else [])


def hits(toks: DataFrame, docs: DataFrame, rules: list[Rule | TextRule]) -> DataFrame:
    """Hits of all rules that can run: by columns where few rules lie in few ways, by the matcher else, and those of rules
    over the text."""
    tokened = [(k, r) for k, r in enumerate(rules) if isinstance(r, Rule)]
    ready = [(k, got) for (k, _), (got, _) in zip(tokened, prepare([r for _, r in tokened]), strict=True) if got]
    parts = parts_of(toks, docs, ready)
    over = [(k, r) for k, r in enumerate(rules) if isinstance(r, TextRule)]
    parts += [text_hits(docs, over)] if over else []
    names = ["doc_id", *(x.split(" ")[0] for x in HIT.split(", "))]
    return reduce(lambda a, b: a.unionByName(b), (x.select(names) for x in parts))


# rules that need no analysis


def of_text(rule: Rule) -> bool:
    """Whether a rule and its antipatterns ask for nothing but texts and spacing of tokens."""
    return all(t.tag is None and not t.inflected for p in (rule.pattern, *rule.antipatterns) for e in p for t in tests_of(e))


def accepting(e: Token | Group, texts: pa.Array) -> np.ndarray:
    """Which of the distinct texts an element accepts, spacing aside."""
    if isinstance(e, Token) and not e.exceptions and e.test.text is not None and not (e.test.regexp or e.test.negate or e.test.case_sensitive):
        return pc.equal(pc.ascii_lower(texts), fold(e.test.text)).to_numpy(zero_copy_only=False)
    if e == Token():
        return np.ones(len(texts), bool)
    loose = replace(e, tokens=tuple(replace(t, spaced=None) for t in e.tokens)) if isinstance(e, Group) else replace(e, spaced=None)
    return np.fromiter((element_token(loose, {"text": t, "tags": [], "lemmas": [], "spaced": None}) for t in texts.to_pylist()), bool, len(texts))


def hits_in_texts(docs: DataFrame, rules: list[tuple[int, Rule]], breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """Hits of rules for which of_text holds, in the columns of HIT and sent, the sentence of the span's first token. A
    document is a row, so nothing shuffles: where a rule can lie is looked for in arrays over the distinct texts of
    tokens, and the matcher decides there."""
    fixed = {number: all(e.bounds == (1, 1, 0) for e in rule.pattern) for number, rule in rules}

    def places(rule: Rule, whole: bool, texts: pa.Array, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Tokens at which a rule may begin; as in Index, its first literal decides where it has one."""
        if (word := first_literal(rule)) is not None:
            ok = pc.equal(pc.ascii_lower(texts), word).to_numpy(zero_copy_only=False)[codes]
        else:
            ok = accepting(rule.pattern[0], texts)[codes] if rule.pattern[0].bounds[0] else np.ones(len(codes), bool)
        for k, e in enumerate(rule.pattern[1:] if whole else (), 1):
            if not ok.any():
                break
            ok[-k:] = False
            ok[:-k] &= accepting(e, texts)[codes[k:]] & (owner[k:] == owner[:-k])
        return np.flatnonzero(ok)

    def found(tiles: tokenizer.Tiles) -> Iterator[tuple[int, dict]]:
        owner, cols = tiles.tokens(True)
        if not len(owner):
            return
        coded = cols["text"].dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        start, stop, sent, spaced = (cols[c].to_numpy(zero_copy_only=False) for c in ("s", "e", "sent", "spaced"))
        words = coded.dictionary.to_pylist()
        first = np.searchsorted(owner, np.arange(len(tiles.doc)))

        def toks(a: int, b: int) -> list[dict]:
            return [{"text": words[codes[k]], "tags": [], "lemmas": [], "spaced": bool(spaced[k]), "s": int(start[k]), "e": int(stop[k]), "sent": int(sent[k])} for k in range(a, b)]

        own: dict[int, tuple[bytes, list[dict], dict]] = {}
        for number, rule in rules:
            at = places(rule, fixed[number], coded.dictionary, codes, owner)
            for k in at:
                d = int(owner[k])
                if fixed[number] and not rule.antipatterns:
                    raw, some, base, seen = tiles.raw[tiles.byte[tiles.doc[d]] + start[k] : tiles.byte[tiles.doc[d]] + stop[k + len(rule.pattern) - 1]], toks(k, k + len(rule.pattern)), int(k), {}
                    shift = some[0]["s"]
                    some = [t | {"s": t["s"] - shift, "e": t["e"] - shift} for t in some]
                else:
                    if d not in own:
                        own[d] = (tiles.raw[tiles.byte[tiles.doc[d]] : tiles.byte[tiles.doc[d + 1]]], toks(first[d], first[d + 1]), {})
                    (raw, some, seen), base, shift = own[d], int(first[d]), 0
                hit = hit_at(number, rule, some, raw, int(k) - base, seen)
                if hit:
                    head = next(t for t in some if t["s"] == hit["s"])
                    ahead = base - int(first[d])
                    yield d, hit | {"start": hit["start"] + ahead, "stop": hit["stop"] + ahead, "s": hit["s"] + shift, "e": hit["e"] + shift, "sent": head["sent"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for a, b in tokenizer.groups(texts):
                rows = list(found(tokenizer.Tiles(texts.slice(a, b - a), langs.slice(a, b - a).to_pylist(), breaks, elide=True)))
                if rows:
                    ids = batch.column("doc_id").take(pa.array([a + d for d, _ in rows])).to_pylist()
                    made = rows_of_hits([{"doc_id": i} | h for i, (_, h) in zip(ids, rows, strict=True)], batch.schema.field("doc_id").type)
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array([h["sent"] for _, h in rows], pa.int64())], [*made.schema.names, "sent"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit("en")
    return docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {HIT}, sent bigint")


# rules that need tags at few places


def loosened(e: Token | Group) -> Token | Group:
    """An element that accepts whatever e may accept by its text alone."""
    if isinstance(e, Group):
        return replace(e, tokens=tuple(map(loosened, e.tokens)))
    t = e.test
    return Token() if t.text is None or t.negate or t.inflected else Token(Test(t.text, t.regexp, case_sensitive=t.case_sensitive))


def windowed(pattern: tuple, antipatterns: tuple) -> bool:
    """Whether a rule lies over as many tokens as it has elements, so that its windows hold all that it looks at."""
    return not antipatterns and all(e.bounds == (1, 1, 0) for e in pattern)


def window_tokens(docs: DataFrame, patterns: list[tuple], breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """Those rows of analysis.full_tokens over which one of the patterns of windowed rules may lie, by their texts, with
    run: the first token of consecutive ones. Nothing shuffles; what is analysed afterwards are these rows."""
    if not all(windowed(p, ()) for p in patterns):
        raise ValueError("a pattern of variable length has no windows")
    wide = [(k, Rule("", tuple(map(loosened, p)), (("x",),))) for k, p in enumerate(patterns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, starting = Index(wide), {}
        bare = lambda t: {"text": t, "tags": [], "lemmas": [], "spaced": None}
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for a, b in tokenizer.groups(texts):
                owner, cols = tokenizer.Tiles(texts.slice(a, b - a), langs.slice(a, b - a).to_pylist(), breaks, elide=True).tokens(True)
                coded = cols["text"].dictionary_encode()
                words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                inside = np.zeros(len(codes) + 1, bool)
                for p in (rule.pattern for _, rule in wide) if len(wide) <= AT_ONCE and len(codes) else ():
                    ok = np.ones(len(codes), bool)
                    for k, e in enumerate(p):
                        ok[len(ok) - k :] = False
                        ok[: len(ok) - k] &= accepting(e, coded.dictionary)[codes[k:]] & (owner[k:] == owner[: len(owner) - k])
                    for k in range(len(p)):
                        inside[np.flatnonzero(ok) + k] = True
                if len(wide) > AT_ONCE:
                    starting = starting if len(starting) <= 100_000 else {}
                    starting |= {w: index.rules_at(bare(w)) for w in words if w not in starting}
                    some = np.fromiter((bool(starting[w]) for w in words), bool, len(words))
                    for k in np.flatnonzero(some[codes]) if len(codes) else ():
                        for _, rule in starting[words[codes[k]]]:
                            n = len(rule.pattern)
                            if k + n <= len(codes) and owner[k + n - 1] == owner[k] and all(element_token(rule.pattern[j], bare(words[codes[k + j]])) for j in range(1, n)):
                                inside[k : k + n] = True
                which = np.flatnonzero(inside)
                if not len(which):
                    continue
                new = np.append(True, (np.diff(which) > 1) | (np.diff(owner[which]) > 0))
                tok = cols["tok"].to_numpy(zero_copy_only=False)[which]
                first = tok[np.maximum.accumulate(np.where(new, np.arange(len(which)), 0))]
                at = pa.array(owner[which] + a)
                fixed = {"doc_id": batch.column("doc_id").take(at), "lang": langs.take(at), "run": pa.array(first)}
                yield pa.RecordBatch.from_arrays([fixed[c] if c in fixed else cols[c].take(pa.array(which)) for c in (*WINDOW, "run")], [*WINDOW, "run"])

    kind = dict(docs.dtypes)["doc_id"]
    kinds = {"doc_id": kind, "lang": "string", "text": "string", "gap": "string", "spaced": "boolean", "last": "boolean", "sentinel": "boolean"}
    lang = F.col("lang") if "lang" in docs.columns else F.lit("en")
    return docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in (*WINDOW, "run")))


WINDOW = ("doc_id", "lang", "sent", "tok", "text", "s", "e", "spaced", "last", "sentinel", "gap")


def hits_in_windows(toks: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Hits of windowed rules on the analysed rows of window_tokens, in the columns of HIT. A row in the matcher is a run
    of tokens, so neither side holds a document's."""
    if not all(windowed(r.pattern, r.antipatterns) for _, r in rules):
        raise ValueError("rules of variable length or with antipatterns need whole documents")
    one = F.struct("tok", "text", "tags", "lemmas", "spaced", "s", "e", "gap")
    rows = toks.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(one)).alias("toks"))

    def found(index: Index, toks: list[dict]) -> Iterator[dict]:
        base, shift = toks[0]["tok"], toks[0]["s"]
        text = "".join((t["gap"] if k else "") + t["text"] for k, t in enumerate(toks))
        for h in match_document(index, [t | {"s": t["s"] - shift, "e": t["e"] - shift} for t in toks], text):
            yield h | {"start": h["start"] + base, "stop": h["stop"] + base, "s": h["s"] + shift, "e": h["e"] + shift}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [{"doc_id": d} | h for d, ts in zip(part.column("doc_id").to_pylist(), part.column("toks").to_pylist(), strict=True) for h in found(index, ts)]
                if out:
                    yield rows_of_hits(out, batch.schema.field("doc_id").type)

    return rows.select("doc_id", "toks").mapInArrow(run, f"doc_id {dict(toks.dtypes)['doc_id']}, {HIT}")


def hits_over(docs: DataFrame, rules: list[Rule | TextRule], analyzed: Callable[[], DataFrame], breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """The hits of hits() over documents cut by the tokenizer: rules for which of_text holds run in the texts, and the
    analysis is made only if there are others. With sent where no others are."""
    ready = [(k, got) for k, r in enumerate(rules) if isinstance(r, Rule) for got, _ in prepare([r]) if got]
    plain = [(k, r) for k, r in ready if of_text(r)]
    if len(plain) == len(rules):
        return hits_in_texts(docs, plain, breaks)
    names = ["doc_id", *(x.split(" ")[0] for x in HIT.split(", "))]
    rest = {k for k, r in enumerate(rules)} - {k for k, _ in plain}
    parts = [hits_in_texts(docs, plain, breaks).select(names)] if plain else []
    tokened = [(k, r) for k, r in ready if k in rest]
    parts += parts_of(analyzed(), docs, tokened) if tokened else []
    over = [(k, r) for k, r in enumerate(rules) if isinstance(r, TextRule)]
    parts += [text_hits(docs, over)] if over or not parts else []
    return reduce(lambda a, b: a.unionByName(b), (x.select(names) for x in parts))


# rules over the whole text (PAT-7)


@dataclass(frozen=True)
class TextRule:
    id: str
    pattern: str
    suggestions: tuple[tuple[str | Ref, ...], ...]
    message: str = ""
    mark: int = 0
    case_sensitive: bool = False


def text_hits(docs: DataFrame, rules: list[tuple[int, TextRule]]) -> DataFrame:
    """One hit per non-overlapping match, in the order of rules and matches, in the columns of HIT: start orders them
    behind all token hits. A mark that takes no part in a match is the whole match. Needs match positions, which column
    functions do not give."""
    ready = [(k, r) for k, r in rules if accepted(r.pattern)]

    def group(m, no: int) -> str | None:
        return m.group(no) if no <= m.re.groups else None

    def made(m, parts: tuple) -> str | None:
        out = []
        for p in parts:
            x = p if isinstance(p, str) else group(m, p.no)
            if x is None:
                return None
            out.append(x if isinstance(p, str) else cased(_regex(p.match, False).sub(p.put.replace("$", "\\"), x) if p.match is not None else x, p.case))
        return "".join(out)

    def found(doc, text: str) -> Iterator[dict]:
        for k, rule in ready:
            for m in _regex(rule.pattern, not rule.case_sensitive).finditer(text):
                fixes = list(dict.fromkeys(t for parts in rule.suggestions if (t := made(m, parts))))
                if fixes:
                    mark = rule.mark if rule.mark <= m.re.groups and m.start(rule.mark) >= 0 else 0
                    a, b = m.span(mark)
                    s, message = len(text[:a].encode("utf-8", "surrogatepass")), re.sub(r"\\(\d+)", lambda g, m=m: g[0] if (x := group(m, int(g[1]))) is None else x, rule.message)
                    e = s + len(text[a:b].encode("utf-8", "surrogatepass"))
                    yield {"doc_id": doc, "start": TEXT_START, "stop": TEXT_START, "rule": k, "literal": 0, "id": rule.id, "s": s, "e": e, "message": message, "suggestions": fixes, "surface": text[a:b]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [h for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for h in found(doc, text or "")]
            if rows:
                yield rows_of_hits(rows, batch.schema.field("doc_id").type)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {HIT}")


def skip_reasons(rules: list[Rule]) -> list[tuple[str, bool, str]]:
    """(id, supported, reason) of every rule (PRD-12, AGG-6)."""
    return [(rule.id, got is not None, why) for rule, (got, why) in zip(rules, prepare(rules), strict=True)]


