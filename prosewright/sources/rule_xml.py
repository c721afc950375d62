"""Rule files in XML: grammar rules with examples, disambiguation rules, and segmentation rules (SRC-10 to SRC-12, SRC-19, SRC-21).

Files are a few megabytes of configuration and are read on the driver. What the rule language can't express makes the
rule unsupported, with a reason, and never drops it silently.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path

from prosewright.operators.disambiguation import Action, TagRule
from prosewright.operators.rules import Group, Ref, Rule, Test, TextRule, Token

PASSES = 10
CASES = {None: "keep", "preserve": "keep", "allupper": "upper", "alllower": "lower", "startupper": "start_upper", "startlower": "keep"}


@dataclass
class Parsed:
    rules: list[Rule] = field(default_factory=list)
    text_rules: list[TextRule] = field(default_factory=list)
    unsupported: list[tuple[str, str]] = field(default_factory=list)
    examples: list[dict] = field(default_factory=list)


class Unsupported(Exception):
    pass


def expand_entities(xml: str, folder: Path | None = None) -> str:
    """Replaces declared entities, also in one another and from external files, and drops the declarations (SRC-12)."""
    declared = dict(re.findall(r'<!ENTITY\s+([\w.-]+)\s+"([^"]*)"', xml)) | dict(re.findall(r"<!ENTITY\s+([\w.-]+)\s+'([^']*)'", xml))
    for name, file in re.findall(r'<!ENTITY\s+%?\s*([\w.-]+)\s+SYSTEM\s+"([^"]+)"', xml):
        if folder and (folder / file).is_file():
            content = (folder / file).read_text(encoding="utf-8")
            declared |= dict(re.findall(r'<!ENTITY\s+([\w.-]+)\s+"([^"]*)"', content)) or {name: content}
    body = re.sub(r"<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", "", xml, flags=re.S)
    for _ in range(PASSES):
        grown = re.sub(r"&([\w.-]+);", lambda m: declared.get(m[1], m[0]), body)
        if grown == body:
            break
        body = grown
    return body


def yes(x: str | None) -> bool:
    return (x or "").strip() == "yes"


def number(x: str | None) -> int | None:
    return int(x) if x is not None else None


def own_text(e: ET.Element) -> str | None:
    """Text of an element with what follows its children, trimmed; None when empty."""
    out = ((e.text or "") + "".join(c.tail or "" for c in e)).strip()
    return out or None


def test_of(e: ET.Element, strict: bool) -> Test:
    sensitive = yes(e.get("case_sensitive")) if e.get("case_sensitive") else strict
    return Test(own_text(e), yes(e.get("regexp")), e.get("postag"), yes(e.get("postag_regexp")), yes(e.get("negate")), yes(e.get("inflected")), sensitive)


def token_of(e: ET.Element, strict: bool, marked: bool) -> Token:
    if e.find("match") is not None or e.get("chunk") or e.find("feature") is not None:
        raise Unsupported("token with match, chunk or feature")
    spaced = {"yes": True, "no": False}.get(e.get("spacebefore") or "")
    exceptions = tuple(test_of(x, strict) for x in e.findall("exception"))
    return Token(test_of(e, strict), exceptions, spaced, number(e.get("min")), number(e.get("max")), number(e.get("skip")), marked)


def pattern_of(e: ET.Element, phrases: dict[str, ET.Element], strict: bool = False, marked: bool = False) -> tuple[Token | Group, ...]:
    """The elements of a pattern; the attribute of the pattern for case holds for all its tokens (PRJ-20)."""
    strict = strict or yes(e.get("case_sensitive"))
    out: list[Token | Group] = []
    for c in e:
        if c.tag == "token":
            out.append(token_of(c, strict, marked))
        elif c.tag == "marker":
            out += pattern_of(c, phrases, strict, True)
        elif c.tag in ("or", "and"):
            out.append(Group(c.tag, tuple(token_of(t, strict, False) for t in c.findall("token")), marked))
        elif c.tag == "phraseref":
            if c.get("idref") not in phrases:
                raise Unsupported(f"phrase {c.get('idref')}")
            out += pattern_of(phrases[c.get("idref")], phrases, strict, marked)
        elif isinstance(c.tag, str):
            raise Unsupported(c.tag)
    return tuple(out)


def suggestion_of(e: ET.Element) -> tuple[str | Ref, ...]:
    r"""Text, \N references of one digit, and match elements (PRJ-18)."""
    def parts(s: str | None) -> list[str | Ref]:
        return [Ref(int(p[1])) if re.fullmatch(r"\\\d", p) else p for p in re.split(r"(\\\d)", s or "") if p]

    out = parts(e.text)
    for c in e:
        if c.tag != "match" or c.get("postag") or c.get("include_skipped"):
            raise Unsupported(f"suggestion with {c.tag}")
        out.append(Ref(int(c.get("no", "0")), CASES.get(c.get("case_conversion"), "keep"), c.get("regexp_match"), c.get("regexp_replace") or ""))
        out += parts(c.tail)
    return tuple(out)


def message_of(e: ET.Element | None) -> str:
    if e is None:
        return ""
    return "".join([e.text or "", *("".join(c.itertext()) + (c.tail or "") if c.tag == "suggestion" else rf"\{c.get('no')}" + (c.tail or "") for c in e)])


def examples_of(e: ET.Element, rule_id: str) -> list[dict]:
    """Examples with their marker's byte span; a correction attribute makes them positive."""
    out = []
    for x in e.findall("example"):
        text, span = x.text or "", None
        for c in x:
            start = len(text.encode())
            text += "".join(c.itertext())
            span = (start, len(text.encode())) if c.tag == "marker" else span
            text += c.tail or ""
        out.append({"rule_id": rule_id, "text": text, "marker": span, "corrections": x.get("correction").split("|") if x.get("correction") is not None else []})
    return out


def grammar(xml: str, folder: Path | None = None) -> Parsed:
    """All enabled rules of a grammar file, groups with their antipatterns copied into each rule (PRD-11, PRJ-19)."""
    root, out = ET.fromstring(expand_entities(xml, folder)), Parsed()
    phrases = {p.get("id"): p for p in root.iter("phrase") if p.get("id")}
    off = ("off", "temp_off")

    def add(e: ET.Element, rule_id: str, shared: list[ET.Element]) -> None:
        out.examples.extend(examples_of(e, rule_id))
        try:
            fixes = [suggestion_of(s) for s in [*e.findall("message/suggestion"), *e.findall("suggestion")]]
            message = message_of(e.find("message"))
            if (r := e.find("regexp")) is not None:
                out.text_rules.append(TextRule(rule_id, (r.text or "").strip(), tuple(fixes), message, int(r.get("mark", "0")), yes(r.get("case_sensitive"))))
                return
            anti = tuple(pattern_of(a, phrases) for a in [*shared, *e.findall("antipattern")])
            out.rules.append(Rule(rule_id, pattern_of(e.find("pattern"), phrases), tuple(fixes), message, anti))
        except (Unsupported, TypeError, ValueError) as why:
            out.unsupported.append((rule_id, str(why)))

    for c in root.iter("category"):
        for e in c:
            if e.get("default") in off:
                continue
            if e.tag == "rule":
                add(e, e.get("id") or "", [])
            elif e.tag == "rulegroup":
                for r in e.findall("rule"):
                    if r.get("default") not in off:
                        add(r, r.get("id") or e.get("id") or "", e.findall("antipattern"))
    return out


def disambiguation(xml: str, folder: Path | None = None) -> tuple[list[TagRule], list[tuple[str, str]]]:
    """Disambiguation rules, grouped ones first and then those at the top (PRJ-21), and the unsupported ones."""
    root = ET.fromstring(expand_entities(xml, folder))
    rules, bad = [], []
    rows = [(r, g.get("id") or "", g.findall("antipattern")) for g in root.iter("rulegroup") for r in g.findall("rule")] + [(r, r.get("id") or "", []) for r in root.findall("rule")]
    for e, rule_id, shared in rows:
        d = e.find("disambig")
        try:
            if d is None or d.find("match") is not None:
                raise Unsupported("no action that can be expressed")
            words = d.findall("wd")
            tags = tuple(t for t in (d.get("postag"), *(w.get("pos") for w in words)) if t)
            kind = d.get("action") or "replace"
            if kind not in ("replace", "add", "remove", "filter"):
                raise Unsupported(f"action {kind}")
            action = Action(kind, tags, tuple(w.get("lemma") for w in words if w.get("lemma")), kind in ("remove", "filter") and not words)
            anti = tuple(pattern_of(a, {}) for a in [*shared, *e.findall("antipattern")])
            rules.append(TagRule(e.get("id") or rule_id, pattern_of(e.find("pattern"), {}), action, anti))
        except (Unsupported, TypeError, ValueError) as why:
            bad.append((e.get("id") or rule_id, str(why)))
    return rules, bad


def segmentation(srx: str, lang: str) -> list[tuple[bool, str, str]]:
    """(break, before, after) patterns of the language rules that a language's map names, in order (SRC-21)."""
    root = ET.fromstring(re.sub(r'\sxmlns(?::\w+)?="[^"]*"', "", srx))
    named = {x.get("languagerulename"): x for x in root.iter("languagerule")}
    out = []
    for m in root.iter("languagemap"):
        if re.fullmatch(m.get("languagepattern") or "", lang):
            for r in named[m.get("languagerulename")].findall("rule"):
                out.append((r.get("break") != "no", r.findtext("beforebreak") or "", r.findtext("afterbreak") or ""))
    return out


def literals(rules: list[Rule]) -> set[str]:
    """All literal texts of the rules, to compare with those of the source (JON-19)."""
    tests = [t.test for r in rules for e in r.pattern for t in (e.tokens if isinstance(e, Group) else (e,))]
    return {t.text for t in tests if t.text and not t.regexp}

