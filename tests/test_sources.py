"""Hand-made dictionaries, rule files and count tables."""

import random

import pytest

from prosewright.operators import rules
from prosewright.sources import codec, dictionaries, rule_xml


def fsa5(words):
    """A trie in the fixed-width format: goto width 4, nodes in depth-first order."""
    tree = {}
    for w in words:
        node = tree
        for b in w:
            node = node.setdefault(b, [False, {}])[1]
    for w in words:
        node = tree
        for k, b in enumerate(w):
            if k == len(w) - 1:
                node[b][0] = True
            node = node[b][1]
    nodes, order = {}, []

    def place(node):
        order.append(node)
        for b in sorted(node):
            if node[b][1]:
                place(node[b][1])

    place(tree)
    at = 10  # the dummy node and the arc to the root
    for n in order:
        nodes[id(n)] = at
        at += 5 * len(n)
    out = bytearray(bytes([0]) + (dictionaries.LAST5).to_bytes(4, "little") + b"^" + (nodes[id(tree)] << 3 | dictionaries.LAST5).to_bytes(4, "little"))
    for n in order:
        for k, b in enumerate(sorted(n)):
            final, child = n[b]
            flags = dictionaries.FINAL5 * final | dictionaries.LAST5 * (k == len(n) - 1)
            out += bytes([b]) + ((nodes[id(child)] if child else 0) << 3 | flags).to_bytes(4, "little")
    return dictionaries.MAGIC + bytes([5, 0, 0, 4]) + bytes(out)


def test_fsa5():
    words = sorted([b"left+Cave+VBD", b"running+E+VBG", b"run+A+VB", b"runs+B+VBZ"])
    data = fsa5(words)
    assert sorted(dictionaries.entries(data)) == words
    meta = dictionaries.info("# c\nfsa.dict.encoding=utf-8\n")
    assert ("running", "run", "VBG") in set(dictionaries.triples(data, meta)) and ("left", "leave", "VBD") in set(dictionaries.triples(data, meta))


def test_cfsa2():
    # ab and ac: the arc to the root, one for a whose target is the next node, then b and c as indexed labels
    arcs = bytes([dictionaries.LAST2 | dictionaries.NEXT2, ord("^")]) + bytes([dictionaries.LAST2 | dictionaries.NEXT2 | 1]) + bytes([dictionaries.FINAL2 | 2, 0]) + bytes([dictionaries.FINAL2 | dictionaries.LAST2, ord("c"), 0])
    data = dictionaries.MAGIC + bytes([0xC6, 0, 0, 3]) + b"?ab" + arcs
    assert list(dictionaries.entries(data)) == [b"ab", b"ac"]


def test_broken_dictionaries_raise():
    data = fsa5([b"a+A+X", b"b+A+Y"])
    for n in range(len(data)):
        with pytest.raises(dictionaries.Broken):
            if list(dictionaries.entries(data[:n])) is not None and n > 10:
                raise dictionaries.Broken  # a cut within unused bytes reads the rest


def test_codec_round_trip_and_faults():
    rng = random.Random(1)
    rows = lambda: sorted({(rng.randint(0, 5), rng.randint(0, 900)): rng.randint(0, 2**32 - 1) for _ in range(30)}.items())
    tables = [[(a, b, n) for (a, b), n in rows()] for _ in range(3)]
    model = (["a", "é"], [("a", "é", 10.0, True)], [(0, 7), (1, 9)], tables)
    data = codec.encode(*model)
    assert codec.decode(data) == model and codec.decode(codec.encode([], [], [], [])) == ([], [], [], [])
    for n in range(len(data)):
        with pytest.raises(codec.Broken):
            codec.decode(data[:n])
    for n in (0, 1, 127, 128, 2**32 - 1, 2**63):
        assert codec.Reader(codec.put_number(n)).number() == n


XML = """<?xml version="1.0"?><!DOCTYPE rules [<!ENTITY be "is|&was;"><!ENTITY was "was">]>
<rules><category><rule id="A"><pattern case_sensitive="yes"><token regexp="yes">&be;</token><marker><token>a<exception>an</exception>n</token></marker></pattern>
<message>Say <suggestion><match no="2" case_conversion="allupper"/>!</suggestion>.</message><example correction="AN!|B">it is <marker>an</marker> é</example><example>fine</example></rule>
<rulegroup id="G"><antipattern><token>x</token></antipattern><rule><pattern><or><token>p</token><token>q</token></or><token min="0" max="-1" skip="2" spacebefore="no"/></pattern><message><suggestion>\\1y</suggestion></message></rule>
<rule default="off"><pattern><token>z</token></pattern></rule></rulegroup>
<rule id="U"><pattern><token><match no="0"/></token></pattern><message/></rule><rule id="R"><regexp mark="1">a(b)</regexp><message><suggestion>c</suggestion></message></rule></category></rules>"""


def test_grammar_xml():
    got = rule_xml.grammar(XML)
    a, g = got.rules
    assert a.pattern[0].test.text == "is|was" and a.pattern[0].test.case_sensitive and a.pattern[1].marked and a.pattern[1].test.text == "an" and a.pattern[1].exceptions[0].case_sensitive
    assert a.suggestions == ((rules.Ref(2, "upper"), "!"),) and g.id == "G" and g.antipatterns[0][0].test.text == "x" and g.pattern[1].bounds == (0, 64, 2) and g.pattern[1].spaced is False
    assert g.suggestions == ((rules.Ref(1), "y"),) and [u for u, _ in got.unsupported] == ["U"] and got.text_rules[0].mark == 1
    assert got.examples[0] == {"rule_id": "A", "text": "it is an é", "marker": (6, 8), "corrections": ["AN!", "B"]} and got.examples[1]["corrections"] == []
    assert rule_xml.literals(got.rules) == {"an", "p", "q"}


def test_disambiguation_and_segmentation_xml():
    xml = '<rules><rule id="T"><pattern><token>a</token></pattern><disambig action="remove" postag="N.*"/></rule><rulegroup id="G"><rule><pattern><token>b</token></pattern><disambig action="add"><wd pos="X" lemma="y"/></disambig></rule></rulegroup></rules>'
    got, bad = rule_xml.disambiguation(xml)
    assert [r.id for r in got] == ["G", "T"] and got[0].action.tags == ("X",) and got[1].action.tag_regexp and not bad
    srx = '<srx xmlns="x"><body><languagerules><languagerule languagerulename="E"><rule break="no"><beforebreak>Mr\\.</beforebreak><afterbreak>\\s</afterbreak></rule></languagerule></languagerules><maprules><languagemap languagepattern="en.*" languagerulename="E"/></maprules></body></srx>'
    assert rule_xml.segmentation(srx, "en-GB") == [(False, r"Mr\.", r"\s")] and rule_xml.segmentation(srx, "de") == []
