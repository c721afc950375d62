"""The matcher, the column compiler and the decoders on small cases, and against each other."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from prosewright.functions import text as fn
from prosewright.operators import analysis, cascade, compounds, disambiguation, neural, rules
from prosewright.operators.rules import Group, Ref, Rule, Test, Token
from prosewright.sources import artifacts, readers

TOKS = "doc_id bigint, tok bigint, text string, fold string, tags array<string>, lemmas array<string>, spaced boolean, s bigint, e bigint, gap string"


def token(text, tags=(), lemmas=(), spaced=True, s=0):
    return {"text": text, "tags": list(tags), "lemmas": list(lemmas), "spaced": spaced, "s": s, "e": s + len(text)}


def line(*words):
    out, at = [], 0
    for w in words:
        out.append(token(w, s=at))
        at += len(w) + 1
    return out


def plain(*words, **more):
    return tuple(Token(Test(w), **more) for w in words)


def test_lazy_repetition_and_gap():
    toks = line("a", "a", "b", "x", "b")
    assert rules.match_at((Token(Test("a"), min=1, max=2), Token(Test("b"))), toks, 0) == (3, [(0, 2), (2, 3)])
    assert rules.match_at((Token(Test("a"), skip=3), Token(Test("b"))), toks, 0) == (3, [(0, 1), (2, 3)])
    assert rules.match_at((Token(Test("a"), min=0, max=1), Token(Test("a"))), toks, 0) == (1, [None, (0, 1)])
    assert rules.match_at((Token(Test("a"), max=-1), Token(Test("x"))), toks, 0) is None
    assert Token(Test("a"), max=-1).bounds == (1, 64, 0) and Token(min=0).bounds == (0, 1, 0)


def test_lazy_order_equals_enumeration():
    """The first success in the order: fewest repetitions, then the shortest gap, element by element."""
    rng = random.Random(1)
    for _ in range(400):
        toks = line(*(rng.choice("ab") for _ in range(rng.randint(0, 6))))
        pattern = tuple(Token(Test(rng.choice(["a", "b", "[ab]"]), regexp=True), min=rng.randint(0, 1), max=rng.randint(1, 2), skip=rng.randint(0, 2)) for _ in range(rng.randint(1, 3)))
        want = None
        for shape in itertools.product(*(itertools.product(range(e.bounds[0], e.bounds[1] + 1), range(e.bounds[2] + 1)) for e in pattern)):
            at, ok = 0, True
            for e, (c, g) in zip(pattern, shape, strict=True):
                ok = ok and at + c + g <= len(toks) and all(rules.element_token(e, t) for t in toks[at : at + c])
                at += c + g
            if ok:
                want = at
                break
        got = rules.match_at(pattern, toks, 0)
        assert (got and got[0]) == want


def test_columns_equal_the_matcher(spark):
    rng = random.Random(2)
    vocab, tags = ["the", "The", "of", "runs", "run", ","], ["NN", "VBZ", "DT"]
    docs, rows = [], []
    for d in range(12):
        text, toks, at = "", [], 0
        gaps = []
        for k in range(rng.randint(0, 12)):
            w, gap = rng.choice(vocab), rng.choice(["", " ", "\n "])
            text += gap + w
            gaps.append(gap)
            at += len(gap)
            toks.append(token(w, rng.sample(tags, rng.randint(0, 2)), ["run"] if w.startswith("run") else [], bool(gap) or k == 0, at))
            at += len(w)
        docs.append((d, text, toks))
        rows += [(d, k, t["text"], rules.fold(t["text"]), t["tags"], t["lemmas"], t["spaced"], t["s"], t["e"], gaps[k]) for k, t in enumerate(toks)]

    def test():
        kind = rng.randint(0, 4)
        neg = rng.random() < 0.2
        return [Test(rng.choice(vocab), negate=neg), Test("r.n.?", regexp=True, negate=neg), Test(tag=rng.choice(tags), negate=neg), Test(tag="N.|V.*", tag_regexp=True), Test("run", inflected=True)][kind]

    def element():
        if rng.random() < 0.2:
            return Group(rng.choice(["or", "and"]), (Token(test()), Token(test())))
        return Token(test(), exceptions=(test(),) if rng.random() < 0.3 else (), spaced=rng.choice([None, None, True, False]), marked=rng.random() < 0.3)

    def loose(k):
        e = element()
        if isinstance(e, Group) or rng.random() < 0.5:
            return e
        least = rng.randint(1 if k == 0 else 0, 1)
        return replace(e, min=least, max=rng.randint(max(least, 1), 2), skip=rng.choice([None, 1, 2]))

    anti = lambda: tuple(tuple(element() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 1)))
    fixes = ((Ref(1, "upper"), "-"), (Ref(2),), ("x",))
    pack = [Rule(f"R{k}", tuple(element() for _ in range(rng.randint(1, 3))), fixes, r"m \1 \9", anti()) for k in range(25)]
    pack += [Rule(f"L{k}", tuple(loose(j) for j in range(rng.randint(1, 3))), fixes, r"m \1 \2", anti()) for k in range(15)]
    pack = [r for r, _ in rules.prepare(pack)]
    numbered = list(enumerate(pack))
    assert all(rules.in_columns(r) for r in pack)
    cols = ["doc_id", "start", "stop", "rule", "s", "e", "message", "suggestions", "surface"]
    got = rules.hits_by_columns(spark.createDataFrame(rows, TOKS), numbered).select(cols).collect()
    want = [(d, h["start"], h["stop"], h["rule"], h["s"], h["e"], h["message"], h["suggestions"], h["surface"]) for d, text, toks in docs for h in rules.match_document(rules.Index(numbered), toks, text)]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_hits_in_texts_equal_the_matcher(spark):
    rng = random.Random(5)
    words = ["the", "The", "of", "run", "é𝒳", ",", ".", "x."]
    texts = {d: "".join(rng.choice(["", " ", " ", "\n "]) + rng.choice(words) for _ in range(rng.randint(0, 30))) for d in range(40)} | {40: None, 41: "  the the"}

    def element():
        one = lambda: Token(Test(*rng.choice([("the", False), ("of", False), ("r.n|,", True), (None, False)]), negate=rng.random() < 0.2), spaced=rng.choice([None, None, True, False]), marked=rng.random() < 0.3)
        return Group(rng.choice(["or", "and"]), (one(), one())) if rng.random() < 0.2 else one() if rng.random() < 0.6 else replace(one(), min=rng.randint(0, 1), max=rng.choice([1, 2, -1]), skip=rng.choice([None, 2]))

    pack = [Rule(f"R{k}", tuple(element() for _ in range(rng.randint(1, 3))), ((Ref(1, "upper"), "-"), ("x",)), r"m \1 \2", tuple((element(),) for _ in range(rng.randint(0, 1)))) for k in range(60)]
    numbered = list(enumerate(pack))
    docs = spark.createDataFrame([(d, "en", t) for d, t in texts.items()], "doc_id bigint, lang string, text string")
    toks = {d: [] for d in texts}
    for r in analysis.full_tokens(docs).orderBy("doc_id", "tok").collect():
        toks[r.doc_id].append(token(r.text, spaced=r.spaced) | {"s": r.s, "e": r.e, "sent": r.sent})
    keys = ("start", "stop", "rule", "literal", "s", "e", "message", "suggestions", "surface")
    want = [(d, *(h[k] for k in keys), next(t["sent"] for t in toks[d] if t["s"] == h["s"])) for d, t in texts.items() for h in rules.match_document(rules.Index(numbered), toks[d], t or "")]
    df = rules.hits_over(docs, pack, lambda: None)
    assert "Exchange" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.select("doc_id", *keys, "sent").collect())) == sorted(want) and len(want) > 500


def test_hits_in_windows_equal_the_matcher(spark):
    rng = random.Random(6)
    texts = {d: "".join(rng.choice(["", " ", " ", "\n "]) + rng.choice(["the", "The", "of", "é𝒳", ",", "."]) for _ in range(rng.randint(0, 30))) for d in range(30)} | {30: None}
    one = lambda: Token(rng.choice([Test("the"), Test("of", negate=True), Test("o.|,", regexp=True), Test("the", tag="NN"), Test(tag="VB"), Test(",", tag="NN", negate=True)]), exceptions=(Test("The", case_sensitive=True),) if rng.random() < 0.3 else (), spaced=rng.choice([None, None, True]))
    pack = [Rule(f"R{k}", tuple(Group(rng.choice(["or", "and"]), (one(), one())) if rng.random() < 0.3 else one() for _ in range(rng.randint(1, 3))), ((Ref(1), "-"),), r"\1") for k in range(6)]
    docs = spark.createDataFrame([(d, "en", t) for d, t in texts.items()], "doc_id bigint, lang string, text string")
    made = lambda toks: toks.withColumns({"tags": F.when(F.col("tok") % 2 == 0, F.array(F.lit("NN"))).otherwise(F.array(F.lit("VB"))), "lemmas": F.array().cast("array<string>")})
    keys = ("start", "stop", "rule", "s", "e", "message", "suggestions", "surface")
    for rule in pack:  # each by itself, so that its windows alone decide
        toks = {d: [] for d in texts}
        for r in made(analysis.full_tokens(docs)).orderBy("doc_id", "tok").collect():
            toks[r.doc_id].append(r.asDict())
        want = [(d, *(h[k] for k in keys)) for d, t in texts.items() for h in rules.match_document(rules.Index([(0, rule)]), toks[d], t or "")]
        got = rules.hits_in_windows(made(rules.window_tokens(docs, [rule.pattern])), [(0, rule)])
        assert sorted(map(tuple, got.select("doc_id", *keys).collect())) == sorted(want)
    many = [rule.pattern for rule in pack]
    few = sorted(map(tuple, rules.window_tokens(docs, many).collect()))
    assert few and few == sorted(map(tuple, rules.window_tokens(docs, many * 10).collect()))  # as one of very many


def test_dialect():
    assert all(map(rules.accepted, ["a+b?", r"\d{2,3}", "[(?=]", r"\\1", r"\p{L}+"]))
    assert not any(map(rules.accepted, ["a(?=b)", "(?<!a)b", r"(a)\1", "a++", "(?>a)", "(", "a{2}+"]))


def test_antipatterns_and_markers():
    rule = Rule("T", (Token(Test("lead")), Token(Test("role"), marked=True)), ((Ref(2, "start_upper"),),), antipatterns=(plain("the", "lead"),))
    assert rules.match_document(rules.Index([(0, rule)]), line("lead", "role"), "lead role")[0]["suggestions"] == ["Role"]
    assert rules.match_document(rules.Index([(0, rule)]), line("the", "lead", "role"), "the lead role") == []


def test_disambiguation_actions():
    def run(action, tags):
        toks = [token("x", tags)]
        disambiguation.apply_rule(disambiguation.TagRule("r", (Token(Test("x"), marked=True),), action), toks)
        return toks[0]["tags"]

    act = disambiguation.Action
    assert run(act("replace", ("NN",)), ["VB", "NN"]) == ["NN"] and run(act("replace", ("JJ",)), ["VB"]) == ["VB", "JJ"]
    assert run(act("add", ("NN",)), ["NN"]) == ["NN"] and run(act("remove", ("N.*",), tag_regexp=True), ["NN", "VB"]) == ["VB"]
    assert run(act("filter", ()), ["NN"]) == ["NN"] and run(act("filter", ("VB",)), ["NN", "VB"]) == ["VB"]


def test_compounds():
    known = {"haus", "tür", "arbeit", "zimmer"}
    assert compounds.parts_of("Haustür", known, ("s",)) == ["haus", "tür"] and compounds.parts_of("Arbeitszimmer", known, ("s",)) == ["arbeit", "zimmer"]
    assert compounds.parts_of("haus", known, ("s",)) == [] and compounds.parts_of("hausx", known, ("s",)) == [] and compounds.parts_of("haus" * 9, known, ()) == []


def test_neural_edits_and_differences():
    assert neural.edit_word("box", "$TRANSFORM_AGREEMENT_PLURAL") == ["boxs"] and neural.edit_word("a-b", "$TRANSFORM_SPLIT_HYPHEN") == ["a", "b"]
    assert neural.edit_word("go", "$TRANSFORM_VERB_VB_VBZ", {("go", "VB_VBZ"): "goes"}) == ["goes"] and neural.edit_word("go", "$MERGE_SPACE") == ["go"]
    assert neural.edit_word("buses", "$TRANSFORM_AGREEMENT_SINGULAR") == ["buse"] and neural.edit_word("bOX", "$TRANSFORM_CASE_CAPITAL") == ["Box"] and neural.edit_word("abC", "$TRANSFORM_CASE_CAPITAL_1") == ["aBc"]
    assert neural.edit_word("a", "$APPEND_b c") == ["a", "b", "c"] and neural.edit_word("a", "$REPLACE_b c") == ["b", "c"]
    spans = [(0, 1), (2, 3), (4, 5)]
    assert neural.differences(spans, list("abc"), list("axc")) == [(2, 3, "x")]
    assert neural.differences(spans, list("abc"), list("ac")) == [(2, 3, "")]
    assert neural.differences(spans, list("abc"), ["z", *"abc"]) == [(0, 1, "z a")] and neural.differences(spans, list("abc"), [*"abc", "z"]) == [(4, 5, "c z")]


def test_span_functions(spark):
    text = "é\n𝒳b\r\nlast"
    raw = text.encode()
    offsets = [len(text[:k].encode()) for k in range(len(text) + 1)]
    df = spark.createDataFrame([(text, o) for o in offsets], "t string, o bigint")
    got = df.select("o", fn.line_of(F.col("t"), F.col("o")), fn.column_of(F.col("t"), F.col("o")), fn.utf16_offset(F.col("t"), F.col("o"))).collect()
    for o, row, col, wide in got:
        before = raw[:o].decode()
        assert (row, col, wide) == (before.count("\n") + 1, len(before.rsplit("\n", 1)[-1]) + 1, len(before.encode("utf-16-le")) // 2)


def test_noops_and_order(spark):
    rows = [(1, 0, 1, "A", "", ["a"], "Grammar", "a"), (1, 0, 1, "B", "", ["a", "b"], "Spelling", "a"), (1, 0, 1, "C", "", [], "Neural", "a"), (1, 0, 3, "Y", "", ["q"], "Grammar", "a c"), (1, 0, 2, "Z", "", ["q"], "Grammar", "a "), (1, 0, 2, "X", "", ["q"], "Grammar", "a ")]
    df = spark.createDataFrame(rows, "doc_id int, s int, e int, code string, message string, suggestions array<string>, source string, surface string")
    got = cascade.ordered(cascade.without_noops(df)).orderBy("rank").collect()
    assert [(r.code, r.suggestions) for r in got] == [("B", ["b"]), ("X", ["q"]), ("Z", ["q"]), ("Y", ["q"]), ("C", [])]


def test_text_rules_render_groups_and_come_last(spark):
    docs = spark.createDataFrame([(1, "é Foo foobar x")], "doc_id bigint, text string")
    pack = [rules.TextRule("T", r"(foo)(bar)?", ((Ref(1, "upper", "o", "0"), "-", Ref(2)), (Ref(1),)), r"\1 and \2 \9", mark=2), rules.TextRule("BAD", r"(?=x)", (("x",),))]
    got = rules.text_hits(docs, list(enumerate(pack))).orderBy("s").collect()
    assert [(r.s, r.e, r.message, r.suggestions, r.surface) for r in got] == [(3, 6, "Foo and \\2 \\9", ["Foo"], "Foo"), (10, 13, "foo and bar \\9", ["F00-bar", "foo"], "bar")]


def test_rule_tables_hold_rules(spark, tmp_path):
    pack = [Rule("A", (Token(Test("a"), min=0, skip=2, exceptions=(Test("b", regexp=True),)), Group("or", plain("x", "y"), marked=True)), ((Ref(1, "upper", "a", "b"), "c"),), "m", (plain("z"),)), rules.TextRule("T", "x", (("y",),), mark=1), disambiguation.TagRule("D", plain("q"), disambiguation.Action("add", ("NN",)))]
    artifacts.write_rules(spark, pack, f"{tmp_path}/rules")
    assert artifacts.read_rules(spark, f"{tmp_path}/rules") == pack
    report = artifacts.conversion_report(spark, [pack[0], Rule("N", plain("a"), ())], [("O", "no way")]).first()
    assert (report.total, report.opaque, report.reasons) == (3, 2, {"no suggestion to render": 1, "no way": 1})


def test_m2():
    assert readers.m2_edits("S a b c\nA 1 2|||R:X|||z|||REQUIRED|||-NONE-|||0\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\nA 0 1|||R|||q|||REQUIRED|||-NONE-|||1\n") == [{"sent": 0, "start": 1, "end": 2, "kind": "R:X", "fix": "z", "old": "b"}]


@pytest.mark.parametrize("word", ["ab", "aa", "x"])
def test_edits(spark, word):
    letters = "abx"
    cut = [word[:k] + word[k + 1 :] for k in range(len(word))] + [word[:k] + word[k + 1] + word[k] + word[k + 2 :] for k in range(len(word) - 1)]
    put = [word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in letters if c != word[k]] + [word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters]
    assert spark.createDataFrame([(word,)], "w string").select(fn.edits1(F.col("w"), letters)).first()[0] == sorted({*cut, *put})
