"""Queries over whole documents, where an earlier one of the same operator keeps a part."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from prosewright import config
from prosewright.operators import analysis, compounds, confusion, evaluation, reports, rules, spelling
from prosewright.plans.base import corpus

SF = "/root/testdata/sf0.001"


def whole(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def test_token_places_by_brute_force(spark):
    texts = {1: "a 𝒳b\n\n é𝒳 c d. " + "w𝒳, x\n" * 60, 2: "", 3: "\n\n z", 4: None, 5: "𝒳" * 50 + "\t end"}
    got = analysis.token_places(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    for r in got:
        before = texts[r.doc_id].encode()[: r.s].decode()
        assert texts[r.doc_id].encode()[r.s :].decode().startswith(r.text)
        assert (r.utf16, r.line, r.col) == (len(before.encode("utf-16-le")) // 2, before.count("\n") + 1, len(before.rpartition("\n")[2]) + 1)
    assert max(r.tok for r in got if r.doc_id == 1) > 180 and sorted(r.tok for r in got if r.doc_id == 1) == list(range(sum(r.doc_id == 1 for r in got)))


def test_places_cover_all_tokens(spark):
    n = whole(spark, "tokenize_spans").count()
    assert whole(spark, "line_col").count() == n and whole(spark, "utf16_spans").count() == n + 2 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_tag_actions_cover_all_tokens(spark):
    got = whole(spark, "disambig_actions")
    assert got.count() == whole(spark, "sentence_sentinels").count()
    assert got.filter("only like '%SENT_END%'").count() == whole(spark, "sentence_segments").count()


def test_text_helpers_cover_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = whole(spark, "text_helpers")
    assert got.count() == docs.count() and got.agg({"plain": "max"}).first()[0] > 400


@pytest.mark.parametrize("name", ["fix_all", "noop_rules", "printed_lines", "diagnostics_json", "rule_firing_rate", "rule_tables"])
def test_rules_without_tags_need_no_tokens(spark, name, monkeypatch):
    """Rows of all tokens were written and shuffled for rules that look at texts alone."""
    monkeypatch.setattr(analysis, "full_tokens", lambda *_: pytest.fail("tokens of all documents"))
    assert whole(spark, name).count() > 0


@pytest.mark.parametrize("name", ["rule_large_pack", "disambig_sequence"])
def test_rules_at_few_places_gather_no_documents(spark, name, monkeypatch):
    """All tokens of a document were gathered in one row, and a batch of such rows was held as Python objects."""
    monkeypatch.setattr(analysis, "full_tokens", lambda *_: pytest.fail("tokens of all documents"))
    monkeypatch.setattr(rules, "gathered", lambda *_: pytest.fail("whole documents"))
    assert whole(spark, name).count() > 0


def test_word_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r.lang, r.text): r["count"] for r in analysis.full_tokens(docs).filter("not sentinel").groupBy("lang", "text").count().collect()}
    assert {(r.lang, r.text): r.n for r in analysis.word_counts(docs).collect()} == want


def test_number_after_beyond_64_bits(spark):
    texts = {1: "the 9223372036854775808", 2: "the 9223372036854775807", 3: "of the x " + "9" * 400, 4: "the", 5: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.n for r in rows.select("doc_id", reports.number_after(F.col("text"), "the").alias("n")).collect()}
    assert got == {1: None, 2: 9223372036854775807, 3: None, 4: None, 5: None}


def plain_tokens(text):
    """The tokens of a text, character by character."""
    out, word, s = [], "", 0
    for c in [*text, " "]:
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Mn" or c == "'":
            word += c
            continue
        if word:
            out.append((word, s - len(word.encode())))
            word = ""
        if not (kind[0] == "Z" or c in "\t\n\x0b\x0c\r\x85"):
            out.append((c, s))
        s += len(c.encode())
    return out


def test_tokens_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, " ", "\n\na", "a", "'", "é\u0301𝒳 b!", "x.\n\ny. Z"] + ["".join(rng.choice("ab'é𝒳.! \n\u00a0\u0301") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(k, "fr", t) for k, t in enumerate(texts)], "doc_id bigint, lang string, text string")
    by = {}
    for r in analysis.tokens(docs).orderBy("doc_id", "tok").collect():
        by.setdefault(r.doc_id, []).append(r)
    sents = {}
    for r in analysis.sentences(docs).orderBy("doc_id", "sent").collect():
        sents.setdefault(r.doc_id, []).append(r)
    full = {}
    for r in analysis.full_tokens(docs).orderBy("doc_id", "tok").collect():
        full.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert [r.text for r in by.get(k, [])] == [w for w, _ in plain_tokens(t or "")], t
        assert all(raw[r.s : r.e].decode() == r.text and r.tok == i for i, r in enumerate(by.get(k, [])))
        assert "".join(r.text for r in sents.get(k, [])) == (t or "") and [r.sent for r in sents.get(k, [])] == list(range(len(sents.get(k, []))))
        assert "".join(r.gap + r.text for r in full.get(k, [])).rstrip(" \n\u00a0") == (t or "").rstrip(" \n\u00a0")
        assert sum(r.sentinel for r in full.get(k, [])) == len(sents.get(k, [])) == sum(r.last for r in full.get(k, []))


def test_elision_and_break_rules(spark):
    docs = spark.createDataFrame([(1, "fr", "L'eau qu'il l' x' d'l'a Presqu'y aujourd'hui"), (2, "it", "dell'uomo po' l'arte"), (3, "en", "l'x. He")], "doc_id bigint, lang string, text string")
    got = {}
    for r in analysis.full_tokens(docs).filter("not sentinel").orderBy("doc_id", "tok").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == ["L'", "eau", "qu'", "il", "l'", "x'", "d'", "l'", "a", "Presqu'y", "aujourd'hui"]
    assert got[2] == ["dell'", "uomo", "po'", "l'", "arte"] and got[3] == ["l'x", ".", "He"]
    breaks = {"en": [(False, r"Dr\.\s", "[A-Z]"), (True, r"[.!]\s+", "[A-Z]")]}
    docs = spark.createDataFrame([(1, "en", "Dr. No left.  He went! and\n\nso. On"), (2, "de", "Eins.\nZwei")], "doc_id bigint, lang string, text string")
    assert [r.text for r in analysis.sentences(docs, breaks).orderBy("doc_id", "sent").collect()] == ["Dr. No left.  ", "He went! and\n\nso. ", "On", "Eins.\n", "Zwei"]


LEX = [("de", "Haus", "SUB:NEU"), ("de", "tür", "X"), ("de", "tür", "A"), ("de", "Tür", "SUB:FEM"), ("de", "Zimmer", "SUB:NEU"), ("de", "arbeit", "A"), ("en", "door", "NN"), ("en", "house", "NN")]


def test_compounds_are_known_and_tagged_by_their_head(spark):
    lex = spark.createDataFrame([(a, s, k, s, t) for k, (a, s, t) in enumerate(LEX)], "lang string, surface string, ord int, lemma string, tag string")
    docs = spark.createDataFrame([(1, "de", "Haustür Arbeitszimmer Haus Hausx haustür."), (2, "en", "housedoor door")], "doc_id bigint, lang string, text string")
    toks = analysis.full_tokens(docs)
    assert {(r.lang, r.word) for r in spelling.unknown_words(toks, lex).collect()} == {("de", "hausx"), ("en", "housedoor")}
    assert {r.s for r in spelling.diagnostics(toks, lex).filter("doc_id = 1").collect()} == {len("Haustür Arbeitszimmer Haus ".encode())}
    got = {(r.doc_id, r.text): (r.tags, r.lemmas) for r in analysis.analyze(docs, lex).collect()}
    assert got[1, ""] == (["SENT_START"], []) and len(got) == toks.count()
    # dictionary order: the first tag is the primary one
    assert got[1, "Haustür"] == (["X", "A"], ["Haustür"]) and got[1, "Arbeitszimmer"] == (["SUB:NEU"], ["Arbeitszimmer"]) and got[1, "haustür"] == (["X", "A"], ["haustür"])
    assert got[1, "Hausx"][0] == [config.LANGS["de"].name_tag] and got[2, "housedoor"][0] == [config.UNKNOWN] and got[2, "door"][0] == ["NN", "SENT_END"]


def test_no_unknown_word_splits(spark):
    c = corpus(spark, SF)
    lex = c.entries.collect()
    known = {x.code: {r.surface for r in lex if r.lang == x.code} for x in config.LANGS.values()}
    for r in whole(spark, "unknown_words").collect():
        assert r.word not in known[r.lang] and not (config.LANGS[r.lang].links and compounds.parts_of(r.word, known[r.lang], config.LANGS[r.lang].links))


def test_layer3_recall_replaces_words_and_runs_layer3(spark):
    pairs = spark.createDataFrame([("their", "there", 0, 10.0, True), ("than", "then", 1, 10.0, False), ("there", "then", 2, 10.0, True)], "a string, b string, ord int, factor float, symmetric boolean")
    docs = spark.createDataFrame([(1, "en", "over there is one of their cars then and There is"), (2, "en", "their is their cars"), (3, "en", "then")], "doc_id bigint, lang string, text string")
    toks = analysis.tokens(docs).withColumn("tags", analysis.F.array(analysis.F.lit("X"))).cache()
    grams = spark.createDataFrame([("over", "there", 90), ("there", "is", 99), ("of", "their", 70), ("their", "cars", 80), ("cars", "then", 3)], "w1 string, w2 string, n bigint")
    counts = spark.createDataFrame([("there", 100), ("their", 100), ("then", 100), ("than", 100)], "w string, n bigint")
    none = [spark.createDataFrame([], x) for x in ("pos string, member string, n bigint", "member string, pos string, n bigint")]
    model = (pairs, grams, counts, *none, 5)
    back = {}
    for p in pairs.collect():
        back.setdefault(p.b, set()).add(p.a)
        if p.symmetric:
            back.setdefault(p.a, set()).add(p.b)
    rows = toks.collect()
    cases = [(t, w) for t in rows for w in sorted(back.get(t.text.lower(), ()))]
    made = []  # each case as a document of its own, with one word replaced
    for k, (t, w) in enumerate(cases):
        made += [(k, *r[1:3], r.tok, w if r.tok == t.tok else r.text, *r[5:]) for r in rows if r.doc_id == t.doc_id]
    run = lambda x: confusion.diagnostics(confusion.scored(x, *model)).collect()
    found = {(r.doc_id, r.surface): r.suggestions[0].lower() for r in run(spark.createDataFrame(made, toks.schema)) if r.s == cases[r.doc_id][0].s}
    tp = sum(found.get((k, w)) == t.text.lower() for k, (t, w) in enumerate(cases))
    fp = len(run(toks))
    got = evaluation.layer3_recall(toks, *model).collect()
    assert [tuple(r) for r in got] == [(len(cases), tp, len(cases) - tp, fp)] and 0 < tp < len(cases) and fp > 0
