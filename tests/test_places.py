"""Layers 1 and 3 by distinct words and contexts against the same layers over rows of all tokens."""

import pytest

from prosewright import scratch
from prosewright.operators import analysis, confusion, places, spelling
from prosewright.plans import base, model_queries

TEXTS = [
    ("en", "That cat sat. The the dog of on the mat, for the man's dog is in the hous of the"),
    ("en", "the cat in the house is of the\nOF THE That's from the The 42 the"),
    ("fr", "Le chat de l'homme. Les chats des hommes d'abord le chien de la maison"),
    ("de", "Die Haustür des Hauses der Haus tür Hausx"),
    (None, "the cat of the house is in that house"),
    ("en", None),
    ("en", ""),
    ("xx", "of the \x00 on the"),
]


@pytest.mark.parametrize("most", [24 << 20, 0])  # by broadcast, and by shuffles
def test_layers_equal_those_over_tokens(spark, monkeypatch, most):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(TEXTS)], "doc_id bigint, lang string, text string")
    monkeypatch.setattr(base, "LEAST", 2)
    pairs = model_queries.pairs_of(spark)
    columns = ["doc_id", "s", "e", "code", "message", "suggestions", "source", "surface"]

    c = base.corpus_of(docs)
    t = model_queries.tables(spark, c)
    fired = confusion.scored(c.tagged, t["pairs"], t["bi"], t["uni"], t["lpos"], t["rpos"], 0)
    want = spelling.diagnostics(c.toks, c.entries).unionByName(confusion.diagnostics(fired)).select(columns).collect()
    got = places.layers_1_and_3(docs, lambda words: base.lexicon(spark, words), pairs, 0, scratch.table).select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 3

    monkeypatch.setattr(confusion, "threshold", lambda factor: -100.0 + 0 * factor)
    fired = confusion.scored(c.tagged, t["pairs"], t["bi"], t["uni"], t["lpos"], t["rpos"], 0)
    want = confusion.diagnostics(fired).select(columns).collect()
    got = places.layers_1_and_3(docs, lambda words: base.lexicon(spark, words), pairs, 0, scratch.table).filter("code = 'CONFUSION'").select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 15 and any(r.doc_id == 4 for r in got)


def test_bigrams_of_contexts(spark):
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(TEXTS)], "doc_id bigint, lang string, text string")
    pairs = model_queries.pairs_of(spark)
    words = confusion.word_set(pairs)
    found = places.counts(docs, {r.w for r in words.collect()})
    got = places.bigrams(found.filter("prev is not null"), pairs).collect()
    assert sorted(got) == sorted(confusion.bigrams(analysis.full_tokens(docs), words).select("w1", "w2", "n").collect())


def test_cascade_writes_no_tokens(spark, monkeypatch):
    names, write = [], scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, name: names.append(name) or write(df, name))
    model_queries.cascade_of(spark, "/root/testdata/sf0.001")
    assert names and not {"tokens", "tagged"} & set(names)
