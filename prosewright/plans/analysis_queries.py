"""Queries of layer 0 and layer 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright import config
from prosewright.functions import text as fn
from prosewright.operators import analysis, compounds, inspection, neural, spelling
from prosewright.plans.base import ANALYSES, FULL, LEAST, LEXICON, TAGGED, TOKENS, closed_class, corpus, documents, full_tokens, lexicon, quoted, read, tagged, tokens

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name, with its DuckDB twin."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {TOKENS} SELECT doc_id, tok, text, s, e FROM tokens")
def tokenize_spans(spark: SparkSession, d: str) -> DataFrame:
    """TOK-2, WIN-4"""
    return tokens(spark, d).select("doc_id", "tok", "text", "s", "e")


@query(f"WITH {TOKENS} SELECT doc_id, sent, min(s) AS s, max(e) AS e FROM pieces GROUP BY 1, 2")
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    """TOK-1"""
    return analysis.sentences(documents(spark, d)).select("doc_id", "sent", "s", "e")


@query(f"WITH {TOKENS}, {FULL} SELECT doc_id, sent, tok, text, s, e, spaced, last, sentinel FROM ftokens")
def sentence_sentinels(spark: SparkSession, d: str) -> DataFrame:
    """TOK-3: all tokens as rules see them"""
    return analysis.full_tokens(documents(spark, d)).select("doc_id", "sent", "tok", "text", "s", "e", "spaced", "last", "sentinel")


@query(f"WITH {TOKENS} SELECT doc_id, sent, tok, text FROM tokens WHERE last")
def sentence_end_tags(spark: SparkSession, d: str) -> DataFrame:
    """TAG-5, WIN-5"""
    return tokens(spark, d).filter("last").select("doc_id", "sent", "tok", "text")


PLACES = r"""t AS (SELECT doc_id, i, piece, s, blank, length(piece) AS n, length(piece) - length(replace(piece, chr(10), '')) AS feeds, length(regexp_replace(piece, '[\x{0}-\x{FFFF}]', '', 'g')) AS astral FROM pieces),
u AS (SELECT *, coalesce(sum(n) OVER w, 0) AS ch, coalesce(sum(n + astral) OVER w, 0) AS utf16, coalesce(sum(feeds) OVER w, 0) + 1 AS line FROM t
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, max(CASE WHEN feeds > 0 THEN ch + n - length(string_split(piece, chr(10))[-1]) END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS behind FROM u)"""


@query(f"WITH {TOKENS}, {PLACES} SELECT doc_id, s, line::BIGINT AS line, (ch - coalesce(behind, 0) + 1)::BIGINT AS col FROM v WHERE NOT blank")
def line_col(spark: SparkSession, d: str) -> DataFrame:
    """SNK-2: where every token stands"""
    return analysis.token_places(documents(spark, d)).select("doc_id", "s", "line", "col")


@query(f"WITH {TOKENS.replace('FROM documents', 'FROM (SELECT doc_id, lang, chr(119987) || chr(32) || chr(233) || chr(32) || text AS text FROM documents)')}, {PLACES} SELECT doc_id, s, utf16::BIGINT AS utf16 FROM v WHERE NOT blank")
def utf16_spans(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-15: byte offsets of all tokens as UTF-16 offsets, in texts with an astral character in front"""
    docs = documents(spark, d).select("doc_id", "lang", F.concat(F.lit("\U0001d4b3 é "), F.col("text")).alias("text"))
    return analysis.token_places(docs).select("doc_id", "s", "utf16")


@query(r"""WITH p AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '[\s\p{Z}\x{85}\x{0B}]+|[^\s\p{Z}\x{85}\x{0B}]+') AS ps FROM conversations),
q AS (SELECT doc_id, unnest(ps) AS word, generate_subscripts(ps, 1) AS i FROM p),
r AS (SELECT *, (sum(strlen(word)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM q)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS word_idx, word, (e - strlen(word))::BIGINT AS s, e
FROM r WHERE NOT regexp_matches(word, '^[\s\p{Z}\x{85}\x{0B}]')""")
def whitespace_words(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-13"""
    return neural.words(read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


#: French texts with clitics put before every word.
CLITICS = r"regexp_replace(text, ' (\p{L})', ' Qu''j''l''\1', 'g')"


@query(f"WITH {TOKENS.replace('FROM documents', f'FROM (SELECT doc_id, lang, {CLITICS} AS text FROM documents WHERE lang = {quoted("fr")})')}, {FULL} SELECT doc_id, tok, text, s, e FROM ftokens")
def elision_split(spark: SparkSession, d: str) -> DataFrame:
    """TOK-4"""
    docs = documents(spark, d).filter("lang = 'fr'").withColumn("text", F.regexp_replace("text", r" (\p{L})", " Qu'j'l'$1"))
    return analysis.full_tokens(docs).select("doc_id", "tok", "text", "s", "e")


@query(f"WITH {TOKENS} SELECT doc_id, tok, text AS key FROM tokens WHERE regexp_full_match(text, '\\p{{L}}+')")
def normalize_marks(spark: SparkSession, d: str) -> DataFrame:
    """TOK-5: words with a combining mark put behind their first letter and stripped again"""
    toks = tokens(spark, d).filter(fn.is_word(F.col("text")))
    marked = F.concat(F.substring("text", 1, 1), F.lit("َ"), F.expr("substring(text, 2)"))
    return toks.select("doc_id", "tok", fn.strip_marks(marked).alias("key"))


@query(f"WITH {TOKENS}, {LEXICON} SELECT * FROM lexicon")
def lexicon_from_corpus(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1, AGG-4, JON-12, PRD-14"""
    return lexicon(spark, full_tokens(spark, d))


@query(f"""WITH {TOKENS}, {LEXICON}, base AS (SELECT * FROM lexicon WHERE (lang, surface) NOT IN (SELECT (lang, surface) FROM closed)),
added AS (SELECT lang, 'x' || surface AS surface, ord, lemma, 'ADD' AS tag FROM base WHERE tag = 'VBG'),
gone AS (SELECT * FROM base WHERE tag = 'RB')
SELECT * FROM ((SELECT * FROM base UNION ALL SELECT * FROM added) EXCEPT ALL SELECT * FROM gone) UNION ALL SELECT * FROM closed""")
def lexicon_supplements(spark: SparkSession, d: str) -> DataFrame:
    """JON-11, JON-12, SET-2"""
    closed = closed_class(spark)
    base = analysis.corpus_lexicon(full_tokens(spark, d), LEAST).join(closed.select("lang", "surface"), ["lang", "surface"], "left_anti")
    added = base.filter("tag = 'VBG'").select("lang", F.concat(F.lit("x"), F.col("surface")).alias("surface"), "ord", "lemma", F.lit("ADD").alias("tag"))
    return analysis.supplement(base, added, base.filter("tag = 'RB'"), closed)


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED} SELECT doc_id, tok, array_to_string(dt, ' ') AS tags, array_to_string(dl, ' ') AS lemmas FROM t1 WHERE len(dt) > 0")
def tag_tokens(spark: SparkSession, d: str) -> DataFrame:
    """JON-1, TAG-1, TAG-2, TAG-3, CMP-2: dictionary analyses, and those of the heads of compounds"""
    c = corpus(spark, d)
    rows = analysis.lookup(c.toks, c.entries).filter(F.size("tags") > 0)
    return rows.select("doc_id", "tok", F.array_join("tags", " ").alias("tags"), F.array_join("lemmas", " ").alias("lemmas"))


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED} SELECT doc_id, tok, array_to_string(tags, ' ') AS tags, array_to_string(lemmas, ' ') AS lemmas FROM tagged")
def structural_tags(spark: SparkSession, d: str) -> DataFrame:
    """TAG-4, TAG-5"""
    return tagged(spark, d).select("doc_id", "tok", F.array_join("tags", " ").alias("tags"), F.array_join("lemmas", " ").alias("lemmas"))


CHECK = "(CASE lang " + " ".join(f"WHEN '{x.code}' THEN regexp_full_match(lower(text), '[{x.alphabet}]{{3,}}')" for x in config.LANGS.values()) + " ELSE false END)"
UNKNOWN = rf"""unk AS (SELECT lang, lower(text) AS word, count(*) AS n FROM ftokens t WHERE {CHECK} AND NOT (lang = 'de' AND lower(text) IN (SELECT low FROM hd))
  AND NOT EXISTS (SELECT 1 FROM lexicon l WHERE l.lang = t.lang AND l.surface = t.text)
  AND NOT EXISTS (SELECT 1 FROM lexicon l WHERE l.lang = t.lang AND l.surface = lower(t.text)) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {ANALYSES}, {UNKNOWN} SELECT lang, word, n FROM unk")
def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    """JON-2, PRD-1, CMP-3"""
    c = corpus(spark, d)
    return spelling.unknown_words(c.toks, c.entries)


@query(f"""WITH {TOKENS}, w AS (SELECT DISTINCT lower(text) AS word FROM tokens WHERE lang = 'en' AND regexp_full_match(lower(text), '[a-z]{{1,5}}')), a AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c),
i AS (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM w),
e AS (SELECT word, word[1:i] || word[i + 2:] AS c FROM i WHERE i < length(word)
UNION SELECT word, word[1:i] || word[i + 2] || word[i + 1] || word[i + 3:] FROM i WHERE i < length(word) - 1
UNION SELECT word, word[1:i] || c || word[i + 2:] FROM i, a WHERE i < length(word) AND c <> word[i + 1]
UNION SELECT word, word[1:i] || c || word[i + 1:] FROM i, a)
SELECT word, count(*) AS n, string_agg(c, ' ' ORDER BY c) AS candidates FROM e GROUP BY 1""")
def edit1_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FN-1, FN-2, SET-6: of the English words of five letters at most"""
    low = F.lower("text")
    words = tokens(spark, d).filter((F.col("lang") == "en") & low.rlike(r"\A[a-z]{1,5}\z")).select(low.alias("word")).distinct()
    made = words.select("word", fn.edits1(F.col("word"), config.LATIN).alias("c"))
    return made.select("word", F.size("c").cast("bigint").alias("n"), F.array_join("c", " ").alias("candidates"))


#: DuckDB's edit distance counts bytes, so letters of several bytes are stood in for by single ones.
WIDE, NARROW = "àâæçèéêëîïôœùûüÿñáíóúäöß", "0123456789ABCDEFGHIJKLMN"
ALPHA = "(CASE l.lang " + " ".join(f"WHEN '{x.code}' THEN regexp_full_match(l.surface, '[{x.alphabet}]+')" for x in config.LANGS.values()) + " ELSE false END)"
SUGGEST = rf"""us AS (SELECT DISTINCT lang, word, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: word[1:i - 1] || word[i + 1:]), word)) AS sig FROM unk),
ls AS (SELECT DISTINCT lang, surface, unnest(list_append(list_transform(range(1, length(surface) + 1), lambda i: surface[1:i - 1] || surface[i + 1:]), surface)) AS sig FROM lexicon),
cand AS (SELECT DISTINCT u.lang, u.word, l.surface AS c FROM us u JOIN ls l ON l.lang = u.lang AND l.sig = u.sig
  WHERE {ALPHA} AND l.surface = lower(l.surface) AND damerau_levenshtein(translate(u.word, {quoted(WIDE)}, {quoted(NARROW)}), translate(l.surface, {quoted(WIDE)}, {quoted(NARROW)})) = 1),
sug AS (SELECT lang, word, list_sort(list(c))[1:5] AS suggestions FROM cand GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {ANALYSES}, {UNKNOWN}, {SUGGEST} SELECT lang, word, array_to_string(suggestions, ' ') AS suggestions FROM sug")
def spelling_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """JON-3, SRT-3"""
    c = corpus(spark, d)
    return spelling.suggestions(spelling.unknown_words(c.toks, c.entries), c.entries).select("lang", "word", F.array_join("suggestions", " ").alias("suggestions"))


SPELL = rf"""spell AS (SELECT t.doc_id, t.s, t.e, 'SPELL' AS code,
  list_transform(coalesce(g.suggestions, []), lambda x: CASE WHEN regexp_matches(t.text, '^\p{{Lu}}') THEN upper(x[1]) || x[2:] ELSE x END) AS suggestions, 'Spelling' AS source, t.text
  FROM ftokens t JOIN unk u ON u.lang = t.lang AND u.word = lower(t.text) LEFT JOIN sug g ON g.lang = u.lang AND g.word = u.word
  WHERE NOT EXISTS (SELECT 1 FROM lexicon l WHERE l.lang = t.lang AND l.surface = t.text))"""


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {ANALYSES}, {UNKNOWN}, {SUGGEST}, {SPELL} SELECT doc_id, s, e, code, array_to_string(suggestions, ' ') AS suggestions FROM spell")
def spelling_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """the whole of layer 1: PRJ-8"""
    c = corpus(spark, d)
    return spelling.diagnostics(c.toks, c.entries).select("doc_id", "s", "e", "code", F.array_join("suggestions", " ").alias("suggestions"))


@query(rf"""WITH {TOKENS}, w AS (SELECT DISTINCT lang, CASE WHEN length(text) % 5 = 0 THEN text[1] || chr(769) || text[2:] ELSE text END AS text FROM tokens WHERE regexp_full_match(text, '\p{{L}}+')),
l AS (SELECT DISTINCT lang, unnest(string_split(regexp_replace(lower(text), '\p{{Mn}}', '', 'g'), '')) AS c FROM w),
a AS (SELECT lang, string_agg(c, '' ORDER BY c) AS alphabet FROM l GROUP BY 1)
SELECT w.lang, count(*) AS surfaces, count_if(regexp_matches(text, '\p{{Mn}}')) AS marked, count_if(text = lower(text)) AS lower_case, max(length(text)) AS longest, any_value(alphabet) AS alphabet FROM w JOIN a USING (lang) GROUP BY 1""")
def tag_inspect(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: keys with marks (put on every fifth length here), and the alphabet of each language"""
    marked = F.when(F.char_length("text") % 5 == 0, F.concat(F.substring("text", 1, 1), F.lit("\u0301"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    words = tokens(spark, d).filter(fn.is_word(F.col("text"))).select("lang", marked.alias("surface"))
    return inspection.keys(words)


@query(f"WITH {TOKENS}, {LEXICON} SELECT lang, split_part(tag, ':', 1) AS top, count(*) AS n FROM lexicon GROUP BY 1, 2")
def top_level_tags(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: how often each top-level tag occurs in the lexicon"""
    return inspection.top_tags(corpus(spark, d).entries)


#: A second analyser to compare with: plain words without marks at their ends, tagged by their last letter.
CAND = r"""cp AS (SELECT doc_id, regexp_extract_all(text, '[^ \n]+| |\n') AS ps FROM documents),
cq AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM cp),
cs AS (SELECT doc_id, text, (sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM cq),
cand AS (SELECT doc_id, (e - strlen(text))::BIGINT AS s, e, text, CASE WHEN ends_with(text, 's') THEN ['NNS'] WHEN ends_with(text, 'e') THEN ['DT', 'SENT_END'] ELSE ['NN'] END AS tags FROM cs WHERE text NOT IN (' ', chr(10)))"""


@query(f"""WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED}, {CAND},
m AS (SELECT r.tags AS rt, c.tags AS ct, c.text IS NOT NULL AS found, regexp_full_match(r.text, '\\p{{L}}+') AS lexical FROM tagged r LEFT JOIN cand c USING (doc_id, s, e, text) WHERE r.text <> '')
SELECT count(*) AS tokens, count_if(found) AS spans, count_if(found AND list_sort(rt) = list_sort(ct)) AS tags, count_if(found AND lexical) AS lexical, count_if(found AND lexical AND len(list_filter(rt, lambda t: NOT list_contains(ct, t))) = 0) AS lexical_tags,
100.0::DOUBLE * count_if(found) / count(*) AS span_pct, 100.0::DOUBLE * count_if(found AND list_sort(rt) = list_sort(ct)) / count_if(found) AS tag_pct,
100.0::DOUBLE * count_if(found AND lexical AND len(list_filter(rt, lambda t: NOT list_contains(ct, t))) = 0) / count_if(found AND lexical) AS lexical_tag_pct FROM m""")
def differential_tally(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, JON-16: the analysis against a second one, which splits at blanks and tags by the last letter"""
    return inspection.tally(inspection.compared(tagged(spark, d).filter("text <> ''"), second(spark, d)))


@query(f"""WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED}, {CAND},
m AS (SELECT unnest(list_filter(r.tags, lambda t: NOT list_contains(c.tags, t))) AS tag FROM tagged r JOIN cand c USING (doc_id, s, e, text) WHERE r.text <> '') SELECT tag, count(*) AS n FROM m GROUP BY 1""")
def missing_tags(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14: the tags that the second analysis lacks on the same span"""
    return inspection.missing(inspection.compared(tagged(spark, d).filter("text <> ''"), second(spark, d)))


def second(spark: SparkSession, d: str) -> DataFrame:
    words = neural.words(documents(spark, d)).withColumnRenamed("word", "text")
    of = lambda *tags: F.array(*map(F.lit, tags))
    tags = F.when(F.col("text").endswith("s"), of("NNS")).when(F.col("text").endswith("e"), of("DT", "SENT_END")).otherwise(of("NN"))
    return words.select("doc_id", "s", "e", "text", tags.alias("tags"))


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {ANALYSES} SELECT low AS word, head FROM hd")
def compound_split(spark: SparkSession, d: str) -> DataFrame:
    """CMP-1, CMP-3: the German words outside the lexicon that split, and their heads"""
    c = corpus(spark, d)
    words = c.toks.filter("lang = 'de'").filter(fn.is_word(F.col("text"))).select("lang", F.lower("text").alias("word")).distinct()
    known = c.entries.select("lang", F.col("surface").alias("word"))
    return compounds.found(words.join(known, ["lang", "word"], "left_anti"), c.entries).select("word", F.element_at("parts", -1).alias("head"))
