"""What the queries share: inputs, the lexicon of the harness, and DuckDB fragments of the same meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prosewright import config, scratch
from prosewright.functions.text import PIECE, SPACE
from prosewright.operators import analysis, tokenizer

LEAST = 20
#: Function words with their tags in dictionary order, written for these queries.
CLOSED = {
    "en": {"the": "DT", "a": "DT", "an": "DT", "of": "IN", "to": "TO IN", "in": "IN RP", "on": "IN", "at": "IN", "by": "IN", "for": "IN CC", "with": "IN", "from": "IN", "and": "CC", "or": "CC", "is": "VBZ", "are": "VBP", "was": "VBD", "be": "VB", "has": "VBZ", "it": "PRP", "he": "PRP", "this": "DT", "that": "IN DT", "not": "RB", "as": "RB IN"},
    "de": {"der": "ART", "die": "ART", "das": "ART", "und": "KON", "ein": "ART", "eine": "ART", "in": "PRP", "von": "PRP", "zu": "PRP", "ist": "VER", "mit": "PRP", "nicht": "ADV"},
    "fr": {"le": "D", "la": "D", "les": "D", "un": "D", "une": "D", "de": "P", "et": "C", "en": "P", "est": "V", "que": "C", "du": "P"},
    "es": {"el": "DA", "la": "DA", "los": "DA", "un": "DI", "una": "DI", "de": "SP", "y": "CC", "en": "SP", "que": "PR CS", "no": "RN"},
}
ENTRY = "lang string, surface string, ord int, lemma string, tag string"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.tokens(documents(spark, sf_dir))


def full_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with sentinels and clitics apart, written once for all that a query derives from them."""
    return scratch.table(analysis.full_tokens(documents(spark, sf_dir)), "tokens")


def closed_entries() -> list[tuple]:
    return [(lang, w, k, w, tag) for lang, words in CLOSED.items() for w, tags in words.items() for k, tag in enumerate(tags.split(" "))]


def closed_class(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(closed_entries(), ENTRY)


def lexicon(spark: SparkSession, toks: DataFrame) -> DataFrame:
    """(lang, surface, ord, lemma, tag): frequent corpus words, with the closed class in place of its surfaces; written
    once, as several joins read it."""
    none = spark.createDataFrame([], ENTRY)
    return scratch.table(analysis.supplement(analysis.corpus_lexicon(toks, LEAST), none, none, closed_class(spark)), "lexicon")


@dataclass(frozen=True)
class Corpus:
    """What queries derive from documents (TOK, TAG, CMP): tokens and lexicon are written, tagged reads them."""

    docs: DataFrame
    toks: DataFrame
    entries: DataFrame

    @property
    def tagged(self) -> DataFrame:
        return analysis.analyze(self.docs, self.entries, toks=self.toks)


def corpus_of(docs: DataFrame) -> Corpus:
    toks = scratch.table(analysis.full_tokens(docs), "tokens")
    return Corpus(docs, toks, lexicon(docs.sparkSession, toks))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return corpus_of(documents(spark, sf_dir))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).tagged


# DuckDB


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chars(s: str) -> str:
    return ", ".join(quoted(c) for c in s)


def distinct(xs: str) -> str:
    """The distinct members of a list in their order, as DuckDB SQL."""
    return f"list_transform(list_filter(list_zip({xs}, range(1, len({xs}) + 1)), lambda x: list_position({xs}, x[1]) = x[2]), lambda x: x[1])"


CLOSED_VALUES = ", ".join(f"({quoted(lang)}, {quoted(w)}, {k}, {quoted(lemma)}, {quoted(t)})" for lang, w, k, lemma, t in closed_entries())

TOKENS = rf"""
p0 AS (SELECT doc_id, lang, regexp_extract_all(text, {quoted(PIECE)}) AS ps FROM documents),
p1 AS (SELECT doc_id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS i FROM p0),
p2 AS (SELECT *, regexp_matches(piece, {quoted(rf'^[{SPACE}]')}) AS blank,
  lag(piece, 1) OVER w AS b1, lag(piece, 2) OVER w AS b2,
  (sum(strlen(piece)) OVER w)::BIGINT AS e FROM p1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p3 AS (SELECT *, blank AND (contains(piece, chr(10)) OR coalesce(
  (b1 IN ({chars(tokenizer.ENDS)}) OR (b1 IN ({chars(tokenizer.CLOSERS)}) AND b2 IN ({chars(tokenizer.ENDS)})))
  AND NOT coalesce(b1 = '.' AND lower(b2) IN ({', '.join(map(quoted, config.ABBREVIATIONS))}), false), false)) AS cut FROM p2),
pieces AS (SELECT doc_id, lang, i, piece, (e - strlen(piece))::BIGINT AS s, e, blank,
  coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent FROM p3),
tokens AS (SELECT doc_id, lang, sent, row_number() OVER w - 1 AS tok, piece AS text, s, e,
  coalesce(lag(e) OVER w < s, true) AS spaced, coalesce(lead(sent) OVER w <> sent, true) AS last
  FROM pieces WHERE NOT blank WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""

#: Clitics at the head of a token whose letters A-Z are folded, each with its apostrophe and something behind it.
HEADS = " ".join(f"WHEN '{x.code}' THEN regexp_extract(fold, {quoted('^((?:' + '|'.join(sorted(x.clitics, key=len, reverse=True)) + ')*)')}, 1)" for x in config.LANGS.values() if x.clitics)

FULL = rf"""
f0 AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS fold FROM tokens),
f1 AS (SELECT *, CASE lang {HEADS} ELSE '' END AS head FROM f0),
f2 AS (SELECT *, regexp_extract_all(text[1:length(head)], '[^'']+''') AS hs, text[length(head) + 1:] AS tail FROM f1 WHERE head <> ''),
f3 AS (SELECT doc_id, lang, sent, s, unnest(CASE WHEN tail = '' THEN hs ELSE list_append(hs, tail) END) AS text, generate_subscripts(CASE WHEN tail = '' THEN hs ELSE list_append(hs, tail) END, 1) AS part FROM f2),
f4 AS (SELECT *, (sum(strlen(text)) OVER (PARTITION BY doc_id, s ORDER BY part))::BIGINT AS upto FROM f3),
f5 AS (SELECT doc_id, lang, sent, text, s, e, false AS sentinel FROM f1 WHERE head = ''
  UNION ALL SELECT doc_id, lang, sent, text, s + upto - strlen(text), s + upto, false FROM f4
  UNION ALL SELECT doc_id, lang, sent, '', min(s), min(s), true FROM pieces GROUP BY doc_id, lang, sent),
ftokens AS (SELECT doc_id, lang, sent, row_number() OVER w - 1 AS tok, text, s, e, coalesce(s > lag(e) OVER w, true) AS spaced, coalesce(lead(sent) OVER w <> sent, true) AS last, sentinel
  FROM f5 WINDOW w AS (PARTITION BY doc_id ORDER BY s, e))"""

LEXICON = rf"""{FULL},
c0 AS (SELECT lang, lower(text) AS surface, count(*) AS n FROM ftokens WHERE regexp_full_match(text, '\p{{L}}+') GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
closed(lang, surface, ord, lemma, tag) AS (VALUES {CLOSED_VALUES}),
lexicon AS (SELECT lang, surface, 0 AS ord, CASE WHEN length(surface) > 4 THEN regexp_replace(surface, '(?:ing|ed|ly|s)$', '') ELSE surface END AS lemma,
  CASE WHEN lang <> 'en' THEN 'W' WHEN regexp_matches(surface, 'ing$') THEN 'VBG' WHEN regexp_matches(surface, 'ed$') THEN 'VBD'
  WHEN regexp_matches(surface, 'ly$') THEN 'RB' WHEN regexp_matches(surface, '[^s]s$') THEN 'NNS' ELSE 'NN' END AS tag
  FROM c0 WHERE (lang, surface) NOT IN (SELECT (lang, surface) FROM closed)
  UNION ALL SELECT * FROM closed)"""


def _case(pick) -> str:
    return "CASE lang " + " ".join(f"WHEN '{x.code}' THEN {quoted(pick(x))}" for x in config.LANGS.values()) + f" ELSE {quoted(pick(config.LANGS['en']))} END"


#: Needs WITH RECURSIVE. hd: lower-cased compounds and their heads; t1: tokens with dictionary tags dt and lemmas dl.
ANALYSES = rf"""
g0 AS (SELECT lang, surface, list(tag ORDER BY ord, tag, lemma) AS ts, list(lemma ORDER BY ord, tag, lemma) AS ls FROM lexicon GROUP BY 1, 2),
g AS (SELECT lang, surface, {distinct("ts")} AS tags, {distinct("ls")} AS lemmas FROM g0),
t0 AS (SELECT t.*, coalesce(x.tags, l.tags, []::VARCHAR[]) AS dt, coalesce(x.lemmas, l.lemmas, []::VARCHAR[]) AS dl FROM ftokens t
  LEFT JOIN g x ON x.lang = t.lang AND x.surface = t.text LEFT JOIN g l ON l.lang = t.lang AND l.surface = lower(t.text)),
links(k, link) AS (VALUES (0, ''), {', '.join(f"({k}, {quoted(x)})" for k, x in enumerate(config.DE.links, 1))}),
kp AS (SELECT DISTINCT lower(surface) AS part FROM lexicon WHERE lang = 'de' AND strlen(surface) >= 3 AND (surface = lower(surface) OR surface = upper(lower(surface)[1]) || lower(surface)[2:])),
dw AS (SELECT DISTINCT lower(text) AS low FROM t0 WHERE lang = 'de' AND len(dt) = 0 AND regexp_full_match(text, '\p{{L}}+') AND lower(text) NOT IN (FROM kp)),
cr AS (SELECT low, low AS rest, []::INT[] AS path, 0 AS n, '' AS head FROM dw
  UNION ALL SELECT low, CASE WHEN part = rest THEN '' ELSE rest[length(part) + length(link) + 1:] END, list_concat(path, [(-length(part))::INT, k::INT]), n + 1, part FROM cr, kp, links
  WHERE rest <> '' AND n < 8 AND starts_with(rest, part) AND ((part = rest AND k = 0) OR (length(rest) > length(part) + length(link) AND starts_with(rest[length(part) + 1:], link)))),
hd AS (SELECT low, arg_min(head, path) AS head FROM cr WHERE rest = '' AND n >= 2 GROUP BY 1),
ht AS (SELECT low, coalesce(a.tags, b.tags) AS tags FROM hd LEFT JOIN g a ON a.lang = 'de' AND a.surface = head LEFT JOIN g b ON b.lang = 'de' AND b.surface = upper(head[1]) || head[2:]),
t1 AS (SELECT t0.* REPLACE (CASE WHEN ht.low IS NULL OR len(dt) > 0 THEN dt ELSE ht.tags END AS dt, CASE WHEN ht.low IS NULL OR len(dt) > 0 THEN dl ELSE [text] END AS dl)
  FROM t0 LEFT JOIN ht ON t0.lang = 'de' AND ht.low = lower(text))"""

TAGGED = rf"""{ANALYSES},
t2 AS (SELECT *, regexp_full_match(text, '\p{{Nd}}+') AS digit, CASE lang {' '.join(f"WHEN '{x.code}' THEN regexp_full_match(text, '[{x.punctuation}]+')" for x in config.LANGS.values())} ELSE regexp_full_match(text, '[{config.PUNCTUATION}]+') END AS punct,
  CASE WHEN lang = 'en' THEN CASE text {' '.join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in config.EN_CLASSES.items())} END END AS cls FROM t1),
t3 AS (SELECT *, CASE WHEN sentinel THEN ['SENT_START'] WHEN digit THEN [{_case(lambda x: x.digit_tag)}]
  WHEN punct THEN list_concat(list_concat(dt, [{_case(lambda x: x.punct_tag)}]), CASE WHEN cls IS NULL OR cls = {_case(lambda x: x.punct_tag)} THEN []::VARCHAR[] ELSE [cls] END)
  WHEN len(dt) = 0 THEN [CASE WHEN regexp_matches(text, '^\p{{Lu}}') THEN {_case(lambda x: x.name_tag)} ELSE 'UNKNOWN' END] ELSE dt END AS tg FROM t2),
tagged AS (SELECT doc_id, lang, sent, tok, text, s, e, spaced, last, CASE WHEN last THEN list_append(tg, 'SENT_END') ELSE tg END AS tags,
  CASE WHEN digit THEN []::VARCHAR[] ELSE dl END AS lemmas,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS fold FROM t3)"""
