"""Queries of layers 3 and 4, the cascade, evaluation, sources and incremental checking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright import engine, scratch
from prosewright.operators import analysis, cascade, confusion, evaluation, neural, places, rules
from prosewright.operators.rules import Ref, Rule, Test, Token
from prosewright.plans.analysis_queries import PLACES, SPELL, SUGGEST, UNKNOWN
from prosewright.plans.base import LEXICON, TAGGED, TOKENS, Corpus, corpus, corpus_of, documents, full_tokens, lexicon, read, tagged, tokens
from prosewright.sources import artifacts, readers
from prosewright.streaming import incremental

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# layer 3

PAIRS = [("the", "that", 1e3, True), ("of", "on", 1e1, True), ("is", "in", 1e6, True), ("and", "an", 1e12, False), ("de", "des", 1e3, True), ("le", "les", 1e4, False), ("for", "from", 1e2, True)]
PAIR_VALUES = ", ".join(f"('{a}', '{b}', {k}, {f}::FLOAT, {str(s).lower()})" for k, (a, b, f, s) in enumerate(PAIRS))
EVIDENCE = 20
WORD = r"regexp_full_match({}, '\p{{L}}+')"


def pairs_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, k, f, s) for k, (a, b, f, s) in enumerate(PAIRS)], "a string, b string, ord int, factor float, symmetric boolean")


GRAMS = rf"""
pairs(a, b, ord, factor, sym) AS (VALUES {PAIR_VALUES}),
cw AS (SELECT a AS w FROM pairs UNION SELECT b FROM pairs),
uni AS (SELECT lower(text) AS w, count(*) AS n FROM ftokens WHERE {WORD.format('text')} GROUP BY 1 HAVING count(*) >= 2),
nb AS (SELECT lag(lower(text)) OVER o AS w1, lower(text) AS w2, lag(sent) OVER o AS ps, sent FROM ftokens WINDOW o AS (PARTITION BY doc_id ORDER BY tok)),
bi AS (SELECT w1, w2, count(*) AS n FROM nb WHERE ps = sent AND {WORD.format('w1')} AND {WORD.format('w2')} AND (w1 IN (FROM cw) OR w2 IN (FROM cw)) GROUP BY 1, 2),
prim AS (SELECT surface, min(struct_pack(o := ord, l := lang, t := tag)).t AS pos FROM lexicon GROUP BY 1),
lpos AS (SELECT pos, w2 AS member, least(sum(n), 4294967295)::BIGINT AS n FROM bi JOIN prim ON surface = w1 WHERE w2 IN (FROM cw) GROUP BY 1, 2),
rpos AS (SELECT w1 AS member, pos, least(sum(n), 4294967295)::BIGINT AS n FROM bi JOIN prim ON surface = w2 WHERE w1 IN (FROM cw) GROUP BY 1, 2)"""


def tables(spark: SparkSession, c: Corpus) -> dict[str, DataFrame]:
    """The count tables of a corpus, written once."""
    pairs = pairs_of(spark)
    words = confusion.word_set(pairs)
    grams = scratch.table(confusion.bigrams(c.toks, words), "bigrams")
    left, right = confusion.context_counts(grams, words, analysis.primary_tags(c.entries))
    return {"pairs": pairs, "uni": confusion.unigrams(c.toks), "bi": grams, "lpos": left, "rpos": right}


@query(f"WITH {TOKENS}, {LEXICON}, {GRAMS} SELECT * FROM uni")
def unigram_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1"""
    return confusion.unigrams(full_tokens(spark, d))


@query(f"WITH {TOKENS}, {LEXICON}, {GRAMS} SELECT * FROM bi")
def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-2, WIN-3, JON-10, SET-4"""
    return tables(spark, corpus(spark, d))["bi"]


@query(f"WITH {TOKENS}, {LEXICON}, {GRAMS} SELECT 'left' AS side, pos, member, n FROM lpos UNION ALL SELECT 'right', pos, member, n FROM rpos")
def pos_context_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-3, JON-9"""
    t = tables(spark, corpus(spark, d))
    one = lambda side, x: x.select(F.lit(side).alias("side"), "pos", "member", "n")
    return one("left", t["lpos"]).unionByName(one("right", t["rpos"]))


VOCAB = f"""v AS (SELECT w, count(*) AS freq FROM (SELECT w1 AS w FROM bi UNION ALL SELECT w2 FROM bi) GROUP BY 1),
vocab AS (SELECT row_number() OVER (ORDER BY freq DESC, w) - 1 AS id, w, freq FROM v)"""


@query(f"WITH {TOKENS}, {LEXICON}, {GRAMS}, {VOCAB} SELECT * FROM vocab")
def vocab_intern(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5, SRT-5"""
    bi = tables(spark, corpus(spark, d))["bi"]
    return confusion.vocabulary([bi.select("w1"), bi.select("w2")])


@query(f"""WITH {TOKENS}, {LEXICON}, {GRAMS}, {VOCAB}, k AS (SELECT a.id AS x, b.id AS y FROM bi JOIN vocab a ON a.w = w1 JOIN vocab b ON b.w = w2)
SELECT x, y, y - coalesce(lag(y) OVER (PARTITION BY x ORDER BY y), 0) AS delta, y AS value FROM k""")
def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    """WIN-6, both ways"""
    bi = tables(spark, corpus(spark, d))["bi"]
    vocab = confusion.vocabulary([bi.select("w1"), bi.select("w2")])
    keyed = bi.join(vocab.select(F.col("w").alias("w1"), F.col("id").alias("x")), "w1").join(vocab.select(F.col("w").alias("w2"), F.col("id").alias("y")), "w2").select("x", "y")
    return confusion.delta_decode(confusion.delta_encode(keyed, "x", "y"), "x", "y")


ALTS = "alts AS (SELECT a AS word, b AS alt, ord, factor FROM pairs UNION ALL SELECT b, a, ord, factor FROM pairs WHERE sym)"
AROUND = """x0 AS (SELECT doc_id, tok, text, s, e, lower(text) AS low, tags[1] AS ft FROM tagged),
x1 AS (SELECT *, lag(low) OVER o AS pl, lead(low) OVER o AS nl, lag(ft) OVER o AS pp, lead(ft) OVER o AS np, lead(text) OVER o AS nt FROM x0 WINDOW o AS (PARTITION BY doc_id ORDER BY tok))"""


def judged(rows: str, out: str) -> str:
    """What layer 3 fires on the given rows of the shape of x1."""
    return rf"""{out}2 AS (SELECT x.*, alt, ord, factor, CASE WHEN {WORD.format('pl')} THEN pl END AS lw, CASE WHEN {WORD.format('nl')} THEN nl END AS rw
  FROM {rows} x JOIN alts ON low = word WHERE {WORD.format('text')} AND NOT coalesce(starts_with(nt, chr(39)), false)),
{out}3 AS (SELECT x.*, coalesce(b1.n, 0) AS la, coalesce(b2.n, 0) AS lo, coalesce(b3.n, 0) AS ar, coalesce(b4.n, 0) AS wr, coalesce(u1.n, 0) AS ua, coalesce(u2.n, 0) AS uw,
  coalesce(p1.n, 0) AS pa, coalesce(p2.n, 0) AS pw, coalesce(q1.n, 0) AS qa, coalesce(q2.n, 0) AS qw FROM {out}2 x
  LEFT JOIN bi b1 ON b1.w1 = lw AND b1.w2 = alt LEFT JOIN bi b2 ON b2.w1 = lw AND b2.w2 = low LEFT JOIN bi b3 ON b3.w1 = alt AND b3.w2 = rw LEFT JOIN bi b4 ON b4.w1 = low AND b4.w2 = rw
  LEFT JOIN uni u1 ON u1.w = alt LEFT JOIN uni u2 ON u2.w = low LEFT JOIN lpos p1 ON p1.pos = pp AND p1.member = alt LEFT JOIN lpos p2 ON p2.pos = pp AND p2.member = low
  LEFT JOIN rpos q1 ON q1.member = alt AND q1.pos = np LEFT JOIN rpos q2 ON q2.member = low AND q2.pos = np),
{out}4 AS (SELECT *, CASE WHEN lw IS NULL THEN 0 ELSE la END + CASE WHEN rw IS NULL THEN 0 ELSE ar END AS evidence,
  CASE WHEN lw IS NULL THEN 0 ELSE ln(la + 1) - ln(lo + 1) END + CASE WHEN rw IS NULL THEN 0 ELSE (ln(ar + 1) - ln(ua + 1)) - (ln(wr + 1) - ln(uw + 1)) END
  + CASE WHEN pp IS NULL THEN 0 ELSE ln(pa + 1) - ln(pw + 1) END + CASE WHEN np IS NULL THEN 0 ELSE ln(qa + 1) - ln(qw + 1) END AS score FROM {out}3),
{out} AS (SELECT * FROM {out}4 WHERE evidence >= {EVIDENCE} AND score >= 2 + 4.5 * (least(greatest(log10(factor::DOUBLE), 3), 12) - 3) / 9)"""


RECASE = r"CASE WHEN regexp_matches(text, '^\p{Lu}') THEN upper(alt[1]) || alt[2:] ELSE alt END"
CONF = f"conf AS (SELECT doc_id, s, e, 'CONFUSION' AS code, [{RECASE}] AS suggestions, 'Statistical' AS source, text FROM fire QUALIFY row_number() OVER (PARTITION BY doc_id, tok ORDER BY score DESC, ord DESC) = 1)"
L3 = f"WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED}, {GRAMS}, {ALTS}, {AROUND}, {judged('x1', 'fire')}, {CONF}"


def fired(spark: SparkSession, d: str) -> DataFrame:
    return fired_in(spark, corpus(spark, d))


def fired_in(spark: SparkSession, c: Corpus, tagged: DataFrame | None = None) -> DataFrame:
    t = tables(spark, c)
    return confusion.scored(c.tagged if tagged is None else tagged, t["pairs"], t["bi"], t["uni"], t["lpos"], t["rpos"], EVIDENCE)


@query(f"{L3} SELECT doc_id, tok, alt, evidence::BIGINT AS evidence, round(score, 6) AS score FROM fire")
def confusion_scores(spark: SparkSession, d: str) -> DataFrame:
    """JON-5 to JON-8, FN-4, PRD-10, WIN-1"""
    return fired(spark, d).select("doc_id", "tok", "alt", F.col("evidence").cast("bigint").alias("evidence"), F.round("score", 6).alias("score"))


@query(f"{L3} SELECT doc_id, s, e, suggestions[1] AS suggestion FROM conf")
def confusion_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17, PRJ-22"""
    return confusion.diagnostics(fired(spark, d)).select("doc_id", "s", "e", F.element_at("suggestions", 1).alias("suggestion"))


# the cascade

PACK = [
    Rule("DOUBLE", (Token(Test("the")), Token(Test("the"))), ((Ref(1),),), "Doubled word."),
    Rule("OF_THE", (Token(Test("of"), marked=True), Token(Test("the"))), (("from",), ("of",)), "Weak."),
]
GRAMMAR = """w AS (SELECT doc_id, tok, tagged AS t0, lead(tagged) OVER o AS t1 FROM tagged WINDOW o AS (PARTITION BY doc_id ORDER BY tok)),
gram AS (SELECT doc_id, t0.s AS s, t1.e AS e, 'DOUBLE' AS code, [t0.text] AS suggestions, 'Grammar' AS source, t0.text || ' ' || t1.text AS text FROM w WHERE t0.fold = 'the' AND t1.fold = 'the'
UNION ALL SELECT doc_id, t0.s, t0.e, 'OF_THE', ['from', 'of'], 'Grammar', t0.text FROM w WHERE t0.fold = 'of' AND t1.fold = 'the')"""
CASCADE = f"""{L3}, {UNKNOWN}, {SUGGEST}, {SPELL}, {GRAMMAR},
stack AS (SELECT doc_id, s, e, code, suggestions, source, text, 0 AS layer FROM spell UNION ALL SELECT doc_id, s, e, code, suggestions, source, text, 1 FROM gram UNION ALL SELECT doc_id, s, e, code, suggestions, source, text, 2 FROM conf),
kept AS (SELECT * REPLACE (list_filter(suggestions, lambda x: x <> text) AS suggestions) FROM stack WHERE len(suggestions) = 0 OR len(list_filter(suggestions, lambda x: x <> text)) > 0),
final AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, layer, e, code) AS rank FROM kept)"""


def cascade_of(spark: SparkSession, d: str) -> DataFrame:
    """Layers 1 to 3 over documents. Texts are cut for counts of words and contexts, for rules, and for where what is
    found occurs; rows of all tokens aren't made."""
    docs = documents(spark, d)
    found = places.layers_1_and_3(docs, lambda words: lexicon(spark, words), pairs_of(spark), EVIDENCE, scratch.table)
    return cascade.check([found, pack_hits(spark, d)])


@query(f"{CASCADE} SELECT doc_id, rank, s, e, code, array_to_string(suggestions, '|') AS suggestions FROM final")
def cascade_all(spark: SparkSession, d: str) -> DataFrame:
    """SET-1, PRJ-9, SRT-1: the flagship"""
    return cascade_of(spark, d).select("doc_id", "rank", "s", "e", "code", F.array_join("suggestions", "|").alias("suggestions"))


@query(f"{CASCADE} SELECT CASE source WHEN 'Spelling' THEN 'error' WHEN 'Grammar' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM final GROUP BY 1")
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-16"""
    return cascade_of(spark, d).groupBy(cascade.severity(F.col("source")).alias("severity")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


FIXABLE = f"""WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED}, {GRAMMAR}"""


def pack_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first hits of PACK, whose rules ask for no tags: no analysis is made for them."""
    return rules.first_hits(rules.hits_over(documents(spark, d), PACK, lambda: tagged(spark, d)))


def grammar_only(spark: SparkSession, d: str) -> DataFrame:
    return cascade.check([pack_hits(spark, d)])


@query(f"""{FIXABLE}, fx AS (SELECT * FROM gram WHERE len(list_filter(suggestions, lambda x: x <> text)) > 0)
SELECT doc_id, list_reduce(list_prepend({{'s': 0::BIGINT, 'e': 0::BIGINT, 'n': 0}}, list({{'s': s, 'e': e, 'n': 1}} ORDER BY s, e)),
lambda a, x: CASE WHEN x.s >= a.e THEN {{'s': x.s, 'e': x.e, 'n': a.n + 1}} ELSE a END).n AS n_fixes FROM fx GROUP BY 1""")
def fix_all(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-17: fixes that apply in each document, greedily without overlap"""
    return cascade.fixed_texts(documents(spark, d), grammar_only(spark, d)).select("doc_id", "n_fixes")


PRINTED = f"""{FIXABLE}, {PLACES},
sp AS (SELECT g.*, (SELECT any_value(1)) AS one FROM gram g),
gp AS (SELECT doc_id, s, e, code, list_filter(suggestions, lambda x: x <> text) AS fixes, len(suggestions) AS had FROM gram),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, code) AS rank FROM gp WHERE had = 0 OR len(fixes) > 0),
sf AS (SELECT rk.doc_id, rk.s, rk.rank, string_agg(p.piece, '' ORDER BY p.i) AS surface FROM rk JOIN pieces p ON p.doc_id = rk.doc_id AND p.s >= rk.s AND p.e <= rk.e GROUP BY 1, 2, 3)
SELECT rk.doc_id, rk.rank::INT AS rank, 'doc' || rk.doc_id || ':' || v.line::BIGINT || ':' || (v.ch - coalesce(v.behind, 0) + 1)::BIGINT || ' ' || code || ' "' || surface || '"' || CASE WHEN len(fixes) > 0 THEN ' -> "' || fixes[1] || '"' ELSE '' END AS line
FROM rk JOIN sf ON sf.doc_id = rk.doc_id AND sf.rank = rk.rank JOIN v ON v.doc_id = rk.doc_id AND v.s = rk.s""".replace("sp AS (SELECT g.*, (SELECT any_value(1)) AS one FROM gram g),\n", "")


@query(PRINTED)
def printed_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1"""
    return cascade.printed(documents(spark, d), grammar_only(spark, d), F.format_string("doc%d", "doc_id")).select("doc_id", "rank", "line")


@query(f"""{FIXABLE}, h AS (SELECT code, doc_id * 1000000 + sent AS sentence FROM gram JOIN (SELECT DISTINCT doc_id, sent, s FROM tagged WHERE text <> '') t USING (doc_id, s))
SELECT code, count(DISTINCT sentence) AS sentences, min(sentence) AS sample, count(DISTINCT sentence) / (SELECT count(*) FROM ftokens WHERE sentinel) AS rate,
count(DISTINCT sentence) / (SELECT count(*) FROM ftokens WHERE sentinel) >= 0.15 AS anomaly FROM h GROUP BY 1""")
def rule_firing_rate(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, SRT-4: by sentence"""
    found = pack_hits(spark, d).withColumn("sentence", F.col("doc_id") * 1_000_000 + F.col("sent"))
    return evaluation.firing_rates(found, analysis.cut(documents(spark, d), "sentences", ("doc_id", "sent")).count())


@query(f"{FIXABLE} SELECT code, count(*) AS n FROM gram WHERE list_contains(suggestions, text) GROUP BY 1")
def noop_rules(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11"""
    return evaluation.noop_rules(pack_hits(spark, d), F.col("surface"))


@query(f"""WITH RECURSIVE items AS (SELECT item_id AS doc_id, 'en' AS lang, text FROM benchmark), {TOKENS.replace('FROM documents', 'FROM items')}, {LEXICON}, {TAGGED}, {GRAMMAR},
ex AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['from', 'the'] ELSE []::VARCHAR[] END AS c FROM items),
r AS (SELECT (SELECT count(*) FROM ex WHERE len(c) > 0) AS positives, (SELECT count(*) FROM ex WHERE len(c) > 0 AND EXISTS (SELECT 1 FROM gram g WHERE g.doc_id = ex.doc_id AND list_has_any(g.suggestions, c))) AS reproduced,
(SELECT count(*) FROM ex WHERE len(c) = 0) AS negatives, (SELECT count(*) FROM ex WHERE len(c) = 0 AND EXISTS (SELECT 1 FROM gram g WHERE g.doc_id = ex.doc_id AND code = 'OF_THE')) AS false_positives)
SELECT *, 100.0::DOUBLE * reproduced / positives AS reproduced_pct, 100.0::DOUBLE * false_positives / negatives AS false_positive_pct FROM r""")
def oracle_score(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7, AGG-8, JON-17: benchmark passages as examples of one rule, the even ones positive"""
    docs = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("en").alias("lang"), "text")
    found = rules.first_hits(rules.hits(corpus_of(docs).tagged, docs, PACK)).withColumnRenamed("doc_id", "ex")
    fix = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("from"), F.lit("the"))).otherwise(F.array().cast("array<string>"))
    return evaluation.reproduced(docs.select(F.col("doc_id").alias("ex"), F.lit("OF_THE").alias("rule_id"), fix.alias("corrections")), found)


@query(f"""{L3}, bad AS (SELECT DISTINCT truth, wrong FROM (SELECT b AS truth, a AS wrong FROM pairs UNION SELECT a, b FROM pairs WHERE sym)),
pert AS (SELECT x1.* REPLACE (wrong AS text, wrong AS low), truth, wrong FROM x1 JOIN bad ON low = truth), {judged('pert', 'pf')},
best AS (SELECT doc_id, tok, wrong, alt FROM pf QUALIFY row_number() OVER (PARTITION BY doc_id, tok, wrong ORDER BY score DESC, ord DESC) = 1)
SELECT count(*) AS perturbations, count_if(coalesce(alt = truth, false)) AS tp, count_if(NOT coalesce(alt = truth, false)) AS fn, (SELECT count(*) FROM conf) AS fp FROM pert LEFT JOIN best USING (doc_id, tok, wrong)""")
def perturb_recall(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9, JON-20: each confusable word replaced and judged by layer 3, with its flags on the text as it is"""
    c = corpus(spark, d)
    t = tables(spark, c)
    return evaluation.layer3_recall(c.tagged, t["pairs"], t["bi"], t["uni"], t["lpos"], t["rpos"], EVIDENCE)


GRID = (0.0, 2.5, 3.0, 3.5, 4.0, 5.0)


@query(f"""{L3}, sc AS (SELECT round(score, 6) AS score, tok % 3 = 0 AS truth FROM fire), gr(threshold) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in GRID)}),
c AS (SELECT threshold, count_if(score >= threshold AND truth) AS tp, count_if(score >= threshold AND NOT truth) AS fp, count_if(score < threshold AND truth) AS fn FROM sc, gr GROUP BY 1),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c),
r AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f05 FROM q)
SELECT *, row_number() OVER (ORDER BY f05 DESC, threshold) = 1 AS best FROM r""")
def f05_sweep(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15, AGG-16: thresholds on the scores of layer 3, against a made-up truth, and the best by F0.5"""
    scored = fired(spark, d).select(F.round("score", 6).alias("score"), (F.col("tok") % 3 == 0).alias("truth"))
    return evaluation.best_of(evaluation.sweep(scored, spark.createDataFrame([(x,) for x in GRID], "threshold double")))


@query(f"""{L3}, hyp AS (SELECT DISTINCT doc_id, s, e, alt AS fix FROM fire), gold AS (SELECT doc_id, s, e, CASE WHEN tok % 2 = 0 THEN alt ELSE 'x' END AS fix FROM fire UNION SELECT doc_id, s, e, 'y' FROM tagged WHERE fold = 'with'),
m AS (SELECT coalesce(h.doc_id, g.doc_id) AS doc_id, h.fix IS NOT NULL AS hf, g.fix IS NOT NULL AS gf FROM hyp h FULL JOIN gold g ON h.doc_id = g.doc_id AND h.s = g.s AND h.e = g.e AND h.fix = g.fix)
SELECT count_if(hf AND gf) AS tp, count_if(hf AND NOT gf) AS fp, count_if(gf AND NOT hf) AS fn, count_if(hf AND gf) / count_if(hf) AS precision, count_if(hf AND gf) / count_if(gf) AS recall,
1.25 * (count_if(hf AND gf) / count_if(hf)) * (count_if(hf AND gf) / count_if(gf)) / (0.25 * (count_if(hf AND gf) / count_if(hf)) + count_if(hf AND gf) / count_if(gf)) AS f05 FROM m""")
def edit_scores(spark: SparkSession, d: str) -> DataFrame:
    """SET-5, AGG-15: edits of layer 3 against made-up gold edits, by span and fix"""
    c = corpus(spark, d)
    full = scratch.table(c.tagged, "tagged")
    fire = scratch.table(fired_in(spark, c, full).select("doc_id", "tok", "s", "e", "alt"), "fired")
    gold = fire.select("doc_id", "s", "e", F.when(F.col("tok") % 2 == 0, F.col("alt")).otherwise(F.lit("x")).alias("fix")).unionByName(full.filter("fold = 'with'").select("doc_id", "s", "e", F.lit("y").alias("fix")))
    return evaluation.edit_scores(fire.select("doc_id", "s", "e", F.col("alt").alias("fix")), gold)


@query("""WITH a AS (SELECT doc_id::VARCHAR AS key, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id::VARCHAR AS key, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.h IS NULL THEN 'NEW' WHEN b.h IS NULL THEN 'MISSING' WHEN a.h <> b.h THEN 'CHANGED' ELSE 'SAME' END AS status FROM a FULL JOIN b USING (key)""")
def manifest_drift(spark: SparkSession, d: str) -> DataFrame:
    """JON-18, FN-8, SNK-11: two made-up states of the documents"""
    docs = documents(spark, d)
    old = evaluation.hashed(docs.filter("doc_id % 7 <> 0"), "doc_id", "text")
    now = docs.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return evaluation.drift(old, evaluation.hashed(now, "doc_id", "text"))


# layer 4

TAGS = ["$KEEP", "$DELETE", "$APPEND_x z", "$REPLACE_y", "$TRANSFORM_CASE_CAPITAL", "$TRANSFORM_CASE_UPPER", "$TRANSFORM_AGREEMENT_PLURAL", "$TRANSFORM_VERB_VB_VBZ", "$TRANSFORM_AGREEMENT_SINGULAR"]


@query(r"""WITH p AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '[^\s\p{Z}\x{85}\x{0B}]+') AS ps FROM conversations),
w AS (SELECT doc_id, unnest(ps) AS word, generate_subscripts(ps, 1) - 1 AS word_idx FROM p),
m AS (SELECT *, (length(word) + word_idx) % 9 AS k, ((length(word) * 7 + word_idx * 3) % 10) / 10.0 AS p FROM w),
g AS (SELECT *, max(p) OVER (PARTITION BY doc_id) >= 0.66 AND p > 0.1 + 0.2 AND p >= 0.66 AS go FROM m),
e AS (SELECT doc_id, word_idx, CASE WHEN NOT go OR k = 0 THEN [word] WHEN k = 1 THEN [] WHEN k = 2 THEN [word, 'x', 'z'] WHEN k = 3 THEN ['y'] WHEN k = 4 THEN [replace(upper(word[1]), 'ẞ', 'SS') || lower(word[2:])] WHEN k = 5 THEN [replace(upper(word), 'ẞ', 'SS')]
  WHEN k = 6 THEN [word || 's'] WHEN k = 8 THEN [word[1:length(word) - 1]] ELSE [CASE WHEN word = 'the' THEN 'thes' ELSE word END] END AS ws FROM g)
SELECT doc_id, word_idx, generate_subscripts(ws, 1) - 1 AS sub_idx, unnest(ws) AS word FROM e""")
def l4_apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """PRD-13, PRJ-10 to PRJ-12, JON-14, JON-15: a made-up tagger that looks at lengths and places"""
    words = neural.words(read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))
    k = (F.char_length("word") + F.col("word_idx")) % 9
    p = ((F.char_length("word") * 7 + F.col("word_idx") * 3) % 10) / 10.0
    rows = words.select("doc_id", "word_idx", "word", F.element_at(F.array(*map(F.lit, TAGS)), (k + 1).cast("int")).alias("tag"), p.alias("edit_prob"), F.lit(0.1).alias("keep_prob"), p.alias("error_prob"))
    verbs = spark.createDataFrame([("the", "VB_VBZ", "thes")], "word string, tags string, form string")
    return neural.apply_edits(rows, verbs)


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS top FROM x),
e AS (SELECT vec_id, list_transform(v, lambda y: exp(y - top)) AS e FROM m), r AS (SELECT vec_id, e, list_sum(e) AS total, list_max(e[2:]) AS best FROM e)
SELECT vec_id, (list_position(e[2:], best))::INT AS edit_label, round(best / total, 6) AS edit_prob, round(e[1] / total, 6) AS keep_prob FROM r""")
def l4_softmax_reduce(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18"""
    rows = read(spark, d, "embeddings").select("vec_id", neural.best_label(F.col("embedding"), 0).alias("b"))
    return rows.select("vec_id", F.col("b.edit_label").cast("int").alias("edit_label"), F.round("b.edit_prob", 6).alias("edit_prob"), F.round("b.keep_prob", 6).alias("keep_prob"))


def _mock(words: list[str]) -> list[tuple[str, float, float, float]]:
    fix = {"the": "$REPLACE_zq1", "of": "$DELETE", "and": "$APPEND_zq2"}
    return [(fix.get(w, "$KEEP"), 0.9 if w in fix else 0.0, 0.05, 0.9 if w in fix else 0.0) for w in words]


@query(r"""WITH p AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '[\s\p{Z}\x{85}\x{0B}]+|[^\s\p{Z}\x{85}\x{0B}]+') AS ps FROM conversations),
q AS (SELECT doc_id, unnest(ps) AS word, generate_subscripts(ps, 1) AS i FROM p),
r AS (SELECT *, (sum(strlen(word)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM q),
w AS (SELECT doc_id, word, e - strlen(word) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, word IN ('the', 'of') AS gone FROM r WHERE NOT regexp_matches(word, '^[\s\p{Z}\x{85}\x{0B}]')),
g AS (SELECT *, sum((NOT gone)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS region FROM w),
h AS (SELECT doc_id, region, max(CASE WHEN NOT gone THEN word END) AS head, min(CASE WHEN NOT gone THEN s END) AS hs, min(CASE WHEN NOT gone THEN e END) AS he, min(CASE WHEN gone THEN s END) AS gs, max(CASE WHEN gone THEN e END) AS ge,
  list_concat(CASE WHEN max(CASE WHEN NOT gone THEN word END) = 'and' THEN ['zq2', 'zq2', 'zq2', 'zq2', 'zq2'] ELSE [] END, list_transform(range(0, count_if(word = 'the')::BIGINT), lambda x: 'zq1')) AS put FROM g GROUP BY 1, 2)
SELECT doc_id, coalesce(gs, hs)::BIGINT AS s, coalesce(ge, he)::BIGINT AS e, CASE WHEN gs IS NULL THEN head || ' ' ELSE '' END || array_to_string(put, ' ') AS fix FROM h WHERE gs IS NOT NULL OR len(put) > 0""")
def l4_decode_diff(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-14, EXT-3: passes of a made-up tagger to a fix point or the limit, and the differences as diagnostics"""
    docs = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return neural.diagnostics(docs, _mock).select("doc_id", "s", "e", F.element_at("suggestions", 1).alias("fix"))


# sources

@query("""WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS a, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a, b, (k + 1)::FLOAT AS factor, k % 3 <> 1 AS symmetric FROM n WHERE k % 4 <> 3 AND a NOT LIKE '% %' AND b NOT LIKE '% %'""")
def confusion_sets_parse(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: lines made of nations and regions, some one-way, with comments, some without a number"""
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    line = F.concat(F.col("n_name"), F.when(k % 3 == 1, F.lit(" -> ")).otherwise(F.lit("; ")), F.concat("r_name", F.lit("|note")), F.lit("; "), F.when(k % 4 == 3, F.lit("x")).otherwise((k + 1).cast("string")), F.lit(" # made"))
    path = f"{scratch.folder(spark)}/sets-{uuid.uuid4().hex}"
    rows.select(line.alias("value")).write.text(path)
    return readers.confusion_sets(spark.read.text(path))


@query("""SELECT p_name AS surface, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name[1:greatest(length(p_name) - 2, 0)] || 'en' END AS lemma, 'T:' || (p_partkey % 5) AS tag FROM part""")
def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7, FN-5: entries made of parts, with suffix codes"""
    code = F.when(F.col("p_partkey") % 3 == 0, "A").otherwise("Cen")
    lines = read(spark, d, "part").select(F.concat("p_name", F.lit("+"), code, F.lit("+T:"), (F.col("p_partkey") % 5).cast("string")).alias("value"))
    return readers.decoded_entries(lines)


@query(f"""WITH {TOKENS}, n AS (SELECT DISTINCT lower(text) AS w FROM tokens WHERE lang = 'en' AND regexp_full_match(lower(text), '[a-z]{{3,}}'))
SELECT w AS word, 'VB_VBZ' AS tags, w || 's' AS form FROM n UNION ALL SELECT w, 'VB_VBD', w || 'ed' FROM n WHERE length(w) % 2 = 0""")
def verb_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """SRC-23: lines made of English words, with doubles, of which the first counts, and broken ones"""
    low = F.lower("text")
    w = tokens(spark, d).filter((F.col("lang") == "en") & low.rlike(r"\A[a-z]{3,}\z")).select(low.alias("w")).distinct()
    lines = F.array(*(F.struct(F.lit(k).alias("n"), F.concat("w", F.lit("_"), *more).alias("value")) for k, more in enumerate((
        ("w", F.lit("s:VB_VBZ")), ("w", F.lit("es:VB_VBZ")), (F.lit("x"),), (F.when(F.char_length("w") % 2 == 0, F.concat("w", F.lit("ed:VB_VBD"))).otherwise(F.lit("y")),)))))
    return readers.verb_forms(w.select(F.inline(lines)))


@query("SELECT split_part(event_type, '_', 1) AS gram, count(*) AS n FROM events GROUP BY 1")
def ngram_tables(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15, SNK-10: counts written as tabbed lines and read back"""
    counts = read(spark, d, "events").groupBy(F.split("event_type", "_")[0].alias("gram")).agg(F.count("*").alias("n"))
    path = f"{scratch.folder(spark)}/counts-{uuid.uuid4().hex}"
    artifacts.write_counts(counts, path)
    return readers.ngrams(spark.read.text(path))


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED}, {GRAMMAR} SELECT doc_id, s, e, code, suggestions[1] AS suggestion FROM gram")
def rule_tables(spark: SparkSession, d: str) -> DataFrame:
    """SRC-20, SNK-6, SNK-7, EXT-1 to EXT-6: rules and lexicon written as tables, and a checker built from them"""
    docs, path = documents(spark, d), f"{scratch.folder(spark)}/tables-{uuid.uuid4().hex}"
    artifacts.write_rules(spark, PACK, f"{path}/rules")
    artifacts.write_lexicon(lexicon(spark, analysis.word_counts(docs)), f"{path}/lexicon")
    checker = engine.build(spark, path, ("grammar",))
    return checker.diagnosed(docs)[0].select("doc_id", "s", "e", "code", F.element_at("suggestions", 1).alias("suggestion"))


@query(f"""{FIXABLE}, o AS (SELECT doc_id, s, e, code, suggestions FROM gram WHERE len(list_filter(suggestions, lambda x: x <> text)) > 0),
j AS (SELECT doc_id, s, e, code, '{{"start":' || s || ',"end":' || e || ',"code":"' || code || '"' AS head FROM o)
SELECT doc_id, string_agg(head, ';' ORDER BY s, e, code) AS heads, count(*) AS n FROM j GROUP BY 1""")
def diagnostics_json(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5: each document's diagnostics as a JSON array, read here by the head of each object"""
    rows = artifacts.diagnostics_json(grammar_only(spark, d))
    heads = F.regexp_extract_all("json", F.lit('\\{"start":\\d+,"end":\\d+,"code":"\\w+"'), F.lit(0))
    return rows.select("doc_id", F.array_join(heads, ";").alias("heads"), F.size(heads).cast("bigint").alias("n"))


@query("""SELECT '{"quality":' || quality || ',"n":' || count(*) || '}' AS json FROM labels GROUP BY quality""")
def score_json(spark: SparkSession, d: str) -> DataFrame:
    """SNK-4: a report as JSON lines"""
    return artifacts.as_json(read(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n")))


# incremental checking


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    """STR-2"""
    return incremental.latest(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM g GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """STR-1"""
    rows = incremental.debounced(read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "30 minutes")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_sweep(spark: SparkSession, d: str) -> DataFrame:
    """STR-6"""
    return incremental.pending(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")
