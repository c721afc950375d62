"""Queries of layer 2: one rule feature each, against the same condition written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright import config, scratch
from prosewright.operators import analysis, cascade, disambiguation, rules
from prosewright.operators.rules import Group, Ref, Rule, Test, TextRule, Token
from prosewright.plans.base import LEXICON, TAGGED, TOKENS, documents, lexicon, tagged

QUERIES, SQL = {}, {}
WITH = f"WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED}"
#: Tokens with the five that follow, as t0 to t5, each a struct.
AHEAD = ", w AS (SELECT doc_id, tok, tagged AS t0, " + ", ".join(f"lead(tagged, {i}) OVER o AS t{i}" for i in range(1, 6)) + " FROM tagged WINDOW o AS (PARTITION BY doc_id ORDER BY tok))"


def lit(*words: str, **more) -> tuple[Token, ...]:
    return tuple(Token(Test(w, **more)) for w in words)


def found(spark: SparkSession, d: str, *pack: Rule) -> DataFrame:
    """The hits of rules, with one string for the suggestions."""
    toks = tagged(spark, d)
    got = rules.hits(toks, documents(spark, d), list(pack))
    return got.select("doc_id", "start", "s", "e", "id", "message", F.array_join("suggestions", "|").alias("suggestions"))


def select(where: str, *, s: str = "t0.s", e: str, message: str = "''", suggestion: str, id: str) -> str:
    return f"SELECT doc_id, tok AS start, {s} AS s, {e} AS e, '{id}' AS id, {message} AS message, {suggestion} AS suggestions FROM w WHERE {where}"


def register(name: str, sql: str | None, *pack: Rule):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return found(spark, d, *pack)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = f"{WITH} {AHEAD} {sql}"


register(
    "rule_literal_sequence", select("t0.fold = 'of' AND t1.fold = 'the'", e="t1.e", suggestion="'of this'", id="OF_THE", message="'Not of the.'"),
    Rule("OF_THE", lit("of", "the"), (("of this",),), "Not of the."),
)
register(
    "rule_regex_token", select(r"regexp_full_match(t0.text, '(?i)th[a-z]+ing')", e="t0.e", suggestion="upper(t0.text)", id="THING"),
    Rule("THING", (Token(Test("th[a-z]+ing", regexp=True)),), ((Ref(1, "upper"),),)),
)
register(
    "rule_postag", select("list_contains(t0.tags, 'DT') AND len(list_filter(t1.tags, lambda x: regexp_full_match(x, 'VB.'))) > 0", e="t1.e", suggestion="t0.text || ' of ' || t1.text", id="DT_VB"),
    Rule("DT_VB", (Token(Test(tag="DT")), Token(Test(tag="VB.", tag_regexp=True))), ((Ref(1), " of ", Ref(2)),)),
)
register(
    "rule_inflected", select("list_contains(list_transform(t0.lemmas, lambda x: lower(x)), 'stat') AND t0.text <> ''", e="t0.e", suggestion="'state'", id="STAT"),
    Rule("STAT", (Token(Test("stat", inflected=True)),), (("state",),)),
)
register(
    "rule_negate_exception",
    select(r"t0.fold = 'the' AND NOT (t1.fold = 'of') AND NOT regexp_full_match(t1.text, '(?i)th.*') AND NOT list_contains(t1.tags, 'UNKNOWN')", e="t1.e", suggestion="'the ' || t1.text || '!'", id="THE_X"),
    Rule("THE_X", (Token(Test("the")), Token(Test("of", negate=True), exceptions=(Test("th.*", regexp=True), Test(tag="UNKNOWN")))), (("the ", Ref(2), "!"),)),
)
register(
    "rule_or_and", select(r"(t0.fold = 'is' OR t0.fold = 'was') AND (len(t1.text) >= 0 AND regexp_full_match(t1.text, '(?i)[a-z]+') AND list_contains(t1.tags, 'DT'))", e="t1.e", suggestion="t1.text", id="BE_DT"),
    Rule("BE_DT", (Group("or", lit("is", "was")), Group("and", (Token(Test("[a-z]+", regexp=True)), Token(Test(tag="DT"))))), ((Ref(2),),)),
)
register(
    "rule_space_before", select(r"regexp_full_match(t0.text, '\p{L}+') AND t1.text = ',' AND NOT t1.spaced", e="t1.e", suggestion="t0.text || ' ,'", id="COMMA"),
    Rule("COMMA", (Token(Test(r"\p{L}+", regexp=True)), Token(Test(","), spaced=False)), ((Ref(1), " ,"),)),
)
register(
    "rule_marker_message", select("t0.fold = 'of' AND t1.fold = 'the' AND t2.text IS NOT NULL", s="t1.s", e="t1.e", suggestion="'a'", message=r"'Before ' || t2.text || ' \9 say a, not ' || t1.text", id="MARK"),
    Rule("MARK", (Token(Test("of")), Token(Test("the"), marked=True), Token()), (("a",),), r"Before \3 \9 say a, not \2"),
)
register(
    "rule_antipattern",
    "SELECT * FROM (" + select("t0.fold = 'the'", e="t0.e", suggestion="'a'", id="THE") + ") h WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = h.doc_id AND t0.fold = 'of' AND t1.fold = 'the' AND w.tok < h.start + 1 AND h.start < w.tok + 2)",
    Rule("THE", lit("the"), (("a",),), antipatterns=(lit("of", "the"),)),
)
register(
    "rule_sentence_start", select("list_contains(t0.tags, 'SENT_START') AND t1.fold = 'the' AND NOT t1.spaced", s="t1.s", e="t1.e", suggestion="'A'", id="START"),
    Rule("START", (Token(Test(tag="SENT_START")), Token(Test("the"), spaced=False, marked=True)), (("A",),)),
)
register(
    "rule_sentence_end", select("list_contains(t0.tags, 'NN') AND list_contains(t1.tags, 'SENT_END') AND t1.text = '.' AND list_contains(t2.tags, 'SENT_START')", s="t0.s", e="t1.e", suggestion="t0.text || '!'", id="END"),
    Rule("END", (Token(Test(tag="NN"), marked=True), Token(Test(".", tag="SENT_END"), marked=True), Token(Test(tag="SENT_START"))), ((Ref(1), "!"),)),
)
register(
    "rule_skip_gap",
    "SELECT * FROM (" + " UNION ALL ".join(select(f"t0.fold = 'of' AND t{k}.fold = 'and'" + "".join(f" AND coalesce(t{j}.fold, '') <> 'and'" for j in range(1, k)), e=f"t{k}.e", suggestion=f"t0.text || ' & ' || t{k}.text", id="OF_AND") for k in (1, 2, 3, 4)) + ")",
    Rule("OF_AND", (Token(Test("of"), skip=3), Token(Test("and"))), ((Ref(1), " & ", Ref(2)),)),
)
register(
    "rule_repeat_element",
    "SELECT * FROM (" + " UNION ALL ".join(select("t0.fold = 'the'" + "".join(f" AND list_contains(t{j}.tags, 'NN')" for j in range(1, k)) + f" AND t{k}.text = '.'", e=f"t{k}.e", suggestion="'x'", id="NNS") for k in (1, 2, 3)) + ")",
    Rule("NNS", (Token(Test("the")), Token(Test(tag="NN"), min=0, max=2), Token(Test("."))), (("x",),)),
)
register(
    "rule_dedup_first",
    "SELECT doc_id, tok AS start, s, e, id, message, suggestions FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY tok, literal, rule) AS rn FROM ("
    + "SELECT doc_id, tok, t0.s AS s, t0.e AS e, 'DUP' AS id, '' AS message, 'first' AS suggestions, 1 AS literal, 0 AS rule FROM w WHERE t0.fold = 'the' "
    + r"UNION ALL SELECT doc_id, tok, t0.s, t0.e, 'DUP', '', 'second', 0, 1 FROM w WHERE regexp_full_match(t0.text, '(?i)the|this') "
    + "UNION ALL SELECT doc_id, tok, t1.s, t1.e, 'DUP', '', 'third', 1, 2 FROM w WHERE t0.fold = 'of' AND t1.fold = 'this')) WHERE rn = 1",
)


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    """PAT-2, WIN-7"""
    pack = [Rule("DUP", lit("the"), (("first",),)), Rule("DUP", (Token(Test("the|this", regexp=True)),), (("second",),)), Rule("DUP", (Token(Test("of")), Token(Test("this"), marked=True)), (("third",),))]
    got = rules.first_hits(rules.hits(tagged(spark, d), documents(spark, d), pack))
    return got.select("doc_id", "start", "s", "e", F.col("code").alias("id"), "message", F.array_join("suggestions", "|").alias("suggestions"))


QUERIES["rule_dedup_first"] = _dedup
register(
    "suggest_case_transform",
    select("regexp_full_match(t0.text, '(?i)[a-z]+ing')", e="t0.e", suggestion="CASE WHEN upper(t0.text[1]) || regexp_replace(t0.text, '(?:ing|ING)$', 'ed')[2:] = lower(t0.text) THEN lower(t0.text) ELSE upper(t0.text[1]) || regexp_replace(t0.text, '(?:ing|ING)$', 'ed')[2:] || '|' || lower(t0.text) END", id="CASE"),
    Rule("CASE", (Token(Test("[a-z]+ing", regexp=True)),), ((Ref(1, "start_upper", "(?:ing|ING)$", "ed"),), (Ref(1, "lower"),), ("",), (Ref(1, "lower"),))),
)


def rule_regexp_text(spark: SparkSession, d: str) -> DataFrame:
    """PAT-7, PRJ-7: per document, how often a rule over the text hits and what it first proposes"""
    pack = [TextRule("OFTHE", r"\b(of) +(the)\b", ((Ref(2), " ", Ref(1)),), "Turn round \\1.", mark=2)]
    got = rules.text_hits(documents(spark, d), list(enumerate(pack)))
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct("s", F.element_at("suggestions", 1).alias("x")))["x"].alias("first_fix"), F.min("message").alias("message"))


QUERIES["rule_regexp_text"] = rule_regexp_text
SQL["rule_regexp_text"] = r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?i)\bof +the\b') AS ms FROM documents)
SELECT doc_id, len(ms)::BIGINT AS n, regexp_replace(ms[1], '(?i)(of) +(the)', '\2 \1') AS first_fix, 'Turn round ' || list_min(list_transform(ms, lambda x: x[1:2])) || '.' AS message FROM m WHERE len(ms) > 0"""


def noop_guard(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-9"""
    toks = tagged(spark, d).filter("fold in ('the', 'of', 'and')")
    made = F.when(F.col("fold") == "the", F.array(F.lit("the"), F.lit("a"))).when(F.col("fold") == "of", F.array(F.lit("of"))).otherwise(F.array().cast("array<string>"))
    rows = toks.select("doc_id", "s", "e", F.col("text").alias("surface"), made.alias("suggestions"))
    return cascade.without_noops(rows).select("doc_id", "s", "e", F.array_join("suggestions", "|").alias("suggestions"))


QUERIES["noop_guard"] = noop_guard
SQL["noop_guard"] = WITH + """ SELECT doc_id, s, e, CASE WHEN fold = 'the' THEN CASE WHEN text = 'the' THEN 'a' ELSE 'the|a' END WHEN fold = 'of' THEN 'of' ELSE '' END AS suggestions
FROM tagged WHERE fold IN ('the', 'and') OR (fold = 'of' AND text <> 'of')"""


def tag_actions(toks: DataFrame) -> DataFrame:
    t = F.col("tags")
    arr = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    cols = {"soft": disambiguation.replaced(t, arr("NN", "VB")), "more": disambiguation.added(t, arr("NN", "X")), "less": disambiguation.removed(t, "N.*", False), "only": disambiguation.filtered(t, arr("NN", "SENT_END")), "same": disambiguation.filtered(t, arr())}
    return toks.select("doc_id", "tok", *(F.array_join(c, " ").alias(n) for n, c in cols.items()))


def disambig_actions(spark: SparkSession, d: str) -> DataFrame:
    """DIS-3, DIS-4, DIS-5, DIS-6 as column functions on the tags of all tokens"""
    return tag_actions(tagged(spark, d))


QUERIES["disambig_actions"] = disambig_actions
SQL["disambig_actions"] = WITH + """ SELECT doc_id, tok,
array_to_string(CASE WHEN list_has_any(tags, ['NN', 'VB']) THEN list_filter(tags, lambda x: x IN ('NN', 'VB')) ELSE list_concat(tags, ['NN', 'VB']) END, ' ') AS soft,
array_to_string(list_concat(tags, list_filter(['NN', 'X'], lambda x: NOT list_contains(tags, x))), ' ') AS more,
array_to_string(list_filter(tags, lambda x: NOT regexp_full_match(x, 'N.*')), ' ') AS less,
array_to_string(list_filter(tags, lambda x: x IN ('NN', 'SENT_END')), ' ') AS only, array_to_string(tags, ' ') AS same FROM tagged"""


def disambig_sequence(spark: SparkSession, d: str) -> DataFrame:
    """DIS-1, DIS-2: two rules in order over sentences, the second seeing what the first did. No dictionary has HEAD, so
    only tokens over which a rule may lie can get it."""
    pack = [
        disambiguation.TagRule("A", (Token(Test("the")), Token(Test(tag="UNKNOWN"), marked=True)), disambiguation.Action("replace", ("NN",))),
        disambiguation.TagRule("B", (Token(Test(tag="NN"), marked=True), Token(Test("of"))), disambiguation.Action("add", ("HEAD",))),
    ]
    docs = documents(spark, d)
    toks = scratch.table(rules.window_tokens(docs, [r.pattern for r in pack]), "windows")
    done = disambiguation.disambiguated(analysis.analyze(docs, lexicon(spark, analysis.word_counts(docs)), toks=toks), pack, runs=True)
    return done.filter(F.array_contains("tags", "HEAD")).select("doc_id", "tok", F.array_join("tags", " ").alias("tags"))


QUERIES["disambig_sequence"] = disambig_sequence
SQL["disambig_sequence"] = WITH + """, a AS (SELECT *, lag(fold) OVER o AS pf, lead(fold) OVER o AS nf FROM tagged WINDOW o AS (PARTITION BY doc_id, sent ORDER BY tok)),
b AS (SELECT *, CASE WHEN pf = 'the' AND list_contains(tags, 'UNKNOWN') THEN CASE WHEN list_contains(tags, 'NN') THEN ['NN'] ELSE list_append(tags, 'NN') END ELSE tags END AS t2 FROM a)
SELECT doc_id, tok, array_to_string(list_append(t2, 'HEAD'), ' ') AS tags FROM b WHERE list_contains(t2, 'NN') AND nf = 'of'"""


def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    """PAT-8, PAT-10, AGG-6, PRD-12: a pack with rules that cannot run, and why"""
    pack = [Rule("OK", lit("a"), (("b",),)), Rule("LOOK", (Token(Test("a(?=b)", regexp=True)),), (("b",),)), Rule("BACK", (Token(Test(r"(a)\1", regexp=True)),), (("b",),)), Rule("NONE", lit("a"), ()), Rule("REF", lit("a"), ((Ref(3),),))]
    rows = spark.createDataFrame(rules.skip_reasons(pack), "id string, supported boolean, reason string")
    return rows.select("id", F.col("supported").cast("int").alias("supported"), "reason")


QUERIES["rule_coverage"] = rule_coverage
SQL["rule_coverage"] = "SELECT * FROM (VALUES ('OK', 1, ''), ('LOOK', 0, 'regex outside the dialect'), ('BACK', 0, 'regex outside the dialect'), ('NONE', 0, 'no suggestion to render'), ('REF', 0, 'no suggestion to render')) t(id, supported, reason)"


def rule_merged_order(spark: SparkSession, d: str) -> DataFrame:
    """PAT-2, PAT-7, SRT-2: rules over tokens and over the text in one pack; of equal span and code the token rule's hit
    stays, and the order is by start, end and code"""
    pack = [TextRule("OF", r"\bof\b", (("text",),)), TextRule("THE", r"\b(th)e\b", ((Ref(1), "is"),), mark=1), Rule("OF", lit("of"), (("token",),))]
    got = cascade.ordered(rules.first_hits(rules.hits(tagged(spark, d), documents(spark, d), pack)))
    return got.select("doc_id", "rank", "s", "e", "code", F.element_at("suggestions", 1).alias("suggestion"))


QUERIES["rule_merged_order"] = rule_merged_order
SQL["rule_merged_order"] = WITH + """, p AS (SELECT doc_id, regexp_extract_all(text, '(?i)\\bof\\b|\\bthe\\b|\\b') AS ignored FROM documents WHERE false),
a AS (SELECT doc_id, s, e, 'OF' AS code, 'token' AS suggestion FROM tagged WHERE fold = 'of'),
pc AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?i)\\b(?:of|the)\\b')) AS piece, generate_subscripts(regexp_split_to_array(text, '(?i)\\b(?:of|the)\\b'), 1) AS i FROM documents),
mt AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:of|the)\\b')) AS m, generate_subscripts(regexp_extract_all(text, '(?i)\\b(?:of|the)\\b'), 1) AS i FROM documents),
po AS (SELECT mt.doc_id, m, (sum(strlen(piece) + strlen(m)) OVER (PARTITION BY mt.doc_id ORDER BY mt.i) - strlen(m))::BIGINT AS s FROM mt JOIN pc ON pc.doc_id = mt.doc_id AND pc.i = mt.i),
t AS (SELECT doc_id, s, s + 2 AS e, CASE WHEN lower(m) = 'of' THEN 'OF' ELSE 'THE' END AS code, CASE WHEN lower(m) = 'of' THEN 'text' ELSE m[1:2] || 'is' END AS suggestion FROM po),
u AS (SELECT * FROM a UNION ALL SELECT * FROM t WHERE (doc_id, s, e, code) NOT IN (SELECT (doc_id, s, e, code) FROM a))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, code) AS rank, s, e, code, suggestion FROM u""".replace("p AS (SELECT doc_id, regexp_extract_all(text, '(?i)\\bof\\b|\\bthe\\b|\\b') AS ignored FROM documents WHERE false),\n", "")


def large_pack() -> list[Rule]:
    """5,000 rules: a general one for each two first letters of words in -ing, and literal ones for words of three letters."""
    general = [Rule(f"ING_{a}{b}", (Token(Test(f"{a}{b}.*ing", regexp=True)),), ((Ref(1, "upper"),),)) for a in config.LATIN for b in config.LATIN]
    words = [a + b + c for a in config.LATIN for b in config.LATIN for c in config.LATIN]
    return general + [Rule(f"W_{w}", (Token(Test(w)), Token(Test(tag="SENT_END"))), (("x",),)) for w in words[-(5000 - len(general)) :]]


def rule_large_pack(spark: SparkSession, d: str) -> DataFrame:
    """JON-4, PAT-3: a pack of the size of a real one"""
    docs, pack = documents(spark, d), [(k, r) for k, (r, _) in enumerate(rules.prepare(large_pack())) if r]
    toks = rules.window_tokens(docs, [r.pattern for _, r in pack])
    got = rules.hits_in_windows(analysis.analyze(docs, lexicon(spark, analysis.word_counts(docs)), toks=scratch.table(toks, "windows")), pack)
    return got.select("doc_id", "start", "id", F.array_join("suggestions", "|").alias("suggestions"))


QUERIES["rule_large_pack"] = rule_large_pack
SQL["rule_large_pack"] = WITH + AHEAD + r""" SELECT doc_id, tok AS start, 'ING_' || t0.fold[1:2] AS id, upper(t0.text) AS suggestions FROM w WHERE regexp_full_match(t0.text, '(?i)[a-z]{2}.*ing')
UNION ALL SELECT doc_id, tok, 'W_' || t0.fold, 'x' FROM w WHERE regexp_full_match(t0.fold, '[a-z]{3}') AND t0.fold >= '""" + large_pack()[676].id[2:] + """' AND list_contains(t1.tags, 'SENT_END')"""
