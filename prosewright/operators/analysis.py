"""Layer 0: sentences, tokens with byte spans, dictionary tags, compounds, structural tags and disambiguation.

Texts are cut in Arrow batches, where a row is a whole document, so nothing shuffles for offsets; what is looked up
afterwards are narrow tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright import config
from prosewright.functions.text import ascii_fold, is_digits, starts_upper, strip_marks
from prosewright.operators import compounds, tokenizer

KINDS = {"lang": "string", "text": "string", "gap": "string", "spaced": "boolean", "last": "boolean", "sentinel": "boolean"}


def cut(docs: DataFrame, view: str, columns: tuple[str, ...], **how) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit("en")
    kinds = KINDS | {"doc_id": dict(docs.dtypes)["doc_id"]}
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in columns)
    return docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(tokenizer.cutter(view, columns, **how), schema)


def sentences(docs: DataFrame, breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """Ranges that tile the text (TOK-1): doc_id, lang, sent, s, e, text. breaks are the segmentation rules of languages;
    without any, a sentence ends with white space that holds a line feed or follows terminal punctuation."""
    return cut(docs, "sentences", ("doc_id", "lang", "sent", "s", "e", "text"), breaks=breaks)


def tokens(docs: DataFrame, breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """Tokens in order (TOK-2): doc_id, lang, sent, tok, text, s, e, spaced (PRD-8: the first counts as spaced), last (TAG-5)."""
    return cut(docs, "tokens", ("doc_id", "lang", "sent", "tok", "text", "s", "e", "spaced", "last"), breaks=breaks)


def full_tokens(docs: DataFrame, breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """Tokens as rules see them: an empty one (sentinel) opens each sentence (TOK-3), and clitics of the language are
    tokens of their own (TOK-4). tok numbers them all."""
    return cut(docs, "tokens", ("doc_id", "lang", "sent", "tok", "text", "s", "e", "spaced", "last", "sentinel", "gap"), breaks=breaks, elide=True, sentinels=True)


def word_counts(docs: DataFrame, breaks: tokenizer.Breaks | None = None) -> DataFrame:
    """(lang, text, n): the distinct tokens of full_tokens without sentinels. They are counted where texts are cut, so
    what shuffles are distinct words."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit("en")
    rows = docs.select(lang.alias("lang"), "text").mapInArrow(tokenizer.counter(breaks), "lang string, text string, n bigint")
    return rows.groupBy("lang", "text").agg(F.sum("n").alias("n"))


def occurrences(toks: DataFrame) -> Column:
    """How often words occur: the rows of tokens, or the sum of n of word_counts."""
    return F.sum("n") if "n" in toks.columns else F.count("*")


def token_places(docs: DataFrame) -> DataFrame:
    """Where each token starts: doc_id, tok, text, s (bytes), utf16 (PRJ-15), line and col from 1 (SNK-2)."""
    return cut(docs, "tokens", ("doc_id", "tok", "text", "s", "utf16", "line", "col"))


def tag_shape(surface: Column, lang: Column) -> Column:
    """The tag of a corpus word by its ending, where no dictionary is at hand."""
    en = F.when(surface.rlike("ing$"), "VBG").when(surface.rlike("ed$"), "VBD").when(surface.rlike("ly$"), "RB").when(surface.rlike("[^s]s$"), "NNS").otherwise("NN")
    return F.when(lang == "en", en).otherwise("W")


def stem(surface: Column) -> Column:
    return F.when(F.char_length(surface) > 4, F.regexp_replace(surface, r"(?:ing|ed|ly|s)\z", "")).otherwise(surface)


def corpus_lexicon(toks: DataFrame, least: int) -> DataFrame:
    """(lang, surface, ord, lemma, tag) of lower-cased words that occur least times or more in a language (AGG-1, AGG-4).
    toks are tokens or their word_counts."""
    words = toks.filter(F.col("text").rlike(r"\A\p{L}+\z")).groupBy("lang", F.lower("text").alias("surface")).agg(occurrences(toks).alias("n"))
    return words.filter(F.col("n") >= least).select("lang", "surface", F.lit(0).alias("ord"), stem(F.col("surface")).alias("lemma"), tag_shape(F.col("surface"), F.col("lang")).alias("tag"))


def supplement(triples: DataFrame, added: DataFrame, removed: DataFrame, closed: DataFrame) -> DataFrame:
    """Entries with additions and without removals, and whole surfaces replaced by the closed class (SET-2, JON-11,
    JON-12). ord is an entry's place in its dictionary. The sides' sizes are for the optimizer to weigh."""
    cols = ["lang", "surface", "ord", "lemma", "tag"]
    kept = triples.select(cols).unionByName(added.select(cols)).join(removed, ["lang", "surface", "lemma", "tag"], "left_anti")
    return kept.join(closed.select("lang", "surface").distinct(), ["lang", "surface"], "left_anti").select(cols).unionByName(closed.select(cols))


def group_lexicon(entries: DataFrame) -> DataFrame:
    """(lang, surface, tags, lemmas): per surface the distinct tags and lemmas in dictionary order (AGG-4, SNK-7, PRD-14);
    the first tag is the primary one (JON-9)."""
    ok = entries.filter("surface <> '' and tag <> ''")
    one = F.array_sort(F.collect_set(F.struct("ord", "tag", "lemma")))
    rows = ok.groupBy("lang", "surface").agg(one.alias("a"))
    return rows.select("lang", "surface", F.array_distinct("a.tag").alias("tags"), F.array_distinct("a.lemma").alias("lemmas"))


def primary_tags(entries: DataFrame) -> DataFrame:
    """(surface, pos): the first tag of each surface, of several languages that of the least ord, then by name (JON-9)."""
    ok = entries.filter("surface <> '' and tag <> ''")
    return ok.groupBy("surface").agg(F.min(F.struct("ord", "lang", "tag"))["tag"].alias("pos"))


def analyses(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, text, tags, lemmas) of distinct words: the exact surface's analyses, else the lower-cased one's, never both
    (TAG-1, JON-1), else those of a compound's head (CMP-2), else none. The key is without combining marks (TOK-5)."""
    key = strip_marks(F.col("text"))
    words, lexicon = words.select("lang", "text", key.alias("exact"), F.lower(key).alias("low")), group_lexicon(entries)
    for by, out in (("exact", "x"), ("low", "l")):
        side = lexicon.select("lang", F.col("surface").alias(by), F.col("tags").alias(f"{out}_tags"), F.col("lemmas").alias(f"{out}_lemmas"))
        words = words.join(side, ["lang", by], "left")
    empty = F.array().cast("array<string>")
    pick = lambda c: F.coalesce(F.when(F.col("x_tags").isNotNull(), F.col(f"x_{c}")).otherwise(F.col(f"l_{c}")), empty).alias(c)
    return compounds.with_heads(words.select("lang", "text", pick("tags"), pick("lemmas")), entries)


def lookup(toks: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds tags and lemmas: distinct words are analysed, and tokens then meet what was found. No size is assumed: what
    is small is broadcast by the optimizer, and frequent words are split by adaptive execution where it isn't."""
    found = analyses(toks.filter("text <> ''").select("lang", "text").distinct(), entries).filter(F.size("tags") > 0)
    rows = toks.join(found, ["lang", "text"], "left")
    empty = F.array().cast("array<string>")
    return rows.select(*toks.columns, F.coalesce("tags", empty).alias("tags"), F.coalesce("lemmas", empty).alias("lemmas"))


def analyze(docs: DataFrame, entries: DataFrame, breaks: tokenizer.Breaks | None = None, tag_rules: list | None = None, toks: DataFrame | None = None) -> DataFrame:
    """The whole of layer 0: full_tokens (or those given) with dictionary tags, those of compounds' heads, structural
    tags (the lemmas and fold beside them) and, with tag_rules, disambiguation. entries is a lexicon with ord."""
    out = structural(lookup(full_tokens(docs, breaks) if toks is None else toks, entries))
    if tag_rules:
        from prosewright.operators import disambiguation

        out = disambiguation.disambiguated(out, tag_rules)
    return out


def structural(toks: DataFrame) -> DataFrame:
    """Digit, punctuation, name, unknown, SENT_START and SENT_END tags (TAG-4, TAG-5, TOK-3). Digits lose dictionary tags and lemmas."""
    langs = list(config.LANGS.values())

    def by_lang(pick) -> Column:
        out = F.lit(pick(config.LANGS["en"]))
        for x in langs:
            out = F.when(F.col("lang") == x.code, F.lit(pick(x))).otherwise(out)
        return out

    digit = is_digits(F.col("text"))
    punct = F.lit(False)
    for x in langs:
        punct = F.when(F.col("lang") == x.code, F.col("text").rlike(rf"\A[{x.punctuation}]+\z")).otherwise(punct)
    punct = F.when(F.col("lang").isin(*config.LANGS), punct).otherwise(F.col("text").rlike(rf"\A[{config.PUNCTUATION}]+\z"))
    classes = F.create_map(*(F.lit(v) for kv in config.EN_CLASSES.items() for v in kv))
    extra = F.when((F.col("lang") == "en") & (F.char_length("text") == 1), F.filter(F.array(classes[F.col("text")]), lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))
    marks = F.array_union(F.array_union(F.col("tags"), F.array(by_lang(lambda x: x.punct_tag))), extra)
    bare = F.when(starts_upper(F.col("text")), by_lang(lambda x: x.name_tag)).otherwise(F.lit(config.UNKNOWN))
    tags = F.when(digit, F.array(by_lang(lambda x: x.digit_tag))).when(punct, marks).when(F.size("tags") == 0, F.array(bare)).otherwise(F.col("tags"))
    if "sentinel" in toks.columns:
        tags = F.when(F.col("sentinel"), F.array(F.lit(config.SENT_START))).otherwise(tags)
    tags = F.when(F.col("last"), F.array_union(tags, F.array(F.lit(config.SENT_END)))).otherwise(tags)
    lemmas = F.when(digit, F.array().cast("array<string>")).otherwise(F.col("lemmas"))
    return toks.withColumns({"tags": tags, "lemmas": lemmas, "fold": ascii_fold(F.col("text"))})
