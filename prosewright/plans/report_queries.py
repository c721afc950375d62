"""Queries of reports, inspections and the language registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosewright import config
from prosewright.operators import analysis, reports
from prosewright.plans.base import LEXICON, TAGGED, TOKENS, documents, read, tagged

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query(f"""WITH {TOKENS}, x AS (SELECT lang, string_agg(piece, '' ORDER BY i) AS t FROM pieces GROUP BY doc_id, lang, sent)
SELECT lang, count(*) AS sentences, count(DISTINCT t) AS distinct_sentences FROM x GROUP BY 1""")
def distinct_sentences(spark: SparkSession, d: str) -> DataFrame:
    """SET-3"""
    docs = documents(spark, d)
    counts = analysis.sentences(docs).groupBy("lang", F.col("text").alias("t")).agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.sum("n").alias("sentences"), F.count("*").alias("distinct_sentences"))


@query(f"WITH RECURSIVE {TOKENS}, {LEXICON}, {TAGGED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    """SRT-6, AGG-12"""
    return reports.top(tagged(spark, d).select(F.explode("tags").alias("tag")), "tag", 10)


@query(r"""SELECT doc_id, CASE WHEN length(text) > 12 THEN text[1:12] || '…' ELSE text END AS head, text[-9:] AS tail,
CASE WHEN regexp_extract(text, 'the[^0-9]*([0-9]+)', 1) <> '' THEN regexp_extract(text, 'the[^0-9]*([0-9]+)', 1)::BIGINT END AS num, length(text) AS plain,
upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS title FROM documents""")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """FN-9, on all documents"""
    colour = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m"))
    return read(spark, d, "documents").select(
        "doc_id", reports.truncate(F.col("text"), 12).alias("head"), reports.tail(F.col("text"), 9).alias("tail"), reports.number_after(F.col("text"), "the").alias("num"),
        F.char_length(reports.strip_ansi(colour)).cast("bigint").alias("plain"), reports.title_case(F.concat_ws(" ", "lang", "source")).alias("title"),
    )


@query("SELECT lang, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def bytes_by_language(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19"""
    return documents(spark, d).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))


@query("""SELECT event_type AS version, row_number() OVER (ORDER BY length(event_type), event_type) - 1 AS place, count(*) AS n FROM events GROUP BY 1
QUALIFY length(event_type) >= (SELECT min(length(event_type)) FROM events) + 1""")
def version_slice(spark: SparkSession, d: str) -> DataFrame:
    """SRT-7: from one to the last in an order of its own (by length), not by spelling"""
    rows = read(spark, d, "events").groupBy(F.col("event_type").alias("version")).agg(F.count("*").alias("n"))
    order = rows.select("version", (F.row_number().over(W.orderBy(F.char_length("version"), "version")) - 1).alias("at"))
    names = [r.version for r in order.orderBy("at").collect()]  # a handful of kinds
    first = next(v for v in names if len(v) > len(names[0]))
    return reports.between_versions(rows, order, first, names[-1]).select("version", F.col("at").alias("place"), "n")


@query("""SELECT 'd' || doc_id AS name, n_chars AS gzip_bytes, CASE WHEN doc_id % 2 = 1 THEN n_chars // 2 END AS brotli_bytes FROM documents""")
def manifest_lifting(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-23: entries made of the documents, the even ones in the old shape"""
    docs, name = read(spark, d, "documents"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    old = F.to_json(F.struct(name, F.col("n_chars").alias("bytes")))
    new = F.to_json(F.struct(name, F.struct(F.col("n_chars").alias("bytes")).alias("gzip"), F.struct(F.floor(F.col("n_chars") / 2).alias("bytes")).alias("brotli")))
    return reports.lifted_manifest(docs.select(F.when(F.col("doc_id") % 2 == 0, old).otherwise(new).alias("value")))


@query("SELECT lang || ':' || source AS tag, count(*) + count_if(doc_id % 3 = 0) AS n FROM documents GROUP BY 1")
def tag_references(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13: rule lines made of the documents, every third of which names its tag twice"""
    tag = F.concat(F.lit('<token postag="'), F.col("lang"), F.lit(":"), F.col("source"), F.lit('"/>'))
    return reports.tag_references(read(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.concat(tag, F.lit(" x "), tag)).otherwise(tag).alias("value")))


@query("SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK-13"""
    return reports.markdown(documents(spark, d).groupBy("lang").agg(F.count("*").alias("n")), ["lang", "n"])


#: What the registry must hold, written out: digits, punctuation and name tags; letters, clitics and links; flags.
REGISTRY = """SELECT * FROM (VALUES
('en', 'CD', 'PCT', 'NNP', 26, 0, 0, false, true, true, 'resources/en/grammar'),
('de', 'ZAN', 'PKT', 'EIG:NOM:SIN:MAS', 26, 0, 8, false, true, false, 'resources/de/grammar'),
('ru', 'NumC:Nom', 'PNCT', 'NN:Name:Masc:Sin:Nom', 33, 0, 0, false, true, false, 'resources/ru/grammar'),
('ar', 'CD', 'PCT', 'NA-;-1U-;---', 37, 0, 0, true, false, false, 'resources/ar/grammar'),
('fr', 'Y', 'M', 'Z', 42, 15, 0, false, true, false, 'resources/fr/grammar'),
('es', 'Z', '_PUNCT', 'NP00000', 33, 0, 0, false, true, false, 'resources/es/grammar'),
('it', 'DET-NUM-CARD', 'PON', 'NPR', 36, 22, 0, false, false, false, 'resources/it/grammar')
) t(code, digit_tag, punct_tag, name_tag, letters, clitics, links, strip_marks, confusion, neural, grammar_path)"""


@query(REGISTRY)
def lang_config(spark: SparkSession, d: str) -> DataFrame:
    """FN-10 and the registry of languages"""
    rows = [(x.code, x.digit_tag, x.punct_tag, x.name_tag, len(x.alphabet), len(x.clitics), len(x.links), x.strip_marks, x.confusion, x.neural, config.artifact(x.code, "grammar")) for x in config.LANGS.values()]
    return spark.createDataFrame(rows, "code string, digit_tag string, punct_tag string, name_tag string, letters int, clitics int, links int, strip_marks boolean, confusion boolean, neural boolean, grammar_path string")
