"""Token counts by an exact length histogram.

Every whole text is encoded and its length counted; documents then aggregate by length. Suffix sums over the lengths
answer, for every context limit: how many documents are at least that long, how many tokens remain when texts are cut
there, and where the quantiles lie. Lengths fall into blocks of BLOCK; sums run within blocks and over the blocks'
totals, so no task holds more than a block's lengths or one row a block.

The encoder's pattern is searched by a machine that recurses on white space, so runs of SPACES or more of it are cut out
and encoded as the one piece that they are; all other text goes to the encoder as it is.

Defined results: a null or empty text has no tokens and counts as length 0; null ids and repeated rows count once
each; an empty table gives an empty histogram, and the answers from it are 0 or null; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosewright.llm.common import documents, lean, small_batches

RANKS, BLOCK, SPACES = "byte_bpe_50k.tiktoken", 2048, 1000
LONG_SPACE = regex.compile(rf"\s{{{SPACES},}}")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level encoder of a rank file, one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ranks_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def n_tokens(encoder, text: str | None) -> int:
    """The length of the encoded text. Of a run of white space before a word, the last character goes with the word."""
    if not text:
        return 0
    total = at = 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._core_bpe.encode_single_piece(text[m.start() : end].encode()))
        at = end
    return total + len(encoder.encode_ordinary(text[at:] if at else text))


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row."""
    small_batches(docs.sparkSession)
    path = path or ranks_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in batches:
            sizes = [n_tokens(encoder, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint")


def histogram(sizes: DataFrame) -> DataFrame:
    """One row a length: n_tokens, docs, docs_at_least, tokens_at_least, tokens_cut (all texts cut at this length),
    docs_below_share (where the length starts among all documents, from 0 to 1)."""
    counts = sizes.groupBy("n_tokens").agg(F.count("*").alias("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("block", *(F.coalesce(F.sum(f"block_{c}").over(after), F.lit(0)).alias(f"{c}_after") for c in ("docs", "tokens")), F.sum("block_docs").over(W.partitionBy()).alias("all_docs"), F.sum("block_tokens").over(W.partitionBy()).alias("all_tokens"))
    within = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = counts.join(blocks, "block")
    out = out.withColumn("docs_at_least", F.col("docs_after") + F.sum("docs").over(within)).withColumn("tokens_at_least", F.col("tokens_after") + F.sum("tokens").over(within))
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select("n_tokens", "docs", "docs_at_least", "tokens_at_least", cut.alias("tokens_cut"), ((F.col("all_docs") - F.col("docs_at_least")) / F.col("all_docs")).alias("docs_below_share"))


def looked_up(hist: DataFrame, found: list[Column], answer, schema: str) -> DataFrame:
    """One pass over the histogram that finds a row for each question, and the answers in the order of the questions."""
    spark = hist.sparkSession
    whole = (F.max("docs_at_least").alias("all_docs"), F.max("tokens_at_least").alias("all_tokens"))
    one = hist.agg(*whole, *(c.alias(f"f{k}") for k, c in enumerate(found)))
    if not found:
        return spark.createDataFrame([], schema)
    return one.select(F.inline(F.array(*(answer(k) for k in range(len(found)))))).to(spark.createDataFrame([], schema).schema)


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: limit, docs_longer, tokens_kept and tokens_lost, exact for any limit, met as a length or not: the
    suffix sums at the first length beyond the limit tell."""
    sums = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
    found = [F.min(F.when(F.col("n_tokens") > n, sums)) for n in limits]

    def answer(k: int) -> Column:
        longer = F.coalesce(F.col(f"f{k}.docs_at_least"), F.lit(0))
        lost = F.coalesce(F.col(f"f{k}.tokens_at_least"), F.lit(0)) - limits[k] * longer
        kept = F.coalesce("all_tokens", F.lit(0)) - lost
        return F.struct(F.lit(limits[k]).cast("bigint").alias("limit"), longer.alias("docs_longer"), kept.alias("tokens_kept"), lost.alias("tokens_lost"))

    return looked_up(hist, found, answer, "limit bigint, docs_longer bigint, tokens_kept bigint, tokens_lost bigint")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length such that at least this share of the documents is no longer."""
    # documents no longer than a length are all but those at least as long, and its own; all are at least as long as the least
    upto = F.col("g_all") - F.col("docs_at_least") + F.col("docs")
    total = hist.agg(F.max("docs_at_least")).first()[0] or 0
    hist = hist.withColumn("g_all", F.lit(total))
    found = [F.min(F.when(upto >= math.ceil(q * total), F.col("n_tokens"))) for q in shares]
    return looked_up(hist, found, lambda k: F.struct(F.lit(float(shares[k])).alias("share"), F.col(f"f{k}").alias("n_tokens")), "share double, n_tokens bigint")


def op3_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(documents(spark, sf_dir)))
