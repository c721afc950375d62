"""From raw documents to an encoded training mix: the stages in order, each written and reread as the next one's input.

The quality classifier drops documents that it rejects, exact dedup all but one row of equal texts (A-Z folded), near
dedup all but one text of each group of linked ones, and mixing reads sources anew up to a limit, every document at least
once. All of them keep the columns of their input, whatever their names; the last gives doc_id, n_tokens, hashes and ids.

Defined results: null and empty texts are scored like any other and count as equal texts, so one of them stays if the
classifier keeps any; they link with nothing, weigh one token and encode to no ids. A null doc_id or source is a value
like any other. Rows that repeat one doc_id and text are one text. Empty tables give empty results.
"""

from pyspark.sql import DataFrame, SparkSession

from prosewright.llm import bpe, exact_dedup, mixing, near_dedup, quality
from prosewright.llm.common import Scratch, documents


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_documents(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.kept_documents(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, outputs=("ids",))


STAGES = [("quality classifier", _quality), ("exact dedup", _exact), ("near dedup", _near), ("mixing", _mix), ("bpe encoding", _encode)]

#: SQL cannot express the stages that learn or draw. tests/llm compares what the first three stages keep with plain Python
#: on the smallest tables, the mix with plain loops, and the ids with the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded rows of all stages; a document that the mix reads twice is there twice."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name.replace(" ", "-"))
    return docs
