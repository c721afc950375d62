"""The stages one by one against what each must keep, on the smallest tables."""

import string

from pyspark.sql import functions as F

import corpus_pipeline
from prosewright.llm.common import documents

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    columns, rows = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        n = got.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert got.columns == columns
        if name in ("quality classifier", "exact dedup", "near dedup"):
            assert 0.5 * rows < n <= rows and got.select("doc_id").distinct().count() == n
        elif name == "mixing":
            assert got.select("doc_id").distinct().count() == rows <= n
        else:
            assert n == rows
        docs, rows = got, n


def test_exact_stage_keeps_the_ids_of_plain_python(spark):
    docs = documents(spark, SF)
    copies = docs.filter("doc_id % 5 = 0").withColumn("doc_id", docs.doc_id + 10**6).withColumn("text", F.upper("text"))
    both = docs.unionByName(copies)
    stays = {}
    for r in both.select("doc_id", "text").collect():
        key = (r.text or "").translate(LOWER)
        stays[key] = max(stays.get(key, r.doc_id), r.doc_id)
    stage = dict(corpus_pipeline.STAGES)["exact dedup"]
    got = [r.doc_id for r in stage(spark, both, SF).select("doc_id").collect()]
    assert sorted(got) == sorted(stays.values()) and len(got) < both.count()
