"""The cascade: layers side by side, the no-op guard, the final order, and fixes."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAYERS = ("Spelling", "Grammar", "Statistical", "Neural")
COLUMNS = ("doc_id", "s", "e", "code", "message", "suggestions", "source", "surface")


def stack(layers: list[DataFrame]) -> DataFrame:
    """All diagnostics of all layers; none overrides another (SET-1)."""
    return reduce(lambda a, b: a.unionByName(b), (x.select(*COLUMNS) for x in layers))


def without_noops(found: DataFrame) -> DataFrame:
    """Drops suggestions that equal the text of the span (surface), and diagnostics that had suggestions and lose all
    (PRJ-9)."""
    rest = F.array_remove("suggestions", F.col("surface"))
    kept = found.withColumn("rest", rest).filter((F.size("suggestions") == 0) | (F.size("rest") > 0))
    return kept.withColumn("suggestions", F.col("rest")).drop("rest")


def layer_of(source: Column) -> Column:
    out = F.lit(len(LAYERS))
    for k, name in enumerate(LAYERS):
        out = F.when(source == name, k).otherwise(out)
    return out


def ordered(found: DataFrame) -> DataFrame:
    """rank within each document: by span start, then layer, then the layer's own order, which is by end and code (SRT-1)."""
    by = W.partitionBy("doc_id").orderBy("s", layer_of(F.col("source")), "e", "code")
    return found.withColumn("rank", F.row_number().over(by))


def severity(source: Column) -> Column:
    """error, warning, info or hint, as an editor marks them (PRJ-16)."""
    return F.when(source == "Spelling", "error").when(source == "Grammar", "warning").when(source == "Statistical", "info").otherwise("hint")


def check(layers: list[DataFrame]) -> DataFrame:
    """The whole cascade in its final order. The guard runs by layer, below the union."""
    return ordered(stack([without_noops(x.select(*COLUMNS)) for x in layers]))


def printed(docs: DataFrame, found: DataFrame, name: Column) -> DataFrame:
    """One line per diagnostic: name:line:column CODE "text" -> "fix" (SNK-1). A document's diagnostics meet its text in
    one row, where line starts are found once."""
    fix = F.when(F.size("suggestions") > 0, F.concat(F.lit(' -> "'), F.element_at("suggestions", 1), F.lit('"'))).otherwise("")
    rest = F.concat(F.lit(" "), F.col("code"), F.lit(' "'), F.col("surface"), F.lit('"'), fix)
    by = found.groupBy("doc_id").agg(F.collect_list(F.struct("s", "rank", rest.alias("rest"))).alias("found"))
    rows = docs.select("doc_id", "text", name.alias("name")).join(by, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, label, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "name", "found")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                starts = [0, *(m.end() for m in re.finditer(b"\n", raw))]
                for h in hits:
                    k = bisect_right(starts, h["s"])
                    column = len(raw[starts[k - 1] : h["s"]].decode("utf-8", "replace")) + 1
                    out.append((doc, h["s"], h["rank"], f"{label}:{k}:{column}{h['rest']}"))
            if out:
                kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "s", "rank", "line"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, s bigint, rank int, line string")


def chosen_fixes(found: DataFrame) -> DataFrame:
    """(doc_id, fixes): first suggestions by position, each that doesn't overlap the fixes before it (PRJ-17)."""
    usable = found.filter(F.size("suggestions") > 0)
    one = F.struct("s", "e", F.element_at("suggestions", 1).alias("fix"), "rank")
    lists = usable.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kind = "array<struct<s:bigint,e:bigint,fix:string,rank:int>>"
    picked = F.aggregate("all", F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast(kind).alias("out")), lambda acc, x: F.when(x["s"] >= acc["end"], F.struct(x["e"].alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc))
    return lists.select("doc_id", picked["out"].alias("fixes"))


def fixed_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_fixes, text) of documents with fixes: the text rebuilt from the parts between them."""
    rows = chosen_fixes(found).join(docs.select("doc_id", "text"), "doc_id")
    raw = F.encode("text", "UTF-8")
    rows = rows.withColumn("raw", raw)
    built = F.aggregate(
        "fixes",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["parts"], F.array(F.decode(F.substring(F.col("raw"), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), "UTF-8"), x["fix"])).alias("parts")),
    )
    rows = rows.withColumn("b", built)
    tail = F.decode(F.substring("raw", (F.col("b.at") + 1).cast("int"), F.octet_length("raw")), "UTF-8")
    return rows.select("doc_id", F.size("fixes").alias("n_fixes"), F.concat(F.array_join("b.parts", ""), tail).alias("text"))
