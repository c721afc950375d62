"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts how often each cell of a Bloom filter is hit and keeps the cells hit twice or more, as a bitmap.
Pass two lets a hash through only if all its cells are kept: those rows, every true copy among them, shuffle and are
grouped by their digest. All other rows are alone for certain and pass straight through.

The filter has BITS_PER_ROW bits a row at any size. Beyond RANGE_BITS (32 MB of bitmaps, the bound of its broadcast) it
is cut into ranges of the hash, each a filter of its own: rows are filed by range, and each range's filter is built,
broadcast to that range's rows and dropped before the next. What moves in pass one are the cells, two integers a row,
added up before they move: whether a cell is hit twice cannot be told from bitmaps of single tasks without all of them.

Defined results: a null text counts as empty; a null doc_id loses to any other and may stay only among nulls; of rows
repeated with one doc_id, exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.common import BROADCAST_BYTES, Scratch, boxed, documents, join_groups, unboxed

BITS_PER_ROW, MIN_BITS, RANGE_BITS, HASHES = 32, 1 << 16, 1 << 28, 2
#: Rows that one task files by range: so many files that a table has times its ranges.
FILED_ROWS = 4_000_000


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def cell(digest: str, k: int, bits: int) -> Column:
    """The k-th cell of a digest: 52 of its bits, as the digest is uniform."""
    return F.pmod(F.conv(F.substring(digest, 1 + 13 * k, 13), 16, 10).cast("long"), F.lit(bits)).cast("int")


def range_of(digest: str, ranges: int) -> Column:
    """The range of a digest, by bits that no cell uses."""
    return F.pmod(F.conv(F.substring(digest, 40, 13), 16, 10).cast("long"), F.lit(ranges)).cast("int")


def digests(docs: DataFrame) -> DataFrame:
    """One scan of the texts: row number, doc_id and the SHA-256 of the normalised text."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))


def repeated_cells(rows: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the cells that two or more rows hit."""
    cells = rows.select(F.explode(F.array_distinct(F.array(*(cell("text_sha256", k, bits) for k in range(HASHES))))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bitmap"))


def may_repeat(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Adds the boolean column suspect: whether all cells of the row are set. bitmaps has bits/32768 rows at most."""
    out, suspect = rows, F.lit(True)
    for k in range(HASHES):
        kept = F.broadcast(bitmaps.select(F.col("bucket").alias(f"b{k}"), F.col("bitmap").alias(f"m{k}")))
        out = out.withColumn(f"c{k}", cell("text_sha256", k, bits)).join(kept, F.expr(f"bitmap_bucket_number(c{k}) = b{k}"), "left")
        at = F.expr(f"cast(bitmap_bit_position(c{k}) as int)")
        byte = F.conv(F.hex(F.substring(f"m{k}", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        suspect = suspect & F.coalesce(F.bit_get(byte, at.bitwiseAND(7)) == 1, F.lit(False))
    return out.select(*rows.columns, suspect.alias("suspect"))


def filtered(rows: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """rows with the column suspect, by one filter or by one for each range of the hash."""
    wanted = max(n, 1) * BITS_PER_ROW
    ranges = -(-wanted // RANGE_BITS)
    bits = max(MIN_BITS, min(RANGE_BITS, 1 << (wanted - 1).bit_length()))
    if ranges == 1:
        return scratch.table(may_repeat(rows, scratch.table(repeated_cells(rows, bits), "cells"), bits), "marked")
    filed, marked = scratch.path("filed"), scratch.path("marked")
    few = rows.withColumn("g_range", range_of("text_sha256", ranges)).coalesce(-(-n // FILED_ROWS))
    few.write.partitionBy("g_range").option("compression", "zstd").parquet(filed)
    schema = may_repeat(rows, repeated_cells(rows, bits), bits).schema
    for k in range(ranges):
        part = rows.sparkSession.read.schema(rows.schema).parquet(f"{filed}/g_range={k}") if scratch.exists(f"{filed}/g_range={k}") else rows.limit(0)
        cells = scratch.table(repeated_cells(part, bits), f"cells{k}")
        may_repeat(part, cells, bits).write.mode("append").option("compression", "zstd").parquet(marked)
        scratch.drop(cells)
    scratch.drop(filed)
    return rows.sparkSession.read.schema(schema).parquet(marked)


def marked_groups(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """All rows with suspect, and for the suspects' digests text_sha256, group_size, keep_id and keep_row."""
    rows = scratch.table(digests(docs), "digests")
    n = rows.count()
    marked = filtered(rows, n, scratch)
    best = F.max(F.struct(F.col("doc_id"), F.col("row")))
    groups = marked.filter("suspect").groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("best"))
    return marked, scratch.table(groups.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups"), n


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256. The row with the largest doc_id stays."""
    scratch = Scratch(docs.sparkSession, "exact")
    marked, groups, n = marked_groups(docs, scratch)
    alone = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    met = join_groups(marked.filter("suspect"), groups, ["text_sha256"], "group_size", n)
    met = met.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return scratch.result(alone.unionByName(met))


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept. Of rows that share doc_id and text, one stays."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = exact_dedup(docs.select("doc_id", "text"))
    key = ("g_id", "g_sha")
    lost = found.filter("group_size > 1").groupBy(F.col("doc_id").alias("g_id"), F.col("text_sha256").alias("g_sha")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    lost = scratch.table(lost.filter("not kept or n > 1"), "lost")
    rows = boxed(docs, g_id=F.col("doc_id"), g_sha=F.sha2(normalised(F.col("text")).cast("binary"), 256))

    def of(other: DataFrame, how: str, left: DataFrame) -> DataFrame:
        right = other.select(*(F.col(c).alias(f"{c}_lost") for c in key))
        right = F.broadcast(right) if other.count() * 160 <= BROADCAST_BYTES else right
        return left.join(right, F.col("g_id").eqNullSafe(F.col("g_id_lost")) & (F.col("g_sha") == F.col("g_sha_lost")), how)

    rest = of(lost, "left_anti", rows)
    again = lost.filter("kept")
    if again.isEmpty():
        return unboxed(rest)
    return unboxed(rest.unionByName(of(again, "left_semi", rows).dropDuplicates(list(key))))


def op5_exact_dedup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
