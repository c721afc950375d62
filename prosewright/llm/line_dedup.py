"""Line dedup by content-defined chunks.

A text's lines are hashed, and a rolling hash over WINDOW line hashes ends a chunk where it is 0 modulo DIVISOR, once
the chunk has SHORTEST lines, or at LONGEST lines. A boundary so depends on the lines around it alone, and inserted or
deleted lines shift no boundaries but their neighbours'. Chunks of several lines whose hash occurs again anywhere are
compared byte by byte with the first occurrence (the least doc_id, then place), and those that are equal are removed.

A chunk repeats only where it lies whole inside what two texts share, so chunks alone leave most short passages. With
passages=True, as the query has it, the least runs of lines with over WORDS words that start or end at each line are
compared in the same way. What such a run is depends on its own lines alone, so all of those inside a shared passage of
over WORDS words, of one line or more, occur again in each of its copies, and together they cover its lines with words.

Only hashes shuffle for the counts. Then the texts that hold a repeated chunk, found by bitmaps, shuffle once for the
bytes of those chunks, the bytes meet the first occurrence's, and the texts that lose something shuffle once more; all
other texts stay where they are. A chunk that a large share of all documents holds is one key: its counts add up before
the shuffle, and its occurrences meet the first one in the join of hot keys, by broadcast while the hot bytes are few
and dealt over copies of them otherwise.

Defined results: a null text counts as empty and has no chunk; lines without a word count as lines; a chunk of one line
stays unless it is a passage; a null doc_id sorts last among occurrences; rows equal in doc_id and text are one document
and get the same result; texts that lose all lines become empty; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch, documents, join_groups, lean, may_meet, small_batches

WINDOW, DIVISOR, SHORTEST, LONGEST = 2, 3, 2, 16
WORDS = 50
NO_ID = (1 << 63) - 1


def boundaries(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks of a text's lines, as ranges that tile them."""
    h = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, start = [], 0
    for k in range(len(lines)):
        n = k + 1 - start
        rolling = sum(x * (2 * j + 3) for j, x in enumerate(h[max(0, k + 1 - WINDOW) : k + 1])) & 0xFFFFFFFFFFFFFFFF
        if n >= SHORTEST and (rolling >> 17) % DIVISOR == 0 or n == LONGEST:
            out.append((start, k + 1))
            start = k + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def passages(lines: list[bytes]) -> set[tuple[int, int]]:
    """The least ranges of lines with over WORDS words (runs without white space) from each line with a word on, and up
    to each."""
    counts = [(k, n) for k, n in enumerate(len(x.split()) for x in lines) if n]
    out, total, j = set(), 0, 0
    for k, n in counts:
        while total <= WORDS and j < len(counts):
            total += counts[j][1]
            j += 1
        if total <= WORDS:
            break
        out.add((k, counts[j - 1][0] + 1))
        total -= n
    total = i = 0
    for k, n in counts:
        total += n
        while total - counts[i][1] > WORDS:
            total -= counts[i][1]
            i += 1
        if total > WORDS:
            out.add((counts[i][0], k + 1))
    return out


def ranges(lines: list[bytes], whole: bool) -> list[tuple[int, int]]:
    """What is compared, in the order of places: chunks of several lines and, if whole, passages; each range once."""
    several = [x for x in boundaries(lines) if x[1] - x[0] > 1]
    return sorted({*several} | passages(lines)) if whole else several


def disjoint(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def split_lines(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def signed_hash(chunk: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(chunk)
    return h - (1 << 64) if h >> 63 else h


def chunks(rows: DataFrame, whole: bool) -> DataFrame:
    """(row, doc, k, h, size) of what is compared, k being its place among the ranges; h is a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc", "text")), strict=True):
                lines = split_lines(text)
                for k, (a, b) in enumerate(ranges(lines, whole)):
                    chunk = b"\n".join(lines[a:b])
                    out.append((row, doc, k, signed_hash(chunk), len(chunk)))
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc", "k", "h", "size"])

    return rows.select("row", "doc", "text").mapInArrow(lean(run), "row binary, doc bigint, k int, h bigint, size bigint")


def numbered(docs: DataFrame) -> DataFrame:
    """row names a row by 128 bits of the SHA-256 of its doc_id and text."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    row = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), row.alias("row"), "text")


def removed_chunks(docs: DataFrame, scratch: Scratch, whole: bool) -> DataFrame:
    """(row, ks): the chunks of each row that repeat an earlier one, confirmed by their bytes."""
    rows = numbered(docs)
    seen = scratch.table(chunks(rows, whole), "chunks")
    repeated = scratch.table(seen.groupBy("h", "size").agg(F.count("*").alias("n")).filter("n > 1").select("h", "size"), "repeated")
    again = scratch.table(may_meet(seen, repeated, ["h", "size"], scratch).filter("g_meets").drop("g_meets"), "again")
    scratch.drop(seen, repeated)
    place = F.struct("doc", "row", "k")
    groups = again.groupBy("h", "size").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    groups = scratch.table(groups, "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_first = (F.col("first.row") == F.col("row")) & (F.col("first.k") == F.col("k"))
    met = join_groups(again, groups, ["h", "size"], "n", total).select("row", F.struct("k", "n", is_first.alias("first")).alias("k"))
    wanted = scratch.table(met.groupBy("row").agg(F.collect_set("k").alias("ks")), "wanted")
    scratch.drop(again, groups)
    return confirm(rows, wanted, scratch, whole)


def confirm(rows: DataFrame, wanted: DataFrame, scratch: Scratch, whole: bool) -> DataFrame:
    """The wanted occurrences, less those whose bytes differ from the first one's. Only texts that hold any move, once,
    and their bytes are cut out then and there."""
    texts = may_meet(rows, wanted, ["row"], scratch).filter("g_meets").groupBy("row").agg(F.first("text").alias("text"))
    cut = scratch.table(picked(texts.join(wanted.hint("merge"), "row"), whole), "bytes")
    firsts = cut.filter("first").select("h", "size", "n", F.col("chunk").alias("first_chunk"))
    others = cut.filter("not first").select("h", "size", "row", "k", "chunk")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    same = join_groups(others, firsts, ["h", "size"], "n", total, width=F.col("size")).filter("chunk = first_chunk")
    removed = scratch.table(same.groupBy("row").agg(F.array_sort(F.collect_set("k")).alias("ks")), "removed")
    scratch.drop(cut, wanted)
    return removed


def picked(rows: DataFrame, whole: bool) -> DataFrame:
    """(row, k, h, size, n, first, chunk) of the chunks ks of each row, given as structs of k, n and first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, ks, text in zip(*(batch.column(c).to_pylist() for c in ("row", "ks", "text")), strict=True):
                lines = split_lines(text)
                spans = ranges(lines, whole)
                for x in ks:
                    chunk = b"\n".join(lines[slice(*spans[x["k"]])])
                    out.append((row, x["k"], signed_hash(chunk), len(chunk), x["n"], x["first"], chunk))
            if out:
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "k", "h", "size", "n", "first", "chunk"])

    return rows.select("row", "ks", "text").mapInArrow(lean(run), "row binary, k int, h bigint, size bigint, n bigint, first boolean, chunk binary")


def line_dedup(docs: DataFrame, passages: bool = False) -> DataFrame:
    """One row a document: doc_id, text (what stays), n_lines, n_removed_lines, n_removed_chunks, text_sha256, spans
    (byte ranges that went, as arrays of start and end in the text). With passages, repeated passages of over WORDS
    words go beside repeated chunks, and ranges that overlap count as one chunk and one span."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    rows = numbered(docs)
    gone = removed_chunks(docs, scratch, passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for ks, text in zip(batch.column("ks").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = split_lines(text)
                places = ranges(lines, passages) if ks else []
                drop = disjoint([places[k] for k in ks or []])
                starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
                spans, stay, at = [[starts[a], starts[b]] for a, b in drop], [], 0
                for a, b in [*drop, (len(lines), len(lines))]:
                    stay += lines[at:a]
                    at = b
                lost = len(lines) - len(stay)
                left = b"\n".join(stay)
                for c, v in zip(cols, (left.decode("utf-8", "surrogatepass"), len(lines), lost, len(drop), hashlib.sha256(left).hexdigest(), spans), strict=True):
                    c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks", "text_sha256", "spans"])

    told = may_meet(rows, gone, ["row"], scratch)
    whole = told.filter("not g_meets").select("doc_id", "text", F.lit(None).cast("array<int>").alias("ks"))
    joined = whole.unionByName(told.filter("g_meets").join(gone.hint("merge"), "row", "left").select("doc_id", "text", "ks"))
    return joined.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n_lines bigint, n_removed_lines bigint, n_removed_chunks bigint, text_sha256 string, spans array<array<bigint>>")


def op4_line_dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir), passages=True).drop("spans")
