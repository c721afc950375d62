"""Incremental checking: latest revisions, debounced edits and running counts, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from prosewright import scratch
from prosewright.engine import Checker
from prosewright.operators import cascade


def latest(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """The newest revision of each document (STR-2): an aggregate, so a much edited document combines before it shuffles."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(revision), *(c for c in rest if c != revision))).alias("m"))
    return best.select(key, "m.*")


def debounced(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, last, n): runs of edits closer than the gap, each checked once at its end (STR-1). Batch or stream."""
    sessions = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("last"), F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("start"), "last", "n")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed sweep has still to do (STR-6)."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def word_counts_stream(spark: SparkSession, path: str, schema: str):
    """A streaming count of words over files of documents (STR-8); start it in update or complete mode."""
    docs = spark.readStream.schema(schema).parquet(path)
    return docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).filter("w <> ''").groupBy("w").count()


def run_once(stream: DataFrame, sink: str, mode: str, checkpoint: str):
    """Drives a stream over what is there now and stops; the result is in the memory table sink."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(sink)


REVISION = "doc_id bigint, lang string, revision bigint, req_id string, text string"


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """Edited texts as they come, as JSON lines of REVISION (SRC-2); req_id names the request (STR-3)."""
    return spark.readStream.schema(REVISION).json(path)


def latest_stream(stream: DataFrame) -> DataFrame:
    """Of each batch the newest revision of each document, unless an earlier batch had one as new (STR-2). The state of a
    document is one number."""
    schema = stream.schema

    def newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        best = None
        for part in parts:
            row = part.loc[[part["revision"].idxmax()]]
            if best is None or row["revision"].iloc[0] > best["revision"].iloc[0]:
                best = row
        if best is not None and (seen is None or best["revision"].iloc[0] > seen):
            state.update((int(best["revision"].iloc[0]),))
            yield best

    return stream.groupBy("doc_id").applyInPandasWithState(newest, schema, "revision bigint", "append", "NoTimeout")


def check_stream(stream: DataFrame, checker_of: Callable[[str], Checker], sink: str, checkpoint: str):
    """Starts the check of a stream of REVISION: every batch is analysed once and its layers are written one after the
    other, in the order of the checker, so that the first ones can be shown early (STR-4). Rows of the sink name request,
    revision, layer and batch (STR-3); a batch that runs again overwrites what it wrote. checker_of gives the checker of
    a language, from a bounded pool (STR-5)."""

    def run(batch: DataFrame, number: int) -> None:
        rows = latest(batch, "doc_id", "revision").select("doc_id", "lang", "revision", "req_id", "text")
        rows = scratch.table(rows, "batch")
        for lang in sorted(r.lang for r in rows.select("lang").distinct().collect()):
            own = rows.filter(F.col("lang") == lang)
            checker = checker_of(lang)
            tokens = checker.analyzed(own)
            for k, layer in enumerate(checker.layers):
                found = cascade.check([layer.diagnose(tokens, own)]).join(own.select("doc_id", "revision", "req_id"), "doc_id")
                found.write.mode("overwrite").parquet(f"{sink}/batch={number}/lang={lang}/layer={k}_{layer.source}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def sweep(work: DataFrame, key: str, record: str, run: Callable[[DataFrame], DataFrame], size: int = 1000) -> int:
    """Works through keys in order, size at a time, and appends what run gives to the table record after each part; keys
    that record has are skipped, so a sweep that was stopped goes on where it was (STR-6). Gives the number of parts."""
    spark, parts = work.sparkSession, 0
    where = spark._jvm.org.apache.hadoop.fs.Path(record)
    has = lambda: where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    while True:
        left = pending(work, spark.read.parquet(record), key) if has() else work
        part = scratch.table(left.orderBy(key).limit(size), "part")
        if part.isEmpty():
            return parts
        run(part).write.mode("append").parquet(record)
        parts += 1
