"""What the operators share: scratch tables, joins that bear hot keys, grouped streams."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes that a broadcast side may have, as counted rows times a bound on the bytes of a row.
BROADCAST_BYTES = 24 << 20
#: Copies of each hot summary that is too large to broadcast.
SALTS = 64
#: Bits that a key has in the bitmaps of may_meet, as far as BROADCAST_BYTES hold them, and bits of one bitmap.
MARK_BITS, BITMAP = 32, 1 << 15
_local_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _local_folders[app]


class Scratch:
    """Tables written to the shared folder, to cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def drop(self, *tables: DataFrame | str) -> None:
        """Deletes tables (or paths) that nothing will read again."""
        for t in tables:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.scratch_path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes df under a folder of its own and deletes all other tables of this scratch."""
        old, self.root = self.root, f"{self.root}-{name}"
        out = self.table(df, name)
        self.drop(old)
        return out


def join_by_size(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int, width: int = 128) -> DataFrame:
    """Broadcasts right when its counted rows, of at most width bytes each, are within BROADCAST_BYTES, and shuffles
    both sides otherwise."""
    return left.join(F.broadcast(right) if rows * width <= BROADCAST_BYTES else right.hint("merge"), on, how)


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, parts: int = 500, width: Column | None = None) -> DataFrame:
    """Inner join of rows with one summary row for each key, where one key may hold a large share of the rows.

    size is the column of groups that counts a key's rows, total their sum. Keys with over total/parts rows number
    fewer than parts, so their summaries are broadcast; all other keys meet by a shuffle, in which none is large.
    width is the bytes of a summary where no small bound is known: if the hot ones together pass BROADCAST_BYTES, they
    are repeated SALTS times and their rows dealt over the repetitions instead.
    """
    hot = groups.filter(F.col(size) * parts > total)
    cold = groups.filter(F.col(size) * parts <= total)
    ids = F.broadcast(hot.select(*key))
    rest = rows.join(ids, key, "left_anti").join(cold.hint("merge"), key)
    if width is None or (hot.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hot), key).unionByName(rest)
    dealt = hot.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.join(ids, key, "left_semi").withColumn("g_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return met.join(dealt.hint("merge"), [*key, "g_salt"]).drop("g_salt").unionByName(rest)


def may_meet(rows: DataFrame, keys: DataFrame, on: list[str], scratch: Scratch) -> DataFrame:
    """Adds the boolean column g_meets, false only for rows that no row of keys equals in the columns on.

    Keys set one bit each of bitmaps that are broadcast, so wide rows without a partner need not shuffle. Where keys pass
    what BROADCAST_BYTES hold, more rows without one are let through; none with one is kept back.
    """
    bits = max(1, min(-(-keys.count() * MARK_BITS // BITMAP), BROADCAST_BYTES * 8 // BITMAP)) * BITMAP
    cell = F.pmod(F.xxhash64(*on), F.lit(bits)).alias("g_cell")
    bitmaps = keys.select(cell).groupBy(F.expr("bitmap_bucket_number(g_cell)").alias("g_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(g_cell))").alias("g_bitmap"))
    told = rows.select("*", cell).join(F.broadcast(scratch.table(bitmaps, "bitmaps")), F.expr("bitmap_bucket_number(g_cell) = g_bucket"), "left")
    at = F.expr("cast(bitmap_bit_position(g_cell) as int)")
    byte = F.conv(F.hex(F.substring("g_bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return told.select(*rows.columns, F.coalesce(F.bit_get(byte, at.bitwiseAND(7)) == 1, F.lit(False)).alias("g_meets"))


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one struct column g_box, beside the keys that are computed from its columns; so no name can clash."""
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("g_box")
    return docs.select(whole, *(v.alias(k) for k, v in keys.items()))


def unboxed(df: DataFrame, *more: Column) -> DataFrame:
    """The columns of g_box again, and more behind them."""
    return df.select("g_box.*", *more)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by key: tables of whole groups, with the borders of the groups in each."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        values = table.column(key).to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        if not len(cuts):
            rest = table
            continue
        yield table.slice(0, cuts[-1]), np.concatenate(([0], cuts))
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def lean(run):
    """The same batch function, which gives freed memory back to the system when its task ends: workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch: texts may be long, and both sides hold a batch at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser on unsigned integers (multiply and shift rounds with fixed constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))
