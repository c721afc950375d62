"""Mixing sources to target weights by temperature.

The share of each source in all tokens is raised to an exponent and normalised. The exponent is found by bisection,
either so that the weights have a target entropy (as a part of the largest possible, that of equal weights), or as the
least one for which no source must be repeated more often than a limit while every source is read once. The weights
times the token budget are then realised by block permutations: a source's documents fall into blocks by hash, and
each pass over the source takes the blocks in an order of its own and the documents in a block in an order of its
own. Whole passes come first; the last one stops at the document that reaches the budget.

Sums over sources run distributed: every step of the bisection evaluates GRID exponents at once in one aggregate, and
the driver gets GRID numbers. A source that holds a large share of the rows is many blocks. A pass that is read whole
needs no plan; for the one that ends early, the place where it ends is found from totals of groups of GROUP blocks, then
of the blocks of one group, then of the documents of one block. That place, one row a source, is all that the texts
meet: they neither move nor sort.

Defined results: tokens are words (runs without white space), and a document without any counts as one token; a null
source is a source of its own; null doc_ids and repeated rows are documents like any other; documents equal in doc_id,
source and text have the same place in a pass and are read or left together; one source alone has weight 1; an empty
table gives an empty result; columns of docs stay, whatever their names, and the added ones are named mix_pass and
mix_order (existing columns of these names are dropped).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosewright.llm.common import BROADCAST_BYTES, Scratch, boxed, documents, join_groups, unboxed

BLOCK_TOKENS, GROUP, GRID, TURNS = 200_000, 4096, 32, 6
ENTROPY, REPEATS, SEED = 0.97, 1.25, 17


def n_words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.greatest(F.size(F.array_remove(F.split(plain, " "), "")), F.lit(1)).cast("long")


def bisect(measure, low: float, high: float, rising: bool) -> float:
    """The x in [low, high] with measure(x) = 0; measure takes a list of points and gives their values at once."""
    for _ in range(TURNS):
        points = [low + (high - low) * k / (GRID - 1) for k in range(GRID)]
        signs = [(v > 0) == rising for v in measure(points)]
        k = next((k for k, s in enumerate(signs) if s), GRID - 1)
        low, high = points[max(0, k - 1)], points[k]
    return (low + high) / 2


def exponent(shares: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """shares has one row a source, with its share p. The exponent lies between 0 (equal weights) and 1 (as they are)."""
    if repeats is not None:
        ends = shares.agg(F.max("p").alias("high"), F.min("p").alias("low")).first()
        if ends.high is None or ends.high == ends.low:
            return 1.0
        # the most repeated source is the smallest one: (high / low) ** (1 - x) = repeats
        ratio = math.log(ends.high / ends.low)
        return bisect(lambda xs: [math.log(repeats) - ratio * (1 - x) for x in xs], 0.0, 1.0, True)
    n = shares.count()
    if n < 2:
        return 1.0

    def above(points: list[float]) -> list[float]:
        sums = []
        for k, x in enumerate(points):
            q = F.exp(F.lit(x) * F.log("p"))
            sums += [F.sum(q).alias(f"q{k}"), F.sum(q * F.lit(x) * F.log("p")).alias(f"l{k}")]
        got = shares.agg(*sums).first()
        return [math.log(got[f"q{k}"]) - got[f"l{k}"] / got[f"q{k}"] - entropy * math.log(n) for k in range(len(points))]

    if above([1.0])[0] >= 0:  # already as even as asked
        return 1.0
    return bisect(above, 0.0, 1.0, False)


def weigh(sizes: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """Of each source in sizes (g_source, tokens, docs): weight, target tokens, and the passes over it (not whole).

    Without a budget it is the corpus size, or with a limit of repeats the least at which every source is read once.
    """
    total = sizes.agg(F.sum("tokens")).first()[0] or 1
    shares = sizes.withColumn("p", F.col("tokens") / F.lit(float(total)))
    x = exponent(shares.select("p"), entropy, repeats)
    raised = shares.withColumn("q", F.pow("p", F.lit(x)))
    norm = raised.agg(F.sum("q").alias("q"), F.max(F.col("p") / F.col("q")).alias("least")).first()
    if budget is None:
        budget = total if repeats is None else (norm.least or 0.0) * (norm.q or 0.0) * total
    weight = F.col("q") / F.lit(norm.q or 1.0)
    passes = F.lit(float(budget)) * weight / F.col("tokens")
    if repeats is not None:  # rounding must not cut the source that is read exactly once, nor pass the limit
        passes = F.least(F.greatest(F.round(passes, 6), F.lit(1.0)), F.lit(float(repeats)))
    return raised.select("g_source", "tokens", "docs", weight.alias("weight"), (passes * F.col("tokens")).alias("target"), passes.alias("passes"))


def placed(source: Column, doc_id: Column, text: Column, seed: int) -> dict[str, Column]:
    return {"g_source": F.coalesce(source.cast("string"), F.lit("\x00")), "g_hash": F.xxhash64(doc_id, text, F.lit(seed))}


def block_order(turn: Column, block: Column, seed: int) -> Column:
    """Where a block comes in a pass over its source: groups in an order of their own, and the blocks of each."""
    group = F.floor(block / GROUP)
    return F.struct(F.xxhash64(group, turn, F.lit(seed)).alias("group_hash"), group.alias("group"), F.xxhash64(block, turn, F.lit(seed + 1)).alias("block_hash"), block.alias("block"))


def doc_order(turn: Column) -> Column:
    return F.xxhash64("g_hash", turn)


def mix_documents(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = None, budget: int | None = None, seed: int = SEED, marks: bool = True) -> DataFrame:
    """docs with mix_pass and mix_order: a row for each time that a document is read. Order is by (pass, order). Without
    marks the columns are those of docs alone."""
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("mix_pass", "mix_order") if marks else docs
    where = placed(F.col("source"), F.col("doc_id"), F.col("text"), seed)
    light = docs.select(*(v.alias(k) for k, v in where.items()), n_words(F.col("text")).alias("g_tokens"))
    light = light.groupBy("g_source", "g_hash").agg(F.sum("g_tokens").alias("g_tokens"), F.count("*").alias("g_docs"))
    plan, total = plan_reads(scratch.table(light, "tokens"), scratch, entropy, repeats, budget, seed)
    sources, rows = plan.count(), boxed(docs, **where)
    met = rows.join(F.broadcast(plan), "g_source") if sources * 256 <= BROADCAST_BYTES else join_groups(rows, plan, ["g_source"], "docs", total)
    last = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    met = met.withColumn("block", F.pmod("g_hash", "blocks"))
    here = F.struct(block_order(F.col("whole"), F.col("block"), seed).alias("b"), doc_order(F.col("whole")).alias("d"))
    met = met.withColumn("pass", F.explode(F.concat(last, F.when(here <= F.col("end"), F.array("whole")).otherwise(F.array().cast("array<int>")))))
    order = F.struct(block_order(F.col("pass"), F.col("block"), seed).alias("block"), doc_order(F.col("pass")).alias("hash"))
    return unboxed(met, F.col("pass").alias("mix_pass"), order.alias("mix_order")) if marks else unboxed(met)


def plan_reads(light: DataFrame, scratch: Scratch, entropy: float | None, repeats: float | None, budget: int | None, seed: int) -> tuple[DataFrame, int]:
    """One row a source: g_source, docs, blocks, whole (passes read whole) and end, the place of the last document of the
    pass after them, or null where there is none. light holds each place with its tokens and documents."""
    sizes = scratch.table(light.groupBy("g_source").agg(F.sum("g_tokens").alias("tokens"), F.sum("g_docs").alias("docs")), "sources")
    total = sizes.agg(F.sum("docs")).first()[0] or 0
    # a thousandth of a token of slack: a target that equals whole passes up to rounding is met by them
    whole = F.floor((F.col("target") + 1e-3) / F.col("tokens")).cast("int")
    weights = weigh(sizes, entropy, repeats, budget).withColumn("whole", whole).withColumn("room", F.col("target") - F.col("whole") * F.col("tokens"))
    weights = scratch.table(weights.withColumn("blocks", F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)).cast("long")), "weights")
    needed = weights.filter("room > 0.001").select("g_source", "docs", "blocks", "whole", "room")
    dealt = join_groups(light, needed, ["g_source"], "docs", total)
    order = block_order(F.col("whole"), F.pmod("g_hash", "blocks"), seed)
    dealt = scratch.table(dealt.select("g_source", "room", order.alias("b"), doc_order(F.col("whole")).alias("d"), "g_tokens"), "dealt")
    totals = dealt.groupBy("g_source", "room", "b").agg(F.sum("g_tokens").alias("sum"))
    totals = scratch.table(totals.withColumn("g", F.struct("b.group_hash", "b.group")), "totals")
    group = last_in_room(totals.groupBy("g_source", "room", "g").agg(F.sum("sum").alias("sum")), "g", scratch)
    block = last_in_room(totals.join(group.select("g_source", "room", "g", "left"), ["g_source", "room", "g"]), "b", scratch)
    inside = dealt.join(block.select("g_source", "room", "b", "left"), ["g_source", "room", "b"])
    doc = last_in_room(inside.withColumnRenamed("g_tokens", "sum"), "d", scratch)
    ends = block.select("g_source", "b").join(doc.select("g_source", "d"), "g_source").select("g_source", F.struct("b", "d").alias("end"))
    return scratch.table(weights.select("g_source", "docs", "blocks", "whole").join(ends, "g_source", "left"), "plan"), total


def last_in_room(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Of each source's rows, in the order of key: the last one that begins within the room (or left, where that is
    given), and in left what room it has."""
    room = F.col("left") if "left" in rows.columns else F.col("room")
    before = F.coalesce(F.sum("sum").over(W.partitionBy("g_source").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", room - before).filter("left > 0")
    last = rows.groupBy("g_source").agg(F.max(F.struct(key, "room", "left")).alias("m"))
    return scratch.table(last.select("g_source", f"m.{key}", "m.room", "m.left"), f"last-{key}")


def kept_documents(docs: DataFrame, repeats: float = REPEATS) -> DataFrame:
    """The mix as rows of docs' columns: every document once at least, those of small sources up to repeats times."""
    return mix_documents(docs, entropy=None, repeats=repeats, marks=False)


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "mix_pass", F.col("mix_order.block.group_hash").alias("mix_group"), F.col("mix_order.block.block_hash").alias("mix_block"), F.col("mix_order.hash").alias("mix_hash"))
