"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text gets plain statistics and, from them, a vector of transformed ratios. Each language and source, each
language and the whole table (the levels) get a minimum-covariance-determinant estimate. It has three starts: medians
and quartile ranges, the scatter of the standardised vectors bent by tanh, and that of their directions alone. From
each, concentration steps take mean and covariance of the SHARE of the vectors that lie nearest, until a step lowers
the determinant by less than STILL; of the starts the one with the least determinant stays, and a last step takes all
within the 97.5 % ellipsoid. A document goes if a base rule fails or its squared Mahalanobis distance passes the cutoff.

An estimate is drawn towards that of the level above as if SHRINK vectors of that were added, and that of the whole
table towards the variances WIDE. So a language and source of any size has its own estimate, which counts the more the
more documents it has; there is no size at which the rule changes. FLOORS are the least standard deviations, so that a
statistic that hardly varies doesn't reject small deviations.

Defined results: a null or empty text has no words and fails the base rule; a null language or source is a group of
its own; null doc_ids and repeated rows are judged each like any other row; an empty table gives an empty result;
other columns are ignored. Windows of words are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.common import BROADCAST_BYTES, Scratch, documents, join_groups

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals")
FLOORS = {"word_length": 0.06, "symbols": 0.25, "dup_lines": 0.12, "repeats": 0.10, "capitals": 0.06}
WIDE = {"word_length": 0.6, "symbols": 1.5, "dup_lines": 0.6, "repeats": 0.6, "capitals": 0.5}
SHARE, STILL, SHRINK, REJECT = 0.75, 0.01, 100, 1e-7
P = range(len(FEATURES))
MEANS = [f"m{i}" for i in P]
CELLS = [f"s{i}{j}" for i in P for j in range(i + 1)]
FACTOR = [f"l{i}{j}" for i in P for j in range(i + 1)]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def settle(df: DataFrame, *cols: Column) -> DataFrame:
    """Adds columns that are computed once a row, even where later expressions use them often or in lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of whole texts, with n_lines and n_capitals for the vector."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    bare = F.translate("text", SPACES, "")
    plain = F.translate("text", SPACES, " " * len(SPACES))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    docs = settle(docs, F.array_remove(F.split(plain, " "), "").alias("w"), lines.alias("lines"), bare.alias("bare"))
    n = F.size("w")
    count = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), count), F.slice("w", F.lit(2), count), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice("w", F.lit(3), count), lambda h, c: F.xxhash64(h, c))
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = settle(
        docs,
        F.size("w").cast("long").alias("n_words"),
        F.char_length("bare").cast("long").alias("word_chars"),
        (F.char_length("bare") - F.char_length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.char_length("bare") - F.char_length(F.regexp_replace("bare", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        F.when(n > 2, ranked).alias("ranked"),
    ).drop("w", "lines", "bare", "text")
    m = F.size("ranked")
    twice = F.zip_with(F.slice("ranked", F.lit(1), m - 1), F.slice("ranked", F.lit(2), m - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    docs = docs.withColumn("n_repeat_words", F.when(m > 1, covered).otherwise(0).cast("long")).drop("ranked")
    return docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """Ratios on scales on which their spread hardly depends on their level."""
    return [
        F.log(F.col("word_chars") / F.col("n_words")).alias("word_length"),
        F.asinh(20 * F.col("n_symbols") / F.col("n_words")).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(8))).alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / F.col("n_words")).alias("repeats"),
        F.asin(F.sqrt(F.col("n_capitals") / F.col("word_chars"))).alias("capitals"),
    ]


def chi2_cdf(x: float, df: int) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    a, term, total, n = df / 2, 2 / df, 2 / df, 0
    while term > total * 1e-15 and n < 10_000:
        n += 1
        term *= x / 2 / (a + n)
        total += term
    return min(1.0, total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return high


def scatter(x: DataFrame, consistency: float) -> DataFrame:
    """By stratum and, where x has it, start: n, mean and covariance, with the floors on its diagonal, and its factor."""
    keys = [c for c in ("stratum", "start") if c in x.columns]
    cov = [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"s{i}{j}") for i in P for j in range(i + 1)]
    out = x.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)), *cov)
    cells = [(F.col(f"s{i}{j}") * consistency + (FLOORS[FEATURES[i]] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i in P for j in range(i + 1)]
    return factored(out.select(*keys, "n", *MEANS, *cells))


def factored(fits: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor of the covariance, and the log of its determinant."""
    out = fits
    for j in P:  # column by column, each computed once
        inner = reduce(add, (F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = settle(out, F.sqrt(F.greatest(F.col(f"s{j}{j}") - inner, F.lit(FLOORS[FEATURES[j]] ** 2 / 100))).alias(f"l{j}{j}"))
        if below := [((F.col(f"s{i}{j}") - reduce(add, (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")).alias(f"l{i}{j}") for i in P if i > j]:
            out = settle(out, *below)
    return out.withColumn("log_det", 2 * reduce(add, (F.log(f"l{i}{i}") for i in P)))


def spread(x: DataFrame) -> DataFrame:
    """By stratum: medians c, and standard deviations w by quartile ranges, with the floors."""
    mids = x.groupBy("stratum").agg(*(F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i, f in enumerate(FEATURES)))
    wide = [F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[f] ** 2).alias(f"w{i}") for i, f in enumerate(FEATURES)]
    return mids.select("stratum", *(F.col(f"q{i}")[1].alias(f"c{i}") for i in P), *wide)


def bent() -> Column:
    """The vectors of the second and third start: by each coordinate's tanh, and by direction."""
    z = [(F.col(f) - F.col(f"c{i}")) / F.col(f"w{i}") for i, f in enumerate(FEATURES)]
    norm = F.sqrt(reduce(add, (v * v for v in z)))
    ways = [[F.tanh(v) for v in z], [F.when(norm > 0, v / norm).otherwise(0.0) for v in z]]
    return F.array(*(F.struct(F.lit(k + 1).alias("start"), *((F.col(f"c{i}") + F.col(f"w{i}") * way[i]).alias(f) for i, f in enumerate(FEATURES))) for k, way in enumerate(ways)))


def distance() -> Column:
    """The squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        z.append(reduce(lambda a, k: a - F.col(f"l{i}{k}") * z[k], range(i), F.col(f) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return reduce(add, (v * v for v in z))


class Strata:
    """The vectors, each in a stratum of every level, and joins with what is known of each stratum."""

    def __init__(self, scratch: Scratch, passed: DataFrame):
        lang, both = F.concat_ws("\x1f", F.lit("lang"), "g_lang"), F.concat_ws("\x1f", F.lit("own"), "g_lang", "g_source")
        self.rows = scratch.table(passed.withColumn("own", both).withColumn("lang", lang).drop("g_lang", "g_source"), "vectors")
        levels = F.array("own", "lang", F.lit("all"))
        self.points = self.rows.select(F.explode(levels).alias("stratum"), *FEATURES)
        self.sizes = scratch.table(self.points.groupBy("stratum").agg(F.count("*").alias("n_stratum")), "sizes")
        found = self.sizes.agg(F.count("*").alias("strata"), F.sum("n_stratum").alias("n")).first()
        self.total, self.small = found.n or 0, found.strata * 800 <= BROADCAST_BYTES

    def join(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """known has one row for each stratum."""
        return rows.join(F.broadcast(known), "stratum") if self.small else join_groups(rows, known.join(self.sizes, "stratum"), ["stratum"], "n_stratum", self.total).drop("n_stratum")

    def measured(self, fits: DataFrame, cut: DataFrame | None = None) -> DataFrame:
        """The points with each fit of their stratum: start, d2 and, given cuts by stratum and start, only those within."""
        values = ["start", *MEANS, *FACTOR]
        if cut is not None:
            fits, values = fits.join(cut, ["stratum", "start"]), [*values, "cut"]
        known = fits.groupBy("stratum").agg(F.collect_list(F.struct(*values)).alias("fits"))
        seen = self.join(self.points, known).select("stratum", *FEATURES, F.inline("fits")).withColumn("d2", distance())
        return seen if cut is None else seen.filter("d2 <= cut")


def starts(strata: Strata, scratch: Scratch) -> DataFrame:
    mids = scratch.table(spread(strata.points), "mids")
    curved = strata.join(strata.points, mids).select("stratum", F.inline(bent()))
    plain = mids.select("stratum", F.lit(0).alias("start"), F.lit(1).cast("long").alias("n"), *(F.col(f"c{i}").alias(f"m{i}") for i in P), *((F.pow(f"w{i}", F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in P for j in range(i + 1)))
    return scratch.table(factored(plain).unionByName(scatter(curved, 1.0)), "starts")


def concentrated(strata: Strata, scratch: Scratch) -> DataFrame:
    """By stratum: the fit of least determinant that the concentration steps reach."""
    half = SHARE / chi2_cdf(chi2_quantile(SHARE, len(FEATURES)), len(FEATURES) + 2)
    now, done = starts(strata, scratch), []
    first = True
    while True:
        cut = scratch.table(strata.measured(now).groupBy("stratum", "start").agg(F.percentile_approx("d2", SHARE, 2000).alias("cut")), "cut")
        new = scatter(strata.measured(now, cut), half).join(now.select("stratum", "start", F.col("log_det").alias("was"), F.struct(*MEANS, *CELLS, *FACTOR).alias("old")), ["stratum", "start"])
        # the determinant of a start is not one of a share of the vectors, so the first step always counts
        falls = F.lit(True) if first else F.col("log_det") < F.col("was") + math.log(1 - STILL)
        new = scratch.table(new.withColumn("falls", falls), "step")
        ended = new.filter("not falls").select("stratum", "start", "n", "old.*", F.col("was").alias("log_det"))
        done.append(ended)
        now, first = new.filter("falls").select(*ended.columns), False
        if now.isEmpty():
            break
    ends = reduce(DataFrame.unionByName, done)
    best = ends.groupBy("stratum").agg(F.min(F.struct("log_det", "start", "n", *MEANS, *CELLS, *FACTOR)).alias("b"))
    return scratch.table(best.select("stratum", "b.*"), "best")


def drawn(fit: DataFrame, above: DataFrame) -> DataFrame:
    """Each fit as if SHRINK vectors of the one above (columns u_) were among its own; both carry key."""
    met = fit.join(above.select("key", *(F.col(c).alias(f"u_{c}") for c in [*MEANS, *CELLS])), "key")
    share = F.lit(SHRINK) / (F.col("n") + SHRINK)

    def off(i: int) -> Column:
        return F.col(f"m{i}") - F.col(f"u_m{i}")

    means = [(F.col(m) - share * off(i)).alias(m) for i, m in enumerate(MEANS)]
    cells = [((1 - share) * F.col(f"s{i}{j}") + share * F.col(f"u_s{i}{j}") + share * (1 - share) * off(i) * off(j)).alias(f"s{i}{j}") for i in P for j in range(i + 1)]
    return met.select("stratum", "n", *means, *cells)


def fit(strata: Strata, scratch: Scratch) -> DataFrame:
    """By language and source: the reweighted estimate, drawn towards its language's and that towards the whole's."""
    most = chi2_quantile(0.975, len(FEATURES))
    near = strata.measured(concentrated(strata, scratch).withColumn("start", F.lit(0))).filter(F.col("d2") <= most)
    final = scratch.table(scatter(near, 0.975 / chi2_cdf(most, len(FEATURES) + 2)), "final")
    whole = final.filter("stratum = 'all'").withColumn("key", F.lit("all"))
    wide = whole.select("key", *MEANS, *(F.lit(WIDE[FEATURES[i]] ** 2 if i == j else 0.0).alias(f"s{i}{j}") for i in P for j in range(i + 1)))
    whole = drawn(whole, wide)
    lang = drawn(final.filter("stratum like 'lang%'").withColumn("key", F.lit("all")), whole.withColumn("key", F.col("stratum")))
    keys = strata.rows.select(F.col("own").alias("stratum"), F.col("lang").alias("key")).distinct()
    own = drawn(final.join(keys, "stratum"), scratch.table(lang.withColumn("key", F.col("stratum")), "lang"))
    return scratch.table(factored(own), "fits")


def outliers(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the base statistics, base_failed, kept, and distance (null where none applies)."""
    scratch = Scratch(docs.sparkSession, "outliers")
    found = scratch.table(statistics(docs.select("doc_id", "lang", "source", "text")), "statistics")
    out = ["doc_id", *BASE]
    keys = (F.coalesce("lang", F.lit("\x00")).alias("g_lang"), F.coalesce("source", F.lit("\x00")).alias("g_source"))
    strata = Strata(scratch, found.filter("not base_failed").select(*out, *keys, *vector()))
    known = fit(strata, scratch).select("stratum", *MEANS, *FACTOR)
    judged = strata.join(strata.rows.withColumn("stratum", F.col("own")), known).withColumn("distance", distance())
    cutoff = chi2_quantile(1 - REJECT, len(FEATURES))
    passed = judged.select(*out, (F.col("distance") <= cutoff).alias("kept"), "distance")
    failed = found.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return scratch.result(passed.unionByName(failed))


def op9_quality_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(documents(spark, sf_dir)).select("doc_id", *BASE, "kept")
