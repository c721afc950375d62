"""Operators and stages as a whole against plain Python versions and the libraries."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prosewright.llm import bpe, exact_dedup, line_dedup, mixing, near_dedup, outliers, quality, token_counts
from prosewright.llm.common import documents
from tests.llm.test_operators import EDGE, LONG, brute_components, family, frame

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def clashing(spark, rows):
    """rows of (doc_id, text, source), with columns named like those that operators use inside."""
    names = ["same", "lost_id", "docs", "blocks", "block", "row", "node", "id", "h", "size", "g_box", "kept", "a.b", "pass", "end", "n"]
    schema = "doc_id bigint, text string, source string, lang string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, t, s, "en", 1, *(f"{n}{k}" for n in names)) for k, (i, t, s) in enumerate(rows)], schema)


# exact dedup


def test_exact_dedup_by_ranges(spark, monkeypatch):
    """A filter of several ranges, one of them perhaps empty, gives what one filter gives."""
    monkeypatch.setattr(exact_dedup, "RANGE_BITS", 1 << 16)
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(exact_dedup, "FILED_ROWS", 1500)
    rng = random.Random(1)
    rows = [(k, f"text {rng.randint(0, 4000)}") for k in range(5000)]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    want = {i: (max(g), len(g), i == max(g)) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(rows)


def test_kept_documents_with_clashing_columns(spark):
    rows = [(1, "a b", "s"), (2, "A b", "s"), (3, None, "t"), (4, "", None), (2, "A b", "s"), (5, "c", "t")]
    docs = clashing(spark, rows)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "A b"), (4, ""), (5, "c")]
    assert near_dedup.kept_documents(docs).columns == docs.columns


# near dedup


FOUR = [(1, "a b c d"), (3, "a b c d"), (3, "x y z w"), (7, "x y z w")]


def test_rows_that_share_an_id_are_one_document(spark):
    got = near_dedup.near_duplicates(frame(spark, FOUR), 3, 85, 100).collect()
    assert [(r.component_id, r.kept) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, True), (1, False), (1, False), (1, False)]


def test_no_text_goes_that_is_not_linked(spark):
    kept = near_dedup.kept_documents(frame(spark, FOUR), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c d"), (3, "x y z w")]


def test_ids_in_several_classes_equal_brute_force(spark, monkeypatch):
    """With small blocks too, so that clusters are compared as pairs of blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    rng = random.Random(5)
    rows = [(rng.randint(0, 90), t) for _, t in family(12, n=150)]
    got = near_dedup.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 3, 85, 100)


# token counts


def test_long_white_space(spark, monkeypatch):
    docs = frame(spark, [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "x" * 300_000)])
    got = {r.doc_id: r.n_tokens for r in token_counts.lengths(docs).collect()}
    assert got[1] > 10 and got[2] > 10 and got[3] > 10
    encoder = token_counts.encoding(token_counts.ranks_path(token_counts.RANKS))
    monkeypatch.setattr(token_counts, "LONG_SPACE", token_counts.regex.compile(r"\s{3,}"))
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab1!' \n\t ") if rng.random() < 0.5 else rng.choice([" ", "\n"]) * rng.randint(1, 6) for _ in range(rng.randint(0, 12)))
        assert token_counts.n_tokens(encoder, t) == len(encoder.encode_ordinary(t)), repr(t)


def test_counts_and_ids_equal_the_libraries(spark):
    """Row by row over all documents."""
    from tokenizers import Tokenizer

    docs = documents(spark, SF2)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    encode = token_counts.encoding(token_counts.ranks_path(token_counts.RANKS)).encode_ordinary
    assert {r.doc_id: r.n_tokens for r in token_counts.lengths(docs).collect()} == {i: len(encode(t)) for i, t in texts.items()}
    lib = Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))
    lib.no_truncation()
    lib.no_padding()
    for r in bpe.op10_bpe_speculate_verify(spark, SF2).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# line dedup


def test_hot_chunks_beyond_the_broadcast_bound(spark, monkeypatch):
    from prosewright.llm import common

    rows = [(k, f"own {k}\n\n" + "\n".join(f"shared line {j}" for j in range(8))) for k in range(30)]
    run = lambda: sorted((r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    want = run()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(common, "SALTS", 3)
    assert run() == want and sum(r[2] for r in want) > 29


def test_texts_without_repeats_stay_where_they_are(spark, monkeypatch):
    from prosewright.llm import common

    rng = random.Random(11)
    line = lambda n: " ".join(f"{rng.getrandbits(64):x}" for _ in range(n))
    twice = line(60)
    texts = ["\n".join([line(150), *[twice] * (k in (7, 70)), line(150)]) for k in range(400)]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.line_dedup(frame(spark, list(enumerate(texts))), passages=True).collect()}
    assert got == {k: int(k == 70) for k in range(400)}
    assert written() - before < 0.3 * sum(map(len, texts))


def test_may_meet_keeps_every_partner(spark, monkeypatch):
    from prosewright.llm import common

    scratch = common.Scratch(spark, "meet")
    rows = spark.range(40_000).withColumnRenamed("id", "a")
    for kept, bound in ((rows.filter("a % 100 = 3"), 24 << 20), (rows.filter("a % 2 = 1"), 100), (rows.limit(0), 100)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        told = {r.a for r in common.may_meet(rows, kept, ["a"], scratch).filter("g_meets").collect()}
        want = {r.a for r in kept.collect()}
        assert want <= told and len(told - want) <= (0.05 if bound > 100 else 0.6) * 40_000 * bool(want)


# mixing


def plain_mix(rows, order, entropy, repeats):
    """Reads of (source, doc_id) by plain loops: order gives each row's place in a pass over its source."""
    words = lambda t: max(1, len((t or "").split()))
    tokens = collections.Counter()
    for i, t, s in rows:
        tokens[s] += words(t)
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}

    def weights(x):
        q = {s: v**x for s, v in p.items()}
        return {s: v / sum(q.values()) for s, v in q.items()}

    def even(x):
        return -sum(w * math.log(w) for w in weights(x).values()) / math.log(len(p)) if len(p) > 1 else 1.0

    low, high = 0.0, 1.0
    fits = lambda x: even(x) <= entropy if repeats is None else (max(p.values()) / min(p.values())) ** (1 - x) <= repeats
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    w = weights(high)
    budget = total if repeats is None else max(p[s] / w[s] for s in p) * total
    out = collections.Counter()
    for s, n in tokens.items():
        own = [(i, t) for i, t, x in rows if x == s]
        target = budget * w[s]
        if repeats is not None:
            target = min(max(round(target / n, 6), 1.0), repeats) * n
        whole = int((target + 1e-3) / n)
        for k in range(whole):
            out.update((s, i, k) for i, _ in own)
        left = target - whole * n
        for i, t in sorted(own, key=lambda r: order(s, r[0], r[1], whole)):
            if left > 1e-3:
                out[s, i, whole] += 1
            left -= words(t)
    return out


@pytest.mark.parametrize("entropy,repeats", [(0.97, None), (None, 1.25), (None, 3.0)])
def test_mix_equals_plain_loops(spark, monkeypatch, entropy, repeats):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(mixing, "GROUP", 3)
    rng = random.Random(8)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice("aaaaaabbc")) for k in range(400)]
    docs = clashing(spark, rows)
    words = collections.Counter()
    for _, t, s in rows:
        words[s] += max(1, len(t.split()))
    blocks = F.create_map(*(F.lit(x) for s, n in words.items() for x in (s, math.ceil(n / 60))))[F.col("source")].cast("long")
    where = mixing.placed(F.col("source"), F.col("doc_id"), F.col("text"), mixing.SEED)
    turns = F.explode(F.sequence(F.lit(0), F.lit(4)))
    placed = docs.select("doc_id", "source", *(v.alias(k) for k, v in where.items()), turns.alias("t")).select("doc_id", "source", "t", mixing.block_order(F.col("t"), F.pmod("g_hash", blocks), mixing.SEED).alias("b"), mixing.doc_order(F.col("t")).alias("d"))
    known = {(r.source, r.doc_id, r.t): (tuple(r.b), r.d) for r in placed.collect()}
    got = mixing.mix_documents(docs, entropy, repeats)
    assert got.columns == [*docs.columns, "mix_pass", "mix_order"]
    reads = got.collect()
    assert collections.Counter((r.source, r.doc_id, r.mix_pass) for r in reads) == plain_mix(rows, lambda s, i, t, k: known[s, i, k], entropy, repeats)
    assert all(r["block"].startswith("block") and r["docs"].startswith("docs") for r in reads)


def test_mix_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "a b", "s"), (2, LONG, "s"), (3, "", "t")]
    docs = clashing(spark, rows)
    got = mixing.kept_documents(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.source) for r in got.collect()} == set(rows) and got.count() >= len(rows)
    assert mixing.kept_documents(docs.limit(0)).count() == 0


# quality


def plain_score(m, text):
    raw = (text or "").encode()
    parts = [raw[k : k + quality.PASSAGE] for k in range(0, len(raw), quality.PASSAGE)] or [b""]
    hs, es = [], []
    for x in parts:
        row = (quality.encoded(x)[0][0] - m.center) / m.scale
        h = [math.tanh(sum(row[i] * m.w[i, j] for i in range(len(row))) + m.b[j]) for j in range(quality.HIDDEN)]
        e = 0.0
        for g in range(quality.GATE):
            v = math.tanh(sum(h[j] * m.v[j, g] for j in range(quality.HIDDEN)))
            u = 1 / (1 + math.exp(-sum(h[j] * m.u[j, g] for j in range(quality.HIDDEN))))
            e += m.a[g] * v * u
        hs.append(h)
        es.append(math.exp(e))
    z = [sum(e * h[j] for e, h in zip(es, hs, strict=True)) / sum(es) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(z[j] * m.c[j] for j in range(quality.HIDDEN)) + m.d[0])))


def test_scores_equal_plain_loops(spark, monkeypatch):
    """Long texts go by pieces, and give what whole texts give."""
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "PIECE", 2 * quality.PASSAGE)
    texts = [None, "", "a b\nc", "é" * 700, LONG, " ".join(r.text for r in docs.limit(6).collect())]
    scores, weights = quality.score_texts(model, texts)
    for s, w, t in zip(scores, weights, texts, strict=True):
        assert abs(s - plain_score(model, t)) < 1e-4 and abs(w.sum() - 1) < 1e-6


def test_quality_fit_takes_all_passages(spark):
    long = " ".join(f"w{k}" for k in range(9000))
    docs = spark.createDataFrame([(k, long) for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    _, counts, _ = quality.bags(quality.sample(docs, labels))
    assert set(counts) == {-(-len(long) // quality.PASSAGE)} and counts[0] > 24


# outliers


def plain_mcd(x):
    """The concentrated estimate of least determinant, and what the last step makes of it, in numpy."""
    p, floors = x.shape[1], np.diag([outliers.FLOORS[f] ** 2 for f in outliers.FEATURES])
    rank = lambda v, q: np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]
    half = outliers.SHARE / outliers.chi2_cdf(outliers.chi2_quantile(outliers.SHARE, p), p + 2)
    cov = lambda v, c: np.cov(v.T, bias=True) * c + floors if len(v) > 1 else floors
    dist = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    mid = rank(x, 0.5)
    wide = np.sqrt(((rank(x, 0.75) - rank(x, 0.25)) / 1.349) ** 2 + np.diag(floors))
    z = (x - mid) / wide
    norm = np.sqrt((z * z).sum(1, keepdims=True))
    found = []
    for start in [None, mid + wide * np.tanh(z), mid + wide * np.where(norm > 0, z / np.where(norm > 0, norm, 1), 0)]:
        m, s = (mid, np.diag(wide**2)) if start is None else (start.mean(0), cov(start, 1.0))
        det, first = np.inf, True
        while True:
            d = dist(m, s)
            near = x[d <= rank(d, outliers.SHARE) * (1 + 1e-12)]
            m2, s2 = near.mean(0), cov(near, half)
            new = np.linalg.slogdet(s2)[1]
            if not first and new >= det + math.log(1 - outliers.STILL):
                break
            m, s, det, first = m2, s2, new, False
        found.append((det, m, s))
    _, m, s = min(found, key=lambda f: f[0])
    most = outliers.chi2_quantile(0.975, p)
    near = x[dist(m, s) <= most]
    return len(near), near.mean(0), cov(near, 0.975 / outliers.chi2_cdf(most, p + 2))


def test_verdicts_equal_numpy(spark):
    """Strata of 3 to 300 documents, so own estimates, those drawn to their language and to the whole all count."""
    rng = random.Random(3)
    rows = []
    for k in range(420):
        lang, source = ("en", "big") if k < 300 else ("en", f"s{k % 4}") if k < 390 else ("de", "few") if k < 417 else ("fr", None)
        word = lambda top=8 if lang == "en" else 12: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, top)))
        words = [word() for _ in range(rng.randint(60, 150))]
        if k % 29 == 0:
            words = [w.upper() if k % 2 else w + "*" for w in words]
        rows.append((k, " ".join(words) if k % 5 else "\n".join(words), lang, source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    stats = outliers.statistics(docs).filter("not base_failed").select("doc_id", "lang", "source", *outliers.vector()).collect()
    x = np.array([[r[f] for f in outliers.FEATURES] for r in stats])
    keys = [(r.lang, r.source) for r in stats]

    def drawn(own, above):
        n, m, s = own
        share = outliers.SHRINK / (n + outliers.SHRINK)
        off = (m - above[0])[:, None]
        return m - share * off[:, 0], (1 - share) * s + share * above[1] + share * (1 - share) * off @ off.T

    n, m, s = plain_mcd(x)
    whole = drawn((n, m, s), (m, np.diag([outliers.WIDE[f] ** 2 for f in outliers.FEATURES])))
    langs = {a: drawn(plain_mcd(x[[k[0] == a for k in keys]]), whole) for a in {k[0] for k in keys}}
    owns = {k: drawn(plain_mcd(x[[j == k for j in keys]]), langs[k[0]]) for k in set(keys)}
    cutoff = outliers.chi2_quantile(1 - outliers.REJECT, len(outliers.FEATURES))
    got = {r.doc_id: r for r in outliers.outliers(docs).collect()}
    rejected = 0
    for r, v, k in zip(stats, x, keys, strict=True):
        m, s = owns[k]
        d = float((v - m) @ np.linalg.inv(s) @ (v - m))
        assert abs(got[r.doc_id].distance - d) < 1e-3 * (1 + d), (r.doc_id, k, d, got[r.doc_id].distance)
        assert got[r.doc_id].kept == (d <= cutoff)
        rejected += d > cutoff
    assert 8 <= rejected <= 20


# the pipeline


def test_stages_equal_plain_python(spark):
    """What each stage keeps of its own input, by plain versions over the smallest tables with copies put in."""
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    good = {i for i, s in zip(rows, quality.score_texts(quality.Model(*(a.astype(np.float32) for a in model)), [r.text for r in rows.values()])[0], strict=True) if s >= 0.5}
    kept = stages["quality classifier"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == good and 0.3 * len(rows) < len(good) < len(rows)
    near = brute_components([(i, rows[i].text) for i in rows], 5, 80, 100)
    got = [r.doc_id for r in stages["near dedup"](spark, docs, SF).collect()]
    assert sorted(got) == sorted(set(near.values())) and len(got) < len(rows)


def test_stages_bear_edges(spark):
    """Nulls, empty and very long texts, repeats, clashing columns and empty tables, stage by stage."""
    rows = [(i, t, None if k % 3 == 0 else "s") for k, (i, t) in enumerate(EDGE)]
    for docs in (clashing(spark, rows), clashing(spark, rows).limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "bpe encoding":
                assert out.count() == docs.count()
            else:
                assert out.columns == docs.columns, name
                assert name == "mixing" or out.count() <= n
                docs = out
    assert "g_box" in clashing(spark, rows).columns
