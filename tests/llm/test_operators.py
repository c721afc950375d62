"""Small cases with known results, and brute-force versions, for every operator."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from prosewright.llm import archive, bpe, exact_dedup, line_dedup, mixing, near_dedup, outliers, quality, queries, token_counts, urls
from tests.twin import differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, node string"


def frame(spark, rows):
    """rows of (doc_id, text); lang and source vary, and the extra columns clash with names used inside."""
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 2}", None, 1, "x") for k, (i, t) in enumerate(rows)], SCHEMA)


LONG = " ".join(f"w{k}" for k in range(3000))
EDGE = [(1, None), (2, ""), (3, "Alpha beta"), (3, "Alpha beta"), (None, "alpha BETA"), (4, LONG), (5, LONG), (6, "ÀB\n\n x"), (None, None)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twins(spark, name):
    assert not differences(queries.QUERIES[name](spark, SF), SF, queries.ORACLE_SQL[name])


# exact dedup


def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_dedup(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for sha, rows in by.items():
        assert {r.group_size for r in rows} == {len(rows)} and sum(r.kept for r in rows) == 1
        assert {r.keep_id for r in rows} == {max((r.doc_id for r in rows if r.doc_id is not None), default=None)}
    assert by[hashlib.sha256(b"alpha beta").hexdigest()][0].keep_id == 3
    assert exact_dedup.exact_dedup(frame(spark, EDGE).limit(0)).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    docs = frame(spark, EDGE)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    norm = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in EDGE})


# BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path(bpe.TOKENIZER)
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng, texts = random.Random(3), ["", None, "<|endoftext|>x<|END|>", "İΣς ﬁ e\u0301 ß", "a" * 500, "!" * 300, LONG]
    for _ in range(4000):
        letters = rng.choice(["abethnsi'`!<|>.  \n0123éÉßİΣςñ€漢字 \u0085\x1c", "ab", "aeinrst", "!.-*"])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 24))))
    for t, (ids, text) in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert text.decode() == lib.decode(want, skip_special_tokens=False) == own.decode(want)


def test_bpe_long_merge_equals_short():
    own = bpe.WordBpe(bpe.tokenizer_path(bpe.TOKENIZER))
    rng = random.Random(1)
    for _ in range(500):
        word = bytes(rng.choice(b"aeinrst") for _ in range(rng.randint(1, 60)))
        assert own.merge(own.symbols(word)) == own.merge_long(own.symbols(word))


def test_bpe_frame(spark):
    got = bpe.encode_documents(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {r.n_tokens for r in got if r.decoded == ""} == {0}
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(frame(spark, EDGE).limit(0)).count() == 0


# near dedup


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def family(seed, n=160, length=60, edits=6):
    """Near copies of a few bases, with similarities on both sides of the threshold."""
    rng, rows = random.Random(seed), []
    bases = [[f"b{b}w{rng.randint(0, 500)}" for _ in range(length)] for b in range(4)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"e{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 80, 100)])
def test_near_dedup_equals_brute_force(spark, k, num, den):
    rows = family(k) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE two"), (1004, "one"), (None, "one two"), (1005, LONG), (1006, LONG + " x"), (3, LONG)]
    got = near_dedup.near_duplicates(frame(spark, rows), k, num, den).collect()
    want = brute_components(rows, k, num, den)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_nodes_that_stay_large(spark, monkeypatch):
    """With small leaves and few rounds, large nodes are dealt out and their stragglers compared; no link may go."""
    monkeypatch.setattr(near_dedup, "LEAF", 12)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rows = family(9, n=120)
    got = near_dedup.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 3, 85, 100)


def test_near_dedup_empty(spark):
    docs = frame(spark, EDGE)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id = 4").count() == 1


# outliers


def test_base_statistics(spark):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [None, "", " \n\t ", "a b c a b c", "# x|y\n# x|y\n\n \nz", LONG, "the the the the the", "é# A\u00a0b $\r\n\x0b<>"]
    rng = random.Random(2)
    texts += [" ".join(rng.choice("ab #\n") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    got = outliers.statistics(frame(spark, list(enumerate(texts)))).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        w = words.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_outliers_are_rejected_and_clean_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinrstlo") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(300)]
    junk = ["*** ".join(word() for _ in range(100)) for _ in range(20)] + [" ".join(word().upper() for _ in range(100)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(clean + junk)], "doc_id bigint, text string, lang string, source string, stratum int")
    got = {r.doc_id: r.kept for r in outliers.outliers(docs).collect()}
    assert sum(got[i] for i in range(300)) >= 299 and not any(got[i] for i in range(300, 340))


def test_mcd_step_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([("a", *map(float, v)) for v in x], "stratum string, " + ", ".join(f"{f} double" for f in outliers.FEATURES))
    r = outliers.scatter(df, 1.0).first()
    cov = np.cov(x.T, bias=True) + np.diag([outliers.FLOORS[f] ** 2 for f in outliers.FEATURES])
    low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose(low @ low.T, cov) and np.allclose([r[f"m{i}"] for i in range(5)], x.mean(0))
    assert abs(outliers.chi2_cdf(outliers.chi2_quantile(0.9, 5), 5) - 0.9) < 1e-9 and abs(outliers.chi2_quantile(0.95, 2) + 2 * math.log(0.05)) < 1e-6


def test_outliers_edges(spark):
    got = outliers.outliers(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and outliers.outliers(frame(spark, EDGE).limit(0)).count() == 0
    assert sum(r.kept for r in got) == 2  # the two long texts: too few for an estimate, so nothing else is judged


# archives


def test_arc_versions_and_faults():
    block = archive.http_block("é\n\nWARC/1.1\r\n\r\nx".encode(), 7)
    for version in (1, 2):
        data = archive.arc_filedesc(version) + b"\n" + archive.arc_header(version, "http://a b/", archive.ARC_DATE, "text/html", len(block)) + block + b"\n"
        (record,) = archive.arc_records(data)
        assert record.block == block and record.fields["URL"] == "http://a%20b/"
        (warc,) = archive.warc_records(archive.warc_record(record, None) + b"\r\n\r\n")
        assert warc.block == block and warc.headers["WARC-Type"] == "response" and warc.headers["WARC-Date"] == "2020-01-02T03:04:05Z"
        with pytest.raises(ValueError):
            list(archive.arc_records(data[:-20]))
    with pytest.raises(ValueError):
        list(archive.arc_records(b"http://a 0.0.0.0 x\n"))
    plain = archive.ArcRecord({"URL": "dns:a", "IP-address": "0.0.0.0", "Archive-date": "2001", "Content-type": "text/dns", "Archive-length": "3"}, b"abc")
    (warc,) = archive.warc_records(archive.warc_record(plain, None) + b"\r\n\r\n")
    assert warc.headers["WARC-Type"] == "resource" and warc.headers["WARC-Date"] == "2001"
    assert [archive.warc_date(d) for d in ("200113", "20010203", "2001020304", "200102030405", "20010203246060")] == ["2001", "2001-02-03", "2001-02-03", "2001-02-03T04:05Z", "2001-02-03"]
    with pytest.raises(ValueError):
        archive.warc_date("x")


def test_gzip_members_and_streams():
    parts = [b"", b"a" * 100, bytes(range(256)) * 300_000, b"z"]
    members = [archive.member(p) for p in parts]
    assert all(m[-1] == 0 for m in members) and len(parts[2]) > 1 << 24
    assert b"".join(archive.inflated(b"".join(members))) == b"".join(parts) == gzip.decompress(b"".join(members))
    rows = list(archive.segments(iter([b"r%d;" % k for k in range(10)]), lambda k: b"head%d;" % k))
    assert gzip.decompress(b"".join(r + b"\0" for r in rows)) == b"head0;" + b"".join(b"r%d;" % k for k in range(10))
    with pytest.raises(ValueError):
        list(archive.inflated(members[1][:-5]))
    source = archive.Source(iter([b"ab", b"c\r", b"\nrest"]))
    assert source.upto(b"\r\n") == b"abc" and source.take(4) == b"rest" and source.take(1) is None and source.ended()


@pytest.mark.parametrize("version", [1, 2])
def test_archive_round_trip(spark, version):
    html = ["x" * 100, "x" * 100, "x" * 99, "x" * 99, None, "", "é\r\n\r\nWARC/1.1\r\n" * 50, "ARC\n" * 90, "y" * 200_000]
    rows = [(10 - k, None if k == 2 else f"http://h/{k} ü", h, 1) for k, h in enumerate(html)]
    got = {r.page_id: r for r in archive.archive_pages(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int"), version).collect()}
    for page, _, h, _ in rows:
        raw = (h or "").encode()
        assert got[page].payload_bytes == len(raw) and got[page].payload_digest == hashlib.sha256(raw).hexdigest()
    assert (got[10].record_type, got[10].refers_to, got[9].record_type) == ("revisit", 9, "response")
    assert all(got[p].record_type == "response" for p in range(2, 10)) and bytes(got[4].payload).decode() == html[6]


def test_archive_of_repeated_and_missing_ids_by_slices(spark, monkeypatch):
    """Small files and a small broadcast bound, so that places meet the files in several slices."""
    monkeypatch.setattr(archive, "SEGMENT", 300)
    monkeypatch.setattr(archive, "BROADCAST_BYTES", 2000)
    texts = ["x" * 150, "y" * 150, "z" * 10]
    rows = [(None if k % 11 == 0 else k % 40, f"http://h/{k}", texts[k % 3] if k % 2 else f"{k}" * 120) for k in range(90)]
    got = archive.archive_pages(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_digest) for r in got) == sorted((p is None, p or 0, hashlib.sha256(h.encode()).hexdigest()) for p, _, h in rows)
    least = {}
    for p, _, h in rows:
        if p is not None and len(h) >= 100:
            d = hashlib.sha256(h.encode()).hexdigest()
            least[d] = min(p, least.get(d, p))
    for r in got:
        first = least.get(r.payload_digest)
        again = r.page_id is not None and first is not None and r.page_id > first
        assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))


def test_revisit_headers():
    arc = archive.ArcRecord({"URL": "http://b/", "IP-address": "0.0.0.0", "Archive-date": "20210102030405", "Content-type": "text/html", "Archive-length": "0"}, archive.http_block(b"x" * 200, 5))
    first = arc._replace(fields=arc.fields | {"URL": "http://a/", "Archive-date": "2020"}, block=archive.http_block(b"x" * 200, 3))
    (response,) = archive.warc_records(archive.warc_record(first, None) + b"\r\n\r\n")
    (revisit,) = archive.warc_records(archive.warc_record(arc, archive.Referred(3, "http://a/", "2020")) + b"\r\n\r\n")
    assert revisit.headers["WARC-Refers-To"] == response.headers["WARC-Record-ID"]
    assert (revisit.headers["WARC-Refers-To-Target-URI"], revisit.headers["WARC-Refers-To-Date"]) == ("http://a/", "2020")
    (info,) = archive.warc_records(archive.warc_info("p", 0, 0) + b"\r\n\r\n")
    assert info.headers["WARC-Type"] == "warcinfo"


def test_archive_empty(spark):
    assert archive.archive_pages(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op2_quality_attention_mil"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(7, quality.INPUTS)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])
    first = np.cumsum(counts) - counts
    m = quality.Model(np.zeros(quality.INPUTS), np.ones(quality.INPUTS), *(rng.normal(0, 0.1, s) for s in ((quality.INPUTS, quality.HIDDEN), quality.HIDDEN, (quality.HIDDEN, quality.GATE), (quality.HIDDEN, quality.GATE), quality.GATE, quality.HIDDEN, 1)))
    grads = quality.gradient(m, x, first, y, 0.0)
    for k, g in enumerate(grads):
        at = tuple(0 for _ in g.shape)
        step = np.zeros_like(g)
        step[at] = 1e-6
        up, down = (m._replace(**{m._fields[k + 2]: m[k + 2] + s}) for s in (step, -step))
        assert abs((quality.log_loss(up, x, first, y) - quality.log_loss(down, x, first, y)) / 2e-6 - g[at]) < 1e-5


def test_quality_edges(spark):
    docs = frame(spark, EDGE)
    none = spark.createDataFrame([(1, 7, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, none)
    got = quality.classify(docs, model).collect()
    assert len(got) == len(EDGE) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert all(abs(sum(r.attention) - 1) < 1e-5 for r in got)
    assert quality.classify(docs.limit(0), model).count() == 0 and quality.kept_documents(docs, none).columns == docs.columns


# urls


def test_url_parts_and_rules(spark):
    cases = [
        ("HTTP://WWW.Example.ORG/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"), ("http://a.example.org/en/12#x", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org", "example.org", "", None, None), ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("https://x.com/de/?q", "x.com", "/de/", "com/de/", "block"),
        ("https://scom/de/", "scom", "/de/", None, None), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://a?b/c", "a", "", None, None), ("x://ÄB/É", "Äb", "/É", None, None),
        ("http://" + "k" * 900 + ".net/" + "p" * 5000, "k" * 900 + ".net", "/" + "p" * 5000, None, None),
    ]
    pages = spark.createDataFrame([(k, c[0], None, "x", 1) for k, c in enumerate(cases)], "page_id bigint, url string, html string, word string, size int")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(got) == len(cases)
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), cases[k]
        assert verdict is None or got[k].verdict == verdict, cases[k]
    assert urls.judge(pages.limit(0)).count() == 0


def brute_judge(rows):
    """Host words and block odds of (page_id, url, html), in plain Python."""
    word = regex.compile(r"\p{L}+")
    parts = []
    for _, url, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        parts.append((host, path, max(fits)[1:] if fits else None))
    counts = collections.Counter()
    for (host, _, _), (_, _, html) in zip(parts, rows, strict=True):
        text = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ", html or "").lower()
        counts.update(w for w in word.findall(text) if len(w) <= urls.WORD and w not in word.findall(host.lower()))
    total = float(max(1, sum(counts.values())))
    cut = lambda host: [w for label in word.findall(host.lower()) for w in urls.viterbi(label, counts, total)]
    hosts = {(h, r[1]) for h, _, r in parts if r}
    seen = collections.Counter((v, w) for h, v in hosts for w in cut(h)) + collections.Counter((v, w) for p, v in {(p, r[1]) for _, p, r in parts if r} for w in word.findall(p.lower()))
    known = {w for _, w in seen}
    both = {v for _, v in hosts} == {"block", "allow"}

    def odds(words):
        if not known.intersection(words):
            return -math.inf
        out = math.log((sum(v == "block" for _, v in hosts) + 0.5) / (sum(v == "allow" for _, v in hosts) + 0.5)) if both else -math.inf
        for w in words:
            if both and w in known:
                p = [(seen[v, w] + 0.5) / (sum(n for (u, _), n in seen.items() if u == v) + 0.5 * (len(known) + 1)) for v in ("block", "allow")]
                out += math.log(p[0] / p[1])
        return out

    return [(h, p, r and r[0], r[1] if r else "block" if odds(cut(h) + word.findall(p.lower())) >= 0 else "allow", " ".join(cut(h)) or None) for h, p, r in parts]


def test_urls_equal_brute_force(spark):
    rng = random.Random(11)
    words = "city garden open library cheap pills news board casino weather blog".split()
    rows = []
    for k in range(300):
        host = rng.choice(["", "www.", "m."]) + "".join(rng.sample(words[: 6 if k % 2 else 11], 2)) + rng.choice([".com", ".org", ".net", ".example.org", ".example.net"])
        path = rng.choice(["/de/", "/fr/", "/en/1", "/es/", "/"]) + rng.choice(words)
        html = "<p>" + " ".join(rng.choices(words, k=20)) + (f" {host.split('.')[-2]} </p><script>var city</script>" if k % 3 else "</p>")
        rows.append((k, f"http://{host}{path}?q" if k % 50 else None, html if k % 40 else None))
    rows += [(None, "http://citygarden.net/x", ""), (7, rows[7][1], rows[7][2]), (301, "http://" + "city" * 300 + "q.net/", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.host_words) for r in urls.judge(pages).collect())
    want = brute_judge(rows)
    assert got == collections.Counter((i, *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert {w[3] for w in want if not w[2]} == {"allow", "block"}
    assert want[-3][4] == "city garden net" and want[-1][4] == "city " * 300 + "q net"


def test_viterbi_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): rng.randint(1, 50) for _ in range(5)}
        label = "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))

        def cost(words, counts=counts):
            return sum(-math.log(counts[w] / 1000) if w in counts else math.log(1000) + len(w) * math.log(10) for w in words)

        def splits(s):
            return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in splits(s[k:])]

        got = urls.viterbi(label, counts, 1000.0)
        assert "".join(got) == label and abs(cost(got) - min(map(cost, splits(label)))) < 1e-9


# token counts


def test_histogram_equals_brute_force(spark):
    docs = frame(spark, EDGE)
    sizes = [r.n_tokens for r in token_counts.lengths(docs).collect()]
    hist = token_counts.histogram(token_counts.lengths(docs))
    for r in hist.collect():
        n = r.n_tokens
        assert (r.docs, r.docs_at_least) == (sizes.count(n), sum(x >= n for x in sizes))
        assert (r.tokens_at_least, r.tokens_cut) == (sum(x for x in sizes if x >= n), sum(min(x, n) for x in sizes))
    for r in token_counts.at_limits(hist, [0, 1, 2, 100, 10**7]).collect():
        assert (r.docs_longer, r.tokens_kept) == (sum(x > r.limit for x in sizes), sum(min(x, r.limit) for x in sizes)) and r.tokens_lost == sum(sizes) - r.tokens_kept
    for r in token_counts.quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(sizes)[max(0, math.ceil(r.share * len(sizes)) - 1)]
    assert token_counts.histogram(token_counts.lengths(docs.limit(0))).count() == 0


def test_lengths_are_tiktoken(spark):
    encode = token_counts.encoding(token_counts.ranks_path(token_counts.RANKS)).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in token_counts.lengths(frame(spark, [(1, "Hello there\n\n x"), (2, LONG)])).collect()}
    assert got == {1: len(encode("Hello there\n\n x")), 2: len(encode(LONG))}


# line dedup


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    passage = [f"shared line {k} of many" for k in range(12)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {rng.random()}" for _ in range(rng.randint(0, 12))]
        if i % 2:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (None, "\n".join(passage)), (103, LONG), (0, rows[0][1])]
    seen, want = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = line_dedup.split_lines(t)
        stay, lost = [], 0
        for a, b in line_dedup.boundaries(lines):
            chunk = b"\n".join(lines[a:b])
            if b - a > 1 and chunk in seen:
                lost += 1
            else:
                seen[chunk] = 1
                stay += lines[a:b]
        want[i] = (b"\n".join(stay).decode(), lost)
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_removed_chunks) == want[r.doc_id]
        raw = dict(rows)[r.doc_id]
        left = bytearray((raw or "").encode())
        for a, b in reversed(r.spans):
            del left[a:b]
        assert left.decode().rstrip("\n") == r.text.rstrip("\n") and r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert sum(r.n_removed_lines for r in got) >= 0.5 * 29 * len(passage)
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_chunks_tile_and_resist_shifts():
    rng = random.Random(7)
    lines = [f"{rng.random()}".encode() for _ in range(300)]
    spans = line_dedup.boundaries(lines)
    assert [x for a, b in spans for x in lines[a:b]] == lines and all(b - a <= line_dedup.LONGEST for a, b in spans)
    moved = [b"new", b"head", *lines]
    chunks = lambda ls: {tuple(ls[a:b]) for a, b in line_dedup.boundaries(ls)}
    assert len(chunks(lines) & chunks(moved)) >= 0.9 * len(spans)


def runs_seen_before(texts):
    """By brute force: the lines with words in runs of over 50 words that occur earlier, in texts in order."""
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = "\n".join(lines[a:b])
                if len(run.split()) > 50:
                    if run in seen:
                        gone |= {k for k in range(a, b) if lines[k].split()}
                    seen.add(run)
        out.append(gone)
    return out


def test_line_dedup_takes_whole_passages(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = [[line(60)], [line(30), line(30)], [line(20), "", line(25), line(20)], [line(9) for _ in range(13)], [line(40), line(10)], [line(50)]]
    texts = []
    for i in range(40):
        lines = [line(rng.choice([0, 1, 5, 30, 70])) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(shared)
        texts.append("\n".join(lines))
    want = runs_seen_before(texts)
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, list(enumerate(texts))), passages=True).collect()}
    plain = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, list(enumerate(texts)))).collect()}
    assert sum(map(len, want)) > 40
    for i, t in enumerate(texts):
        cut = lambda r, n=len(t.encode()) + 1: {k for a, b in r.spans for k in range(a, min(b, n))}
        at, worded, lost = 0, set(), cut(got[i])
        for k, x in enumerate(t.split("\n")):
            if x.split() and at in lost:
                worded.add(k)
            assert not x or set(range(at, at + len(x))) <= lost or not set(range(at, at + len(x))) & lost
            at += len(x.encode()) + 1
        chunked = cut(plain[i])
        assert chunked <= lost and worded >= want[i]
        at = 0
        for k, x in enumerate(t.split("\n")):
            assert k not in worded - want[i] or at in chunked
            at += len(x.encode()) + 1


# mixing


def sources(spark, counts):
    rows = [(s * 10_000 + k, "a b c d", "en", None if s == 0 else f"s{s}") for s, n in enumerate(counts) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_mixing_meets_the_entropy(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    counts = [900, 60, 30, 10]
    got = mixing.mix_documents(sources(spark, counts), entropy=0.9).groupBy("source", "mix_pass").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    by = collections.Counter()
    for r in got:
        by[r.source] += r.n
        assert r.n == r.d  # a pass reads no document twice
    total = sum(by.values())
    entropy = -sum(n / total * math.log(n / total) for n in by.values())
    assert abs(entropy / math.log(4) - 0.9) < 0.01 and abs(total - sum(counts)) < 10
    whole = {(r.source, r.mix_pass): r.n for r in got}
    for s, n in by.items():
        full = {None: 900, "s1": 60, "s2": 30, "s3": 10}[s]
        assert all(whole[s, p] == full for p in range(n // full))


def test_mixing_repeats_limit_loses_nothing(spark):
    docs = sources(spark, [500, 100, 20])
    kept = mixing.kept_documents(docs, repeats=1.5)
    assert kept.columns == docs.columns
    n = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert len(n) == 620 and max(n.values()) == 2 and sum(v for k, v in n.items() if k >= 20_000) == 30 and sum(v for k, v in n.items() if k < 10_000) == 500


def test_mixing_edges(spark):
    assert mixing.mix_documents(sources(spark, [0])).count() == 0
    one = mixing.mix_documents(sources(spark, [7])).collect()
    assert len(one) == 7 and {r.mix_pass for r in one} == {0}
    assert mixing.mix_documents(frame(spark, EDGE), entropy=None, repeats=2.0).count() >= len(EDGE)
