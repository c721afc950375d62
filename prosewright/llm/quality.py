"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from its bytes (frequencies of single bytes,
how concentrated its four-byte strings are, how often a word repeats its predecessor) into a hidden vector. Gated
attention weighs the passages of a document, and the weighted sum gives the score. Encoder, attention and classifier
are learned together from document labels, with early stopping on a part of the training rows.

The fit uses a sample of at most SAMPLE labelled rows, chosen by hash, with all passages of their whole texts; encoded,
they take about half the bytes of those texts on the driver. Scoring reads every passage of every text. Labels, lang, source
and doc_id are never inputs of a score; doc_id only decides which labels may be learned.

Defined results: a null or empty text is one empty passage and gets a score like any other; a null doc_id is scored,
is not held out and is never learned; labels other than 0 and
1, and ids whose labels contradict each other, are not learned; without labels of both kinds every score is the share of
label 1 (0.5 without any); repeated rows each get the same score; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.common import boxed, documents, lean, small_batches, unboxed

SAMPLE, PASSAGE, HIDDEN, GATE, GRAMS = 3000, 1024, 32, 16, 512
INPUTS = 256 + 6
#: Bytes that are encoded or scored at once; whole passages.
PIECE = 512 * PASSAGE


class Model(NamedTuple):
    center: np.ndarray  # INPUTS
    scale: np.ndarray  # INPUTS
    w: np.ndarray  # INPUTS, HIDDEN
    b: np.ndarray  # HIDDEN
    v: np.ndarray  # HIDDEN, GATE
    u: np.ndarray  # HIDDEN, GATE
    a: np.ndarray  # GATE
    c: np.ndarray  # HIDDEN
    d: np.ndarray  # 1


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The inputs of all passages of the texts, and the number of passages of each text (1 at least)."""
    return encoded(*((t or "").encode("utf-8", "surrogatepass") for t in texts))


def encoded(*raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    counts = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = int(counts.sum())
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = first[text] + at // PASSAGE
    total = np.maximum(1, np.bincount(owner, minlength=n)).astype(np.float32)
    singles = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32)
    out = np.zeros((n, INPUTS), np.float32)
    out[:, :256] = np.sqrt(singles / total[:, None])
    out[:, 256] = np.log(1e-3)  # of passages under four bytes, whatever else is encoded with them
    if len(data) >= 4:
        word = data.astype(np.uint32)
        four = word[:-3] | word[1:-2] << 8 | word[2:-1] << 16 | word[3:] << 24
        hashed = ((four * np.uint32(0x9E3779B1)) >> np.uint32(23)).astype(np.int64)
        inside = owner[:-3] == owner[3:]
        grams = np.bincount(owner[:-3][inside] * GRAMS + hashed[inside], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
        share = grams / np.maximum(1, grams.sum(1, keepdims=True))
        out[:, 256] = np.log((share * share).sum(1) + 1e-3)
        out[:, 257] = (grams > 0).sum(1) / np.minimum(GRAMS, total)
    upper = singles[:, 65:91].sum(1)
    lower = singles[:, 97:123].sum(1)
    out[:, 258] = upper / np.maximum(1, upper + lower)
    out[:, 259] = singles[:, list(b"#*$%&|<>!")].sum(1) / total
    out[:, 260] = singles[:, list(b" \t\n\r\x0b\x0c")].sum(1) / total
    out[:, 261] = np.log(total)
    return out, counts


def forward(m: Model, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """first: where each bag's passages start in x."""
    h = np.tanh(((x - m.center) / m.scale) @ m.w + m.b)
    t = np.tanh(h @ m.v)
    g = 1 / (1 + np.exp(-(h @ m.u)))
    e = np.exp(np.clip((t * g) @ m.a, -30, 30))
    counts = np.diff(np.append(first, len(x)))
    total = np.add.reduceat(e, first)
    weight = e / np.repeat(total, counts)
    z = np.add.reduceat(weight[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "g": g, "sum": total, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ m.c + m.d, -30, 30))), "counts": counts}


def gradient(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the mean log loss, for w, b, v, u, a, c, d."""
    f = forward(m, x, first)
    h, t, g, weight, z = f["h"], f["t"], f["g"], f["weight"], f["z"]
    out = (f["score"] - y) / len(y)
    dz = np.repeat(out[:, None] * m.c, f["counts"], axis=0)
    dweight = (dz * h).sum(1)
    mean = np.repeat(np.add.reduceat(weight * dweight, first), f["counts"])
    de = weight * (dweight - mean)
    dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
    dh = (weight[:, None] * dz + dt @ m.v.T + dg @ m.u.T) * (1 - h * h)
    inputs = (x - m.center) / m.scale
    return [inputs.T @ dh + decay * m.w, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ out + decay * m.c, out.sum(keepdims=True)]


def log_loss(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(forward(m, x, first)["score"], 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def constant(share: float) -> Model:
    z = np.zeros
    logit = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return Model(z(INPUTS), np.ones(INPUTS), z((INPUTS, HIDDEN)), z(HIDDEN), z((HIDDEN, GATE)), z((HIDDEN, GATE)), z(GATE), z(HIDDEN), np.array([logit]))


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on shuffled batches; keeps the epoch with the least loss on every fifth bag."""
    if not len(y) or len(set(y.tolist())) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    starts = np.cumsum(counts) - counts
    spread = x.std(0)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    m = Model(x.mean(0).astype(np.float64), np.where(spread > 1e-3, spread, 1e-1).astype(np.float64), normal(INPUTS, HIDDEN), np.zeros(HIDDEN), normal(HIDDEN, GATE), normal(HIDDEN, GATE), normal(GATE), normal(HIDDEN), np.zeros(1))

    def take(bags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.concatenate([np.arange(starts[k], starts[k] + counts[k]) for k in bags])
        return x[rows].astype(np.float64), np.cumsum(counts[bags]) - counts[bags], y[bags]

    order = rng.permutation(len(y))
    held, rest = order[::5], np.setdiff1d(order, order[::5])
    if not len(rest):
        rest = order
    held_rows = take(held)
    best, least, waited = m, np.inf, 0
    first, second, step = [0.0] * 7, [0.0] * 7, 0
    for _ in range(epochs):
        rng.shuffle(rest)
        for k in range(0, len(rest), batch):
            step += 1
            grads = gradient(m, *take(rest[k : k + batch]), decay)
            first = [0.9 * f + 0.1 * g for f, g in zip(first, grads, strict=True)]
            second = [0.999 * s + 0.001 * g * g for s, g in zip(second, grads, strict=True)]
            m = Model(m.center, m.scale, *(p - rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) for p, f, s in zip(m[2:], first, second, strict=True)))
        loss = log_loss(m, *held_rows)
        best, least, waited = (m, loss, 0) if loss < least else (best, least, waited + 1)
        if waited > 6:
            break
    return best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE labelled rows (doc_id, quality, text) that may be learned; the ids alone are broadcast."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "quality")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def bags(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The encoded sample on the driver: inputs, passages of each bag, labels. SAMPLE bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                cuts = range(0, max(1, len(raw)), PIECE)
                out.append(b"".join(encoded(raw[a : a + PIECE])[0].astype(np.float16).tobytes() for a in cuts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(out, pa.binary())], ["doc_id", "quality", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    got = rows.select("doc_id", "quality", "text").mapInArrow(lean(run), f"doc_id {kind}, quality int, x binary").dropDuplicates(["doc_id"]).limit(SAMPLE).toArrow().sort_by("doc_id")
    xs = [np.frombuffer(b, np.float16).reshape(-1, INPUTS) for b in got.column("x").to_pylist()]
    y = np.array(got.column("quality").to_pylist(), np.float64)
    return np.concatenate(xs).astype(np.float32) if xs else np.zeros((0, INPUTS), np.float32), np.array([len(x) for x in xs], np.int64), y


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*bags(sample(docs, labels)))


def score_texts(m: Model, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The scores, and each text's attention weights by passage."""
    scores, weights, lo = [], [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < PIECE):
            size += len(texts[hi] or "")
            hi += 1
        if size > 4 * PIECE:
            score, weight = score_long(m, texts[lo].encode("utf-8", "surrogatepass"))
            scores.append(score)
            weights.append(weight)
        else:
            x, counts = passages(texts[lo:hi])
            first = np.cumsum(counts) - counts
            f = forward(m, x, first)
            scores.append(f["score"])
            weights += np.split(f["weight"], first[1:])
        lo = hi
    return np.concatenate(scores) if scores else np.zeros(0), weights


def score_long(m: Model, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One text by pieces, whose attention adds up to that of the whole text."""
    sums, z, parts = 0.0, 0.0, []
    for a in range(0, len(raw), PIECE):
        f = forward(m, encoded(raw[a : a + PIECE])[0], np.zeros(1, np.int64))
        total = float(f["sum"][0])
        sums, z = sums + total, z + total * f["z"]
        parts.append(f["weight"] * total)
    score = 1 / (1 + np.exp(-np.clip(z / sums @ m.c + m.d, -30, 30)))
    return score, np.concatenate(parts) / sums


def classify(docs: DataFrame, model: Model, outputs: bool = True) -> DataFrame:
    """docs' doc_id with held_out, score, predicted and, with outputs, the attention weights by passage."""
    small_batches(docs.sparkSession)
    model = Model(*(a.astype(np.float32) for a in model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            score, weights = score_texts(model, batch.column("text").to_pylist())
            held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()]
            score = score.astype(np.float64)
            cols = [ids, pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            if outputs:
                cols.append(pa.array(weights, pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", *(["attention"] if outputs else [])])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int" + (", attention array<float>" if outputs else ""))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted 0; all columns kept."""
    small_batches(docs.sparkSession)
    model = Model(*(a.astype(np.float32) for a in fit(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("g_box"), [place])
            yield batch.filter(pa.array(score_texts(model, texts.to_pylist())[0] >= 0.5))

    rows, place = boxed(docs), docs.columns.index("text")
    return unboxed(rows.mapInArrow(lean(run), rows.schema))


def op2_quality_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), outputs=False)
