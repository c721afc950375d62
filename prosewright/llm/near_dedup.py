"""Near-duplicate documents by a chosen-path set similarity join.

Each document's set of word shingles gets minwise coordinates. Equal sets form one class, and the classes enter TREES
independent random trees: at a node a document follows one or two of its minwise tokens, chosen by the node alone, so
that a pair of similarity J follows a common path with chance J at each choice, and there is a little over 1/threshold
choices a level. A node of at most LEAF classes is a leaf; larger nodes branch on. Leaves are compared exhaustively:
first their sketches, which drops what is clearly dissimilar, and then the full sets, which decides each link. The
texts of what may be similar are compared in blocks of at most BLOCK_BYTES, and a pair of blocks is one task's work, so
neither many nor long members of a leaf fill a task's memory.

A node that is still large after ROUNDS of branching holds classes that are nearly all alike: a round goes down as many
levels as would suffice if each halved the node, so classes of similarity 0.5 are apart after the first. It is dealt
into leaves of a few pivots and a share of the rest, so no task gets it whole; members that end in another component
than the node's main one are then compared with every member, by sketches first. No partner or candidate is capped.

Links become components by alternating star contraction. Only 64-bit keys, sketches and candidate texts shuffle.

Defined results: A-Z is lower-cased, words are runs without ASCII white space; a document with fewer words than a
shingle has its whole word sequence as the one shingle; null or empty texts have no shingles and link with nothing;
a null doc_id links with nothing and is kept; rows that share a doc_id count as one document, linked by any of their
texts, in near_duplicates, while kept_documents takes each text by itself, so that a text goes only if it is linked with
one that stays; an empty table gives an empty result; other columns are ignored. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch, boxed, documents, join_by_size, join_groups, lean, mix, runs, small_batches, unboxed

TREES, LEAF, ROUNDS, PIVOTS, SKETCH = 16, 3000, 4, 4, 128
#: Cells of the bit matrix, and shingles, that are compared at once; words whose hashes are remembered.
CELLS, AT_ONCE, MEMO = 1 << 24, 1 << 20, 100_000
#: Bytes of the texts of a block of a cluster.
BLOCK_BYTES = 8 << 20
#: Standard errors that the sketches' estimate may lie below the threshold.
SLACK = 4.0


class WordHashes(dict):
    """64-bit hashes of words, memoised up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO and len(word) < 100:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(words) if len(words) < k else k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(h))):
            out = mix(out + h[j : j + n], j + 1)
    return np.unique(out)


@lru_cache(maxsize=4)
def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64), salt) | np.uint64(1)


def root_choices(trees: int, threshold: float) -> list[int]:
    """The tree of each root coordinate: one or two a tree, 1.25 on average, or more for a lower threshold."""
    extra = max(0.25, 1.05 / threshold - 1)
    return [t for t in range(trees) for _ in range(1 + (((t + 1) * extra) // 1 > (t * extra) // 1))]


def describe(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of each row: doc_id, what names its text (h, g, bytes), n_shingles, a 128-bit signature of the set, its sketch,
    and its keys at the trees' roots."""
    roots = len(root_choices(TREES, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a32, a64 = (seeds(SKETCH, 11) & np.uint64(0xFFFFFFFF)).astype(np.uint32), seeds(roots, 12)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                sets = [shingles(t, k) for t in texts[lo : lo + 256]]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                sketch = np.zeros((SKETCH, len(sets)), np.uint16)
                keys = np.zeros((roots, len(sets)), np.uint64)
                if len(full):
                    flat = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[full]
                    low = (flat >> np.uint64(32)).astype(np.uint32)
                    with np.errstate(over="ignore"):
                        for j in range(SKETCH):
                            least = np.minimum.reduceat(low * a32[j], starts)
                            sketch[j, full] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
                        for j in range(roots):
                            keys[j, full] = mix(np.minimum.reduceat(flat * a64[j], starts), j + 101)
                signs = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, len(sets)) for c in ("doc_id", "h", "g", "bytes")),
                        pa.array(sizes),
                        pa.array(signs, pa.binary()),
                        pa.array([c.tobytes() for c in np.ascontiguousarray(sketch.T)], pa.binary()),
                        pa.array(list(np.ascontiguousarray(keys.T).view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "h", "g", "bytes", "n_shingles", "sign", "sketch", "roots"],
                )

    rows = docs.select(*(v.alias(c) for c, v in names().items()), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), "text")
    return rows.mapInArrow(lean(run), "doc_id bigint, h bigint, g bigint, bytes bigint, n_shingles bigint, sign binary, sketch binary, roots array<bigint>")


def names() -> dict[str, Column]:
    """What names a row's text: its doc_id and a 128-bit hash of the text, in two halves."""
    return {"doc_id": F.col("doc_id").cast("bigint"), "h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")}


def branch(rows: DataFrame, threshold: float) -> DataFrame:
    """The children of rows (node, size, id, sketch): each follows tokens that its node chooses, level by level.

    A node may go down as many levels at once as would leave LEAF classes if each halved it.
    """
    extra = max(0.25, 1.05 / threshold - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy().view(np.uint64)
            steps = np.maximum(1, np.log2(batch.column("size").to_numpy() / LEAF).astype(np.int64))
            ids = batch.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
            at = np.arange(len(ids))
            while len(at):
                choice = mix(node, 301)
                twice = (mix(choice, 302) >> np.uint64(11)).astype(np.float64) / 2.0**53 < extra
                at, node, steps = np.concatenate((at, at[twice])), np.concatenate((choice, mix(choice[twice], 303))), np.concatenate((steps, steps[twice])) - 1
                token = sketch[at, (node % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64)
                node = mix(node + token * np.uint64(0x100000001B3), 304)
                done = steps <= 0
                if done.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[done].view(np.int64)), pa.array(ids[at[done]])], ["node", "id"])
                at, node, steps = at[~done], node[~done], steps[~done]

    return rows.select("node", "size", "id", "sketch").mapInArrow(run, "node bigint, id bigint")


def leaves(classes: DataFrame, scratch: Scratch, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Rows (node, id) of all leaves, and rows (node, id) of the nodes that stay large, if any."""
    tree_of = root_choices(TREES, threshold)
    tree = F.array(*map(F.lit, tree_of))
    rows = classes.select("id", F.posexplode("roots").alias("k", "key")).select(F.xxhash64(F.element_at(tree, F.col("k") + 1), "k", "key").alias("node"), "id")
    sketches = classes.select("id", "sketch")
    found = []
    for turn in range(ROUNDS + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        rows = scratch.table(rows.join(sizes.hint("merge"), "node"), f"nodes{turn}")
        found.append(rows.filter(F.col("size") <= LEAF).select("node", "id"))
        large = rows.filter(F.col("size") > LEAF)
        if large.isEmpty():
            return union(found), None
        if turn < ROUNDS:
            rows = scratch.table(branch(large.join(sketches.hint("merge"), "id"), threshold), f"paths{turn}")
    return union(found), large


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def deal(large: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves of large nodes: each gets PIVOTS of the node, the same for all its leaves, and a share of the rest."""
    order = F.xxhash64("id", "node")
    first = large.groupBy("node", "size").agg(F.min(F.struct(order.alias("o"), "id")).alias("p0"), *(F.min(F.struct(F.xxhash64("id", "node", F.lit(j)).alias("o"), "id")).alias(f"p{j}") for j in range(1, PIVOTS)))
    parts = F.ceil(F.col("size") / (LEAF - PIVOTS)).cast("int")
    leaf = F.xxhash64("node", "part")
    rest = large.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")).select(leaf.alias("node"), "id")
    pivots = first.select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.array(*(F.col(f"p{j}.id") for j in range(PIVOTS))).alias("ids"))
    return rest.unionByName(pivots.select(leaf.alias("node"), F.explode("ids").alias("id"))).distinct()


def unlike(rows: DataFrame) -> DataFrame:
    """Of nodes with the same members only one."""
    shape = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("xor"))
    one = shape.groupBy("n", "sum", "xor").agg(F.min("node").alias("node")).select("node")
    return rows.join(one.hint("merge"), "node", "left_semi")


def alike(found: np.ndarray, floor: float) -> np.ndarray:
    """By sketches: the square matrix of which members may be similar enough."""
    n = len(found)
    same = np.empty((n, n), np.int16)
    for i in range(n):
        same[i] = (found == found[i]).sum(1)
    return same >= floor * SKETCH


def clusters(rows: DataFrame, threshold: float) -> DataFrame:
    """Compares the sketches of each leaf's members; what may be similar, directly or by others, is a cluster. With a
    column side, only pairs with a member of side 1 count."""
    floor = threshold - SLACK * (threshold * (1 - threshold) / SKETCH) ** 0.5
    sided = "side" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, "node"):
            ids = table.column("id").to_numpy()
            asks = table.column("side").to_numpy() == 1 if sided else None
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
            names, members = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                near = alike(sketch[a:b], floor)
                if sided:
                    near &= asks[a:b, None] | asks[None, a:b]
                left = np.ones(b - a, bool)
                for i in range(b - a):
                    if not left[i]:
                        continue
                    now = np.zeros(b - a, bool)
                    now[i] = True
                    edge = now
                    while edge.any():
                        edge = near[edge].any(0) & ~now
                        now = now | edge
                    left &= ~now
                    if now.sum() > 1:
                        own = np.sort(ids[a:b][now])
                        names.append(np.full(len(own), xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).view(np.int64))
                        members.append(own)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], ["node", "id"])

    cols = ["node", "id", "sketch", *(["side"] if sided else [])]
    return rows.select(*cols).repartition("node").sortWithinPartitions("node").mapInArrow(lean(run), "node bigint, id bigint").distinct()


def blocks(near: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The clusters as nodes of at most two blocks of some BLOCK_BYTES: a larger cluster gives a node for each pair."""
    sized = scratch.table(near.join(classes.select("id", "bytes").hint("merge"), "id"), "sized")
    parts = sized.groupBy("node").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("parts")).filter("parts > 2")
    parts = scratch.table(parts, "parts")
    met = join_by_size(sized.select("node", "id"), parts, "node", "left", parts.count(), 32)
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    other = F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own"))
    split = met.filter("parts is not null").withColumn("own", own).withColumn("other", F.explode(other))
    split = split.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id")
    return met.filter("parts is null").select("node", "id").unionByName(split)


def add_shared(out: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds intersection sizes to the lower half of a square matrix, by bit sets over the shingles that sets share."""
    n = len(sets)
    names, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), np.fromiter(map(len, sets), np.int64, n))
    number = np.cumsum(often > 1) - 1
    keep = often[which] > 1
    owner, which = owner[keep], number[which[keep]]
    width = max(64, CELLS // n // 64 * 64)
    for low in range(0, int((often > 1).sum()), width):
        here = (which >= low) & (which < low + width)
        bits = np.zeros((n, width), bool)
        bits[owner[here], which[here] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        words = words[:, words.any(0)]
        for j in range(1, n):
            out[j, :j] += np.bitwise_count(words[:j] & words[j]).sum(1, dtype=np.int32)


def joined(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(least id, id) of the components of a cluster: pairs with den * intersection >= num * union are linked."""
    n = len(ids)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    both = np.zeros((n, n), np.int32)
    parts = int(sizes.sum()) // AT_ONCE + 1
    for p in range(parts):  # shingles by their hash, so that few are held at once
        add_shared(both, sets if parts == 1 else [s[s % np.uint64(parts) == p] for s in sets])
    link = np.zeros((n, n), bool)
    for j in range(1, n):
        row = both[j, :j].astype(np.int64)
        link[j, :j] = (den * row >= num * (sizes[j] + sizes[:j] - row)) & (row > 0)
    link |= link.T
    left, out = np.ones(n, bool), []
    for i in range(n):
        if left[i]:
            now = np.zeros(n, bool)
            now[i] = True
            edge = now
            while edge.any():
                edge = link[edge].any(0) & ~now
                now = now | edge
            left &= ~now
            own = np.sort(ids[now])
            out += [(own[0], x) for x in own[1:]]
    return out


def confirm(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b), a < b, between the members of each cluster, decided on full sets; each goes to the least id of
    its component within the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, "node"):
            ids = table.column("id").to_numpy()
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out += joined(ids[a:b], [shingles(t, k) for t in table.column("text").slice(a, b - a).to_pylist()], num, den)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(out, np.int64).T], ["a", "b"])

    return rows.select("node", "id", "text").repartition("node").sortWithinPartitions("node").mapInArrow(lean(run), "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every linked id, by alternating large and small star steps until nothing changes."""
    edges = scratch.table(links.select("a", "b").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b")
        # small star: every edge leads from the larger id to the smaller one
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(least.hint("merge"), "b")
        small = met.select(F.col("m").alias("a"), "b").unionByName(met.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct()
        old, edges = edges, scratch.table(small, "stars")
        scratch.drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def texts_of(docs: DataFrame, classes: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows with the texts of their classes; only those texts move, one for each class."""
    wanted = classes.select("id", "doc_id", "h", "g").join(rows.select("id").distinct().hint("merge"), "id", "left_semi")
    wanted = scratch.table(wanted, f"{name}-ids")
    texts = join_by_size(docs.select(*(v.alias(c) for c, v in names().items()), "text"), wanted, ["doc_id", "h", "g"], "inner", wanted.count(), 64)
    texts = scratch.table(texts.groupBy("id").agg(F.first("text").alias("text")), f"{name}-texts")
    return rows.join(texts.hint("merge"), "id")


class Groups:
    """The classes of equal sets, which class each row is of, and the components of linked classes."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        small_batches(docs.sparkSession)
        threshold = num / den
        self.scratch = scratch = Scratch(docs.sparkSession, "near")
        found = scratch.table(describe(docs, k, threshold), "sets")
        self.total = found.count()
        full = found.filter("n_shingles > 0 and doc_id is not null")
        self.alone = found.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
        groups = full.groupBy("sign").agg(F.min(F.struct("doc_id", "h", "g", "bytes")).alias("first"), F.count("*").alias("size"), F.min("sketch").alias("sketch"), F.min("roots").alias("roots"))
        self.classes = classes = scratch.table(groups.select(F.monotonically_increasing_id().alias("id"), "sign", "first.*", "size", "sketch", "roots"), "classes")
        self.rows = join_groups(full.select("doc_id", "h", "g", "n_shingles", "sign"), classes.select("sign", "size", "id"), ["sign"], "size", self.total).select("doc_id", "h", "g", "n_shingles", "id")
        self.rows = scratch.table(self.rows, "rows")
        sketches = classes.select("id", "sketch").hint("merge")
        rows, large = leaves(classes, scratch, threshold)
        if large is not None:
            rows = rows.unionByName(deal(large.select("node", "size", "id"), scratch))
        rows = scratch.table(unlike(rows), "leaves")
        self.links = self.compare(docs, rows.join(sketches, "id"), "near", k, num, den)
        if large is not None:
            late = stragglers(large.select("node", "id"), components(self.links, scratch), scratch)
            self.links = self.links.unionByName(self.compare(docs, late.join(sketches, "id"), "late", k, num, den))

    def compare(self, docs: DataFrame, rows: DataFrame, name: str, k: int, num: int, den: int) -> DataFrame:
        near = self.scratch.table(clusters(rows, num / den), f"{name}-clusters")
        near = blocks(near, self.classes, self.scratch)
        return self.scratch.table(confirm(texts_of(docs, self.classes, near, self.scratch, name), k, num, den), f"{name}-links")

    def best(self, links: DataFrame) -> DataFrame:
        """(id, size, best): of each class the least row (doc_id, h, g) of its component's classes."""
        tops = self.scratch.table(components(links, self.scratch), "components")
        own = self.classes.select("id", "size", F.struct("doc_id", "h", "g").alias("own"))
        least = tops.join(own.hint("merge"), "id").groupBy("component").agg(F.min("own").alias("best"), F.count("*").alias("n"))
        least = self.scratch.table(least, "least")
        named = join_groups(tops, least, ["component"], "n", least.agg(F.sum("n")).first()[0] or 0).select("id", "best")
        return self.scratch.table(own.join(named.hint("merge"), "id", "left").select("id", "size", F.coalesce("best", "own").alias("best")), "named")

    def shared(self) -> DataFrame:
        """Links between classes in which one doc_id occurs."""
        held = self.rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n")).filter("a < z")
        held = self.scratch.table(held.select("doc_id", "a", "n"), "held")
        if held.isEmpty():
            return held.select("a", F.col("a").alias("b"))
        pairs = join_groups(self.rows.select("doc_id", "id").distinct(), held, ["doc_id"], "n", self.total)
        return self.scratch.table(pairs.filter("id > a").select("a", F.col("id").alias("b")), "held-links")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. Documents link at similarity num/den or more."""
    g = Groups(docs, k, num, den)
    named = g.best(g.links.unionByName(g.shared()))
    linked = join_groups(g.rows, named, ["id"], "size", g.total).select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"))
    out = linked.unionByName(g.alone.withColumn("component_id", F.col("doc_id")))
    return g.scratch.result(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def stragglers(large: DataFrame, tops: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, id, side) in which members of a large node that lie outside its main component (side 1) meet every
    member of the node, in blocks."""
    owned = scratch.table(large.join(tops.hint("merge"), "id", "left").select("node", "id", F.coalesce("component", "id").alias("top")), "owned")
    count = owned.groupBy("node", "top").agg(F.count("*").alias("n"))
    main = count.groupBy("node").agg(F.max(F.struct("n", "top")).alias("m"), F.sum("n").alias("size")).select("node", F.col("m.top").alias("main"), "size")
    with_main = owned.join(main.hint("merge"), "node")
    parts = F.ceil(F.col("size") / LEAF).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(9)), parts).cast("int")
    outside = with_main.filter("top <> main")
    every = with_main.withColumn("block", block)
    homes = outside.withColumn("home", block).select("node", "home").distinct()
    pairs = homes.join(main.hint("merge"), "node").select("node", "home", F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"))
    members = pairs.join(every.select("node", "block", "id").hint("merge"), ["node", "block"]).select(F.xxhash64("node", "home", "block").alias("node"), "id", F.lit(0).alias("side"))
    askers = pairs.join(outside.withColumn("home", block).select("node", "home", "id").hint("merge"), ["node", "home"]).select(F.xxhash64("node", "home", "block").alias("node"), "id", F.lit(1).alias("side"))
    return scratch.table(members.unionByName(askers).groupBy("node", "id").agg(F.max("side").alias("side")), "stragglers")


def kept_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one text of each component, that of the least doc_id; all columns kept. Rows that repeat its doc_id
    and text all stay: exact copies are the exact dedup's work."""
    g = Groups(docs, k, num, den)
    rows = join_groups(g.rows, g.best(g.links), ["id"], "size", g.total)
    lost = rows.filter(F.struct("doc_id", "h", "g") != F.col("best")).select(F.col("doc_id").alias("g_doc"), F.col("h").alias("g_h"), F.col("g").alias("g_g"))
    lost = g.scratch.result(lost.distinct(), "lost")
    rows = boxed(docs, **{f"g_{c}": v for c, v in zip(("doc", "h", "g"), names().values(), strict=True)})
    return unboxed(join_by_size(rows, lost, ["g_doc", "g_h", "g_g"], "left_anti", lost.count(), 64))


def op8_near_dedup_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 3, 85, 100)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)
"""
