"""SimHash near-duplicates, linked exactly through a vantage-point tree.

Fingerprints are counted once each. A tree of vantage points, fitted on a bounded sample of them, partitions
fingerprints by Hamming distance. A pair within the radius differs by no more than the radius in its distance from
any vantage point, so a fingerprint near a boundary goes to both sides and every linked pair meets in some leaf.
Leaves that hold too many are split again, each by a tree fitted on a bounded sample of its own, until they fit or no
longer shrink: fingerprints so close that no vantage point parts them number a few millions at most. A leaf finds its
components and gives each member's smallest fellow; components that leaves share are merged by large-star and small-star
rounds, of which 60 do for any chain of documents that a table can hold; beyond, ``components`` raises.

Edge cases: null and empty texts have no words and fingerprint zero, linked like any other; texts of one or two words
are a single shingle; a null doc_id is never a component's id unless all are null; an empty table gives no rows; other
columns are ignored by the fingerprint and kept by ``first_of_group``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, maybe_broadcast, row_hashes, tidy

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints that the tree is fitted on, and those a leaf should hold; with OVERFULL times as many it is split again.
SAMPLE, LEAF, OVERFULL = 20_000, 4096, 4
#: Fingerprints that a leaf's own tree is fitted on, rounds of splitting, the share of its parent at which a leaf no longer shrinks, and rows routed by one task.
LEAF_SAMPLE, SPLITS, SHRINKS, TASK_ROWS = 2000, 5, 0.9, 1_000_000
#: Leaves of one tree that a number holds.
CHILDREN = 1 << 9
#: A leaf of more rows than this looks up flipped bits; others compare all, by strips of so many bytes at most.
COMPARED, STRIP_BYTES = 1 << 14, 1 << 20


def fingerprint(text: str | None) -> int:
    """SimHash of a text: lower-cased A-Z, words between ASCII white space, 3-word shingles, XXH64 with seed 42."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = ([0, *ends[:-1].tolist()], (ends - 1).tolist())
    k, digest = min(SHINGLE, len(words)), xxhash.xxh64_digest
    h = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)])
    bits = np.frombuffer(h, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for i in range(0, len(bits), 1 << 14):
        count += np.unpackbits(bits[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > len(bits)).tobytes(), "big", signed=True)


def _keys(id_col: str, text_col: str) -> list[Column]:
    return row_hashes(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, two hashes k1 and k2 of the id and the text, fp."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([fingerprint(t.as_py()) for t in b.column(3)], pa.int64())], names=["doc_id", "k1", "k2", "fp"])

    k1, k2 = _keys(id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64) if a.dtype == np.int64 else a ^ b)


class VantageTree:
    """Nodes (vantage point, median distance, left, right); a child under 0 is the leaf of that number, negated, less 1."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int, radius: int = RADIUS, seed: int = 7):
        self.nodes: list[list[int]] = []
        self.leaves, self.radius = 0, radius
        if not len(sample):
            self.leaves, self.root = 1, -1
            return
        self._rng = np.random.default_rng(seed)
        self._scale, self._leaf = total / max(1, len(sample)), leaf
        self.root = self._grow(sample, 0)

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        if len(rows) * self._scale <= self._leaf or len(rows) < 8 or depth >= 40:
            self.leaves += 1
            return -self.leaves
        v, m = vantage(rows, self._rng)
        d = distance(rows, v)
        left, right = rows[d <= m], rows[d > m]
        if not len(left) or not len(right):
            self.leaves += 1
            return -self.leaves
        k = len(self.nodes)
        self.nodes.append([int(v), m, 0, 0])
        self.nodes[k][2], self.nodes[k][3] = self._grow(left, depth + 1), self._grow(right, depth + 1)
        return k

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in rows and the leaves they go to."""
        at, leaf, todo = [], [], [(self.root, np.arange(len(rows)))]
        while todo:
            k, own = todo.pop()
            if not len(own):
                continue
            if k < 0:
                at.append(own)
                leaf.append(np.full(len(own), -k - 1))
                continue
            v, m, left, right = self.nodes[k]
            d = distance(rows[own], np.int64(v)).astype(np.int64)
            todo += [(left, own[d <= m + (self.radius + 1) // 2]), (right, own[d > m - self.radius // 2])]
        return (np.concatenate(at), np.concatenate(leaf)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def vantage(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.int64, int]:
    """Of some rows the one with the widest spread of distances, and their median."""
    probe = rows[rng.integers(0, len(rows), min(512, len(rows)))]
    best = max((rows[i] for i in rng.integers(0, len(rows), 8)), key=lambda v: float(distance(probe, v).std()))
    return best, int(np.median(distance(rows, best)))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Which b each a is within the radius of, by strips of a: two workers an executor hold one strip each, whatever a leaf holds."""
    step = max(1, STRIP_BYTES // (8 * max(1, len(b))))
    for i in range(0, len(a), step):
        yield distance(a[i : i + step, None], b[None, :]) <= radius


def leaf_components(rows: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The smallest row that each distinct row is linked with, directly or not."""
    rows = np.sort(rows)
    if len(rows) > COMPARED and radius <= 2:
        return rows, _by_masks(rows, radius)
    linked = np.concatenate([np.zeros(0, bool), *(near.sum(axis=1) > 1 for near in _near(rows, rows, radius))])
    root, todo = rows.copy(), np.flatnonzero(linked)
    while len(todo):
        first, frontier, todo = rows[todo[0]], todo[:1], todo[1:]
        while len(frontier) and len(todo):
            hit = np.zeros(len(todo), bool)
            for near in _near(rows[frontier], rows[todo], radius):
                hit |= near.any(axis=0)
            frontier, todo = todo[hit], todo[~hit]
            root[frontier] = first
    return rows, root


def _by_masks(rows: np.ndarray, radius: int) -> np.ndarray:
    """For a large leaf: look up each row with each set of at most radius bits flipped; smallest labels spread along the links."""
    one = [np.uint64(1 << i) for i in range(64)]
    masks = [*one, *(one[i] | one[j] for i in range(64) for j in range(i) if radius > 1)]
    a, b = [], []
    for m in np.array(masks, np.uint64).view(np.int64):
        k = np.minimum(np.searchsorted(rows, other := rows ^ m), len(rows) - 1)
        hit = np.flatnonzero((rows[k] == other) & (rows < other))
        a.append(hit)
        b.append(k[hit])
    a, b, label = np.concatenate(a), np.concatenate(b), np.arange(len(rows))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new[new], new[label])
        if (new == label).all():
            return rows[label]
        label = new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of the component, by alternating large-star and small-star; edges has a, b.

    Raises if so many rounds don't do.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("low"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "k")
        star = large.join(down, large["a"] == down["k"])
        small = star.select("b", "low").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.select(F.col("k").alias("a"), F.col("low").alias("b"))).distinct()
        last, edges = edges, materialize(small)
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _packed_tree(tree: VantageTree) -> bytes:
    return np.array([[tree.root, 0, 0, 0], *tree.nodes], "<i8").tobytes()


def _unpacked_tree(raw: bytes, radius: int) -> VantageTree:
    tree = VantageTree(np.zeros(0, np.int64), 0, 1, radius)
    rows = np.frombuffer(raw, "<i8").reshape(-1, 4).tolist()
    tree.root, tree.nodes = rows[0][0], rows[1:]
    return tree


def _split_again(routed: DataFrame, big: DataFrame, depth: int, radius: int, leaf: int) -> DataFrame:
    """The rows of big leaves (leaf, size) to the leaves of their own trees; every pair within the radius still meets."""
    sized = routed.select("leaf", "fp").join(maybe_broadcast(big, 32), "leaf")
    some = sized.where(F.pmod(F.xxhash64(F.lit(depth), "fp"), F.col("size")) < LEAF_SAMPLE)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        sample, size, goal = np.sort(rows["fp"].to_numpy(np.int64)), int(rows["size"].iloc[0]), leaf
        while (tree := VantageTree(sample, size, goal, radius, depth)).leaves > CHILDREN:
            goal *= 2
        return pd.DataFrame({"leaf": rows["leaf"].iloc[:1].to_numpy(), "size": [size], "tree": [_packed_tree(tree)]})

    trees = materialize(some.groupBy("leaf").applyInPandas(fit, "leaf long, size long, tree binary"))
    salts = F.ceil(F.col("size") / TASK_ROWS)
    a = trees.select("leaf", "size", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("fp"), "tree")
    b = sized.select("leaf", "size", F.pmod(F.xxhash64("fp"), salts).alias("salt"), "fp", F.lit(None).cast("binary").alias("tree"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for x in batches:
            leaves, sizes, rows, raw = x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2), x.column(3)
            heads = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False))
            for s, e in zip([0, *heads.tolist()], [*heads.tolist(), len(leaves)], strict=True):
                if s in heads:
                    tree, s = _unpacked_tree(raw[s].as_py(), radius), s + 1
                if e > s:  # rows of the leaf whose tree came last
                    own = rows[s:e].to_numpy(zero_copy_only=False).astype(np.int64)
                    at, to = tree.route(own)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves[s] * CHILDREN + to, pa.int64()), pa.array(own[at], pa.int64()), pa.array(np.full(len(at), sizes[s]), pa.int64())], names=["leaf", "fp", "parent"])

    n = max(routed.sparkSession.sparkContext.defaultParallelism, -(-big.agg(F.sum("size").alias("n")).head()["n"] // TASK_ROWS))
    both = a.unionByName(b).repartition(n, "leaf", "salt").sortWithinPartitions("leaf", "salt", F.col("tree").isNull())
    out = materialize(both.select("leaf", "size", "fp", "tree").mapInArrow(route, "leaf long, fp long, parent long"))
    discard(trees)
    return out


def leaves(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF, splits: int = SPLITS) -> DataFrame:
    """(depth, leaf, fp) of a materialized table of distinct fp: any two within the radius share a (depth, leaf)."""
    total = fps.count()
    some = fps.select("fp").orderBy(F.xxhash64(F.lit(1), "fp")).limit(sample).toPandas()["fp"].to_numpy(np.int64)
    tree = VantageTree(some, total, leaf, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy(zero_copy_only=False)
            at, to = tree.route(rows)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(rows[at], pa.int64())], names=["leaf", "fp"])

    routed = fps.select("fp").mapInArrow(route, "leaf long, fp long").withColumn("parent", F.lit(None).cast("long"))
    if total <= OVERFULL * leaf or not splits:
        return routed.select(F.lit(0).alias("depth"), "leaf", "fp")
    done, routed = [], materialize(routed)
    for depth in range(splits):
        sizes = routed.groupBy("leaf").agg(F.count("*").alias("size"), F.max("parent").alias("parent"))
        big = materialize(sizes.where((F.col("size") > OVERFULL * leaf) & (F.col("parent").isNull() | (F.col("size") < SHRINKS * F.col("parent")))).select("leaf", "size"))
        if big.isEmpty():
            break
        done.append(routed.join(maybe_broadcast(big.select("leaf"), 16), "leaf", "left_anti").select(F.lit(depth).alias("depth"), "leaf", "fp"))
        routed = _split_again(routed, big, depth, radius, leaf)
    out = routed.select(F.lit(len(done)).alias("depth"), "leaf", "fp")
    for d in done:
        out = out.unionByName(d)
    return out


def link(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(fp, low) of distinct fingerprints to (fp, root, component): the component's smallest fingerprint and smallest low."""
    fps = materialize(fps)

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        member, root = leaf_components(rows["fp"].to_numpy(np.int64), radius)
        out = pd.DataFrame({"a": member, "b": root})
        return out[member != root]

    stars = leaves(fps, radius, sample, leaf).groupBy("depth", "leaf").applyInPandas(local, "a long, b long")
    roots = maybe_broadcast(components(stars), 64)
    named = materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    discard(fps)
    least = maybe_broadcast(materialize(named.groupBy("root").agg(F.min("low").alias("component")).withColumnRenamed("root", "r")), 64)
    return named.join(least, named["root"] == least["r"]).select("fp", "root", "component")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    own = materialize(fingerprints(docs, id_col, text_col))
    linked = materialize(link(own.groupBy("fp").agg(F.min("doc_id").alias("low")), radius).withColumnRenamed("fp", "f"))
    linked = maybe_broadcast(linked, 72)
    return own, own.join(linked, own["fp"] == linked["f"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id."""
    return _grouped(docs, id_col, text_col, radius)[1].select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, that with its smallest id, nulls last; all columns are kept."""
    own, grouped = _grouped(docs, id_col, text_col, radius)
    a, b = fresh(docs, "first_hash"), fresh(docs, "second_hash")
    hashes = [F.col("k1").alias(a), F.col("k2").alias(b)]
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")).alias("m")).select("m.k1", "m.k2")
    first = materialize(first)
    again = materialize(own.join(maybe_broadcast(first, 48), ["k1", "k2"], "left_semi").groupBy("k1", "k2").count().where("count > 1").select(*hashes))
    first = maybe_broadcast(first, 48).select(*hashes)
    kept = docs.withColumns(dict(zip((a, b), _keys(id_col, text_col), strict=True))).join(first, [a, b], "left_semi")
    if again.isEmpty():
        return kept.drop(a, b)
    again = maybe_broadcast(again, 48)  # rows with the same id and text
    once = kept.join(again, [a, b], "left_semi").dropDuplicates([a, b])
    return kept.join(again, [a, b], "left_anti").unionByName(once).drop(a, b)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
