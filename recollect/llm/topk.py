"""Exact top-k search by inner product with dual cover trees.

Vectors are scaled to integers. A net of centres, chosen on a bounded sample, deals all rows into cells by the nearest one,
and a cell into blocks of a bounded number of vectors, so that blocks are compact and no cell is too large for a task.
Queries are dealt alike. Each block of queries first meets one block of its own cell, which gives every query a k-th score
to beat; a cell is then left out for the block of queries if no inner product within their covering radii can reach the
worst of these scores. The pairs of blocks that remain are searched by cover trees of both, which prune pairs of nodes in
the same way; the best of all are merged by rank. Centres bound scores in floating point with a margin that grows with
their size; scores themselves are exact integers: products are summed in floating point only where every sum is below
2**53, else in 64-bit integers, and a score that doesn't fit in these is refused.

Edge cases: rows whose vector is null, empty, of another length than most, or holds null or non-finite components take no part; equal
scores go by the smaller id; rows with equal ids are one candidate each, and queries with equal ids one query each, told apart by place; null
ids are no queries and come last among ties; an empty table, or no queries, gives no rows; components that scaled don't fit in 62 bits, and
scores of 2**63 or more, raise; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE, K, EVERY = 1024, 10, 100
#: Vectors in a block of candidates and of queries, the least in a block where cores would idle, and vectors in a leaf of a tree.
BLOCK, QUERY_BLOCK, LEAST_BLOCK, LEAF = 16_384, 2048, 1024, 128
#: Blocks of queries that a task holds at once; centres of the net, and the sample that they are chosen from.
QUERY_BLOCKS_A_TASK, CELLS, SAMPLE = 64, 512, 8192
#: Partitions at most; one holds several pairs of blocks then, which it searches one after the other.
MOST_TASKS = 20_000
#: Pairs in a batch of rows, each with a block of queries.
PAIRS_A_BATCH = 16
#: Integers below which every sum is exact in floating point, and the largest component.
EXACT, LARGEST = 1 << 53, 1 << 62

RESULT = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("products", pa.int64())])


class CoverTree:
    """Nodes hold a centre, the covering radius, their rows (a slice of order) and children of at most half the reach."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.leaf = rows.astype(np.float64), leaf
        self.order = np.arange(len(rows))
        self.centre, self.radius, self.first, self.last, self.children = [], [], [], [], []
        if len(rows):
            self._grow(0, len(rows))

    def _grow(self, first: int, last: int) -> int:
        own = self.order[first:last]
        centre = self.rows[own].mean(axis=0)
        centre = self.rows[own[np.argmin(((self.rows[own] - centre) ** 2).sum(axis=1))]]
        d = np.sqrt(((self.rows[own] - centre) ** 2).sum(axis=1))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.first.append(first)
        self.last.append(last)
        self.children.append([])
        if last - first > self.leaf and d.max() > 0:
            reach, near, to = d.max() / 2, d.copy(), np.zeros(len(own), np.int64)
            centres = 1
            most = min(256, max(2, 2 * len(own) // self.leaf))  # so that children are no smaller than a leaf need be
            while near.max() > reach and centres < most:  # a net: the farthest row is the next centre
                e = np.sqrt(((self.rows[own] - self.rows[own[np.argmax(near)]]) ** 2).sum(axis=1))
                to[e < near] = centres
                near = np.minimum(near, e)
                centres += 1
            order = np.argsort(to, kind="stable")
            self.order[first:last] = own[order]
            at = first
            for n in np.bincount(to).tolist():
                if n:
                    self.children[node].append(self._grow(at, at + n))
                    at += n
        return node


class Products:
    """Inner products of integer vectors, exact: as floating point has them where no sum can reach 2**53, else by 64-bit integers."""

    def __init__(self, largest: int, width: int):
        self.plain = width * largest * largest < EXACT

    def __call__(self, about: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """about: the same in floating point."""
        if self.plain:
            return np.rint(about).astype(np.int64)
        if about.size and np.abs(about).max() >= 2.0**63 * (1 - 1e-9):
            raise ValueError("an inner product doesn't fit in 64 bits")
        return q @ x.T  # modulo 2**64, and the sums fit


def bound(centre: np.ndarray, radius: float, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What no inner product of a vector within the radius of the centre and one within a radius of its centre exceeds."""
    a, b = np.sqrt(centre @ centre) + radius, np.sqrt((centres * centres).sum(axis=1)) + radii
    far = radius * (b - radii) + radii * (a - radius) + radius * radii
    return centres @ centre + far + a * b * 1e-12 + 1e-3


class DualSearch:
    """The k best candidates of each query, with the place in the candidates, by score, then id; an empty place is -1.

    least: scores that a query's candidates must reach, from earlier blocks; products counts what was computed.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, query_tree: CoverTree | None = None, tree: CoverTree | None = None, least: np.ndarray | None = None, multiply: Products | None = None):
        self.q, self.q_ids, self.x, self.ids, self.own, self.k = queries, query_ids, rows, ids, own, k
        self.qt, self.xt = query_tree or CoverTree(queries), tree or CoverTree(rows)
        largest = max((int(np.abs(v).max()) for v in (queries, rows) if v.size), default=0)
        self.multiply = multiply or Products(largest, queries.shape[1] if queries.ndim > 1 else 0)
        self.score = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.place = np.full((len(queries), k), -1)
        self.least = np.full(len(queries), np.iinfo(np.int64).min) if least is None else least.copy()
        self.products = 0
        if len(queries) and len(rows):
            self._search()

    def _search(self) -> None:
        centres, radii = np.array(self.xt.centre), np.array(self.xt.radius)
        todo = [(0, 0, float("inf"))]
        while todo:
            a, b, most = todo.pop()
            if most < self.least[self.qt.order[self.qt.first[a] : self.qt.last[a]]].min():
                continue
            of_a, of_b = self.qt.children[a], self.xt.children[b]
            if not of_a and not of_b:
                self._leaf(a, b)
                continue
            split_a = bool(of_a) and (not of_b or self.qt.radius[a] > self.xt.radius[b])
            pairs = []
            for x in of_a if split_a else [a]:
                others = [b] if split_a else of_b
                pairs += [(x, y, v) for y, v in zip(others, bound(self.qt.centre[x], self.qt.radius[x], centres[others], radii[others]).tolist(), strict=True)]
            todo += sorted(pairs, key=lambda p: p[2])  # the most promising pair is next

    def _leaf(self, a: int, b: int) -> None:
        i = self.qt.order[self.qt.first[a] : self.qt.last[a]]
        j = self.xt.order[self.xt.first[b] : self.xt.last[b]]
        s = self.multiply(self.qt.rows[i] @ self.xt.rows[j].T, self.q[i], self.x[j])
        self.products += s.size
        fits = (s >= self.least[i, None]) & (self.own[j][None, :] != self.q_ids[i][:, None])
        hit = np.flatnonzero(fits.any(axis=1))
        if not len(hit):
            return
        i, s, fits = i[hit], s[hit], fits[hit]
        some = np.flatnonzero(fits.any(axis=0))  # few candidates of a leaf are good enough for any query
        s, fits, j = s[:, some], fits[:, some], j[some]
        place = np.concatenate([self.place[i], np.where(fits, j, -1)], axis=1)
        s = np.concatenate([self.score[i], np.where(fits, s, np.iinfo(np.int64).min)], axis=1)
        ids = np.where(place >= 0, self.ids[place], np.iinfo(np.int64).max)
        best = np.lexsort((ids, place < 0, ~s), axis=1)[:, : self.k]
        self.score[i], self.place[i] = np.take_along_axis(s, best, 1), np.take_along_axis(place, best, 1)
        full = self.place[i, -1] >= 0
        self.least[i[full]] = np.maximum(self.least[i[full]], self.score[i[full], -1])


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(v) > 0) & ~bad, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def net(rows: np.ndarray, cells: int) -> np.ndarray:
    """Up to so many of the rows, each the farthest from those before."""
    if not len(rows):
        return rows
    chosen = [int(np.argmin(((rows - rows.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < cells and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _celled(centres: np.ndarray, width: int):
    """Add each row's nearest centre and its distance from it; vectors become bytes."""
    norms = (centres * centres).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = v.astype(np.float64)
            cell = (norms - 2 * x @ centres.T).argmin(axis=1) if len(v) else np.zeros(0, np.int64)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            raw = v.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([raw[8 * width * i : 8 * width * (i + 1)] for i in range(len(v))], pa.binary()), b.column(3), pa.array(cell, pa.int64()), pa.array(far, pa.float64())],
                names=["id", "place", "v", "q", "cell", "far"],
            )

    return run


def _packed(size: int):
    """Rows, sorted by cell and block, to one row a block: ids, places, nulls, vectors and least scores as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                for at in range(0, t.num_rows, size):
                    o = t.slice(at, size).combine_chunks()
                    ids, places = o.column("id"), o.column("place").to_numpy()
                    null = ids.is_null().to_numpy()
                    parts = (ids.fill_null(np.iinfo(np.int64).max).to_numpy().tobytes(), places.tobytes(), null.tobytes(), b"".join(o.column("v").to_pylist()), o.column("least").to_numpy().tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, at // size, *parts), [pa.int64()] * 3 + [pa.binary()] * 5, strict=True)], names=["cell", "block", "slice", "ids", "places", "nulls", "vectors", "least"])

        for b in batches:
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
            for s, e in zip([0, *edges], [*edges, len(keys)], strict=True):
                if e > s:
                    if tuple(keys[s]) != key:
                        yield from flush()
                        held, key = [], tuple(keys[s].tolist())
                    held.append(b.slice(s, e - s))
        yield from flush()

    return run


def search_blocks(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int | None = None, query_block: int = QUERY_BLOCK, cells: int = CELLS) -> DataFrame:
    """row, query_id, vec_id, score, products: each query's best of every pair of blocks searched; a row without vec_id tells products alone."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where("v is not null")
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()))
    largest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.count_if("q").alias("q"), largest.alias("m")).orderBy(F.desc("c"), "n").head()
    if sizes is None or not sizes["q"]:
        return rows.select(F.col("place").alias("row"), F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("products")).limit(0)
    width, n = sizes["n"], sizes["c"]
    if sizes["m"] >= LARGEST or sizes["m"] < 0:
        raise ValueError("a component doesn't fit in 62 bits")
    multiply = Products(sizes["m"], width)
    rows = rows.where(F.size("v") == width)
    parallel = spark.sparkContext.defaultParallelism
    block = block or min(BLOCK, max(LEAST_BLOCK, -(-n // (4 * parallel))))
    some = rows.select("v").orderBy(F.xxhash64("place"), "place").limit(SAMPLE).toArrow().column("v").combine_chunks()
    centres = net(some.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64), min(cells, -(-n // block)))
    schema = "id long, place long, v binary, q boolean, cell long, far double"
    dealt = materialize(rows.select("id", "place", "v", "q").mapInArrow(_celled(centres, width), schema))
    # at most a row a cell: its vectors, queries, radius and blocks
    stats = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max("far").alias("radius")).orderBy("cell").collect()
    blocks = {r["cell"]: -(-r["n"] // block) for r in stats}
    q_blocks = {r["cell"]: -(-r["q"] // query_block) for r in stats}
    known, radii = np.array([r["cell"] for r in stats]), np.array([r["radius"] for r in stats])
    known_centres = centres[known]
    of = lambda table: F.get(F.array(*(F.lit(max(1, table.get(c, 1))) for c in range(len(centres)))), F.col("cell").cast("int"))
    chunks = max(1, -(-sum(q_blocks.values()) // QUERY_BLOCKS_A_TASK))
    tasks = min(sum(blocks.values()) * chunks, MOST_TASKS)
    schema = "cell long, block long, slice long, ids binary, places binary, nulls binary, vectors binary, least binary"

    def blocked(df: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
        own = df.select("cell", F.pmod(F.xxhash64("place"), of(counts)).cast("long").alias("block"), "id", "place", "v", "least")
        return own.repartition(min(sum(counts.values()), MOST_TASKS), "cell", "block").sortWithinPartitions("cell", "block", "place").mapInArrow(_packed(2 * size), schema)

    least = F.lit(np.iinfo(np.int64).min).alias("least")
    x = materialize(blocked(dealt.withColumn("least", least), blocks, block))
    q = materialize(blocked(dealt.where("q").withColumn("least", least), q_blocks, query_block))

    def columns(r: dict) -> tuple[np.ndarray, ...]:
        return np.frombuffer(r["vectors"], "<i8").reshape(-1, width), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["places"], np.int64), np.frombuffer(r["nulls"], bool), np.frombuffer(r["least"], np.int64)

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        there = [(columns(r), CoverTree(columns(r)[0])) for r in candidates.to_pylist()] if asked.num_rows else []
        for o in asked.to_pylist() if there else []:
            own, q_ids, q_places, _, worst = columns(o)
            query_tree = CoverTree(own)
            for (data, ids, places, nulls, _), tree in there:
                found = DualSearch(own, q_places, data, ids, places, k, query_tree, tree, worst, multiply)
                a, b = np.nonzero(found.place >= 0)
                p = found.place[a, b]
                out.append(pa.table([pa.array(q_places[a]), pa.array(q_ids[a]), pa.array(ids[p], mask=nulls[p]), pa.array(found.score[a, b]), pa.nulls(len(a), pa.int64())], schema=RESULT))
                out.append(pa.table([[None], [None], [None], [None], [found.products]], schema=RESULT))
        return pa.concat_tables(out) if out else RESULT.empty_table()

    result = "row long, query_id long, vec_id long, score long, products long"

    def met(asked: DataFrame) -> DataFrame:
        """asked: blocks of queries with the cell (at) and the block (to) that each meets, and the chunk that they go in."""
        to = [F.col("at").alias("cell"), F.col("to").alias("block")]
        both = asked.select(*to, "chunk", "ids", "places", "nulls", "vectors", "least").repartition(tasks, "cell", "block", "chunk")
        every = x.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).repartition(tasks, "cell", "block", "chunk")
        return every.groupBy("cell", "block", "chunk").cogroup(both.groupBy("cell", "block", "chunk")).applyInArrow(search, result)

    chunk = F.pmod(F.xxhash64("cell", "block", "slice"), F.lit(chunks)).alias("chunk")
    first = F.pmod(F.xxhash64("cell", "block", "slice", F.lit(1)), of(blocks)).cast("long").alias("to")  # one block of the own cell
    near = materialize(met(q.select(F.col("cell").alias("at"), first, chunk, "ids", "places", "nulls", "vectors", "least")))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))
    worst = near.where("row is not null").withColumn("rank", rank).where(F.col("rank") == k).select(F.col("row").alias("place"), F.col("score").alias("least"))
    q = materialize(blocked(dealt.where("q").join(worst, "place", "left").withColumn("least", F.coalesce("least", least)), q_blocks, query_block))
    names = ["at", "to", "chunk", "ids", "places", "nulls", "vectors", "least"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that a block of queries has yet to meet: of each cell that may hold better vectors all, but for the one it met."""
        for b in batches:
            for r in b.to_pylist():
                own, _, _, _, least = columns(r)
                centre = own.astype(np.float64).mean(axis=0)
                radius, worst = float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max()), float(least.min())
                may = bound(centre, radius, known_centres, radii) >= worst - abs(worst) * 1e-12
                to = ((c, m) for c in known[may].tolist() for m in range(blocks[c]) if (c, m) != (r["cell"], r["first"]))
                while some := list(itertools.islice(to, PAIRS_A_BATCH)):
                    same = [pa.array([r[c]] * len(some), pa.binary()) for c in names[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int64()), pa.array([m for _, m in some], pa.int64()), pa.array([r["chunk"]] * len(some), pa.int64()), *same], names=names)

    later = q.select("cell", first.alias("first"), chunk, "ids", "places", "nulls", "vectors", "least").mapInArrow(pairs, "at long, to long, chunk long, ids binary, places binary, nulls binary, vectors binary, least binary")
    return near.unionByName(met(later))


def top_k(vectors: DataFrame, queries: Column, k: int = K, **options) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best other rows; options as of search_blocks."""
    best = search_blocks(vectors, queries, k, **options).where("row is not null")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
