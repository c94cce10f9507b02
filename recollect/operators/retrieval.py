"""Keyword and vector retrieval, their fusion, and packing under a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, types
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..functions import vectors as V
from ..scratch import written
from . import temporal


def tokens(x: Column) -> Column:
    return T.words(F.lower(x))


def visible(edges: DataFrame, user=None, valid_only: bool = True) -> DataFrame:
    """Edges of a user, and only those neither closed nor retracted, as far as the table tells."""
    if user is not None:
        edges = edges.where(F.col("user_id") == F.lit(user))
    for c in ("invalid_at", "retracted_at") if valid_only else ():
        if c in edges.columns:
            edges = edges.where(F.col(c).isNull())
    return edges


def query_terms(query: str) -> dict[str, int]:
    terms: dict[str, int] = {}
    for t in query.lower().split():
        terms[t] = terms.get(t, 0) + 1
    return terms


def vocabulary(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(term, df, length) of each tenant's rows (tokens); the empty term stands for all rows and sums their lengths."""
    each = docs.select(*keys, F.size("tokens").alias("length"), F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit("")))).alias("term"))
    return each.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("length"))).alias("length"))


def statistics(words: DataFrame, keys: list[str], terms: dict[str, int]) -> DataFrame:
    """A row a tenant: mean length, mean idf of its vocabulary, and the idf of each term as i0, i1, ...; words is a vocabulary."""
    heads = words.where("term = ''").select(*keys, F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    own = words.where("term <> ''").groupBy(*keys, "df").agg(F.count("*").alias("terms"), *(F.max(F.col("term") == t).alias(f"t{k}") for k, t in enumerate(terms)))
    each = (F.max(F.when(F.col(f"t{k}"), idf)).alias(f"i{k}") for k in range(len(terms)))  # few rows: terms of equal df have equal idf
    return own.join(heads, keys).groupBy(*keys).agg(F.max("avgdl").alias("avgdl"), (F.sum(idf * F.col("terms")) / F.sum("terms")).alias("mean_idf"), *each)


def okapi(counted: DataFrame, terms: dict[str, int], keys: list[str] | None, limit: int) -> DataFrame:
    """The best rows of counted: length, the terms' counts f0, f1, ... and the tenant's statistics. A share of the mean idf stands in for a negative one."""
    score = F.lit(0.0)
    for k, times in enumerate(terms.values()):
        f, idf = F.col(f"f{k}"), F.col(f"i{k}")
        weight = F.when(idf < 0, R.BM25_EPSILON * F.col("mean_idf")).otherwise(idf)
        part = weight * f * (R.BM25_K1 + 1) / (f + R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * F.col("length") / F.col("avgdl")))
        score = score + times * F.coalesce(part, F.lit(0.0))
    return top(counted.select(*(keys or []), "edge_id", F.round(score, 9).alias("score")).where("score > 0"), limit, keys)


#: Terms that a task counts before it hands them on.
TERMS = 1 << 19
#: Texts that are parted at once.
ROWS = 1024


def scanned(docs: DataFrame, keys: list[str], terms: dict[str, int]) -> DataFrame:
    """One pass over texts (lower): partial vocabularies (term, df, length) as of ``vocabulary``, and, without a term, the rows
    that hold one of the query's: edge_id, length and the counts f0, f1, ..."""
    counts = [f"f{k}" for k in range(len(terms))]
    names = ["term", "df", "length", *counts]
    schema = types.StructType([*(docs.schema[c] for c in (*keys, "edge_id")), types.StructField("term", types.StringType()), *(types.StructField(c, types.LongType()) for c in names[1:])])
    schema = types.StructType([types.StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        own: pa.Schema | None = None
        heads: dict[tuple, list[int]] = {}
        parts: list[pa.Table] = []
        size = 0

        def vocabularies() -> Iterator[pa.RecordBatch]:
            n = len(heads)
            if n:
                key = [pa.array(x, own.field(c).type) for c, x in zip(keys, zip(*heads, strict=True), strict=True)]
                rows, total = (pa.array(x, pa.int64()) for x in zip(*heads.values(), strict=True))
                yield pa.RecordBatch.from_arrays([*key, pa.nulls(n, own.field("edge_id").type), pa.array([""] * n, pa.string()), rows, total, *(pa.nulls(n, pa.int64()) for _ in counts)], schema=own)
            for t in parts:
                none = [pa.nulls(t.num_rows, own.field(c).type) for c in ("edge_id", "length", *counts)]
                yield from pa.table([*(t.column(c) for c in keys), none[0], t.column("term"), t.column("df"), *none[1:]], schema=own).to_batches()
            heads.clear()
            parts.clear()

        def merged() -> pa.Table:
            t = pa.concat_tables(parts).group_by([*keys, "term"]).aggregate([("df", "sum")])
            return t.rename_columns([{"df_sum": "df"}.get(c, c) for c in t.column_names]).select([*keys, "term", "df"])

        def sliced() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    yield b.slice(at, ROWS).filter(b.column("lower").slice(at, ROWS).is_valid())

        for b in sliced():
            if own is None:
                own = pa.schema([*(pa.field(c, b.schema.field(c).type) for c in (*keys, "edge_id")), pa.field("term", pa.string()), *(pa.field(c, pa.int64()) for c in names[1:])])
            if not b.num_rows:
                continue
            words = pc.ascii_split_whitespace(b.column("lower"))  # parts at the white space that the expression \s names
            coded = words.flatten().dictionary_encode()
            row, code, found = pc.list_parent_indices(words).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
            if (blank := found.index("").as_py()) >= 0:  # before or after a text's words
                row, code = row[code != blank], code[code != blank]
            length = np.bincount(row, minlength=b.num_rows)
            width = max(1, len(found))
            pairs, times = np.unique(row * width + code, return_counts=True)
            row, code = pairs // width, pairs % width
            f = np.zeros((b.num_rows, len(terms)), np.int64)
            for k, t in enumerate(terms):
                if (own_code := found.index(t).as_py()) >= 0:
                    f[row[code == own_code], k] = times[code == own_code]
            at = np.flatnonzero(f.any(axis=1))
            if len(at):
                held = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(held.column(c) for c in (*keys, "edge_id")), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.int64()), *(pa.array(x, pa.int64()) for x in (length[at], *f[at].T))], schema=own)
            numbers: dict[tuple, int] = {}
            tenant = np.array([numbers.setdefault(x, len(numbers)) for x in zip(*(b.column(c).to_pylist() for c in keys), strict=True)], np.int64)
            for key, n, total in zip(numbers, np.bincount(tenant).tolist(), np.bincount(tenant, length).astype(np.int64).tolist(), strict=True):
                own_head = heads.setdefault(key, [0, 0])
                own_head[0] += n
                own_head[1] += total
            pairs, df = np.unique(tenant[row] * width + code, return_counts=True)
            which = pairs // width
            of_key = [pa.array(x, own.field(c).type).take(pa.array(which)) for c, x in zip(keys, zip(*numbers, strict=True), strict=True)]
            parts.append(pa.table([*of_key, found.take(pa.array(pairs % width)), pa.array(df, pa.int64())], names=[*keys, "term", "df"]))
            size += len(df)
            if size > 2 * TERMS:
                parts[:] = [merged()]
                size = parts[0].num_rows
                if size > TERMS:
                    yield from vocabularies()
                    size = 0
        if parts:
            parts[:] = [merged()]
        yield from vocabularies()

    return docs.select(*keys, "edge_id", "lower").mapInArrow(run, schema)


def bm25(facts: DataFrame, query: str, tenant: list[str] | None = None, limit: int = R.SEARCH_LIMIT) -> DataFrame:
    """edge_id, score and rank (from 0) of each tenant's best facts; statistics are those of its rows. A blank query finds nothing.

    Texts are read once; their vocabulary and the counts of the rows that hold a term of the query are written. Where queries
    are many, ``keyword_index`` keeps both.
    """
    keys, terms = tenant or ["__all"], query_terms(query)
    facts = facts if tenant else facts.withColumn("__all", F.lit(1))
    if not terms:
        return top(facts.select(*(tenant or []), "edge_id", F.lit(0.0).alias("score")).limit(0), limit, tenant)
    found = written(scanned(facts.select(*keys, "edge_id", F.lower("fact_string").alias("lower")), keys, terms))
    words = found.where("term IS NOT NULL").groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    return okapi(found.where("term IS NULL").drop("term", "df").join(statistics(words, keys, terms), keys), terms, tenant, limit)


def top(scored: DataFrame, limit: int, keys: list[str] | None = None) -> DataFrame:
    """The best rows by score, then id, with their rank; a limit a group is applied before the shuffle too."""
    order = [F.desc("score"), F.col("edge_id")]
    if not keys:
        scored = scored.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


def vector_search(vectors: DataFrame, query: list[float], limit: int = R.SEARCH_LIMIT, tenant: list[str] | None = None) -> DataFrame:
    scored = vectors.select(*(tenant or []), "edge_id", F.round(V.cosine(F.col("vector"), V.literal(query)), 9).alias("score"))
    return top(scored, limit, tenant)


def fuse(keyword: DataFrame, vector: DataFrame, k: int = R.RRF_K) -> DataFrame:
    """Reciprocal rank fusion; an edge in both lists keeps the vector's score, and ties keep the keyword list's order."""
    a = keyword.select("edge_id", F.col("rank").alias("a"), F.col("score").alias("a_score"))
    b = vector.select("edge_id", F.col("rank").alias("b"), F.col("score").alias("b_score"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r) + 1), F.lit(0.0))
    both = a.join(b, "edge_id", "full_outer").select("edge_id", F.coalesce("b_score", "a_score").alias("score"), F.round(part("a") + part("b"), 12).alias("rrf_score"), "a", "b")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rrf_score"), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    return both.withColumn("position", F.row_number().over(order) - 1).drop("a", "b")


def fit_budget(ranked: DataFrame, budget: int | None = R.TOKEN_BUDGET, keys: list[str] | None = None, order: str = "position", text: str = "fact", count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """The prefix whose tokens fit; every item counts at least one token, so that no more rows than the budget are counted and summed."""
    budget = budget or R.TOKEN_BUDGET
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    first = ranked.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= budget).withColumn("tokens", count(F.col(text)))
    total = F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("total_tokens", total).where(F.col("total_tokens") <= budget).drop("__n")


def newest(facts: DataFrame, budget: int | None = R.TOKEN_BUDGET, limit: int = R.RETRIEVE_LIMIT, valid_only: bool = True) -> DataFrame:
    """What a blank query finds: the newest memories, packed."""
    rows = temporal.list_active(facts, limit, valid_only)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("valid_at"), "edge_id"))  # of at most limit rows
    rows = rows.withColumn("position", place - 1).select("edge_id", "fact", "score", F.lit(None).cast("double").alias("rrf_score"), "position")
    return fit_budget(rows, budget)


def hybrid(facts: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], budget: int | None = R.TOKEN_BUDGET, limit: int = R.RETRIEVE_LIMIT, user=None, valid_only: bool = True) -> DataFrame:
    """Both searches, fused and packed; facts of vectors without a text are dropped as blank. A blank query lists the newest.

    Users and validity are told by facts (user_id, invalid_at, retracted_at), and by vectors where they have these columns.
    """
    facts = visible(facts, user, valid_only)
    if not query.strip():
        return newest(facts, budget, limit, valid_only)
    vectors = visible(vectors, user if "user_id" in vectors.columns else None, valid_only)
    fused = fuse(bm25(facts, query, limit=limit), vector_search(vectors, query_vector, limit))
    named = facts.join(F.broadcast(fused), "edge_id").where("fact_string <> ''").select("edge_id", F.col("fact_string").alias("fact"), "score", "rrf_score", "position")
    return fit_budget(named, budget)


def search(facts: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], valid_only: bool, limit: int = R.API_LIMIT, user=None) -> DataFrame:
    """A user's valid facts by meaning; otherwise all, retracted ones too, by words. A blank query finds nothing."""
    if not valid_only:
        return bm25(visible(facts, user, False), query, limit=limit)
    found = visible(vectors, user if "user_id" in vectors.columns else None)
    return vector_search(found if query.strip() else found.limit(0), query_vector, limit)


def index_facts(facts: DataFrame, path: str, part: int) -> None:
    """Append a batch of facts to a keyword index below path, under its number; a batch that runs again overwrites its own part.

    postings (term, edge_id, tf, length) are sorted by term, so that a query reads its terms' row groups; words holds df.
    """
    docs = facts.select(F.lit(1).alias("__all"), "edge_id", tokens(F.col("fact_string")).alias("tokens"))
    each = docs.select("edge_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    postings = each.groupBy("term", "edge_id", "length").agg(F.count("*").alias("tf"))
    postings.repartitionByRange("term", "edge_id").sortWithinPartitions("term", "edge_id").write.mode("overwrite").parquet(f"{path}/postings/part={part}")
    vocabulary(docs, ["__all"]).drop("__all").write.mode("overwrite").parquet(f"{path}/words/part={part}")


def keyword_index(spark: SparkSession, path: str, query: str, limit: int = R.SEARCH_LIMIT) -> DataFrame:
    """bm25 from an index: only the postings of the query's terms are read, and the parts' statistics are summed."""
    terms = query_terms(query)
    read = lambda kind: spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}/part=*")
    words = read("words").withColumn("__all", F.lit(1)).groupBy("__all", "term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    found = read("postings").where(F.col("term").isin(*terms))
    counted = found.groupBy("edge_id", "length").agg(*(F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"f{k}") for k, t in enumerate(terms))).withColumn("__all", F.lit(1))
    if not terms:
        return top(counted.select("edge_id", F.lit(0.0).alias("score")).limit(0), limit)
    return okapi(counted.join(statistics(written(words), ["__all"], terms), "__all"), terms, None, limit)
