"""Search over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from .. import scratch
from ..functions import tokens
from ..functions import vectors as V
from ..operators import conflict, retrieval, temporal
from ..providers import Offline, embedded
from ..sources import tables as S

#: Frequent and rare words of the corpus; the query's vector is that of the row with id 0.
QUERY = "the of that passage oneded this"
WIDTH = 64


def _query_vector(spark, sf_dir) -> list[float]:
    row = S.vectors(spark, sf_dir).where("edge_id = 0").select("vector").head()
    return list(row["vector"]) if row else [0.0] * WIDTH


def token_budget_prefix(spark, sf_dir):
    """Each source's first documents under a budget of 2000 tokens."""
    docs = S.corpus(spark, sf_dir).withColumnRenamed("fact_string", "fact")
    out = retrieval.fit_budget(docs, 2000, ["source"], "edge_id")
    return out.select("source", "edge_id", "tokens", "total_tokens")


def token_budget_bpe(spark, sf_dir):
    """The same with the tokens of a byte-pair vocabulary."""
    import public_tokenizers as P

    docs = S.corpus(spark, sf_dir).withColumnRenamed("fact_string", "fact")
    out = retrieval.fit_budget(docs, 2000, ["source"], "edge_id", count=tokens.bpe_count(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    return out.select("source", "edge_id", "tokens", "total_tokens")


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(S.corpus(spark, sf_dir), QUERY)


def bm25_per_tenant(spark, sf_dir):
    return retrieval.bm25(S.corpus(spark, sf_dir), QUERY, ["tenant"], R.API_LIMIT)


def vector_topk(spark, sf_dir):
    return retrieval.vector_search(S.vectors(spark, sf_dir), _query_vector(spark, sf_dir))


def vector_topk_per_tenant(spark, sf_dir):
    return retrieval.vector_search(S.vectors(spark, sf_dir), _query_vector(spark, sf_dir), R.API_LIMIT, ["tenant"])


def rrf_hybrid(spark, sf_dir):
    a = retrieval.bm25(S.corpus(spark, sf_dir), QUERY, limit=R.RETRIEVE_LIMIT)
    return retrieval.fuse(a, retrieval.vector_search(S.vectors(spark, sf_dir), _query_vector(spark, sf_dir), R.RETRIEVE_LIMIT))


def hybrid_retrieve(spark, sf_dir):
    """Keyword and vector search, fused, packed under the default budget."""
    out = retrieval.hybrid(S.corpus(spark, sf_dir), S.vectors(spark, sf_dir), QUERY, _query_vector(spark, sf_dir))
    return out.select("edge_id", "score", "rrf_score", "position", "tokens", "total_tokens")


def audit_search(spark, sf_dir):
    return retrieval.search(S.corpus(spark, sf_dir), S.vectors(spark, sf_dir), "with the was", [], False)


def blank_query(spark, sf_dir):
    """Without a query the newest memories, packed by their fact strings."""
    newest = temporal.list_active(S.edges(spark, sf_dir))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("valid_at"), "edge_id"))
    out = retrieval.fit_budget(newest.withColumn("position", place - 1), 100)
    return out.select("edge_id", "fact", "position", "tokens", "total_tokens")


#: Cosine that some of the vectors of a tenant reach and most do not.
NEAR = 0.25


def paraphrase_conflicts(spark, sf_dir):
    """Pairs of one tenant's vectors that are similar, the later id new."""
    v = S.vectors(spark, sf_dir)
    n = conflict.near_duplicates(v, v, ["tenant"], NEAR, earlier=True)
    return n.select("tenant", "edge_id", "old_id", F.round("similarity", 6).alias("similarity"))


def near_duplicate_skip(spark, sf_dir):
    """All vectors that none of their tenant with a smaller id is near to."""
    v = S.vectors(spark, sf_dir)
    near = conflict.with_near(v, v, ["tenant"], NEAR, earlier=True)
    return v.join(near, "edge_id", "left_anti").select("edge_id", "tenant")


def missing_vectors(spark, sf_dir):
    """Documents without a vector: what a repair embeds."""
    return S.corpus(spark, sf_dir).join(S.vectors(spark, sf_dir).select("edge_id"), "edge_id", "left_anti").select("edge_id", "tenant")


class Letters(Offline):
    """Vectors of letter counts, scaled to 1: a model that SQL can follow."""

    def embed(self, text: str) -> list[float]:
        v = [float(text.lower().count(c)) for c in LETTERS]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def repaired_vectors(spark, sf_dir):
    """A vector for each document without one."""
    out = embedded(missing_texts(spark, sf_dir), Letters(), "fact_string")
    return out.select("edge_id", F.size("vector").alias("width"), F.round(V.norm(F.col("vector")), 6).alias("norm"), *(F.round(F.col("vector")[k], 6).alias(f"v{k}") for k in (0, 4, 19)))


def missing_texts(spark, sf_dir):
    return S.corpus(spark, sf_dir).join(S.vectors(spark, sf_dir).select("edge_id"), "edge_id", "left_anti").where("fact_string <> ''")


def hybrid_blank(spark, sf_dir):
    """A blank query of one user: their newest confirmed memories, packed."""
    out = retrieval.hybrid(S.edges(spark, sf_dir), S.vectors(spark, sf_dir), "  ", [], 100, user=8)
    return out.select("edge_id", "fact", "position", "tokens", "total_tokens")


def _judged_vectors(spark, sf_dir):
    """Vectors of users, some closed and some retracted."""
    at = lambda c: F.when(c, F.lit("2024-03-01").cast("timestamp_ntz"))
    return S.vectors(spark, sf_dir).withColumns({"user_id": F.col("tenant"), "invalid_at": at(F.col("edge_id") % 3 == 1), "retracted_at": at(F.col("edge_id") % 5 == 2)})


def vector_search_valid(spark, sf_dir):
    """One user's valid facts by meaning."""
    v = _judged_vectors(spark, sf_dir)
    return retrieval.search(S.corpus(spark, sf_dir), v, QUERY, _query_vector(spark, sf_dir), True, user=3)


def bm25_indexed(spark, sf_dir):
    """bm25_topk from an index that two batches of documents were appended to."""
    path, docs = scratch.folder(spark), S.corpus(spark, sf_dir)
    long = F.length("fact_string") >= 1000
    retrieval.index_facts(docs.where(long), path, 0)
    retrieval.index_facts(docs.where(~F.coalesce(long, F.lit(False))), path, 1)
    return retrieval.keyword_index(spark, path, QUERY)


QUERIES = {
    f.__name__: f
    for f in (
        token_budget_prefix, token_budget_bpe, bm25_topk, bm25_per_tenant, vector_topk, vector_topk_per_tenant, rrf_hybrid, hybrid_retrieve, audit_search, blank_query,
        paraphrase_conflicts, near_duplicate_skip, missing_vectors, repaired_vectors, hybrid_blank, vector_search_valid, bm25_indexed,
    )
}


def _bm25_sql(query: str, tenant: bool, limit: int) -> str:
    key = "lang" if tenant else "1"
    terms: dict[str, int] = {}
    for t in query.split():
        terms[t] = terms.get(t, 0) + 1
    score = " + ".join(f"{n} * coalesce((CASE WHEN i{k} < 0 THEN 0.25 * mean_idf ELSE i{k} END) * f{k} * 2.5 / (f{k} + 1.5 * (0.25 + 0.75 * len(w) / avgdl)), 0)" for k, n in enumerate(terms.values()))
    freq = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(terms))
    idfs = ", ".join(f"max(idf) FILTER (t = '{t}') AS i{k}" for k, t in enumerate(terms))
    return f"""d AS (SELECT doc_id AS edge_id, {key} AS tenant, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents
), n AS (SELECT tenant, count(*) AS n, avg(len(w)) AS avgdl FROM d GROUP BY tenant
), v AS (SELECT tenant, t, count(*) AS df FROM (SELECT tenant, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL
), i AS (SELECT v.*, n.n, n.avgdl, ln(n.n - df + 0.5) - ln(df + 0.5) AS idf FROM v JOIN n USING (tenant)
), m AS (SELECT tenant, avg(idf) AS mean_idf, any_value(avgdl) AS avgdl, {idfs} FROM i GROUP BY tenant
), s AS (SELECT edge_id, tenant, round({score}, 9) AS score FROM (SELECT d.*, m.* EXCLUDE (tenant), {freq} FROM d JOIN m USING (tenant))
), bm AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY score DESC, edge_id) - 1 AS rank FROM s WHERE score > 0 QUALIFY rank < {limit})"""


def _vector_sql(limit: int, tenant: bool) -> str:
    part = "PARTITION BY tenant" if tenant else ""
    return f"""vs AS (
  SELECT e.vec_id AS edge_id, e.label AS tenant, round(coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0), 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
), vr AS (SELECT *, row_number() OVER ({part} ORDER BY score DESC, edge_id) - 1 AS rank FROM vs QUALIFY rank < {limit})"""


_RRF = "WITH " + _bm25_sql(QUERY, False, 50) + ", " + _vector_sql(50, False) + """, f AS (
  SELECT coalesce(vr.edge_id, bm.edge_id) AS edge_id, coalesce(vr.score, bm.score) AS score, round(coalesce(1.0 / (61 + CAST(bm.rank AS DOUBLE)), 0) + coalesce(1.0 / (61 + CAST(vr.rank AS DOUBLE)), 0), 12) AS rrf_score, bm.rank AS a, vr.rank AS b FROM bm FULL JOIN vr ON bm.edge_id = vr.edge_id
), r AS (SELECT edge_id, score, rrf_score, row_number() OVER (ORDER BY rrf_score DESC, a NULLS LAST, b NULLS LAST) - 1 AS position FROM f)"""
_PAIR = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

ORACLE_SQL = {
    "token_budget_prefix": "SELECT * FROM (SELECT source, edge_id, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY edge_id) AS BIGINT) AS total_tokens FROM (SELECT source, doc_id AS edge_id, greatest(1, length(text) // 4) AS tokens FROM documents)) WHERE total_tokens <= 2000",
    "bm25_topk": "WITH " + _bm25_sql(QUERY, False, 20) + " SELECT edge_id, score, rank FROM bm",
    "bm25_per_tenant": "WITH " + _bm25_sql(QUERY, True, 10) + " SELECT tenant, edge_id, score, rank FROM bm",
    "vector_topk": "WITH " + _vector_sql(20, False) + " SELECT edge_id, score, rank FROM vr",
    "vector_topk_per_tenant": "WITH " + _vector_sql(10, True) + " SELECT edge_id, tenant, score, rank FROM vr",
    "rrf_hybrid": _RRF + " SELECT * FROM r",
    "hybrid_retrieve": _RRF + " SELECT * FROM (SELECT edge_id, score, rrf_score, position, tokens, CAST(sum(tokens) OVER (ORDER BY position) AS BIGINT) AS total_tokens FROM (SELECT r.*, greatest(1, length(text) // 4) AS tokens FROM r JOIN documents ON doc_id = edge_id WHERE text <> '')) WHERE total_tokens <= 2000",
    "audit_search": "WITH " + _bm25_sql("with the was", False, 10) + " SELECT edge_id, score, rank FROM bm",
    "blank_query": "WITH " + S.EDGES_SQL + ", l AS (SELECT edge_id, 'user ' || lower(replace(relation, '_', ' ')) || ' ' || object AS fact, row_number() OVER (ORDER BY valid_at DESC, edge_id) - 1 AS position FROM edges WHERE relation <> 'SWITCHED_FROM' ORDER BY valid_at DESC, edge_id LIMIT 50), t AS (SELECT *, greatest(1, length(fact) // 4) AS tokens FROM l) SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (ORDER BY position) AS BIGINT) AS total_tokens FROM t) WHERE total_tokens <= 100",
    "paraphrase_conflicts": f"SELECT a.label AS tenant, a.vec_id AS edge_id, b.vec_id AS old_id, round({_PAIR}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE {_PAIR} > {NEAR}",
    "near_duplicate_skip": f"SELECT vec_id AS edge_id, label AS tenant FROM embeddings a WHERE NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.label = a.label AND b.vec_id < a.vec_id AND {_PAIR} > {NEAR})",
    "bm25_indexed": "WITH " + _bm25_sql(QUERY, False, 20) + " SELECT edge_id, score, rank FROM bm",
    "hybrid_blank": "WITH " + S.EDGES_SQL + ", l AS (SELECT edge_id, 'user ' || lower(replace(relation, '_', ' ')) || ' ' || object AS fact, row_number() OVER (ORDER BY valid_at DESC, edge_id) - 1 AS position FROM edges WHERE user_id = 8 AND relation <> 'SWITCHED_FROM' ORDER BY valid_at DESC, edge_id LIMIT 50), t AS (SELECT *, greatest(1, length(fact) // 4) AS tokens FROM l) SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (ORDER BY position) AS BIGINT) AS total_tokens FROM t) WHERE total_tokens <= 100",
    "vector_search_valid": "WITH " + _vector_sql(1 << 40, False) + " SELECT edge_id, score, row_number() OVER (ORDER BY score DESC, edge_id) - 1 AS rank FROM vs WHERE tenant = 3 AND edge_id % 3 <> 1 AND edge_id % 5 <> 2 QUALIFY rank < 10",
    "missing_vectors": "SELECT doc_id AS edge_id, lang AS tenant FROM documents ANTI JOIN embeddings ON vec_id = doc_id",
    "repaired_vectors": "WITH m AS (SELECT doc_id, [CAST(length(text) - length(replace(lower(text), chr(CAST(i AS INT)), '')) AS DOUBLE) FOR i IN range(97, 123)] AS c FROM documents ANTI JOIN embeddings ON vec_id = doc_id WHERE text <> ''), "
    "n AS (SELECT *, sqrt(list_inner_product(c, c)) AS n FROM m) SELECT doc_id AS edge_id, CAST(len(c) AS INT) AS width, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, 6) AS norm, "
    + ", ".join(f"round(CASE WHEN n > 0 THEN c[{k + 1}] / n ELSE 0.0 END, 6) AS v{k}" for k in (0, 4, 19)) + " FROM n",
}
