"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words, lower-cased, and their first letters (stems), hashed. On a bounded sample of
labelled documents the terms that tell the classes apart are chosen, and a factorization machine learns a weight for
each and a vector whose inner products weigh pairs. Presence counts, not length, so that one insult in a long text is
as visible as in a short one. Scoring streams every text once.

Edge cases: null and empty texts have no terms and get the bias' score; with labels of one class only, or none, scores
are the smoothed share of class 1; null and repeated doc_ids are scored row by row; null ids are not held out; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .training import fold, labelled_sample

FOLDS, HELD_OUT = 5, 0
#: Labelled documents learnt from, a class; terms chosen; letters of a stem; values of the hash.
PER_CLASS, TERMS, STEMS, BITS = 5000, 2048, (4, 5), 30
FACTORS, ROUNDS, RATE, PENALTY = 8, 400, 0.05, 2e-5
#: Likelihood-ratio statistic (chi-squared, one degree) below which a term is no evidence, and documents it needs.
MIN_GAIN, MIN_DOCS = 25.0, 4
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def word_terms(token: str) -> list[int]:
    out = []
    for w in _WORD.findall(token.lower()):
        out.append("w" + w)
        out += [f"{k}{w[:k]}" for k in STEMS if len(w) > k]
    return [xxhash.xxh64_intdigest(t) & ((1 << BITS) - 1) for t in out]


def terms(text: str | None) -> set[int]:
    return {t for token in set((text or "").split()) for t in word_terms(token)}


class FactorizationMachine:
    """score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the chosen terms present."""

    def __init__(self, index: dict[int, int], b: float, w: np.ndarray, v: np.ndarray):
        self.index, self.b, self.w, self.v = index, b, w, v

    def score(self, found: list[int]) -> float:
        z = self.b
        if found:
            v = self.v[found]
            z += self.w[found].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def gain(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Likelihood-ratio statistic of a term's presence against the class."""
    n = n_pos + n_neg
    part = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12)), 0)
    present = pos + neg
    return 2 * (part(pos, present * n_pos / n) + part(neg, present * n_neg / n) + part(n_pos - pos, (n - present) * n_pos / n) + part(n_neg - neg, (n - present) * n_neg / n))


def fit(documents: list[np.ndarray], label: np.ndarray, sizes: dict[int, int], seed: int = 11) -> FactorizationMachine:
    """documents: sorted distinct terms of each; sizes: the classes' sizes in the whole, which weigh the sample."""
    n_pos, n_neg = int(label.sum()), int((1 - label).sum())
    prior = np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))
    if not n_pos or not n_neg:
        return FactorizationMachine({}, float(prior), np.zeros(0), np.zeros((0, FACTORS)))
    all_terms, inverse = np.unique(np.concatenate(documents), return_inverse=True)
    row = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    pos = np.bincount(inverse, weights=label[row], minlength=len(all_terms))
    neg = np.bincount(inverse, weights=1.0 - label[row], minlength=len(all_terms))
    g = np.where(pos + neg >= MIN_DOCS, gain(pos, neg, n_pos, n_neg), 0)
    chosen = np.flatnonzero(g >= MIN_GAIN)
    chosen = np.sort(chosen[np.lexsort((all_terms[chosen], -g[chosen]))][:TERMS])
    place = np.full(len(all_terms), -1)
    place[chosen] = np.arange(len(chosen))
    col = place[inverse]
    row, col = row[col >= 0], col[col >= 0]
    rng, n, m = np.random.default_rng(seed), len(documents), len(chosen)
    params = [np.array([prior]), np.zeros(m), rng.normal(0, 0.02, (m, FACTORS))]
    weight = np.where(label == 1, sizes.get(1, n_pos) / n_pos, sizes.get(0, n_neg) / n_neg)
    weight = weight / weight.sum()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, ROUNDS + 1):
        b, w, v = params
        s = np.stack([np.bincount(row, weights=v[col, f], minlength=n) for f in range(FACTORS)], axis=1)
        q = np.bincount(row, weights=(v[col] ** 2).sum(axis=1), minlength=n)
        z = b[0] + np.bincount(row, weights=w[col], minlength=n) + 0.5 * ((s * s).sum(axis=1) - q)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        dv = np.stack([np.bincount(col, weights=e[row] * (s[row, f] - v[col, f]), minlength=m) for f in range(FACTORS)], axis=1)
        grads = [np.array([e.sum()]), np.bincount(col, weights=e[row], minlength=m) + PENALTY * w, dv + PENALTY * v]
        for k, d in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    b, w, v = params
    return FactorizationMachine({int(t): k for k, t in enumerate(all_terms[chosen])}, float(b[0]), w, v)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> FactorizationMachine:
    sample, sizes = labelled_sample(docs, labels, label_col, fold("id", FOLDS) != HELD_OUT, per_class, id_col, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.array(sorted(terms(t.as_py())), "<u4").tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), b.column(1)], names=["terms", "label"])

    rows = sample.mapInArrow(run, "terms binary, label int").toArrow().sort_by([("label", "ascending"), ("terms", "ascending")])
    documents = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows.column("terms").to_pylist()]
    return fit(documents, rows.column("label").to_numpy().astype(np.float64), sizes)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        index = model.index
        for b in batches:
            out = []
            for text in b.column(1):
                found: set[int] = set()
                for token in set((text.as_py() or "").split()):
                    own = known.get(token)
                    if own is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        own = known[token] = tuple(index[t] for t in word_terms(token) if t in index)
                    if own:
                        found.update(own)
                out.append(model.score(sorted(found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
