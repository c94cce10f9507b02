"""Quality classifier: a sparse ensemble of rules over statistics.

Boosted trees over statistics of the text give candidate rules: each path from a root is a conjunction of comparisons.
A logistic regression with an L1 penalty weighs them and leaves few. The rules are compiled into Spark column
expressions over the statistics' columns; rejections are then a plain filter.

Edge cases: null and empty texts have statistics of zero; with labels of one class only, or none, the score is the
smoothed share of class 1; null and repeated doc_ids are scored row by row; null ids are not held out; an empty table
gives no rows; other columns are ignored by ``score_documents`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy
from .divergence import coded, histograms
from .training import fold, labelled_sample

FOLDS, HELD_OUT = 3, 1
#: Labelled documents learnt from, a class.
PER_CLASS = 6000
TREES, DEPTH, BINS, MIN_LEAF, RATE, PENALTY, STEPS = 30, 3, 32, 20, 0.3, 1e-3, 400

STATISTICS = (
    "words", "word_length", "distinct_words", "distinct_pairs", "top_word", "adjacent_repeats", "lower", "upper", "digits", "points",
    "symbols", "other", "beyond_ascii", "exclamations", "bars", "repeated_lines", "words_a_line", "common_words", "words_with_symbols",
)


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    codes, known = coded(words)
    classes, common = histograms(raw, codes, known)
    size = max(1, int(classes[1:].sum()))
    pairs = codes[:-1] * len(known) + codes[1:]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    each = np.bincount(codes)
    with_symbols = sum(map(text.count, "#*$%&|<>"))
    return [
        float(n), size / n, len(known) / n, len(np.unique(pairs)) / max(1, n - 1), float(each.max()) / n, float((codes[1:] == codes[:-1]).sum()) / max(1, n - 1),
        *(float(c) / size for c in classes[1:]), text.count("!") / n, text.count("|") / n,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), float(common[:-1].sum()) / n, min(1.0, with_symbols / n),
    ]


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most, value), all of which must hold


def _tree(x: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, hess: np.ndarray) -> list[tuple[Rule, np.ndarray, float]]:
    """Nodes but the root as (rule, rows, value); x holds bins."""
    out: list[tuple[Rule, np.ndarray, float]] = []

    def grow(rows: np.ndarray, rule: Rule, depth: int) -> None:
        g, h = residual[rows], hess[rows]
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
            base = g.sum() ** 2 / (h.sum() + 1)
            for f in range(x.shape[1]):
                bins = len(edges[f]) + 1
                cg = np.cumsum(np.bincount(x[rows, f], weights=g, minlength=bins))[:-1]
                ch = np.cumsum(np.bincount(x[rows, f], weights=h, minlength=bins))[:-1]
                cn = np.cumsum(np.bincount(x[rows, f], minlength=bins))[:-1]
                ok = (cn >= MIN_LEAF) & (len(rows) - cn >= MIN_LEAF)
                if ok.any():
                    gain = np.where(ok, cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - base, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (f, k))
        if rule:
            out.append((rule, rows, float(g.sum() / (h.sum() + 1)) if best[1] is None else 0.0))
        if best[1] is not None:
            f, k = best[1]
            low = x[rows, f] <= k
            grow(rows[low], (*rule, (f, True, float(edges[f][k]))), depth + 1)
            grow(rows[~low], (*rule, (f, False, float(edges[f][k]))), depth + 1)

    grow(np.arange(len(x)), (), 0)
    return out


def holds(rule: Rule, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for f, at_most, v in rule:
        out &= (values[:, f] <= v) if at_most else (values[:, f] > v)
    return out


def fit(values: np.ndarray, label: np.ndarray, sizes: dict[int, int]) -> tuple[float, list[tuple[Rule, float]]]:
    """The intercept and the rules with their weights."""
    n_pos, n_neg = int(label.sum()), int((1 - label).sum())
    prior = float(np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)))
    if not n_pos or not n_neg:
        return prior, []
    weight = np.where(label == 1, sizes.get(1, n_pos) / n_pos, sizes.get(0, n_neg) / n_neg)
    weight = weight / weight.mean()
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(values.shape[1])]
    x = np.stack([np.searchsorted(e, values[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, rules = np.full(len(x), prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(x))
        for rule, rows, value in _tree(x, edges, weight * (label - p), weight * p * (1 - p)):
            rules.setdefault(tuple(sorted(rule)), None)
            step[rows] += value
        z += RATE * step
    rules = sorted(rules)
    a = np.stack([holds(r, values) for r in rules], axis=1).astype(np.float64)
    w, b, y, t = np.zeros(len(rules)), prior, (np.zeros(len(rules)), prior), 1.0
    mass = weight / weight.sum()
    lipschitz = 0.25 * (np.linalg.norm(a * np.sqrt(mass)[:, None], 2) ** 2 + 1)
    for _ in range(STEPS):  # accelerated proximal gradient
        e = mass * (1 / (1 + np.exp(-np.clip(y[1] + a @ y[0], -50, 50))) - label)
        new = y[0] - (a.T @ e) / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / lipschitz, 0)
        new_b, new_t = y[1] - e.sum() / lipschitz, (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = (new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b))
        w, b, t = new, new_b, new_t
    return float(b), [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-9]


def compiled(b: float, rules: list[tuple[Rule, float]], prefix: str = "s_") -> Column:
    """The score as a column over the statistics' columns."""
    z = F.lit(b)
    for rule, w in rules:
        cond = F.lit(True)
        for f, at_most, v in rule:
            c = F.col(f"{prefix}{STATISTICS[f]}")
            cond = cond & ((c <= v) if at_most else (c > v))
        z = z + F.when(cond, w).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "s_") -> DataFrame:
    """docs with a column for each statistic, named by the prefix and it; docs has none of that name."""
    names = [f"{prefix}{s}" for s in STATISTICS]
    columns = docs.columns
    at = columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(at)]
            own = np.array(rows, np.float64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(own[:, k]) for k in range(len(names)))], names=[*columns, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(s, T.DoubleType()) for s in names)]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> tuple[float, list[tuple[Rule, float]]]:
    sample, sizes = labelled_sample(docs, labels, label_col, fold("id", FOLDS) != HELD_OUT, per_class, id_col, text_col)
    names = [f"s_{s}" for s in STATISTICS]
    rows = with_statistics(sample).select("label", *names).toPandas().sort_values(["label", *names])
    return fit(rows[names].to_numpy(np.float64).reshape(-1, len(names)), rows["label"].to_numpy(np.float64), sizes)


def score_documents(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    scored = own.select("doc_id", compiled(*model).alias("score"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], text_col: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, with all columns."""
    prefix = "s_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return with_statistics(docs, text_col, prefix).where(compiled(*model, prefix) >= 0.5).select(*docs.columns)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
