"""Quality rules by distribution divergence.

A document's histograms of byte classes and of common words are compared with references of the corpus' languages by
Jensen-Shannon distance; the nearest language counts, and short documents are left alone. References are counted over
the whole corpus, in the groups of its language column, and a plain word and repetition rule stands beside them.

Edge cases: null and empty texts have no words and fail the base rule; documents with fewer words than the guard get no
verdict from divergence; without any reference (an empty table) nothing diverges; null languages form no reference, and
their documents are compared with all others; null or repeated doc_ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Frequent function words of English, German, French and Spanish.
COMMON = {
    "en": "the of and to in a is that it for on was with be as are this by at from or an not have which you were".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me".split(),
}
WORDS = list(dict.fromkeys(w for own in COMMON.values() for w in own))
CLASSES = ("space", "lower", "upper", "digit", "point", "symbol", "other", "beyond ASCII")
#: Words a document needs for a verdict by classes and by common words, and the distances (0 to 1) beyond which it fails.
#: The distances were chosen on half of the labelled documents, beyond what any good one of these lengths has, and hold on the other half.
MIN_WORDS, MIN_WORDS_FOR_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 50, 120, 0.28, 0.30
#: Words that a label needs for a reference of its own: below, labels are pooled, so that none vouches for itself.
MIN_REFERENCE_WORDS = 2000
WINDOW, MIN_BASE_WORDS, MAX_REPEATED = 8, 20, 30

_CLASS = np.full(256, 7, np.uint8)
for _k, _own in enumerate((b" \t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#*$%&|<>")):
    _CLASS[list(_own)] = _k
_CLASS[[b for b in range(128) if _CLASS[b] == 7]] = 6
_BYTES = [w.encode() for w in WORDS]
_CAPITAL = [w.capitalize().encode() for w in WORDS]


def histograms(raw: bytes, codes: np.ndarray, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of byte classes, and of the common words with all other words last."""
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES))
    each = np.bincount(codes, minlength=len(words) + 1)
    get, none = words.get, len(words)
    common = np.fromiter((each[get(w, none)] + each[get(c, none)] for w, c in zip(_BYTES, _CAPITAL, strict=True)), np.int64, len(WORDS))
    return classes, np.append(common, len(codes) - common.sum())


def coded(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    known: dict[bytes, int] = {}
    put = known.setdefault
    return np.array([put(w, len(known)) for w in words], np.int64), known


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows whose sequence is found twice or more; ids of pairs of pairs are exact."""
    if len(codes) <= window:
        return 0
    own, size = codes, 1
    while size < window:
        step = min(size, window - size)
        own = np.unique(own[:-step] * (int(own.max()) + 1) + own[step:], return_inverse=True)[1]
        size += step
    twice = np.bincount(own)[own] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, of p with each row of q; counts are scaled to 1."""
    p, q = p / max(1, p.sum()), q / np.maximum(1, q.sum(axis=1, keepdims=True))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a: np.nansum(np.where(a > 0, a * np.log2(a / m), 0), axis=1)
        return np.sqrt(np.clip((part(np.broadcast_to(p, q.shape)) + part(q)) / 2, 0, 1))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_REFERENCE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A row of counts for each language, over all documents; small ones share a row if together they reach the limit or no others are there."""
    width = len(CLASSES) + len(WORDS) + 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if lang is not None and raw:
                    counts = np.concatenate(histograms(raw, *coded(raw.split())))
                    total[lang] = total[lang] + counts if lang in total else counts
            if len(total) > 1024:
                yield flush(total)
                total = {}
        yield flush(total)

    def flush(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([c.tolist() for c in total.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    counts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "lang string, counts array<long>")
    summed = counts.groupBy("lang").agg(*(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(width)))
    words = sum((F.col(f"c{i}") for i in range(len(CLASSES) + 1, width)), F.col(f"c{len(CLASSES)}"))
    pooled = summed.withColumn("lang", F.when(words >= least, F.col("lang"))).groupBy("lang").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(width)))
    rows = pooled.orderBy("lang").collect()
    large = [r for r in rows if r["lang"] is not None or sum(r[1 + len(CLASSES) :]) >= least]
    rows = large or rows
    table = np.array([r[1:] for r in rows], np.float64).reshape(len(rows), width)
    return table[:, : len(CLASSES)], table[:, len(CLASSES) :]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row of counts, distances and verdicts for each document."""
    of_class, of_word = references(docs, text_col, lang_col)

    def one(doc: int | None, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode()
        words = raw.split()
        codes, known = coded(words)
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        n, repeats = len(words), repeated_words(codes)
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        failed = n < MIN_BASE_WORDS or 100 * repeats > MAX_REPEATED * n
        a = b = None
        if n >= MIN_WORDS and len(of_class):
            classes, common = histograms(raw, codes, known)
            a, b = float(js_distance(classes, of_class).min()), float(js_distance(common, of_word).min())
        kept = not failed and (a is None or a <= MAX_CLASS_DISTANCE) and (b is None or n < MIN_WORDS_FOR_WORDS or b <= MAX_WORD_DISTANCE)
        return doc, n, chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeats, failed, kept, a, b

    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                rows = [one(doc, text.as_py()) for doc, text in zip(x.column(0).to_pylist(), x.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'boolean' if k == pa.bool_() else 'double'}" for n, k in zip(names, kinds, strict=True))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
