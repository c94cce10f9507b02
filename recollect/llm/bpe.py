"""BPE encoding and decoding over a distinct-word table.

Texts are split into words once, in chunks of rows, and written: a chunk's distinct words in a list, and its documents as
places in that list. The lists' words are dealt to buckets by their hash, where each distinct word of the corpus is encoded
once; the ids go back to the chunks and are joined by place. A chunk sends a bucket one row whatever its words, so that a
frequent word loads no bucket more than a rare one. Buckets follow the vocabulary, not the corpus: a sketch of the distinct
words says how many there are. Decoding joins each id to its piece, in a table of fixed size that every task holds.

Words are split at the ASCII white space ``[\\x20\\x09-\\x0D]``, which the tokenizer's split pattern drops and no piece
crosses, so that the ids of the words in order are the ids of the text. The normalizer composes nothing over white space.

As both kinds of rows come from one written table, words and places agree in whatever order an input comes, also where
tasks run again after an executor is lost.

Edge cases: null text is empty; an empty text has no ids and decodes to the empty string; rows with null or repeated
doc_ids are encoded each; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, tidy

#: Bytes of text in a chunk: its distinct words and their ids are held by one task.
CHUNK_BYTES = 12 << 20
#: Distinct words a bucket should hold, the buckets at least, and one in how many words the sketch sees.
WORDS_A_BUCKET, MIN_BUCKETS, SKETCHED = 400_000, 24, 64
ENCODE_BATCH = 2048

DOCS, WORDS = 0, 1
SPLIT = "chunk long, doc_id array<long>, sizes binary, body binary, sketch array<long>, kind int"
DEALT = "chunk long, bucket int, codes binary, sizes binary, body binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def _rows(schema: str, *rows: tuple) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


#: Numbers below it take a byte; those below LARGE a byte with their highest bits, and two more.
SMALL, LARGE = 240, 16 << 16


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers, most of them small, compressed in lanes of like bytes; larger ones plane by plane."""
    v = numbers.astype("<u4")
    if len(v) and int(v.max()) >= LARGE:
        return b"p" + _zip(v.view(np.uint8).reshape(-1, 4).T.tobytes())
    wide = v[v >= SMALL]
    first = np.where(v < SMALL, v, SMALL + (v >> 16)).astype(np.uint8)
    return b"l" + _zip(len(v).to_bytes(8, "little") + first.tobytes() + (wide & 255).astype(np.uint8).tobytes() + (wide >> 8 & 255).astype(np.uint8).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    if raw[:1] == b"p":
        return np.ascontiguousarray(body.reshape(4, -1).T).view("<u4").ravel()
    n = int.from_bytes(body[:8].tobytes(), "little")
    out = body[8 : 8 + n].astype("<u4")
    wide = np.flatnonzero(out >= SMALL)
    low, high = body[8 + n : 8 + n + len(wide)], body[8 + n + len(wide) :]
    out[wide] = (out[wide] - SMALL << 16) | high.astype("<u4") << 8 | low
    return out


@tidy
def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's documents as places in its distinct words, and these, the most frequent first."""
    from pyspark import TaskContext

    def flush() -> Iterator[pa.RecordBatch]:
        each = np.concatenate(codes)
        order = np.argsort(-np.bincount(each, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield _rows(SPLIT, (chunk, docs, _pack(np.array(sizes, np.int64)), _pack(rank[each]), [], DOCS))
        if words:
            known = list(words)
            sketch = [h - (1 << 63) for h in map(xxhash.xxh64_intdigest, known) if h % SKETCHED == 0]
            yield _rows(SPLIT, (chunk, [], b"", _zip(b"\n".join([known[i] for i in order.tolist()])), sketch, WORDS))

    words: dict[bytes, int] = {}
    docs, sizes, codes, seen = [], [], [], 0
    chunk = TaskContext.get().partitionId() << 24
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            seen += len(raw)
            own = raw.split()
            try:
                code = list(map(words.__getitem__, own))
            except KeyError:
                put = words.setdefault
                code = [put(w, len(words)) for w in own]
            docs.append(doc)
            sizes.append(len(code))
            codes.append(np.array(code, "<u4"))
        if seen >= CHUNK_BYTES:
            yield from flush()
            chunk, seen, words, docs, sizes, codes = chunk + 1, 0, {}, [], [], []
    if docs:
        yield from flush()


def _deal(buckets: int):
    """A chunk's words to a row for each bucket that has some."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = zstandard.ZstdDecompressor().decompress(body.as_py()).split(b"\n")
                of = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % buckets
                order = np.argsort(of, kind="stable")
                edges = np.flatnonzero(np.diff(of[order])) + 1
                for own in np.split(order, edges):
                    raw = _zip(b"\n".join([words[i] for i in own.tolist()]))
                    yield _rows(DEALT, (chunk, int(of[own[0]]), _pack(np.diff(own, prepend=0)), b"", raw))  # places ascend

    return run


def _encode(vocab_path: str, cache_words: int):
    """The words of a bucket to their ids, each distinct word once."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known, at = tokenizer(vocab_path), {}, None
        kind = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != at or len(known) > cache_words:
                    known, at = {}, r["bucket"]
                words = zstandard.ZstdDecompressor().decompress(r["body"]).split(b"\n")
                new = [w for w in words if w not in known]
                for i in range(0, len(new), ENCODE_BATCH):
                    own = new[i : i + ENCODE_BATCH]
                    for w, e in zip(own, t.encode_batch([w.decode() for w in own], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, kind).tobytes()
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                yield _rows(DEALT, (r["chunk"], at, r["codes"], _pack(sizes), _zip(b"".join(ids))))

    return run


def _join(vocab_path: str):
    """A chunk's documents: ids by place in its words, pieces by id."""

    def run(docs: pa.Table, ids: pa.Table) -> pa.Table:
        t = tokenizer(vocab_path)
        kind = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
        pieces = [((t.id_to_token(i) or "") + " ").encode() for i in range(t.get_vocab_size())]
        lists = [(np.cumsum(_unpack(r["codes"]), dtype=np.int64).tolist(), (_unpack(r["sizes"]).astype(np.int64) // kind.itemsize).tolist(), zstandard.ZstdDecompressor().decompress(r["body"])) for r in ids.to_pylist()]
        n = sum(len(codes) for codes, _, _ in lists)
        ids_of, text_of = [b""] * n, [b""] * n
        for codes, sizes, body in lists:
            own = np.frombuffer(body, kind)
            raw, own, s = own.astype("<u4").tobytes(), own.tolist(), 0
            for code, size in zip(codes, sizes, strict=True):
                ids_of[code] = raw[4 * s : 4 * (s + size)]
                text_of[code] = b"".join([pieces[i] for i in own[s : s + size]])
                s += size
        del lists
        out: list[tuple] = []
        for r in docs.to_pylist():
            words, s = _unpack(r["body"]).tolist(), 0
            for doc, size in zip(r["doc_id"], _unpack(r["sizes"]).tolist(), strict=True):
                own = words[s : s + size]
                s += size
                raw, text = b"".join(map(ids_of.__getitem__, own)), b"".join(map(text_of.__getitem__, own))[:-1]
                out.append((doc, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()))
        del ids_of, text_of
        release()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, cache_words: int = 4 * WORDS_A_BUCKET) -> DataFrame:
    """One row for each document: its number of tokens, and SHA-256 of its ids and of their decoded text."""
    spark = docs.sparkSession
    if tokenizer(vocab_path).decoder is not None:
        raise ValueError("pieces are joined by spaces, as for a file without a decoder")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = materialize(docs.mapInArrow(_split, SPLIT), "kind")
    texts, words = both.where(F.col("kind") == DOCS), both.where(F.col("kind") == WORDS)
    sizes = words.select("chunk", F.explode_outer("sketch").alias("h")).agg(F.count_distinct("chunk").alias("chunks"), F.approx_count_distinct("h").alias("h")).head()
    parallel = spark.sparkContext.defaultParallelism
    buckets = buckets or max(MIN_BUCKETS, -(-sizes["h"] * SKETCHED // WORDS_A_BUCKET))
    n = max(parallel, sizes["chunks"])
    dealt = words.select("chunk", "body").mapInArrow(_deal(buckets), DEALT).repartition(max(parallel, buckets), "bucket").sortWithinPartitions("bucket")
    ids = dealt.mapInArrow(_encode(vocab_path, cache_words), DEALT).select("chunk", "codes", "sizes", "body").repartition(n, "chunk")
    texts = texts.select("chunk", "doc_id", "sizes", "body").repartition(n, "chunk")
    return texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_join(vocab_path), RESULT)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
