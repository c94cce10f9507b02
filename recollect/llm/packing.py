"""Bound-certified best-fit packing of token sequences.

Documents become token pieces of at most ``capacity`` tokens. Pieces are dealt over partitions, each packed by
best-fit decreasing. Lower bounds from dual-feasible functions certify a partition's bin count; a partition that
is not certified gives the pieces of its bins with gaps back, those of all such partitions are exchanged, and
best-fit decreasing runs again on them over fewer partitions. That goes on while a round closes a fair share of the
pieces it got; the last round's bins stay as they are, and the result says of each whether it is certified.

Edge cases: null text is empty, an empty document is its end token alone, null and repeated doc_ids are packed as
they come and dealt by their place, so that equal rows share no partition, an empty table gives no rows, and columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidy

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs; the number of partitions follows the number of pieces.
PIECES_PER_PARTITION = 60_000
#: Rounds at most, and the share of its pieces that a round must close for another.
ROUNDS, PROGRESS = 8, 0.1
#: Words a worker remembers the ids of, within a task.
CACHE_WORDS = 400_000
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", part long, bin long, offset long, bins long, bound long, open boolean"

_ENCODERS: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """Ids of a byte-level BPE file as little-endian unsigned 32-bit bytes.

    A text is cut before each single space that a non-space follows. The split pattern always starts a new word
    there, so that the parts' ids are the text's, and each distinct part is encoded once a task. Texts that hold
    a special token's string, or a space in a run of white space, are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        # what the pattern and the library's byte-level split have in common; other files are read by the library alone
        self.plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bpe = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._whole = path, None
        self.cache: dict[str, bytes] = {}

    def whole(self):
        """The library's own tokenizer, read only where a text needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(s in text for s in self.special):
            return np.array(self.whole().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(" ")
        cache = self.cache
        try:
            return self._first(parts[0]) + b"".join(map(cache.__getitem__, parts[1:]))
        except KeyError:
            return self._learn(text, parts)

    def forget(self) -> None:
        """Drop the words remembered: workers are kept for later stages, and would hold them through these."""
        self.cache.clear()

    def _first(self, part: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(part), "<u4").tobytes() if part else b""

    def _learn(self, text: str, parts: list[str]) -> bytes:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        encode, cache = self.bpe.encode_ordinary, self.cache
        for p in parts[1:]:
            if p not in cache:
                if not p or p[0].isspace():  # the space before it isn't a place to cut
                    return np.array(encode(text), "<u4").tobytes()
                cache[p] = np.array(encode(" " + p), "<u4").tobytes()
        return self._first(parts[0]) + b"".join(map(cache.__getitem__, parts[1:]))


def encoder(path: str) -> ByteBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most capacity tokens; only the first piece of a longer document is shorter."""
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab_path)
        try:
            for b in batches:
                out: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    at, first = 0, n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        size = first if k == 0 else capacity
                        out.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            encode.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of the bounds by dual-feasible functions on integer sizes: thresholds and rounded-up multiples."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for a in range(half + 1):  # sizes over capacity - a count whole, those under a not at all
        whole = int(count[-1] - count[capacity - a])
        middle, m_sum = int(count[capacity - a] - count[half]), int(total[capacity - a] - total[half])
        low = int(total[half] - (total[a - 1] if a else 0))
        best = max(best, whole + middle + max(0, -(-(low - (middle * capacity - m_sum)) // capacity)))
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        up = np.where(x * (k + 1) % capacity == 0, x * k, (k + 1) * x // capacity * capacity)  # times capacity * k
        best = max(best, -(-int((n * up).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The bin and the offset of each size, and what is left in each bin; sizes in descending order."""
    left: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    there, rest = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fit = there >> s
        if fit:
            at = s + (fit & -fit).bit_length() - 1
            k = left[at].pop()
            if not left[at]:
                there ^= 1 << at
        else:
            at, k = capacity, len(rest)
            rest.append(capacity)
        bins[i], offsets[i], rest[k] = k, capacity - at, at - s
        if at > s:
            left[at - s].append(k)
            there |= 1 << (at - s)
    return bins, offsets, rest


def _pack_partition(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "place"], ascending=[False, True, True, True, True], kind="stable").drop(columns="place")
        sizes = rows["length"].to_numpy(np.int64)
        bins, offsets, rest = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        gaps = np.array(rest) > 0
        return rows.assign(part=key[0], bin=bins, offset=offsets, bins=len(rest), bound=bound, open=gaps[bins] if len(rest) > bound else False)

    return run


def dealt(pieces: DataFrame, parts: int, seed: int) -> DataFrame:
    """Pieces of a materialized table with part, by the hash of their place in it: equal rows go to different parts."""
    place = F.monotonically_increasing_id()
    return pieces.withColumn("place", place).withColumn("part", F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(parts)))


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS, progress: float = PROGRESS) -> DataFrame:
    """Add sequence_id, offset and certified to pieces.

    certified: the bound of the partition that closed the piece's bin proves that no fewer bins hold its pieces.
    """
    pieces = written = materialize(pieces)
    done: DataFrame | None = None
    n = pieces.count()
    for k in range(rounds):
        parts = max(1, -(-n // per_partition))
        packed = materialize(dealt(pieces, parts, k).groupBy("part").applyInPandas(_pack_partition(capacity), PACKED_SCHEMA))
        discard(written)
        again = packed.where("open")
        left = 0 if parts == 1 else again.count()
        last = not left or k == rounds - 1 or left > (1 - progress) * n
        closed = (packed if last else packed.where(~F.col("open"))).select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.lit(k).cast("long") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 28) + F.col("bin")).alias("sequence_id"),
            "offset", (F.col("bins") == F.col("bound")).alias("certified"),
        )
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        written = None  # a round's table holds the bins it closed
        pieces, n = again.select("doc_id", "piece", "start", "length", "ids_crc32"), left
    return done


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, vocab_path, capacity), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
