"""Substring deduplication by repeated-phrase automata.

1. Every window of words has an anchor: the least hash among the grams in it. Equal windows have equal anchors, so that
   only windows whose anchor is found twice can recur. Anchors are counted over the corpus, a few for each document.
2. Consecutive windows of one such anchor are a segment. All windows of a segment found twice recur; those of segments
   found once are counted, and recur if they are found twice. Each is represented by one document, and consecutive
   windows represented there form a passage: confirmed, and distinct but for overlaps.
3. Documents that hold an anchor found twice are dealt over blocks of a bounded number of bytes. A block's automaton
   (Aho-Corasick over words) holds the passages that share an anchor with its documents, cut into phrases so that any
   window of a passage holds a whole one. The documents are streamed through it; windows around the phrases found are
   looked up among the passages' and compared word by word. A passage goes to a block once, however many documents hold it;
   where a block's passages are too many for one automaton they are dealt over shards, and its documents stream past each.
   An anchor that many passages and many documents hold would send all of these passages almost everywhere: its windows
   are listed instead, and a block gets for each of its windows the first passage that holds it.

Segments and windows are counted under two hashes of 64 bits; matches are compared word by word. Rows are told apart by two
hashes of 64 bits of their id and text.

Edge cases: null and empty texts have no words and stay empty; texts shorter than a window lose nothing; repeated rows,
with equal ids or not, count as occurrences of each other; null doc_ids are kept; an empty table gives no rows; other
columns are ignored by ``kept_digests`` and kept by ``remove_passages``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, fresh, materialize, maybe_broadcast, release, row_hashes, tidy

WINDOW, GRAM, PHRASE = 35, 12, 8
#: Words from one phrase of a passage to the next: any window then holds a whole phrase.
STRIDE = WINDOW - PHRASE + 1
#: Windows in a segment at most: less than a window has words, so that a segment's first and last window hold its text.
SEGMENT = WINDOW - GRAM + 1
#: An anchor of more passages and of more documents than this sends its passages by windows.
COMMON = 2
#: Bytes of documents that one automaton is built for.
BLOCK_BYTES = 4 << 20
#: Bytes of passages that one automaton holds.
SHARD_BYTES = 8 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _rolling(h: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """A polynomial hash, modulo 2**64, of each run of size elements; runs are doubled."""
    with np.errstate(over="ignore"):
        out, done, power, own, step = None, 0, np.uint64(1), h, 1
        factor = by
        while step <= size:
            if size & step:
                part = own[done:] if out is not None else own
                out = own.copy() if out is None else out[: len(part)] + power * part[: len(out)]
                done += step
                power = power * factor
            if 2 * step <= size:
                own = own[:-step] + factor * own[step:]
                factor = factor * factor
            step *= 2
        n = len(h) - size + 1
        return out[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _M1
        return h ^ (h >> np.uint64(29))


def _sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    own, step = h, 1
    while 2 * step <= size:
        own = np.minimum(own[:-step], own[step:])
        step *= 2
    rest = size - step
    return np.minimum(own[:-rest], own[rest:]) if rest else own


def hashed(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8")


def window_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The anchor and the hash of each window; both are empty for a text shorter than one."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = hashed(words)
    anchors = _sliding_min(_mixed(_rolling(h, GRAM, _M1)), WINDOW - GRAM + 1)
    return anchors.view(np.int64), _mixed(_rolling(h, WINDOW, _M2)).view(np.int64)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _texts(b: pa.RecordBatch, k: int) -> Iterator[tuple]:
    return zip(*(b.column(i).to_pylist() for i in range(b.num_columns) if i != k), b.column(k), strict=True)


ANCHORS = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
HASHES = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
WINDOWS = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("own", pa.int64())])
PASSAGES = pa.schema([("id", pa.int64()), ("anchors", pa.list_(pa.int64())), ("text", pa.string())])
FOUND = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("spans", pa.binary())])


@tidy
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of a document; n is 2 where the document itself repeats a window of it."""
    for b in batches:
        rows = [], [], []
        for key, text in _texts(b, 1):
            anchors, windows = window_hashes(split(text.as_py()))
            if not len(windows):
                continue
            own = np.unique(anchors)
            n = np.ones(len(own), np.int64)
            order = np.sort(windows)
            if (twice := order[1:][order[1:] == order[:-1]]).size:
                n[np.searchsorted(own, np.unique(anchors[np.isin(windows, twice)]))] = 2
            for to, x in zip(rows, (own, np.full(len(own), key), n), strict=True):
                to.append(x)
        if rows[0]:
            yield _batch(ANCHORS, *(np.concatenate(x) for x in rows))


def segments(anchors: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of each segment, and its hash."""
    n = np.arange(len(anchors))
    new = np.r_[True, anchors[1:] != anchors[:-1]]
    starts = np.flatnonzero((n - np.maximum.accumulate(np.where(new, n, 0))) % SEGMENT == 0)
    ends = np.r_[starts[1:], len(anchors)]
    with np.errstate(over="ignore"):
        first, last = windows[starts].view(np.uint64), windows[ends - 1].view(np.uint64)
        return starts, _mixed(first * _M1 + last * _M2 + (ends - starts).astype(np.uint64)).view(np.int64)


def _counted(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(anchor, hash, key) of a batch, equal hashes once: their number and the least key."""
    a, w, k = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((k, a, w))
    a, w, k = a[order], w[order], k[order]
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (a[1:] != a[:-1])]) if len(w) else np.zeros(0, np.int64)
    return _batch(HASHES, a[first], w[first], k[first], np.diff(np.r_[first, len(w)]))


@tidy
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments under anchors found twice."""
    for b in batches:
        rows = []
        for key, hot, text in _texts(b, 1):
            anchors, windows = window_hashes(split(text.as_py()))
            if len(windows):
                starts, own = segments(anchors, windows)
                hit = np.isin(anchors[starts], np.array(hot, np.int64))
                rows.append((anchors[starts][hit], own[hit], np.full(int(hit.sum()), key)))
        if rows:
            yield _counted(rows)


def _members(anchors: np.ndarray, windows: np.ndarray, wanted: list[int]) -> np.ndarray:
    """Which windows belong to wanted segments."""
    starts, own = segments(anchors, windows)
    return np.repeat(np.isin(own, np.array(wanted, np.int64)), np.diff(np.r_[starts, len(windows)]))


@tidy
def _lone_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of segments found once."""
    for b in batches:
        rows = []
        for key, lone, text in _texts(b, 1):
            anchors, windows = window_hashes(split(text.as_py()))
            if len(windows):
                hit = _members(anchors, windows, lone)
                rows.append((anchors[hit], windows[hit], np.full(int(hit.sum()), key)))
        if rows:
            yield _counted(rows)


@tidy
def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the windows that a document represents; each window at its first such place only."""
    for b in batches:
        out = [], [], []
        for key, whole, single, text in _texts(b, 1):
            words = split(text.as_py())
            anchors, windows = window_hashes(words)
            if not len(windows):
                continue
            hit = _members(anchors, windows, whole) | np.isin(windows, np.array(single or [], np.int64))
            at = np.flatnonzero(hit)
            at = np.sort(at[np.unique(windows[at], return_index=True)[1]])
            if not len(at):
                continue
            starts = at[np.r_[True, np.diff(at) > 1]]
            ends = at[np.r_[np.diff(at) > 1, True]] + 1
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                own = words[s : e + WINDOW - 1]
                for to, x in zip(out, (xxhash.xxh64_intdigest(b"%d %d" % (key, s)) >> 1, np.unique(anchors[s:e]), b" ".join(own).decode()), strict=True):
                    to.append(x)
        if out[0]:
            yield _batch(PASSAGES, *out)


@tidy
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's windows under some anchors."""
    for b in batches:
        rows = []
        for own, wanted, text in _texts(b, 1):
            anchors, windows = window_hashes(split(text.as_py()))
            hit = np.flatnonzero(np.isin(anchors, np.array(wanted, np.int64)))
            hit = hit[np.unique(windows[hit], return_index=True)[1]]
            rows.append((anchors[hit], windows[hit], np.full(len(hit), own)))
        if rows:
            yield _batch(WINDOWS, *(np.concatenate(x) for x in zip(*rows, strict=True)))


class Automaton:
    """An automaton over the passages' phrases, and their windows; words are numbered, exactly, within it.

    A text's windows that hold a phrase found are looked up by a hash of their numbers and compared word by word with
    the passage's. So a text costs its length, however many passages share a phrase, as runs of one word do.
    """

    def __init__(self, passages: list[str]):
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        put = self.ids.setdefault
        own = [[put(w, len(self.ids) + 1) for w in split(p)] for p in passages]
        self.base = max(16, round((len(self.ids) + 1) ** (1 / 3)) + 1)
        phrases = set()
        for p in own:
            text = self._spelled(np.array(p, np.int64))
            phrases.update(text[3 * at : 3 * (at + PHRASE)] for at in range(0, len(p) - PHRASE + 1, STRIDE))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase in phrases:
            self.automaton.add_word(phrase, 1)
        if phrases:
            self.automaton.make_automaton()
        self.empty = not phrases
        self.code = np.random.default_rng(17).integers(0, 2**63, len(self.ids) + 1, np.uint64)
        self.words = np.concatenate([np.array(p, np.int64) for p in own]) if own else np.zeros(0, np.int64)
        starts = np.cumsum([0, *map(len, own)])
        at = [np.arange(s, s + len(p) - WINDOW + 1) for s, p in zip(starts.tolist(), own, strict=False)]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        hashes = self._hashes(self.words)[at] if len(at) else np.zeros(0, np.uint64)
        self.hashes, first = np.unique(hashes, return_index=True)
        self.at = at[first]

    def _spelled(self, ids: np.ndarray) -> str:
        """Three letters a word, each from its own alphabet: nodes have few children, and matches start at words."""
        letters = np.empty(3 * len(ids), "<u4")
        for k, own in enumerate((ids // self.base**2, ids // self.base % self.base, ids % self.base)):
            letters[k::3] = 256 + k * self.base + own
        return letters.tobytes().decode("utf-32-le")

    def _hashes(self, ids: np.ndarray) -> np.ndarray:
        return _rolling(self.code[ids], WINDOW, _M2)

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        if self.empty or len(words) < WINDOW:
            return []
        get = self.ids.get
        own = [get(w, 0) for w in words]
        doc, n = np.array(own, np.int64), len(own) - WINDOW + 1
        edge = np.flatnonzero(np.diff(np.r_[0, doc > 0, 0]))  # no match crosses a word that no passage holds
        ends = []
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if stop - start >= WINDOW:
                ends += [start + e // 3 for e, _ in self.automaton.iter(self._spelled(doc[start:stop]))]
        if not ends:
            return []
        ends = np.array(ends, np.int64)
        edge = np.zeros(n + 1, np.int64)  # windows that hold a phrase start at most as early as one that ends with it
        np.add.at(edge, np.clip(ends + 1 - WINDOW, 0, n), 1)
        np.add.at(edge, np.clip(ends + 2 - PHRASE, 0, n), -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        hashes = self._hashes(doc)[at]
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[place] == hashes
        at, place = at[hit], self.at[place[hit]]
        step = np.arange(WINDOW)
        same = [(doc[at[i : i + 4096, None] + step] == self.words[place[i : i + 4096, None] + step]).all(axis=1) for i in range(0, len(at), 4096)]
        at = at[np.concatenate(same)] if same else at
        if not len(at):
            return []
        new = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        return list(zip(at[new].tolist(), (at[np.r_[new[1:] - 1, len(at) - 1]] + WINDOW).tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _stream(passages: pa.Table, docs: pa.Table) -> pa.Table:
    if not passages.num_rows or not docs.num_rows:
        return FOUND.empty_table()
    automaton = Automaton(passages.column("text").to_pylist())
    rows = [], [], []
    for key, key2, text in zip(docs.column("key").to_pylist(), docs.column("key2").to_pylist(), docs.column("text"), strict=True):
        if found := merged(automaton.spans(split(text.as_py()))):
            for to, x in zip(rows, (key, key2, np.array(found, "<i4").tobytes()), strict=True):
                to.append(x)
    del automaton
    release()
    return pa.table([pa.array(x, f.type) for x, f in zip(rows, FOUND, strict=True)], schema=FOUND)


def _with(docs: DataFrame, table: DataFrame, size: Column) -> DataFrame:
    """Join a materialized table with a row for few of the documents: broadcast if it is small; else, if its keys are,
    documents without a row go before the shuffle."""
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
    if total <= BROADCAST_BYTES:
        return docs.join(F.broadcast(table), "key")
    if 32 * n <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(table.select("key").distinct()), "key", "left_semi")
    return docs.join(table, "key")


def shards(route: DataFrame, passages: DataFrame, shard_bytes: int) -> DataFrame:
    """(block, shards) of the blocks whose passages are more than one automaton holds; passages has id and bytes."""
    sizes = route.join(passages, "id").groupBy("block").agg(F.sum("bytes").alias("bytes"))
    return materialize(sizes.where(F.col("bytes") > shard_bytes).select("block", F.ceil(F.col("bytes") / shard_bytes).cast("long").alias("shards")))


def routes(docs: DataFrame, hot: DataFrame, passages: DataFrame, block: Column, common: int) -> DataFrame:
    """(id, block): passages go where an anchor of theirs is found; under anchors common to many passages and documents, the
    passage with the least id of those that hold a window goes where the window is found."""
    of_anchor = passages.select("id", F.explode("anchors").alias("anchor"))
    several = [t.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > common).select("anchor") for t in (of_anchor, hot)]
    busy = materialize(several[0].join(several[1], "anchor"))
    found = hot.select("anchor", block.alias("block")).distinct()
    if busy.isEmpty():
        return materialize(found.join(of_anchor, "anchor").select("id", "block").distinct())
    few = maybe_broadcast(busy, 16)
    route = found.join(few, "anchor", "left_anti").join(of_anchor, "anchor").select("id", "block")
    size, kinds = 8 * F.size("anchors") + 64, "anchor long, hash long, own long"
    of_doc, of_passage = (materialize(t.join(few, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))) for t in (hot, of_anchor.withColumnRenamed("id", "key")))
    seen = _with(docs, of_doc, size).select(block.alias("own"), "text", "anchors").mapInArrow(_windows, kinds).distinct()
    held = _with(passages.withColumnRenamed("id", "key").select("key", "text"), of_passage, size).select("key", "text", "anchors").mapInArrow(_windows, kinds)
    held = held.groupBy("anchor", "hash").agg(F.min("own").alias("id"))
    route = materialize(route.unionByName(seen.withColumnRenamed("own", "block").join(held, ["anchor", "hash"]).select("id", "block")).distinct())
    discard(busy, of_doc, of_passage)
    return route


def locate(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, common: int = COMMON) -> DataFrame:
    """(key, key2, spans) of documents (key, key2, text) that hold recurring windows: covered words as pairs of 32-bit start and end.

    key joins what belongs to a document, so that documents of equal keys only see more than their own; both keys tell rows apart.
    """
    spark = docs.sparkSession
    anchors = materialize(docs.select("key", "text").mapInArrow(_anchors, "anchor long, key long, n long"))
    twice = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n >= 2").select("anchor")
    hot = materialize(anchors.select("anchor", "key").join(twice, "anchor"))
    discard(anchors)
    of_doc = materialize(hot.groupBy("key").agg(F.collect_set("anchor").alias("anchors")))

    hashes = "anchor long, hash long, key long, n long"
    counts = (F.sum("n").alias("n"), F.min("key").alias("key"))
    found = _with(docs, of_doc, 8 * F.size("anchors") + 64).select("key", "text", "anchors").mapInArrow(_segments, hashes).groupBy("anchor", "hash").agg(*counts)
    own = materialize(found.groupBy("key").agg(*(F.collect_set(F.when(c, F.col("hash"))).alias(k) for k, c in (("whole", F.col("n") > 1), ("lone", F.col("n") == 1)))))
    lone = own.where(F.size("lone") > 0).select("key", "lone")
    single = _with(docs, lone, 8 * F.size("lone") + 64).select("key", "text", "lone").mapInArrow(_lone_windows, hashes).groupBy("anchor", "hash").agg(*counts).where("n > 1")
    single = single.groupBy("key").agg(F.collect_set("hash").alias("single"))
    reps = materialize(own.select("key", "whole").join(single, "key", "left").where((F.size("whole") > 0) | F.col("single").isNotNull()))
    discard(own)
    size = 8 * F.size("whole") + 8 * F.coalesce(F.size("single"), F.lit(0)) + 64
    first = _with(docs, reps, size).dropDuplicates(["key", "key2"]).select("key", "text", "whole", "single")
    passages = materialize(first.mapInArrow(_passages, "id long, anchors array<long>, text string"))
    discard(reps)

    keys = of_doc.select("key")
    streams = _with(docs, keys, F.lit(32)).select("key", "key2", "text")
    total = streams.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(blocks))
    route = routes(docs, hot, passages, block, common)
    many = shards(route, passages.select("id", F.octet_length("text").alias("bytes")), shard_bytes)
    held = route.join(passages.select("id", "text"), "id").select("block", "id", "text")
    dealt = streams.withColumn("block", block)
    if many.isEmpty():
        held, dealt, extra = held.withColumn("shard", F.lit(0).cast("long")), dealt.withColumn("shard", F.lit(0).cast("long")), 0
    else:
        extra, many = many.agg(F.sum("shards").alias("n")).head()["n"], maybe_broadcast(many, 32)
        n_shards = F.coalesce("shards", F.lit(1).cast("long"))
        held = held.join(many, "block", "left").withColumn("shard", F.pmod(F.xxhash64("id"), n_shards))
        dealt = dealt.join(many, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), n_shards - 1)))
    n = max(spark.sparkContext.defaultParallelism, blocks + extra)
    held = held.select("block", "shard", "text").repartition(n, "block", "shard").groupBy("block", "shard")
    dealt = dealt.select("block", "shard", "key", "key2", "text").repartition(n, "block", "shard").groupBy("block", "shard")
    spans = held.cogroup(dealt).applyInArrow(_stream, "key long, key2 long, spans binary")
    out = materialize(spans.groupBy("key", "key2").agg(F.collect_set("spans").alias("spans")))
    discard(hot, of_doc, passages, route)
    return out


def _kept(spans: list[bytes] | None, text: str | None) -> tuple[int, int, bytes]:
    words = split(text)
    n = len(words)
    if spans:
        keep = np.ones(n, bool)
        for own in spans:
            for s, e in np.frombuffer(own, "<i4").reshape(-1, 2).tolist():
                keep[s:e] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return n, n - len(words), b" ".join(words)


def _located(docs: DataFrame, id_col: str, text_col: str, extra: list[str], **limits: int) -> tuple[DataFrame, str, str]:
    """The extra columns, and spans and text under names that they don't have."""
    a, b, spans, text = (fresh(docs, c) for c in ("first_hash", "second_hash", "found_spans", "found_text"))
    own = docs.withColumns(dict(zip((a, b), row_hashes(F.col(id_col).cast("long"), F.col(text_col).cast("string")), strict=True)))
    found = locate(own.select(F.col(a).alias("key"), F.col(b).alias("key2"), F.col(text_col).cast("string").alias("text")), **limits)
    size = found.agg(F.coalesce(F.sum(F.aggregate("spans", F.lit(80), lambda a, x: a + F.octet_length(x))), F.lit(0)).alias("n")).head()["n"]
    found = found.select(F.col("key").alias(a), F.col("key2").alias(b), F.col("spans").alias(spans))
    out = own.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, [a, b], "left")
    return out.select(*extra, spans, F.col(text_col).cast("string").alias(text)), spans, text


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words kept, joined by single spaces; limits as of ``locate``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = [(doc, *_kept(spans, text.as_py())) for doc, spans, text in _texts(b, 2)]
                doc, n, removed, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _located(docs, "doc_id", "text", ["doc_id"], **limits)[0].mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """docs without the words of recurring windows; a text that loses none stays as it is, the others' words are joined by single spaces."""

    @F.pandas_udf("string")
    def kept(spans, text):
        return text.combine(spans, lambda t, s: t if s is None else _kept(s, t)[2].decode())

    out, spans, text = _located(docs, id_col, text_col, docs.columns, **limits)
    return out.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text)).otherwise(kept(F.col(spans), F.col(text)))).select(*docs.columns)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return kept_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by brute force: all windows as lists of words.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), dup AS (
  SELECT k, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT k, unnest(range(i, i + 35)) AS p FROM dup
), word AS (
  SELECT k, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT k, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (k, p) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""
