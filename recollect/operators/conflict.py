"""Duplicates, conflicts and reconciliation of edges."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, types
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..functions import vectors as V
from .temporal import OPEN, close, now_literal


def _key(x: dict[str, Column]) -> Column:
    """The object's key, from a column if the row has it: a join compares many pairs of the same objects."""
    return x["key"] if "key" in x else T.object_key(x["object"])


def same_object(f: dict[str, Column], e: dict[str, Column]) -> Column:
    return _key(f) == _key(e)


def is_duplicate(f: dict[str, Column], e: dict[str, Column]) -> Column:
    """The same relation or the same slot, and the same object."""
    same = F.upper(f["relation"]) == F.upper(e["relation"])
    return same_object(f, e) & (same | F.coalesce(T.slot(f["relation"]) == T.slot(e["relation"]), F.lit(False)))


def is_redundant(f: dict[str, Column], e: dict[str, Column]) -> Column:
    families = F.coalesce(T.family(f["relation"]) == T.family(e["relation"]), F.lit(False))
    return same_object(f, e) & (F.upper(f["relation"]) != F.upper(e["relation"])) & families


def invalidates(f: dict[str, Column], e: dict[str, Column], similarity: Column | None = None, threshold: float = R.CONFLICT_THRESHOLD) -> Column:
    """Whether storing f closes e; the similarity counts where nothing else decides."""
    fr, er, same = F.upper(f["relation"]), F.upper(e["relation"]), same_object(f, e)
    out = (
        F.when((fr == er) & same, F.lit(False))
        .when(F.coalesce(T.slot(fr) == T.slot(er), F.lit(False)) & ~same, F.lit(True))
        .when(fr.isin(*R.CURRENT_EMPLOYMENT) & (er.isin(*R.PAST_EMPLOYMENT, *R.TRANSITIONS) | ((er == "WORKS_AT") & ~same)), F.lit(True))
        .when(T.supersedes(fr, er) & same, F.lit(True))
        .when(is_redundant(f, e), F.lit(True))
    )
    if similarity is not None:
        out = out.when((similarity >= threshold) & (fr == er), ~same)
    return out.otherwise(F.lit(False))


def contradicts(f: dict[str, Column], e: dict[str, Column]) -> Column:
    """The older test: relations with one value, another object; letters' case aside."""
    return (T.behavior(f["relation"]) == "singular") & (F.lower(T.strip(f["object"])) != F.lower(T.strip(e["object"])))


def pairs(new: DataFrame, old: DataFrame, on: list[str], condition) -> DataFrame:
    """Pairs of a new fact and an earlier edge with equal keys that meet a condition on both."""
    keyed = lambda df: df.withColumn("key", T.object_key(F.col("object")))
    e = keyed(old).select(*on, *(F.col(c).alias(f"old_{c}") for c in ("edge_id", "relation", "object", "valid_at", "key")))
    f = {c: F.col(c) for c in ("relation", "object", "key")}
    out = keyed(new).join(e, on).where(F.col("old_valid_at") < F.col("valid_at")).where(condition(f, {c: F.col(f"old_{c}") for c in f}))
    return out.drop("key", "old_key")


def drop_duplicates(new: DataFrame, edges: DataFrame) -> DataFrame:
    """New facts without a duplicate among open edges of the user: two anti joins on equal keys, no loops."""
    key = {"__key": T.object_key(F.col("object")), "__relation": F.upper("relation"), "__slot": T.slot(F.col("relation"))}
    f, e = new.withColumns(key), edges.where(OPEN).withColumns(key)
    by_relation = e.select("user_id", "__key", "__relation").distinct()
    by_slot = e.where("__slot IS NOT NULL").select("user_id", "__key", "__slot").distinct()
    return f.join(by_relation, ["user_id", "__key", "__relation"], "left_anti").join(by_slot, ["user_id", "__key", "__slot"], "left_anti").select(*new.columns)


def without_earlier_duplicate(edges: DataFrame) -> DataFrame:
    """Rows that no open edge of the user with a smaller id duplicates: each row is held against all before it, by two aggregates."""
    key = {"__key": T.object_key(F.col("object")), "__relation": F.upper("relation"), "__slot": T.slot(F.col("relation"))}
    f = edges.withColumns(key)
    first = lambda by: f.where(OPEN).groupBy("user_id", "__key", by).agg(F.min("edge_id").alias(f"__first{by}"))
    both = f.join(first("__relation"), ["user_id", "__key", "__relation"], "left").join(first("__slot").where("__slot IS NOT NULL"), ["user_id", "__key", "__slot"], "left")
    earlier = F.least("__first__relation", "__first__slot") < F.col("edge_id")
    return both.where(~F.coalesce(earlier, F.lit(False))).select(*edges.columns)


#: Buckets that keys are counted in at most; rows and bytes of a strip's vectors at most.
BUCKETS, STRIP, STRIP_BYTES = 4096, 32768, 16 << 20


def _matrix(vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, shorter ones filled with zeros, and their lengths; norms are summed from left to right."""
    lists = vectors.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    squares = np.zeros(len(sizes))
    with np.errstate(all="ignore"):
        for k in range(width):
            squares += out[:, k] * out[:, k]
        return out / np.sqrt(squares)[:, None], sizes


def _compared(new: pa.Table, old: pa.Table, on: list[str], threshold: float, earlier: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of new, rows of old, similarities) over the threshold, a few rows of new at a time; a row of new is in one of them."""
    width = max(pc.max(pc.list_value_length(t["vector"])).as_py() for t in (new, old))
    (f, f_size), (e, e_size) = _matrix(new["vector"], width), _matrix(old["vector"], width)
    codes: dict[tuple, int] = {}
    f_key, e_key = (np.array([codes.setdefault(k, len(codes)) for k in zip(*(t[c].to_pylist() for c in on), strict=True)], np.int64) for t in (new, old))
    f_order, e_order = np.argsort(f_key, kind="stable"), np.argsort(e_key, kind="stable")
    at = np.arange(len(codes) + 1)
    f_at, e_at = np.searchsorted(f_key[f_order], at), np.searchsorted(e_key[e_order], at)
    for k in np.flatnonzero((np.diff(f_at) > 0) & (np.diff(e_at) > 0)).tolist():
        right = e_order[e_at[k] : e_at[k + 1]]
        own, step = e[right].T, max(1, (1 << 22) // len(right))
        for start in range(f_at[k], f_at[k + 1], step):
            left = f_order[start : min(start + step, f_at[k + 1])]
            with np.errstate(all="ignore"):
                s = f[left] @ own
                s[f_size[left][:, None] != e_size[right][None, :]] = 0.0
                i, j = np.nonzero((np.abs(s - threshold) < 1e-12) & (f_size[left][:, None] == e_size[right][None, :]))
                exact = np.zeros(len(i))  # so near, the order of the sum decides
                for d in range(width if len(i) else 0):
                    exact += f[left[i], d] * e[right[j], d]
                s[i, j] = exact
                i, j = np.nonzero(~(s <= threshold))
            a, b, s = left[i], right[j], s[i, j]
            if earlier and len(a):
                hit = pc.less(old["old_id"].take(pa.array(b)), new["edge_id"].take(pa.array(a))).to_numpy()
                a, b, s = a[hit], b[hit], s[hit]
            if len(a):
                yield a, b, s


def _cells(new: DataFrame, edges: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number of a cell (__cell): any two rows of equal keys, one of each side, meet in one.

    Keys go to buckets, the rows of a bucket to strips of bounded size, whatever their keys; a cell is a strip of each side.
    """
    spark = new.sparkSession
    keyed = lambda df, k: df.select(*on, k, V.doubles(F.col("vector")).alias("vector")).where(V.norm(F.col("vector")) > 0).dropna(subset=on).withColumn("__hash", F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int"))
    f, e = keyed(new, "edge_id"), keyed(edges, "old_id")
    count = lambda df, side: df.groupBy("__hash").agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.max(F.size("vector")).alias("width"))
    counted = count(f, 0).unionByName(count(e, 1)).collect()  # at most a row a bucket and side
    total, width = sum(r["n"] for r in counted), max((r["width"] for r in counted), default=1)
    most = max(256, min(STRIP, STRIP_BYTES // (8 * width)))
    buckets = 256
    while buckets < BUCKETS and buckets * most < total:
        buckets *= 2
    sizes: dict[int, list[int]] = {}
    for r in counted:
        sizes.setdefault(r["__hash"] % buckets, [0, 0])[r["side"]] += r["n"]
    strip = min(most, max(4096, max((max(n) for n in sizes.values()), default=0) // 8))
    rows, first = [], 0
    for bucket, (a, b) in sorted(sizes.items()):
        a, b = -(-a // strip), -(-b // strip)
        if a and b:
            rows.append((bucket, first, a, b))
            first += a * b
    plan = F.broadcast(spark.createDataFrame(rows, "__bucket int, __first long, __new int, __old int"))
    own = lambda k, n: F.pmod(F.xxhash64(F.lit(7), k), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    n = max(spark.sparkContext.defaultParallelism, min(first, 4096))

    def dealt(df: DataFrame, k: str, a, b) -> DataFrame:
        df = df.withColumn("__bucket", F.col("__hash") % buckets).join(plan, "__bucket").withColumn("__a", a).withColumn("__b", b)
        return df.select((F.col("__first") + F.col("__a") * F.col("__old") + F.col("__b")).alias("__cell"), *(F.col(c).alias(c) for c in (*on, k, "vector"))).repartition(n, "__cell")

    return dealt(f, "edge_id", own("edge_id", "__new"), each("__old")), dealt(e, "old_id", each("__new"), own("old_id", "__old"))


def _sides(new: DataFrame, edges: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    return new.select(*on, "vector", "edge_id"), edges.select(*on, "vector", F.col("edge_id").alias("old_id"))


def near_duplicates(new: DataFrame, edges: DataFrame, on: list[str], threshold: float = R.DEDUP_THRESHOLD, earlier: bool = False) -> DataFrame:
    """New rows (edge_id, vector) for which an edge with equal keys is more similar than the threshold: (edge_id, on, old_id, similarity).

    Strips of vectors are compared by products of matrices; zero vectors are like none. With earlier, only edges of smaller ids count.
    """
    f, e = _sides(new, edges, on)
    schema = types.StructType([*(f.schema[c] for c in on), f.schema["edge_id"], e.schema["old_id"], types.StructField("similarity", types.DoubleType())])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        own = pa.schema([*(x.schema.field(c) for c in (*on, "edge_id")), y.schema.field("old_id"), pa.field("similarity", pa.float64())])
        if not x.num_rows or not y.num_rows:
            return own.empty_table()
        found = [pa.table([*(x[c].take(pa.array(a)) for c in (*on, "edge_id")), y["old_id"].take(pa.array(b)), pa.array(s)], schema=own) for a, b, s in _compared(x, y, on, threshold, earlier)]
        return pa.concat_tables([own.empty_table(), *found])

    f, e = _cells(f, e, on)
    return f.groupBy("__cell").cogroup(e.groupBy("__cell")).applyInArrow(run, schema)


def with_near(new: DataFrame, edges: DataFrame, on: list[str], threshold: float = R.DEDUP_THRESHOLD, earlier: bool = False) -> DataFrame:
    """The edge_id of each new row that has a near duplicate, once; pairs are compared as in ``near_duplicates`` but not listed."""
    f, e = _sides(new, edges, on)
    schema = types.StructType([f.schema["edge_id"]])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        ids = x.select(["edge_id"])
        if not x.num_rows or not y.num_rows:
            return ids.slice(0, 0)
        found = [np.unique(a) for a, _, _ in _compared(x, y, on, threshold, earlier)]
        return ids.take(pa.array(np.concatenate(found))) if found else ids.slice(0, 0)

    f, e = _cells(f, e, on)
    return f.groupBy("__cell").cogroup(e.groupBy("__cell")).applyInArrow(run, schema).distinct()


def reconcile(edges: DataFrame, now: dt.datetime) -> DataFrame:
    """(edge_id, user_id, relation, valid_at, rule, close_at, new_invalid_at) of open edges to close; the first rule that hits counts.

    1 transitions; 2 an origin that is a residence; 3 all but the newest of a slot; 4 past employment beside a current one.
    Only aggregates are joined back, so that a user with many edges meets partial sums, not one task.
    """
    e = edges.where(OPEN).withColumns({"__slot": T.slot(F.col("relation")), "__key": T.object_key(F.col("object"))})
    by_user = e.where(~F.col("relation").isin(*R.TRANSITIONS)).groupBy("user_id").agg(F.max("valid_at").alias("__last"))
    lives = e.where("relation = 'LIVES_IN'").groupBy("user_id", "__key").agg(F.min_by("valid_at", "edge_id").alias("__lives"))
    newest = F.min(F.struct((-F.unix_micros(F.col("valid_at").cast("timestamp"))).alias("t"), F.col("edge_id").alias("id"), F.col("valid_at").alias("at")))
    winners = e.where("__slot IS NOT NULL").groupBy("user_id", "__slot").agg(newest.alias("__w"))
    employer = winners.where("__slot = 'employer'").select("user_id", F.col("__w.at").alias("__works"))
    found = e.join(by_user, "user_id", "left").join(lives, ["user_id", "__key"], "left").join(winners, ["user_id", "__slot"], "left").join(employer, "user_id", "left")
    rule = (
        F.when(F.col("relation").isin(*R.TRANSITIONS), 1)
        .when((F.col("relation") == "BORN_IN") & F.col("__lives").isNotNull(), 2)
        .when(F.col("__slot").isNotNull() & (F.col("__w.id") != F.col("edge_id")), 3)
        .when(F.col("relation").isin(*R.PAST_EMPLOYMENT) & F.col("__works").isNotNull(), 4)
    )
    at = F.when(F.col("rule") == 1, F.coalesce("__last", now_literal(now))).when(F.col("rule") == 2, F.col("__lives")).when(F.col("rule") == 3, F.col("__w.at")).otherwise(F.col("__works"))
    out = found.withColumn("rule", rule).where("rule IS NOT NULL").withColumn("close_at", at)
    return out.select("edge_id", "user_id", "relation", "valid_at", "rule", "close_at", F.greatest("close_at", F.col("valid_at") + F.expr("INTERVAL '0.001' SECOND")).alias("new_invalid_at"))


def reconciled(edges: DataFrame, now: dt.datetime) -> DataFrame:
    return close(edges, reconcile(edges, now).select("edge_id", "close_at"), now)


def retract_category(edges: DataFrame, keep: DataFrame, category: str = "USES") -> DataFrame:
    """Open edges of a category whose object isn't among a user's kept ones (user_id, object); only USES has an effect."""
    if category.upper() != "USES":
        return edges.limit(0)
    key = F.lower(T.strip(F.col("object"))).alias("__key")
    return edges.where(OPEN).where("relation = 'USES'").withColumn("__key", key).join(keep.select("user_id", key).distinct(), ["user_id", "__key"], "left_anti").drop("__key")
