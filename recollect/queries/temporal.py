"""Validity, conflicts and profiles over events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import refdata as R
from .. import scratch
from ..functions import text as T
from ..operators import conflict, profile, resolve, temporal
from ..plans import pipeline
from ..providers import Offline
from ..sources import snapshots
from ..sources import tables as S
from ..sources.tables import CONFLICTING_SQL, EDGES_SQL

NOW = dt.datetime(2024, 6, 1)
VALID, KNOWN = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)
#: The events' two batches part here.
MIDDLE = dt.datetime(2024, 1, 15)
SLOT_SQL = "CASE WHEN {0} IN ('IS', 'HAS_ROLE') THEN 'role' WHEN {0} = 'WORKS_AT' THEN 'employer' WHEN {0} = 'LIVES_IN' THEN 'residence' WHEN {0} = 'BORN_IN' THEN 'origin' WHEN {0} = 'GOAL_IS' THEN 'goal' END"
FAMILY_SQL = "CASE WHEN {0} IN ('WORKS_AT', 'WORKED_AT', 'SWITCHED_FROM') THEN 'employment' WHEN {0} IN ('LIVES_IN', 'LIVED_IN', 'BORN_IN') THEN 'location' END"
SCD_SQL = EDGES_SQL + """, fresh AS (
  SELECT * FROM (SELECT *, lag(object) OVER (PARTITION BY user_id, relation ORDER BY valid_at, edge_id) AS b FROM edges) WHERE b IS NULL OR b <> object
), scd AS (
  SELECT edge_id, user_id, relation, object, valid_at, lead(valid_at) OVER (PARTITION BY user_id, relation ORDER BY valid_at, edge_id) AS nxt FROM fresh
), hist AS (SELECT edge_id, user_id, relation, object, valid_at, CASE WHEN nxt IS NOT NULL THEN greatest(nxt, valid_at + INTERVAL 1 MILLISECOND) END AS invalid_at FROM scd)"""



def _micros(df, *columns):
    """Times as microseconds, so that both engines' values are plain numbers."""
    return df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in columns})


def active_edges_recent(spark, sf_dir):
    """The newest active memories."""
    out = temporal.list_active(S.edges(spark, sf_dir))
    return _micros(out.select("edge_id", "fact", "confidence", "valid_at"), "valid_at")


def _history(spark, sf_dir):
    return temporal.history(S.edges(spark, sf_dir), ["user_id", "relation"])


def scd2_slot_history(spark, sf_dir):
    return _micros(_history(spark, sf_dir).select("edge_id", "user_id", "relation", "object", "valid_at", "invalid_at"), "valid_at", "invalid_at")


def multi_first_seen(spark, sf_dir):
    """The first edge of each user, relation and object."""
    out = S.edges(spark, sf_dir).groupBy("user_id", "relation", "object").agg(F.min("edge_id").alias("edge_id"), F.min("valid_at").alias("valid_at"), F.count("*").alias("n"))
    return _micros(out, "valid_at")


def _rule(k):
    def query(spark, sf_dir):
        out = conflict.reconcile(S.conflicting_edges(spark, sf_dir), NOW)
        if k:
            out = out.where(F.col("rule") == k)
        return _micros(out.select("edge_id", "user_id", "relation", "rule", "new_invalid_at"), "new_invalid_at")

    return query


def as_of_snapshot(spark, sf_dir):
    out = temporal.as_of(_history(spark, sf_dir), F.lit(VALID).cast("timestamp_ntz"), F.lit(KNOWN).cast("timestamp_ntz"))
    return out.select("edge_id", "user_id", "relation", "object")


def as_of_transaction(spark, sf_dir):
    """Edges recorded two days after they became valid, and closed in the books five days after their end, as known a day later."""
    day = lambda c, n: F.col(c) + F.expr(f"INTERVAL '{n}' DAY")
    late = _history(spark, sf_dir).withColumns({"created_at": day("valid_at", 2), "retracted_at": day("invalid_at", 5)})
    out = temporal.as_of(late, F.lit(VALID).cast("timestamp_ntz"), F.lit(VALID + dt.timedelta(days=1)).cast("timestamp_ntz"))
    return out.select("edge_id", "user_id", "relation", "object")


def category_retract(spark, sf_dir):
    """Uses that a user's list of tools, the objects seen in January's first week, leaves out."""
    edges = S.edges(spark, sf_dir)
    keep = edges.where((F.col("relation") == "USES") & (F.col("valid_at") < F.lit(dt.datetime(2024, 1, 8)).cast("timestamp_ntz")))
    return conflict.retract_category(edges, keep).select("edge_id", "user_id", "object")


def retract_by_id(spark, sf_dir):
    out = temporal.retract(_history(spark, sf_dir), [1, 2, 3, 5, 8, 13], NOW)
    return _micros(out.select("edge_id", "invalid_at", "retracted_at"), "invalid_at", "retracted_at")


def retention_cleanup(spark, sf_dir):
    return temporal.retain(_history(spark, sf_dir), dt.datetime(2024, 2, 15)).select("edge_id", "user_id", "relation")


def close_edges(spark, sf_dir):
    """All open edges after reconciliation."""
    return temporal.active(conflict.reconciled(S.conflicting_edges(spark, sf_dir), NOW)).groupBy("user_id", "relation").agg(F.count("*").alias("n"), F.max("object").alias("last_object"))


def _pairs(condition):
    def query(spark, sf_dir):
        e = S.conflicting_edges(spark, sf_dir).select("user_id", "edge_id", "relation", "object", "valid_at")
        return conflict.pairs(e, e, ["user_id"], condition).groupBy("user_id", "relation", "old_relation").agg(F.count("*").alias("n"), F.min("edge_id").alias("first_new"), F.max("old_edge_id").alias("last_old"))

    return query


def _slots(f, e):
    return (T.slot(f["relation"]) == T.slot(e["relation"])) & ~conflict.same_object(f, e)


def _supersession(f, e):
    return T.supersedes(f["relation"], e["relation"]) & conflict.same_object(f, e)


def legacy_contradictions(spark, sf_dir):
    return _pairs(conflict.contradicts)(spark, sf_dir)


def exact_duplicate_drop(spark, sf_dir):
    """All facts that no edge of a smaller id duplicates."""
    return conflict.without_earlier_duplicate(S.conflicting_edges(spark, sf_dir)).select("edge_id", "user_id", "relation", "object")


def _subject_edges(spark, sf_dir):
    relation = T.lookup(F.col("event_type"), {"signup": "LIVES_IN", "purchase": "WORKS_AT", "view": "USES", "click": "IS", "error": "WORKS_ON"})
    return S.edges(spark, sf_dir).join(S.table(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"), "event_type"), "edge_id").withColumn("relation", relation)


PROFILE_EDGES_SQL = """edges AS (
  SELECT event_id AS edge_id, user_id, CASE event_type WHEN 'signup' THEN 'LIVES_IN' WHEN 'purchase' THEN 'WORKS_AT' WHEN 'view' THEN 'USES' WHEN 'click' THEN 'IS' ELSE 'WORKS_ON' END AS relation,
    'o' || json_extract_string(props, '$.k') AS object, ts AS valid_at FROM events)"""


def profile_latest(spark, sf_dir):
    out = profile.values(_subject_edges(spark, sf_dir)).where("value_type = 'string'")
    return _micros(out.select("user_id", "key", "value", "updated_at"), "updated_at")


def profile_list(spark, sf_dir):
    e = _subject_edges(spark, sf_dir)
    return profile.values(e).unionByName(profile.stack(e)).where("value_type = 'list'").select("user_id", "key", "value")


def profile_last_updated(spark, sf_dir):
    out = profile.read(profile.sync(_subject_edges(spark, sf_dir))).select("user_id", F.size("profile").alias("n_keys"), F.col("profile")["company"].alias("company"), "last_updated")
    return _micros(out, "last_updated")


def profile_upsert_merge(spark, sf_dir):
    """The second half of the events over the first; errors delete their key."""
    e = S.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"), F.col("ts").alias("updated_at"))
    half = {k: profile.newest(e.where(c).select("user_id", "key", "value", F.col("updated_at").alias("valid_at"), F.col("event_id").alias("edge_id")), ["user_id", "key"]) for k, c in (("old", "event_id % 2 = 0"), ("new", "event_id % 2 = 1"))}
    both = snapshots.upsert(half["old"], half["new"], ["user_id", "key"], "valid_at")
    gone = e.where("key = 'error'").select("user_id", "key").distinct()
    return _micros(snapshots.delete(both, gone).select("user_id", "key", "value", F.col("valid_at").alias("updated_at")), "updated_at")


def resolve_fold(spark, sf_dir):
    """The sequential fold of all events by user."""
    e = S.conflicting_edges(spark, sf_dir).select("edge_id", "user_id", "relation", "object", "valid_at", F.col("edge_id").alias("ordinal"), (F.col("edge_id") % 17 == 0).alias("retraction"))
    return resolve.resolve(e).groupBy("user_id", "relation").agg(F.count("*").alias("n"), F.count_if(F.col("invalid_at").isNull()).alias("n_open"))


def resolve_single_slot(spark, sf_dir):
    """The fold restricted to one slot a user, which is the slot's history; its SQL knows no embeddings, and so no similarity counts."""
    e = S.edges(spark, sf_dir).where("relation = 'LIVES_IN'").select("edge_id", "user_id", "relation", "object", "valid_at", F.col("edge_id").alias("ordinal"), F.lit(False).alias("retraction"))
    out = resolve.resolve(e, None).select(F.col("edge_id").cast("long"), F.col("user_id").cast("long"), "object", "invalid_at")
    return _micros(out, "invalid_at")


def event_windows(spark, sf_dir):
    from ..streaming.ingest import event_windows as windows

    return _micros(windows(S.table(spark, sf_dir, "events")), "start")


def stream_ingest(spark, sf_dir):
    """The fold as a stream over the events: a second run goes on from the state that the first one left."""
    from ..streaming import ingest

    root = scratch.folder(spark)
    facts = S.conflicting_edges(spark, sf_dir).select(
        F.col("edge_id").cast("string"), F.col("user_id").cast("string"), "relation", "object", "valid_at", F.col("edge_id").alias("ordinal"), F.lit(False).alias("retraction")
    )
    early = F.col("valid_at") < F.lit(MIDDLE).cast("timestamp_ntz")
    for part in (facts.where(early), facts.where(~early)):
        part.write.mode("append").parquet(f"{root}/in")
        ingest.ingest_stream(ingest.fact_stream(spark, f"{root}/in", 1 << 20), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return ingest.current_edges(spark, f"{root}/out").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("invalid_at").isNull()).alias("n_open"))


TOLD = {"signup": "I live in ", "purchase": "I work at ", "view": "I use ", "click": "I prefer ", "error": "Nothing of "}


def ingest_batch(spark, sf_dir):
    """Sentences of all events from episodes to edges, in two batches: the second meets the edges that the first one stored."""
    e = S.table(spark, sf_dir, "events")
    said = F.concat(T.lookup(F.col("event_type"), TOLD), F.lit("O"), F.get_json_object("props", "$.k"), F.lit("."))
    told = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("episode_id"), F.col("user_id").cast("string"), said.alias("content"), "ts")
    early = F.col("ts") < F.lit(MIDDLE).cast("timestamp_ntz")
    first, _, _ = pipeline.ingest(told.where(early).drop("ts"), Offline(), MIDDLE)
    second, _, _ = pipeline.ingest(told.where(~early).drop("ts"), Offline(), NOW, first)
    return _micros(second.select(F.col("episode_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "relation", "object", "valid_at", "invalid_at"), "valid_at", "invalid_at")


QUERIES = {
    f.__name__: f
    for f in (
        active_edges_recent, scd2_slot_history, multi_first_seen, as_of_snapshot, category_retract, retract_by_id, retention_cleanup, close_edges, legacy_contradictions,
        as_of_transaction, exact_duplicate_drop, profile_latest, profile_list, profile_last_updated, profile_upsert_merge, resolve_fold, resolve_single_slot, ingest_batch, event_windows, stream_ingest,
    )
} | {
    "reconcile_full": _rule(0), "reconcile_transitions": _rule(1), "reconcile_same_place": _rule(2), "reconcile_slots": _rule(3), "reconcile_past_employment": _rule(4),
    "supersession_pairs": _pairs(_supersession), "slot_conflict_pairs": _pairs(_slots), "redundant_pairs": _pairs(conflict.is_redundant), "invalidation_pairs": _pairs(conflict.invalidates),
}

_RECONCILE = "WITH " + CONFLICTING_SQL + f""", e AS (SELECT *, {SLOT_SQL.format('relation')} AS slot FROM edges
), lives AS (SELECT user_id, object, arg_min(valid_at, edge_id) AS at FROM e WHERE relation = 'LIVES_IN' GROUP BY ALL
), last AS (SELECT user_id, max(valid_at) AS at FROM e WHERE relation NOT IN ('SWITCHED_FROM', 'SWITCHED_TO') GROUP BY ALL
), win AS (SELECT user_id, slot, edge_id AS id, valid_at AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY valid_at DESC, edge_id) AS n FROM e WHERE slot IS NOT NULL) WHERE n = 1
), r AS (
  SELECT e.*, CASE WHEN relation IN ('SWITCHED_FROM', 'SWITCHED_TO') THEN 1 WHEN relation = 'BORN_IN' AND lives.at IS NOT NULL THEN 2 WHEN win.id <> e.edge_id THEN 3 WHEN relation = 'WORKED_AT' AND job.at IS NOT NULL THEN 4 END AS rule,
    coalesce(last.at, TIMESTAMP '2024-06-01') AS a1, lives.at AS a2, win.at AS a3, job.at AS a4
  FROM e LEFT JOIN lives ON lives.user_id = e.user_id AND lives.object = e.object LEFT JOIN last ON last.user_id = e.user_id
    LEFT JOIN win ON win.user_id = e.user_id AND win.slot = e.slot LEFT JOIN win job ON job.user_id = e.user_id AND job.slot = 'employer'
)
SELECT edge_id, user_id, relation, rule, epoch_us(greatest(CASE rule WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 ELSE a4 END, valid_at + INTERVAL 1 MILLISECOND)) AS new_invalid_at FROM r WHERE rule """


def _pair_sql(condition: str) -> str:
    return "WITH " + CONFLICTING_SQL + f""", p AS (
  SELECT f.user_id, f.edge_id, f.relation AS fr, f.object AS fo, e.edge_id AS eid, e.relation AS er, e.object AS eo FROM edges f JOIN edges e ON f.user_id = e.user_id AND e.valid_at < f.valid_at
) SELECT user_id, fr AS relation, er AS old_relation, count(*) AS n, min(edge_id) AS first_new, max(eid) AS last_old FROM p WHERE {condition} GROUP BY ALL"""


#: The fold by recursion: each step meets a user's next fact with the edges that the facts before it left open.
def _fold_sql(retracted: str) -> str:
    slot = lambda x: SLOT_SQL.format(x)
    same = f"(e.r = f.r OR {slot('e.r')} = {slot('f.r')})"
    skip = f"((f.r = 'WORKED_AT' AND len(list_filter(open, lambda e: e.r = 'WORKS_AT')) > 0) OR len(list_filter(open, lambda e: e.o = f.o AND coalesce({same}, false))) > 0)"
    supersedes = "((f.r = 'LIVES_IN' AND e.r IN ('BORN_IN', 'LIVED_IN')) OR (f.r = 'WORKS_AT' AND e.r IN ('WORKED_AT', 'SWITCHED_FROM', 'SWITCHED_TO')))"
    close = (
        f"CASE WHEN e.r = f.r AND e.o = f.o THEN false WHEN coalesce({slot('e.r')} = {slot('f.r')}, false) AND e.o <> f.o THEN true "
        "WHEN f.r = 'WORKS_AT' AND (e.r IN ('WORKED_AT', 'SWITCHED_FROM', 'SWITCHED_TO') OR (e.r = 'WORKS_AT' AND e.o <> f.o)) THEN true "
        f"ELSE e.o = f.o AND ({supersedes} OR (e.r <> f.r AND coalesce({FAMILY_SQL.format('e.r')} = {FAMILY_SQL.format('f.r')}, false))) END"
    )
    return "WITH RECURSIVE " + CONFLICTING_SQL + f""", f AS (
  SELECT user_id, relation AS r, object AS o, {retracted} AS gone, row_number() OVER (PARTITION BY user_id ORDER BY valid_at, CASE WHEN relation IN ('WORKS_AT', 'IS', 'HAS_ROLE', 'LIVES_IN') THEN 0 ELSE 3 END, edge_id) AS i FROM edges
), s AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(r VARCHAR, o VARCHAR)[]) AS open, CAST(NULL AS VARCHAR) AS r, false AS stored FROM f
  UNION ALL
  SELECT s.user_id, f.i, CASE WHEN f.gone OR {skip} THEN open ELSE list_append(list_filter(open, lambda e: NOT ({close})), {{'r': f.r, 'o': f.o}}) END, f.r, f.gone OR NOT {skip}
  FROM s JOIN f ON f.user_id = s.user_id AND f.i = s.i + 1
), last AS (
  SELECT user_id, unnest(open).r AS r FROM (SELECT user_id, arg_max(open, i) AS open FROM s GROUP BY user_id)
), n AS (SELECT user_id, r, count(*) AS n FROM s WHERE stored GROUP BY ALL), o AS (SELECT user_id, r, count(*) AS n_open FROM last GROUP BY ALL)
"""


_FR, _ER = SLOT_SQL.format("fr"), SLOT_SQL.format("er")
_SUPERSEDES = "((fr = 'LIVES_IN' AND er IN ('BORN_IN', 'LIVED_IN')) OR (fr = 'WORKS_AT' AND er IN ('WORKED_AT', 'SWITCHED_FROM', 'SWITCHED_TO')))"
_REDUNDANT = f"fo = eo AND fr <> er AND {FAMILY_SQL.format('fr')} = {FAMILY_SQL.format('er')}"

ORACLE_SQL = {
    "active_edges_recent": "WITH " + EDGES_SQL + " SELECT edge_id, 'user ' || lower(replace(relation, '_', ' ')) || ' ' || object AS fact, confidence, epoch_us(valid_at) AS valid_at FROM edges WHERE relation NOT IN ('SWITCHED_FROM', 'SWITCHED_TO') ORDER BY valid_at DESC, edge_id LIMIT 50",
    "scd2_slot_history": "WITH " + SCD_SQL + " SELECT edge_id, user_id, relation, object, epoch_us(valid_at) AS valid_at, epoch_us(invalid_at) AS invalid_at FROM hist",
    "multi_first_seen": "WITH " + EDGES_SQL + " SELECT user_id, relation, object, min(edge_id) AS edge_id, epoch_us(min(valid_at)) AS valid_at, count(*) AS n FROM edges GROUP BY ALL",
    "reconcile_full": _RECONCILE + "IS NOT NULL", "reconcile_transitions": _RECONCILE + "= 1", "reconcile_same_place": _RECONCILE + "= 2", "reconcile_slots": _RECONCILE + "= 3", "reconcile_past_employment": _RECONCILE + "= 4",
    "close_edges": "WITH retired AS (" + _RECONCILE + "IS NOT NULL), " + CONFLICTING_SQL + " SELECT user_id, relation, count(*) AS n, max(object) AS last_object FROM edges ANTI JOIN retired USING (edge_id) GROUP BY ALL",
    "as_of_snapshot": "WITH " + SCD_SQL + " SELECT edge_id, user_id, relation, object FROM hist WHERE valid_at <= TIMESTAMP '2024-01-10' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-10') AND valid_at <= TIMESTAMP '2024-01-20'",
    "category_retract": "WITH " + EDGES_SQL + ", u AS (SELECT * FROM edges WHERE relation = 'USES') SELECT edge_id, user_id, object FROM u WHERE NOT EXISTS (SELECT 1 FROM u k WHERE k.user_id = u.user_id AND k.object = u.object AND k.valid_at < TIMESTAMP '2024-01-08')",
    "retract_by_id": "WITH " + SCD_SQL + " SELECT edge_id, epoch_us(CASE WHEN edge_id IN (1, 2, 3, 5, 8, 13) THEN greatest(TIMESTAMP '2024-06-01', valid_at + INTERVAL 1 MILLISECOND) ELSE invalid_at END) AS invalid_at, epoch_us(CASE WHEN edge_id IN (1, 2, 3, 5, 8, 13) THEN TIMESTAMP '2024-06-01' ELSE invalid_at END) AS retracted_at FROM hist",
    "retention_cleanup": "WITH " + SCD_SQL + " SELECT edge_id, user_id, relation FROM hist WHERE invalid_at IS NULL OR invalid_at >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY",
    "supersession_pairs": _pair_sql(f"{_SUPERSEDES} AND fo = eo"), "slot_conflict_pairs": _pair_sql(f"{_FR} = {_ER} AND fo <> eo"), "redundant_pairs": _pair_sql(_REDUNDANT),
    "invalidation_pairs": _pair_sql(f"CASE WHEN fr = er AND fo = eo THEN false WHEN {_FR} = {_ER} AND fo <> eo THEN true WHEN fr = 'WORKS_AT' AND er IN ('WORKED_AT', 'SWITCHED_FROM', 'SWITCHED_TO') THEN true WHEN {_SUPERSEDES} AND fo = eo THEN true WHEN {_REDUNDANT} THEN true ELSE false END"),
    "legacy_contradictions": _pair_sql("fr IN (" + ", ".join(f"'{r}'" for r in R.SINGULAR) + ") AND fo <> eo"),
    "exact_duplicate_drop": "WITH " + CONFLICTING_SQL + f" SELECT edge_id, user_id, relation, object FROM edges f WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_id < f.edge_id AND e.user_id = f.user_id AND e.object = f.object AND (e.relation = f.relation OR {SLOT_SQL.format('e.relation')} = {SLOT_SQL.format('f.relation')}))",
    "profile_latest": "WITH " + PROFILE_EDGES_SQL + ", k AS (SELECT *, CASE relation WHEN 'IS' THEN 'role' WHEN 'WORKS_AT' THEN 'company' WHEN 'LIVES_IN' THEN 'location' END AS key FROM edges), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY valid_at DESC, edge_id) AS n FROM k WHERE key IS NOT NULL) SELECT user_id, key, object AS value, epoch_us(valid_at) AS updated_at FROM n WHERE n = 1",
    "profile_list": "WITH " + PROFILE_EDGES_SQL + ", k AS (SELECT *, CASE relation WHEN 'WORKS_ON' THEN 'current_project' WHEN 'USES' THEN 'current_stack' END AS key FROM edges), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, key, object ORDER BY valid_at DESC, edge_id) AS n FROM k WHERE key IS NOT NULL) SELECT user_id, key, '[' || string_agg('\"' || object || '\"', ',' ORDER BY valid_at DESC, edge_id) || ']' AS value FROM n WHERE n = 1 GROUP BY user_id, key",
    "profile_last_updated": "WITH " + PROFILE_EDGES_SQL + " SELECT user_id, CAST(count(DISTINCT relation) AS INT) AS n_keys, arg_max(object, valid_at) FILTER (relation = 'WORKS_AT') AS company, epoch_us(max(valid_at)) AS last_updated FROM edges GROUP BY user_id",
    "profile_upsert_merge": "SELECT user_id, event_type AS key, arg_max(json_extract_string(props, '$.k'), ts) AS value, epoch_us(max(ts)) AS updated_at FROM events WHERE event_type <> 'error' GROUP BY ALL",
    "resolve_fold": _fold_sql("edge_id % 17 = 0") + "SELECT CAST(user_id AS VARCHAR) AS user_id, r AS relation, n, coalesce(n_open, 0) AS n_open FROM n LEFT JOIN o USING (user_id, r)",
    "stream_ingest": _fold_sql("false") + "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(coalesce(n_open, 0)) AS BIGINT) AS n_open FROM n LEFT JOIN o USING (user_id, r) GROUP BY user_id",
    "as_of_transaction": "WITH " + SCD_SQL + " SELECT edge_id, user_id, relation, object FROM hist WHERE valid_at + INTERVAL 2 DAY <= TIMESTAMP '2024-01-11' AND valid_at <= TIMESTAMP '2024-01-10' AND (invalid_at IS NULL OR invalid_at + INTERVAL 5 DAY > TIMESTAMP '2024-01-11' OR invalid_at > TIMESTAMP '2024-01-10')",
    "ingest_batch": """WITH e AS (
  SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'LIVES_IN' WHEN 'purchase' THEN 'WORKS_AT' WHEN 'view' THEN 'USES' ELSE 'PREFERS' END AS relation, 'O' || json_extract_string(props, '$.k') AS object,
    CASE WHEN ts < TIMESTAMP '2024-01-15' THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-06-01' END AS told FROM events WHERE event_type <> 'error'
), c AS (
  SELECT *, lag(object) OVER w AS b, row_number() OVER (PARTITION BY user_id, relation, object ORDER BY told, event_id) AS n FROM e WINDOW w AS (PARTITION BY user_id, relation ORDER BY told, event_id)
), k AS (SELECT * FROM c WHERE CASE WHEN relation = 'PREFERS' THEN n = 1 ELSE b IS NULL OR b <> object END
), l AS (SELECT *, CASE WHEN relation <> 'PREFERS' THEN lead(told) OVER (PARTITION BY user_id, relation ORDER BY told, event_id) END AS nxt FROM k)
SELECT event_id, user_id, relation, object, epoch_us(told) AS valid_at, epoch_us(CASE WHEN nxt IS NOT NULL THEN greatest(nxt, told + INTERVAL 1 MILLISECOND) END) AS invalid_at FROM l""",
    "resolve_single_slot": "WITH " + SCD_SQL + " SELECT edge_id, user_id, object, epoch_us(invalid_at) AS invalid_at FROM hist WHERE relation = 'LIVES_IN'",
    "event_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}


