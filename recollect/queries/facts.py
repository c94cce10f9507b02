"""Normalization, routing and deduplication of facts over the supplied tables and over literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..operators import ontology, routing
from ..plans import pipeline
from ..sources import tables as S


def _parts(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" - ", "p_name", "p_type", "p_brand").alias("phrase"))


def canonical_token(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", T.canonical_token(F.col("phrase")).alias("token"))


def alias_key(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", T.alias_key(F.col("phrase")).alias("key"))


def object_trim(spark, sf_dir):
    """The first three words of each document, and how many it has."""
    return S.corpus(spark, sf_dir).select("edge_id", T.trim_object(F.col("fact_string")).alias("object"), T.word_count(F.col("fact_string")).alias("n_words"))


#: Phrases for each type of event and each remainder of the key: exact, with noise, near and unknown ones.
PHRASES = ("works at", "Lives  in!", "USES", "works att", "obsessed with", "resides inn", "prefer", "!!!", "switched to", "is a")


def _phrases(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.get_json_object("props", "$.k").cast("int") % len(PHRASES)).alias("p"), "ts", (F.col("value") / 100).alias("confidence"))
    return e.withColumn("phrase", T.lookup(F.col("p"), dict(enumerate(PHRASES))))


def alias_exact(spark, sf_dir):
    out = ontology.match_exact(_phrases(spark, sf_dir).select("id", "phrase"), ontology.aliases(spark))
    return out.where("relation IS NOT NULL").select("id", "relation", T.behavior(F.col("relation")).alias("behavior"))


def alias_fuzzy(spark, sf_dir):
    """Known phrases with some letters of the parts' names in them: nearly as many as there are parts."""
    part = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_partkey") % len(PHRASES)).alias("p"))
    base, at = T.lookup(F.col("p"), dict(enumerate(PHRASES))), (F.col("id") % 6).cast("int")
    noisy = F.concat(F.substring(base, F.lit(1), at), F.substring("p_name", (F.col("id") % 7 + 1).cast("int"), (F.col("id") % 4).cast("int")), F.substring(base, at + 1, F.length(base)))
    out = ontology.normalize(part.select("id", noisy.alias("phrase")), ontology.aliases(spark))
    return out.select("id", "relation", F.round("match_score", 3).alias("match_score"), "tier", "behavior")


def learned_aliases(spark, sf_dir):
    known = ontology.aliases(spark)
    return ontology.learned(ontology.normalize(_phrases(spark, sf_dir).select("id", "phrase"), known), known)


def alias_semantic(spark, sf_dir):
    """The nearest of six described relations; the vectors with ids 1 to 6 stand for their descriptions."""
    v = S.vectors(spark, sf_dir)
    by_id = {r["edge_id"]: r["vector"] for r in v.where("edge_id BETWEEN 1 AND 6").collect()}
    described = [(name, list(by_id[k + 1])) for k, name in enumerate(R.DESCRIPTIONS)]
    return ontology.match_meaning(v, described, 0.3).select("edge_id", "relation", "match_score")


#: Objects that lists, words and capitals tell.
OBJECTS = ("cats", "Guitar", "Luna park", "New York city", "Delhi", "Ålesund", "somewhere", "a big town", "", "two Words")


def entity_types(spark, sf_dir):
    """What objects seem to be, of a list and of the customers' names and segments."""
    own = spark.createDataFrame([(k, o) for k, o in enumerate(OBJECTS)], "id long, object string")
    c = S.table(spark, sf_dir, "customer").select((F.col("c_custkey") + len(OBJECTS)).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_name")).alias("object"))
    return own.unionByName(c).select("id", routing.entity_type(F.col("object")).alias("type"))


def aliases_told(spark, sf_dir):
    """Phrases normalized with two aliases told outright, one of them in the place of another."""
    told = spark.createDataFrame([("Obsessed-with", "likes_much"), ("prefer", "USES"), (" ", "X")], "alias string, relation string")
    out = ontology.normalize(_phrases(spark, sf_dir).select("id", "phrase").where("phrase IN ('obsessed with', 'prefer', 'uses')"), ontology.learn(ontology.aliases(spark), told))
    return out.select("id", "relation", "tier")


def pending_unknowns(spark, sf_dir):
    """Phrases seen, but for those seen often and surely enough."""
    p = _phrases(spark, sf_dir).select("id", "ts", F.col("phrase").alias("relation"), "confidence")
    out = ontology.pending(ontology.unknown_statistics(p), ontology.promotions(p, ["ts", "id"], 60, 0.35))
    return out.select("relation", "count", F.round("avg_confidence", 6).alias("avg_confidence"))


def unknown_relation_stats(spark, sf_dir):
    """Statistics of each phrase, the odd half combined with those stored of the even half."""
    p = _phrases(spark, sf_dir).select("id", F.col("phrase").alias("relation"), "confidence")
    stored = ontology.unknown_statistics(p.where("id % 2 = 0"))
    return ontology.combine_unknown(stored, p.where("id % 2 = 1")).select("relation", "count", F.round("avg_confidence", 6).alias("avg_confidence"))


def auto_promote(spark, sf_dir):
    p = _phrases(spark, sf_dir).select("id", "ts", F.col("phrase").alias("relation"), "confidence")
    return ontology.promotions(p, ["ts", "id"], 20, 0.1).select("relation", "count", F.round("avg_confidence", 6).alias("avg_confidence"))


def _reviewed(spark, sf_dir):
    """Facts from documents: confidence by quality and toxicity, status by length, tense by id."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    both = d.join(S.table(spark, sf_dir, "labels"), "doc_id", "left")
    first = T.trim_object(F.col("text"))
    return both.select(
        "doc_id", "lang", F.lit("USES").alias("relation"), F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(first).alias("object"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("absent from the text")).otherwise(F.substring("text", 5, 20)).alias("source_span"),
        F.when(F.col("toxic") == 1, 0.1).when(F.col("quality") == 0, 0.5).when(F.col("quality") == 1, 0.9).otherwise(0.65).alias("confidence"),
        F.when(F.col("doc_id") % 5 == 0, "pending").otherwise("confirmed").alias("review_status"), F.when(F.col("doc_id") % 13 == 0, "future").otherwise("current").alias("temporal_status"),
    )


def judge_routing(spark, sf_dir):
    out = routing.judged(_reviewed(spark, sf_dir))
    return out.select("doc_id", "action", "review_status")


def gate_routing(spark, sf_dir):
    return routing.gate(_reviewed(spark, sf_dir)).select("doc_id", "route")


def review_counts(spark, sf_dir):
    """Facts of each route; only reasons for review are stored beside the kept ones."""
    return routing.gate(_reviewed(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def _batch(spark, sf_dir):
    """Facts of each user: a batch is an hour of events."""
    relation = F.element_at(F.array(*(F.lit(r) for r in ("IS", "HAS_ROLE", "WORKS_AT", "WORKED_AT", "LEARNING", "USES", "PREFERS", "LIVES_IN", "SWITCHED_TO", "MET"))), (F.col("k") % 10 + 1).cast("int"))
    e = S.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.concat_ws("-", (F.col("user_id") % 50).cast("string"), F.date_format("ts", "yyyyMMdd")).alias("episode_id"), F.col("event_id").cast("int").alias("ordinal"), F.lit("user").alias("subject"),
        relation.alias("relation"), F.concat(F.lit("o"), F.floor(F.col("k") / 25).cast("string")).alias("object"), F.least(F.round(F.col("value") / 100, 6), F.lit(1.0)).alias("confidence"),
        F.when(F.col("event_type") == "view", "llm").otherwise("local").alias("source"),
    )


def merge_candidates(spark, sf_dir):
    return routing.merge(_batch(spark, sf_dir), ["episode_id"]).select("episode_id", "relation", "object", "ordinal", "source", "position")


def prefer_model(spark, sf_dir):
    return routing.prefer_model(_batch(spark, sf_dir)).select("episode_id", "ordinal", "source")


def engagement_collapse(spark, sf_dir):
    return routing.collapse_engagement(_batch(spark, sf_dir), ["episode_id"]).select("episode_id", "relation", "object", "ordinal", F.col("position").cast("long").alias("position"))


def batch_dedupe(spark, sf_dir):
    return routing.dedupe_batch(_batch(spark, sf_dir), ["episode_id"]).select("episode_id", "relation", "object", "ordinal", "position")


def slot_winner_by_position(spark, sf_dir):
    """Of three words the one that a document mentions last."""
    words = F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(w).alias("object")) for k, w in enumerate(("the", "and", "that")))))
    d = S.corpus(spark, sf_dir).select("edge_id", "fact_string", words.alias("w")).select("edge_id", "w.*", T.object_position(F.col("fact_string"), F.col("w.object")).alias("at"))
    best = F.max(F.struct("at", (-F.col("ordinal")).alias("o"), "object"))
    return d.groupBy("edge_id").agg(best.alias("b")).select("edge_id", F.col("b.object").alias("object"), F.col("b.at").alias("place"))


def grounding_check(spark, sf_dir):
    c = S.episodes(spark, sf_dir)
    span = F.when(F.col("pos") % 3 == 0, F.lit("  ")).when(F.col("pos") % 3 == 1, F.substring("content", 3, 12)).otherwise(F.lit("nowhere said"))
    return c.select("user_id", "pos", routing.grounded(span, F.col("content")).alias("grounded"))


def infer_span(spark, sf_dir):
    """The clause around the word from the 20th character."""
    c = S.episodes(spark, sf_dir)
    obj = F.coalesce(F.get(T.words(F.col("content")), 3), F.lit(""))
    return c.select("user_id", "pos", F.md5(routing.inferred_span(F.col("content"), F.lit(""), F.regexp_replace(obj, "[.,]", ""))).alias("span_md5"))


def sentence_split(spark, sf_dir):
    c = S.episodes(spark, sf_dir).select("user_id", "pos", F.posexplode(T.sentences(F.col("content"))).alias("n", "sentence"))
    return c.select("user_id", "pos", "n", F.md5("sentence").alias("sentence_md5"))


def _clauses(spark, sf_dir):
    """Thirds of each message as clauses."""
    c = S.episodes(spark, sf_dir).withColumn("third", F.floor(F.length("content") / 3).cast("int"))
    rows = c.select("user_id", "pos", "content", "third", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
    status = T.lookup(F.col("ordinal"), {0: "past", 1: "current", 2: "future"})
    return rows.select("user_id", "pos", F.substring(F.col("content"), F.col("ordinal") * F.col("third") + 1, F.col("third")).alias("text"), status.alias("temporal_status"), (F.col("ordinal") * F.col("third")).alias("start"), ((F.col("ordinal") + 1) * F.col("third")).alias("end"), "ordinal")


def clause_overlap(spark, sf_dir):
    """The status of the span from 25 to 45 hundredths of each message."""
    c = S.episodes(spark, sf_dir)
    n = F.length("content")
    spans = c.select("user_id", "pos", F.substring(F.col("content"), F.floor(n * 25 / 100).cast("int") + 1, F.lit(4)).alias("span"), F.floor(n * 25 / 100).cast("int").alias("start"), F.floor(n * 45 / 100).cast("int").alias("end"))
    return routing.clause_status(spans, _clauses(spark, sf_dir), ["user_id", "pos"]).select("user_id", "pos", "temporal_status")


def clause_containment(spark, sf_dir):
    """Without offsets: the shortest clause that holds the span."""
    c = S.episodes(spark, sf_dir)
    spans = c.select("user_id", "pos", F.substring("content", 2, 3).alias("span"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return routing.clause_status(spans, _clauses(spark, sf_dir), ["user_id", "pos"]).select("user_id", "pos", "temporal_status")


def first_message_episode(spark, sf_dir):
    out = pipeline.first_messages(S.episodes(spark, sf_dir))
    return out.select("user_id", "pos", "role", F.md5("content").alias("content_md5"))


def profile_values(spark, sf_dir):
    rows = [("IS", "an AI engineer"), ("HAS_ROLE", "the head of a very large research group"), ("WORKS_AT", "Deepmind"), ("WORKS_AT", "a company that was sold last year"), ("GOAL_IS", "x" * 201), ("LIVES_IN", "  ")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, relation string, object string")
    return df.select("id", T.profile_value(F.col("relation"), F.col("object")).alias("value"))


def past_tense_signal(spark, sf_dir):
    rows = [("I used to work at Slice before.", "WORKS_AT", "Slice", ""), ("I work at Slice now.", "WORKS_AT", "Slice", ""), ("anything", "WORKED_AT", "Slice", ""), ("I like go", "USES", "go", "past"), ("I was at Stripe then", "LIVED_IN", "Stripe", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, text string, relation string, object string, status string")
    return df.select("id", routing.retraction_signal(F.col("text"), F.col("relation"), F.col("object"), F.col("status"), F.lit(False)).alias("past"))


def exhaustive_signal(spark, sf_dir):
    rows = [("I mainly use Python and Go", True, ""), ("I like Python", True, ""), ("I only use Rust", False, ""), ("anything", False, "uses")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, text string, uses boolean, hint string")
    return df.select("id", routing.category_signal(F.col("text"), F.col("uses"), F.col("hint")).alias("category"))


TECH = ("Python", "Deepmind", "Visual Studio", "htmx", "C++", "Stripe Inc", "café", "a-very-long-tool-name-indeed")


def technology_filter(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(TECH)), "id int, object string")
    return df.select("id", T.is_technology(F.col("object")).alias("technology"))


def lives_in_guard(spark, sf_dir):
    rows = [("LIVES_IN", "Delhi", "I live in Delhi"), ("LIVES_IN", "cats", "I live with cats"), ("LIVES_IN", "Luna house", ""), ("USES", "cats", ""), ("LIVES_IN", "Berlin", "she lives with me in Berlin")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, relation string, object string, span string")
    return df.select("id", routing.lives_in_valid(F.col("relation"), F.col("object"), F.col("span")).alias("valid"), routing.pet_relation(F.col("relation"), F.col("span")).alias("relation"))


SOURCE = (
    ("I am living in Delhi these days.", "BORN_IN", "Delhi"), ("I am living in Delhi these days.", "LIVES_IN", "Delhi"), ("I switched to Deepmind.", "SWITCHED_TO", "Deepmind"), ("I worked at Slice for years", "WORKED_AT", "Slice"),
    ("Slice is where I am", "WORKED_AT", "Slice"), ("I use Python daily", "USES", "Python"), ("I use Python daily", "USES", "Rust"), ("we met in Goa", "MET", "Goa"), ("I lived in old Rome", "LIVED_IN", "Rome"),
)


def source_validation(spark, sf_dir):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(SOURCE)], "id int, text string, relation string, object string")
    return df.select("id", routing.source_valid(F.col("text"), F.col("relation"), F.col("object")).alias("valid"))


def pipeline_scenario(spark, sf_dir):
    """Extraction to facts over three messages with the offline provider."""
    from ..providers import Offline

    rows = [("e1", "u1", "I works at Deepmind. I uses Python."), ("e2", "u2", "I lives in Delhi. Every street there sounds noisy by day. Then I worked at Slice."), ("e3", "u1", "I will play guitar.")]
    episodes = spark.createDataFrame(rows, "episode_id string, user_id string, content string")
    kept, _ = pipeline.storable(pipeline.extract_facts(episodes, Offline()))
    return kept.select("episode_id", "subject", "relation", "object", "temporal_status", "retraction_signal")


QUERIES = {
    f.__name__: f
    for f in (
        canonical_token, alias_key, object_trim, alias_exact, alias_fuzzy, learned_aliases, alias_semantic, entity_types, aliases_told, pending_unknowns, unknown_relation_stats, auto_promote, judge_routing, gate_routing, review_counts,
        merge_candidates, prefer_model, engagement_collapse, batch_dedupe, slot_winner_by_position, grounding_check, infer_span, sentence_split, clause_overlap, clause_containment,
        first_message_episode, profile_values, past_tense_signal, exhaustive_signal, technology_filter, lives_in_guard, source_validation, pipeline_scenario,
    )
}

_PART = "p_name || ' - ' || p_type || ' - ' || p_brand"
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_PHRASE = "(SELECT event_id AS id, ts, value / 100 AS confidence, ([" + ", ".join(f"'{p}'" for p in PHRASES) + "])[CAST(json_extract_string(props, '$.k') AS INT) % 10 + 1] AS phrase FROM events)"
_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_EXACT = "(VALUES " + ", ".join(f"('{p}', '{r}')" for p, r in [*R.ALIASES, *((r.lower().replace("_", " "), r) for r in R.BEHAVIOR if r.lower().replace("_", " ") not in dict(R.ALIASES))]) + ") a(phrase_, relation)"
_BEHAVIOR = "CASE WHEN relation IN (" + ", ".join(f"'{r}'" for r in R.SINGULAR) + ") THEN 'singular' WHEN relation IN (" + ", ".join(f"'{r}'" for r in R.TEMPORAL) + ") THEN 'temporal' ELSE 'multi' END"
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_REVIEWED = (
    "r AS (SELECT doc_id, 'USES' AS relation, CASE WHEN doc_id % 11 = 0 THEN '' ELSE array_to_string("
    + _WORDS.format("regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^[.,;:!?]+|[.,;:!?]+$', '', 'g')")
    + "[1:3], ' ') END AS object, text AS content, CASE WHEN doc_id % 7 = 0 THEN 'absent from the text' ELSE substr(text, 5, 20) END AS span, "
    "CASE WHEN toxic = 1 THEN 0.1 WHEN quality = 0 THEN 0.5 WHEN quality = 1 THEN 0.9 ELSE 0.65 END AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'confirmed' END AS review_status, "
    "CASE WHEN doc_id % 13 = 0 THEN 'future' ELSE 'current' END AS tense FROM documents LEFT JOIN labels USING (doc_id))"
)
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ROUTED = _REVIEWED + f""", t AS (SELECT *, list_filter(regexp_extract_all(lower(object), '[a-z0-9]+'), lambda x: length(x) > 2) AS tokens FROM r
), g AS (SELECT doc_id, CASE WHEN object = '' THEN 'drop' WHEN tense = 'future' THEN 'future_fact_skipped'
    WHEN {_STRIP.format('span')} = '' OR NOT contains(lower({_STRIP.format('content')}), lower({_STRIP.format('span')})) THEN 'ungrounded'
    WHEN confidence < 0.6 THEN 'low_confidence' WHEN review_status = 'pending' THEN 'drop'
    WHEN len(tokens) > 0 AND len(list_filter(tokens, lambda x: contains(lower(content), x))) = 0 THEN 'failed_source_validation' ELSE 'store' END AS route FROM t)"""
_BATCH = """b AS (
  SELECT CAST(user_id % 50 AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS episode_id, CAST(event_id AS INT) AS ordinal, (['IS', 'HAS_ROLE', 'WORKS_AT', 'WORKED_AT', 'LEARNING', 'USES', 'PREFERS', 'LIVES_IN', 'SWITCHED_TO', 'MET'])[k % 10 + 1] AS relation,
    'o' || CAST(k // 25 AS VARCHAR) AS object, least(round(value / 100, 6), 1.0) AS confidence, CASE WHEN event_type = 'view' THEN 'llm' ELSE 'local' END AS source
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
_ENGAGE = "CASE relation " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in R.ENGAGEMENT.items()) + " END"
_CLAUSE = """c AS (SELECT conv_id AS user_id, turn AS pos, text AS content, CAST(length(text) // 3 AS INT) AS third FROM conversations
), k AS (SELECT user_id, pos, content, third, unnest([0, 1, 2]) AS o FROM c), cl AS (SELECT user_id, pos, o, substr(content, o * third + 1, third) AS text, (['past', 'current', 'future'])[o + 1] AS s, o * third AS st, (o + 1) * third AS en FROM k)"""


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows) + f") v({names})"


ORACLE_SQL = {
    "canonical_token": f"SELECT p_partkey AS id, upper(trim(regexp_replace(lower({_PART}), '[^a-z0-9]+', '_', 'g'), '_')) AS token FROM part",
    "alias_key": f"SELECT p_partkey AS id, {_KEY.format(_PART)} AS key FROM part",
    "object_trim": f"SELECT doc_id AS edge_id, array_to_string({_WORDS.format(chr(114) + 'egexp_replace(regexp_replace(text, ' + chr(39) + '^[ ]+|[ ]+$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '^[.,;:!?]+|[.,;:!?]+$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}[1:3], ' ') AS object, CAST(len({_WORDS.format('text')}) AS INT) AS n_words FROM documents",
    "alias_exact": f"SELECT id, relation, {_BEHAVIOR} AS behavior FROM {_PHRASE} p JOIN {_EXACT} ON phrase_ = {_KEY.format('phrase')}",
    "alias_semantic": "WITH q AS (SELECT vec_id, embedding, (['" + "', '".join(R.DESCRIPTIONS) + "'])[vec_id] AS name FROM embeddings WHERE vec_id BETWEEN 1 AND 6), s AS (SELECT e.vec_id AS edge_id, q.vec_id AS k, q.name, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score FROM embeddings e, q) SELECT edge_id, CASE WHEN score >= 0.3 THEN name END AS relation, round(score, 3) AS match_score FROM s QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY score DESC, k) = 1",
    "entity_types": f"WITH o AS ({_values(list(enumerate(OBJECTS)), 'id, object')} UNION ALL SELECT c_custkey + {len(OBJECTS)}, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_name END FROM customer) "
    f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN lower(object) IN {R.NOT_LOCATIONS} OR split_part(lower(object), ' ', 1) IN {R.NOT_LOCATIONS} THEN CASE WHEN lower(object) IN {R.ANIMALS} THEN 'animal' ELSE 'object' END "
    f"WHEN regexp_matches(object, '{R.LOCATION_LIKE}') OR (object <> '' AND NOT contains(object, ' ') AND regexp_matches(object, '^\\p{{Lu}}')) THEN 'location' END AS type FROM o",
    "aliases_told": f"SELECT id, CASE phrase WHEN 'prefer' THEN 'USES' ELSE 'LIKES_MUCH' END AS relation, 'confirmed' AS tier FROM {_PHRASE} WHERE phrase IN ('obsessed with', 'prefer')",
    "pending_unknowns": f"WITH s AS (SELECT phrase, count(*) OVER w AS n, avg(greatest(least(confidence, 1), 0)) OVER w AS m FROM {_PHRASE} WINDOW w AS (PARTITION BY phrase ORDER BY ts, id)) SELECT phrase AS relation, count(*) AS count, round(avg(confidence), 6) AS avg_confidence FROM {_PHRASE} WHERE phrase NOT IN (SELECT phrase FROM s WHERE n >= 60 AND round(m, 9) >= 0.35) GROUP BY phrase",
    "unknown_relation_stats": f"SELECT phrase AS relation, count(*) AS count, round(avg(confidence), 6) AS avg_confidence FROM {_PHRASE} GROUP BY phrase",
    "auto_promote": f"WITH s AS (SELECT phrase AS relation, count(*) OVER w AS count, avg(greatest(least(confidence, 1), 0)) OVER w AS m FROM {_PHRASE} WINDOW w AS (PARTITION BY phrase ORDER BY ts, id)) SELECT relation, count, round(m, 6) AS avg_confidence FROM s WHERE count >= 20 AND round(m, 9) >= 0.1 QUALIFY row_number() OVER (PARTITION BY relation ORDER BY count) = 1",
    "judge_routing": "WITH " + _REVIEWED + " SELECT doc_id, CASE WHEN confidence >= 0.7 THEN 'store' ELSE 'review' END AS action, CASE WHEN confidence < 0.7 AND review_status = 'confirmed' THEN 'pending' ELSE review_status END AS review_status FROM r WHERE confidence >= 0.4",
    "gate_routing": "WITH " + _ROUTED + " SELECT * FROM g",
    "review_counts": "WITH " + _ROUTED + " SELECT route, count(*) AS n, min(doc_id) AS first_doc FROM g GROUP BY route",
    "merge_candidates": "WITH " + _BATCH + " SELECT episode_id, relation, object, ordinal, source, position FROM (SELECT *, min(ordinal) OVER (PARTITION BY episode_id, relation, object) AS position, row_number() OVER (PARTITION BY episode_id, relation, object ORDER BY source = 'llm' DESC, ordinal DESC) AS n FROM b) WHERE n = 1",
    "prefer_model": "WITH " + _BATCH + " SELECT episode_id, ordinal, source FROM b WHERE source = 'llm' OR confidence >= 0.8 OR NOT EXISTS (SELECT 1 FROM b m WHERE m.episode_id = b.episode_id AND m.source = 'llm')",
    "engagement_collapse": "WITH " + _BATCH + f", e AS (SELECT *, {_ENGAGE} AS r FROM b), x AS (SELECT *, min(ordinal) OVER w AS low, row_number() OVER (PARTITION BY episode_id, object, r IS NULL ORDER BY r DESC, ordinal) AS n FROM e WINDOW w AS (PARTITION BY episode_id, object, r IS NULL)) SELECT episode_id, relation, object, ordinal, CAST(CASE WHEN r IS NULL THEN ordinal ELSE low END AS BIGINT) AS position FROM x WHERE r IS NULL OR n = 1",
    "batch_dedupe": "WITH " + _BATCH + f""", f AS (SELECT b.*, bool_or(relation = 'WORKS_AT') OVER (PARTITION BY episode_id) AS has FROM b
), g AS (SELECT *, CASE WHEN relation IN ('IS', 'HAS_ROLE') THEN 'role' WHEN relation = 'WORKS_AT' THEN 'employer' WHEN relation = 'LIVES_IN' THEN 'residence' END AS slot FROM f WHERE relation <> 'SWITCHED_TO' AND NOT (has AND relation = 'WORKED_AT')
), s AS (SELECT *, CASE WHEN slot IS NOT NULL THEN 0 WHEN relation = 'WORKED_AT' THEN 1 ELSE 2 END AS sec FROM g
), k AS (SELECT *, CASE sec WHEN 0 THEN row_number() OVER (PARTITION BY episode_id, slot, sec ORDER BY CASE relation WHEN 'HAS_ROLE' THEN 2 WHEN 'IS' THEN 1 ELSE 0 END DESC, confidence DESC, ordinal DESC) WHEN 1 THEN row_number() OVER (PARTITION BY episode_id, sec, object ORDER BY ordinal) ELSE 1 END AS n,
    sec * 1000000000 + CASE WHEN sec = 0 THEN min(ordinal) OVER (PARTITION BY episode_id, slot, sec) ELSE ordinal END AS place FROM s
), u AS (SELECT *, row_number() OVER (PARTITION BY episode_id, relation, object ORDER BY place) AS m FROM k WHERE n = 1
), e AS (SELECT *, {_ENGAGE} AS r FROM u WHERE m = 1
), x AS (SELECT *, min(place) OVER (PARTITION BY episode_id, object, r IS NULL) AS low, row_number() OVER (PARTITION BY episode_id, object, r IS NULL ORDER BY r DESC, place) AS q FROM e)
SELECT episode_id, relation, object, ordinal, CAST(CASE WHEN r IS NULL THEN place ELSE low END AS BIGINT) AS position FROM x WHERE r IS NULL OR q = 1""",
    "slot_winner_by_position": "WITH w AS (SELECT doc_id AS edge_id, lower(text) AS t, unnest([0, 1, 2]) AS o FROM documents), p AS (SELECT edge_id, o, (['the', 'and', 'that'])[o + 1] AS object, t FROM w), q AS (SELECT edge_id, o, object, CASE WHEN contains(t, object) THEN CAST(length(t) - instr(reverse(t), reverse(object)) - length(object) + 1 AS INT) ELSE -1 END AS place FROM p) SELECT edge_id, object, place FROM q QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY place DESC, o) = 1",
    "grounding_check": "SELECT conv_id AS user_id, turn AS pos, turn % 3 = 1 AND trim(substr(text, 3, 12)) <> '' AND contains(lower(text), lower(trim(substr(text, 3, 12)))) AS grounded FROM conversations",
    "infer_span": f"""WITH c AS (SELECT conv_id AS user_id, turn AS pos, text, lower(text) AS low, regexp_replace(coalesce({_WORDS.format('text')}[4], ''), '[.,]', '', 'g') AS obj FROM conversations
), a AS (SELECT *, instr(low, lower(obj)) - 1 AS i FROM c), b AS (SELECT *, substr(low, 1, i) AS before, instr(substr(low, i + 1), '.') - 1 AS stop FROM a
), s AS (SELECT *, greatest(CASE WHEN contains(before, '.') THEN i - instr(reverse(before), '.') + 1 ELSE 0 END, CASE WHEN contains(before, ',') THEN i - instr(reverse(before), ',') + 1 ELSE 0 END) AS st, CASE WHEN stop < 0 THEN length(text) ELSE i + stop END AS en FROM b)
SELECT user_id, pos, md5(CASE WHEN obj = '' THEN '' ELSE regexp_replace(substr(text, st + 1, en - st), '^\\s+|\\s+$', '', 'g') END) AS span_md5 FROM s""",
    "sentence_split": "WITH s AS (SELECT conv_id AS user_id, turn AS pos, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM conversations) SELECT user_id, pos, CAST(unnest(range(len(l))) AS INT) AS n, md5(unnest(l)) AS sentence_md5 FROM s",
    "clause_overlap": "WITH " + _CLAUSE + ", sp AS (SELECT user_id, pos, length(content) * 25 // 100 AS a, length(content) * 45 // 100 AS b, substr(content, CAST(length(content) * 25 // 100 AS INT) + 1, 4) AS span FROM c), h AS (SELECT sp.*, s, o, least(b, en) - greatest(a, st) AS n, contains(lower(text), lower(trim(span))) AS held, length(text) AS len FROM sp JOIN cl USING (user_id, pos)) SELECT user_id, pos, coalesce(arg_max(s, n * 10 - o) FILTER (n > 0), arg_min(s, len * 10 + o) FILTER (held), 'unspecified') AS temporal_status FROM h GROUP BY ALL",
    "clause_containment": "WITH " + _CLAUSE + ", sp AS (SELECT user_id, pos, substr(content, 2, 3) AS span FROM c) SELECT user_id, pos, coalesce(arg_min(s, length(text) * 10 + o) FILTER (contains(lower(text), lower(trim(span)))), 'unspecified') AS temporal_status FROM sp JOIN cl USING (user_id, pos) GROUP BY ALL",
    "first_message_episode": "SELECT conv_id AS user_id, turn AS pos, role, md5(text) AS content_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
    "profile_values": _values([(0, "AI engineer"), (1, None), (2, "Deepmind"), (3, None), (4, None), (5, None)], "id, value"),
    "past_tense_signal": _values([(0, True), (1, False), (2, True), (3, True), (4, True)], "id, past"),
    "exhaustive_signal": _values([(0, "USES"), (1, None), (2, None), (3, "USES")], "id, category"),
    "technology_filter": _values([(0, True), (1, False), (2, False), (3, True), (4, True), (5, False), (6, False), (7, False)], "id, technology"),
    "lives_in_guard": _values([(0, True, "LIVES_IN"), (1, False, "HAS_PET"), (2, False, "LIVES_IN"), (3, True, "USES"), (4, False, "LIVES_IN")], "id, valid, relation"),
    "source_validation": _values([(0, False), (1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, True), (8, True)], "id, valid"),
    "pipeline_scenario": _values([("e1", "user", "WORKS_AT", "Deepmind", "current", False), ("e1", "user", "USES", "Python", "current", False), ("e2", "user", "LIVES_IN", "Delhi", "current", False), ("e2", "user", "WORKED_AT", "Slice", "past", True)], "episode_id, subject, relation, object, temporal_status, retraction_signal"),
}
