"""Operators on small tables: examples, invariants, and the fold against a plain model."""

import datetime as dt
import difflib
import random
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect import providers as P
from recollect import refdata as R
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import conflict, ontology, profile, resolve, retrieval, routing, temporal
from recollect.plans import pipeline
from recollect.sources import snapshots, store

DAY = dt.datetime(2026, 7, 21, 7, 0)
EDGES = "edge_id string, user_id string, subject string, relation string, object string, valid_at timestamp_ntz, invalid_at timestamp_ntz, retracted_at timestamp_ntz"


def edges(spark, rows):
    return spark.createDataFrame([(i, "u", "user", r, o, DAY + dt.timedelta(minutes=m), None, None) for i, r, o, m in rows], EDGES)


RECONCILE = [
    ("role-old", "IS", "backend engineer", 0), ("role-new", "HAS_ROLE", "ai engineer", 5), ("past-job", "WORKED_AT", "Slice", 6), ("current-job", "WORKS_AT", "Deepmind", 7),
    ("switch", "SWITCHED_FROM", "Slice", 8), ("born", "BORN_IN", "Delhi", 1), ("live", "LIVES_IN", "Delhi", 2),
]


def test_reconcile_example(spark):
    now = DAY + dt.timedelta(days=1)
    out = {r["edge_id"]: r for r in conflict.reconcile(edges(spark, RECONCILE), now).collect()}
    minutes = {k: (r["close_at"] - DAY).seconds // 60 for k, r in out.items()}
    assert minutes == {"role-old": 5, "past-job": 7, "switch": 7, "born": 2}
    after = conflict.reconciled(edges(spark, RECONCILE), now)
    assert {r["edge_id"] for r in temporal.active(after).collect()} == {"role-new", "current-job", "live"}
    assert after.where("invalid_at <= valid_at").isEmpty()
    assert conflict.reconcile(after, now).isEmpty()
    assert after.count() == 7


def test_transition_alone_closes_now(spark):
    out = conflict.reconcile(edges(spark, [("s", "SWITCHED_TO", "Go", 0)]), DAY + dt.timedelta(hours=1)).head()
    assert out["close_at"] == DAY + dt.timedelta(hours=1)


def test_safe_end(spark):
    rows = [(dt.datetime(2026, 7, 21, 7, 30, 39), dt.datetime(2026, 7, 21, 7, 22, 4)), (dt.datetime(2026, 7, 21, 7, 22, 4), dt.datetime(2026, 7, 21, 7, 30, 39))]
    out = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz").select(temporal.safe_end(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r["e"] for r in out] == [dt.datetime(2026, 7, 21, 7, 30, 39, 1000), dt.datetime(2026, 7, 21, 7, 30, 39)]


def test_conflict_examples(spark):
    rows = [
        ("IS", "ai engineer", "HAS_ROLE", "backend engineer", True, False), ("IS", "backend engineer", "HAS_ROLE", "backend engineer", False, True), ("SWITCHED_FROM", "Slice", "WORKED_AT", "Slice", True, False),
        ("LIVES_IN", "Delhi", "BORN_IN", "Delhi", True, False), ("WORKS_AT", "Deepmind", "WORKED_AT", "Slice", True, False), ("USES", "Go", "USES", "Rust", False, False), ("USES", "Go", "USES", "go!", False, True),
    ]
    df = spark.createDataFrame(rows, "fr string, fo string, er string, eo string, closes boolean, duplicate boolean")
    f, e = {"relation": F.col("fr"), "object": F.col("fo")}, {"relation": F.col("er"), "object": F.col("eo")}
    # a redundant phrasing in one slot is a duplicate first: resolution skips it before it looks for conflicts
    got = df.select("closes", "duplicate", conflict.invalidates(f, e).alias("c"), conflict.is_duplicate(f, e).alias("d")).collect()
    assert [(r["c"] and not r["d"], r["d"]) for r in got] == [(r["closes"], r["duplicate"]) for r in got]
    assert all(resolve.should_close(r[0], resolve._key(r[1]), r[2], resolve._key(r[3])) == bool(g["c"]) for r, g in zip(rows, got, strict=True))


def test_each_row_meets_all_before_it(spark):
    rows = [("1", "USES", "Go", 0), ("2", "USES", "Rust", 1), ("3", "USES", "go!", 2), ("4", "HAS_ROLE", "chef", 3), ("6", "IS", "Chef", 4), ("8", "USES", "rust", 5)]
    out = conflict.without_earlier_duplicate(edges(spark, rows))
    assert sorted(r["edge_id"] for r in out.collect()) == ["1", "2", "4"]


def test_similarity_arm(spark):
    df = spark.createDataFrame([("USES", "a", "USES", "b")], "fr string, fo string, er string, eo string")
    f, e = {"relation": F.col("fr"), "object": F.col("fo")}, {"relation": F.col("er"), "object": F.col("eo")}
    assert df.select(conflict.invalidates(f, e, F.lit(0.95)).alias("x"), conflict.invalidates(f, e, F.lit(0.5)).alias("y")).head() == (True, False)


def model(facts):
    """The sequential rules again, by replaying the whole store for each fact."""
    store = []
    for f in facts:
        rel, obj, active = f["relation"], resolve._key(f["object"]), [e for e in store if e["end"] is None]
        if not f["retraction"]:
            if rel == "WORKED_AT" and any(e["rel"] == "WORKS_AT" for e in active):
                continue
            if any(e["obj"] == obj and (e["rel"] == rel or (R.SLOTS.get(rel, 1) == R.SLOTS.get(e["rel"], 2))) for e in active):
                continue
            for e in active:
                slot = R.SLOTS.get(rel, 1) == R.SLOTS.get(e["rel"], 2) and e["obj"] != obj
                job = rel == "WORKS_AT" and e["rel"] in ("WORKED_AT", *R.TRANSITIONS)
                again = e["obj"] == obj and (e["rel"] in R.SUPERSEDES.get(rel, ()) or (e["rel"] != rel and R.FAMILIES.get(rel, 1) == R.FAMILIES.get(e["rel"], 2)))
                if slot or job or again:
                    e["end"] = f["valid_at"]
        store.append({"id": f["edge_id"], "rel": rel, "obj": obj, "end": f["valid_at"] if f["retraction"] else None})
    return [(e["id"], e["end"] is None) for e in store]


@given(st.lists(st.tuples(st.sampled_from(sorted({*R.SLOTS, *R.FAMILIES, "USES"})), st.sampled_from(["a", "B", "b!"]), st.booleans()), max_size=25))
def test_fold_matches_model(rows):
    facts = [{"edge_id": str(k), "user_id": "u", "relation": r, "object": o, "valid_at": pd.Timestamp(DAY) + pd.Timedelta(minutes=k), "retraction": x and k % 3 == 0} for k, (r, o, x) in enumerate(rows)]
    got = resolve.fold([dict(f) for f in facts])
    assert [(e["edge_id"], e["invalid_at"] is None) for e in got] == model(facts)
    assert all(e["invalid_at"] is None or e["invalid_at"] > e["valid_at"] for e in got)


def test_fold_skips_and_closes_by_similarity(spark):
    class Near(P.Offline):
        """Vectors by the last word of a fact string; a and b are near, a and c in the middle band, a and d conflict."""

        def embed(self, text):
            x = {"a": 1.0, "b": 0.96, "c": 0.87, "d": 0.92}.get(text.split()[-1], 0.0)
            return [x, (1 - x * x) ** 0.5]

        def same_fact(self, new, old):
            return (new, old) == ("user uses c", "user uses a")

    cases = [("b", ["a"]), ("c", ["a"]), ("d", ["d"]), ("e", ["a", "e"])]
    rows = [(f"{u}{k}", u, "USES", o, DAY + dt.timedelta(minutes=k), k, False) for u, _ in cases for k, o in enumerate(["a", u])]
    facts = spark.createDataFrame(rows, "edge_id string, user_id string, relation string, object string, valid_at timestamp_ntz, ordinal long, retraction boolean")
    out = resolve.resolve(facts, Near()).collect()
    open_ = {u: sorted(r["object"] for r in out if r["user_id"] == u and r["invalid_at"] is None) for u, _ in cases}
    assert open_ == dict(cases)
    assert [(r["object"], r["invalid_at"]) for r in out if r["user_id"] == "d" and r["invalid_at"]] == [("a", DAY + dt.timedelta(minutes=1))]
    assert sum(r["user_id"] in "bc" for r in out) == 2


def test_resolve_distributed(spark):
    random.seed(5)
    rows = [(str(k), f"u{k % 3}", random.choice(["WORKS_AT", "WORKED_AT", "LIVES_IN", "USES", "IS"]), random.choice("abc"), DAY + dt.timedelta(minutes=k), k, False) for k in range(90)]
    out = resolve.resolve(spark.createDataFrame(rows, "edge_id string, user_id string, relation string, object string, valid_at timestamp_ntz, ordinal long, retraction boolean"))
    got = sorted((r["edge_id"], r["invalid_at"] is None) for r in out.collect())
    names = ["edge_id", "user_id", "relation", "object", "valid_at", "ordinal", "retraction"]
    want = sorted(x for u in range(3) for x in model([dict(zip(names, r, strict=True)) for r in rows if r[1] == f"u{u}"]))
    assert got == want


def test_scalars(spark):
    df = spark.createDataFrame([("  Deepmind as ai engineer, and more!", "WORKS_AT", "I live in Delhi. Not Delhi")], "x string, r string, t string")
    row = df.select(
        T.trim_object(F.col("x")).alias("trim"), T.word_count(F.lit("Deepmind as ai engineer")).alias("n"), T.canonical_token(F.lit(" Works-at!")).alias("token"), T.alias_key(F.lit("!!!")).alias("blank"),
        T.object_position(F.col("t"), F.lit("Delhi now")).alias("at"), T.object_position(F.col("t"), F.lit("Goa")).alias("none"), T.token_count(F.lit("abc")).alias("tokens"),
        T.timestamp(F.lit("2026-07-21T07:30:39Z")).alias("ts"), T.timestamp(F.lit("soon")).alias("bad"), T.subject(F.lit(" My ")).alias("me"), T.subject(F.lit(" Ann ")).alias("ann"),
        T.pair_confidence(F.lit(None).cast("double"), F.lit(0.5)).alias("p"), T.pair_confidence(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("q"),
        T.fact_string(F.lit("user"), F.lit("WORKS_AT"), F.lit("X")).alias("fact"), T.sentences(F.lit("One. Two!  Three? ")).alias("s"),
    ).head()
    assert (row.trim, row.n, row.token, row.blank) == ("Deepmind as ai", 4, "WORKS_AT", "")
    assert (row["at"], row.none, row.tokens, row.ts, row.bad) == (21, -1, 1, dt.datetime(2026, 7, 21, 7, 30, 39), None)
    assert (row.me, row.ann, row.p, row.q, row.fact, row.s) == ("user", "Ann", 0.5, 0.75, "user works at X", ["One.", "Two!", "Three?"])


@given(st.text("abcd e", max_size=12), st.text("abcd e", max_size=12))
def test_ratio(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    want = 2 * grid[-1][-1] / (len(a) + len(b)) if a or b else 1.0
    assert abs(T.ratio(a, b) - want) < 1e-12
    assert T.ratio(a, b) >= difflib.SequenceMatcher(None, a, b).ratio() - 1e-9


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r["c"] for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_normalization_learns(spark):
    known = ontology.aliases(spark)
    phrases = spark.createDataFrame([("works at",), ("works att",), ("obsessed with",), ("!!!",), (None,)], "phrase string")
    out = ontology.normalize(phrases, known)
    tiers = {r["phrase"]: (r["relation"], r["tier"]) for r in out.collect()}
    assert tiers["works at"] == ("WORKS_AT", "confirmed") and tiers["works att"] == ("WORKS_AT", "fuzzy")
    assert tiers["obsessed with"] == ("OBSESSED_WITH", "unknown") and tiers["!!!"][1] == "reject"
    again = ontology.normalize(phrases, ontology.learned(out, known)).where("phrase = 'works att'").head()
    assert again["tier"] == "confirmed"


def test_bm25_small_corpora_are_empty(spark):
    one = spark.createDataFrame([(1, "alpha beta")], "edge_id int, fact_string string")
    assert retrieval.bm25(one, "alpha").isEmpty()
    two = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "edge_id int, fact_string string")
    assert retrieval.bm25(two, "alpha").isEmpty()


def test_fusion_prefers_both(spark):
    a = spark.createDataFrame([(1, 9.0, 0), (2, 8.0, 1)], "edge_id int, score double, rank int")
    b = spark.createDataFrame([(3, 0.9, 0), (2, 0.8, 1)], "edge_id int, score double, rank int")
    out = [(r["edge_id"], r["score"]) for r in retrieval.fuse(a, b).orderBy("position").collect()]
    assert out == [(2, 0.8), (1, 9.0), (3, 0.9)]


def test_batch_dedupe_examples(spark):
    schema = "episode_id int, ordinal int, subject string, relation string, object string, confidence double, content string"
    rows = [
        (1, 0, "user", "WORKS_AT", "Deepmind", 0.9, ""), (1, 1, "user", "WORKED_AT", "Slice", 0.9, ""), (1, 2, "user", "SWITCHED_FROM", "Slice", 0.9, ""),
        (2, 0, "user", "IS", "ai engineer", 0.9, "I was a backend engineer, now an ai engineer"), (2, 1, "user", "HAS_ROLE", "backend engineer", 0.9, "I was a backend engineer, now an ai engineer"),
        (3, 0, "user", "IS", "a", 0.9, ""), (3, 1, "user", "IS", "b", 0.9, ""),
        (4, 0, "user", "INTERESTED_IN", "guitar", 0.9, ""), (4, 1, "user", "LEARNING", "Guitar ", 0.9, ""),
    ]
    out = routing.dedupe_batch(spark.createDataFrame(rows, schema), ["episode_id"], "content")
    assert sorted((r["episode_id"], r["relation"], r["object"]) for r in out.collect()) == [(1, "WORKS_AT", "Deepmind"), (2, "IS", "ai engineer"), (3, "IS", "b"), (4, "LEARNING", "Guitar ")]


def test_profile_sync_keeps_role_but_not_company(spark):
    long = " ".join(["word"] * 8)
    stored = spark.createDataFrame([("u", "role", "engineer", "string", DAY), ("u", "company", "Old", "string", DAY)], "user_id string, key string, value string, value_type string, updated_at timestamp_ntz")
    out = profile.sync(edges(spark, [("a", "IS", long, 0), ("b", "WORKS_AT", long, 1), ("c", "USES", "Python", 2), ("d", "USES", "python", 3), ("e", "USES", "Stripe", 4)]), stored)
    assert {(r["key"], r["value"]) for r in out.collect()} == {("role", "engineer"), ("current_stack", '["python"]')}
    assert profile.decoded(out).where("key = 'current_stack'").head()["list"] == ["python"]


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([("u", "a", 1, DAY), ("u", "b", 1, DAY)], "user string, key string, v int, at timestamp_ntz")
    new = spark.createDataFrame([("u", "a", 2, DAY)], "user string, key string, v int, at timestamp_ntz")
    both = snapshots.upsert(old, new, ["user", "key"], "at")
    assert {(r["key"], r["v"]) for r in both.collect()} == {("a", 2), ("b", 1)}
    root = str(tmp_path / "s")
    snapshots.write_snapshot(old, root)
    snapshots.write_snapshot(snapshots.delete(both, new.select("key")), root)
    snapshots.append(new, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_classifier_answers(spark):
    good, whole = [("x", "PAST")], [("s", "UNSPECIFIED")]
    raw = {'```json\n[{"clause": "x", "status": "PAST"}]\n```': good, '```JSON\n[{"clause": "x", "status": "PAST"}]\n```': good, "no json": whole, "[]": whole, '[{"clause": "x", "status": "MAYBE"}]': whole, "{}": whole, '{"clause": "x", "status": "PAST"}': whole, None: whole}
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", store.parsed_clauses(F.col("raw"), F.lit("s")).alias("c"))
    assert {r["raw"]: [tuple(c) for c in r["c"]] for r in df.collect()} == raw
    p = P.Offline()
    assert p.embed("") == [0.0] * 768 and p.embed("a b") == p.embed("a b")


def test_fuzzy_groups_equal_brute_force(spark, monkeypatch):
    """Small groups of phrases and of keys, with ties, give what comparing all gives."""
    monkeypatch.setattr(ontology, "PHRASES_A_TASK", 7)
    monkeypatch.setattr(ontology, "KEYS_A_TASK", 3)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcd ") for _ in range(r.randint(1, 12)))
    known = [(" ".join(word().split()) or "a", f"R{k}", k) for k in range(60)]
    keys = sorted({" ".join(word().split()) for _ in range(40)} - {""})
    got = ontology.match_fuzzy(spark.createDataFrame([(k,) for k in keys], "phrase string"), spark.createDataFrame(known, "phrase string, relation string, place int"))
    best = lambda k: max((round(T.similarity(k, p), 3), -place, rel) for p, rel, place in known)
    assert {x["key"]: (x["score"], x["relation"]) for x in got.collect()} == {k: (best(k)[0], best(k)[2]) for k in keys}
    none = spark.createDataFrame([], "phrase string, relation string, place int")
    assert ontology.match_fuzzy(spark.createDataFrame([("a",)], "phrase string"), none).head()["score"] == 0.0


def test_near_duplicates_lose_no_pair(spark):
    r = random.Random(5)
    rows = [(k, k % 2, [r.gauss(0, 1) + (k % 5) * c for c in (3, -2, 1, 0)]) for k in range(80)] + [(80, 0, [0.0] * 4), (81, 0, []), (82, 1, None)]
    df = spark.createDataFrame(rows, "edge_id int, user int, vector array<double>")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, _, v in rows if v and any(v)}
    for t in (0.2, 0.9, 0.99):
        want = {(a, b) for a, ua, _ in rows for b, ub, _ in rows if ua == ub and a in unit and b in unit and unit[a] @ unit[b] > t and a != b}
        assert {(x["edge_id"], x["old_id"]) for x in conflict.near_duplicates(df, df, ["user"], t).where("edge_id <> old_id").collect()} == want


def test_bm25_reads_texts_once(spark, monkeypatch):
    r = random.Random(9)
    texts = [r.choice(["  ", " ", "\t\n", "\x0b"]).join(r.choice(["The", "of", "Été", "rare", f"w{r.randrange(60)}", "\u00a0x"]) for _ in range(r.randrange(30))) for _ in range(120)] + [None, "", " "]
    rows = [(k, "ab"[k % 2], t) for k, t in enumerate(texts)]
    monkeypatch.setattr(retrieval, "TERMS", 20)  # vocabularies are handed on in parts
    df = spark.createDataFrame(rows, "edge_id long, tenant string, fact_string string").repartition(3)
    found = retrieval.bm25(df, "the rare été rare none", ["tenant"], 7)
    assert "fact_string" not in found._jdf.queryExecution().toString()
    want = {}
    for tenant in "ab":
        docs = {k: t.lower().encode().split() for k, x, t in rows if x == tenant and t is not None}
        n, mean = len(docs), np.mean([len(w) for w in docs.values()])
        df_of = {t: sum(t in w for w in docs.values()) for t in {t for w in docs.values() for t in w}}
        idf = {t: np.log(n - c + 0.5) - np.log(c + 0.5) for t, c in df_of.items()}
        own = {t: v if v >= 0 else R.BM25_EPSILON * np.mean([*idf.values()]) for t, v in idf.items()}
        score = {k: sum(m * own[t] * w.count(t) * (R.BM25_K1 + 1) / (w.count(t) + R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * len(w) / mean)) for t, m in ((b"the", 1), (b"rare", 2), ("été".encode(), 1)) if t in w) for k, w in docs.items()}
        best = sorted(((-round(x, 9), k) for k, x in score.items() if round(x, 9) > 0))[:7]
        want |= {(tenant, i): (k, -x) for i, (x, k) in enumerate(best)}
    got = {(x["tenant"], x["rank"]): (x["edge_id"], x["score"]) for x in found.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


def test_keyword_scan_in_slices(spark, monkeypatch):
    """Slices of few texts, parted at once, give the counts of a plain split: blank texts, null ones and null tenants too."""
    monkeypatch.setattr(retrieval, "ROWS", 5)
    monkeypatch.setattr(retrieval, "TERMS", 30)
    r = random.Random(4)
    texts = [r.choice(["", " ", "\n\x0b"]) + r.choice(["  ", " ", "\t\r", "\x0c"]).join(r.choice(["the", "été", "rare", f"w{r.randrange(40)}", "\u2003y", "\x1cz"]) for _ in range(r.randrange(20))) + r.choice(["", " "]) for _ in range(90)] + [None, "", " \t "]
    rows = [(k, r.choice(["a", "b", None]), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "edge_id long, tenant string, lower string").repartition(3)
    found = retrieval.scanned(df, ["tenant"], {"rare": 1, "none": 1, "été": 2}).collect()
    held = {x["edge_id"]: (x["tenant"], x["length"], x["f0"], x["f1"], x["f2"]) for x in found if x["term"] is None}
    df_of, heads = Counter(), {}
    for x in found:
        if x["term"]:
            df_of[x["tenant"], x["term"]] += x["df"]
        elif x["term"] == "":
            n, total = heads.get(x["tenant"], (0, 0))
            heads[x["tenant"]] = (n + x["df"], total + x["length"])
    plain = [(k, x, [w.decode() for w in t.encode().split()]) for k, x, t in rows if t is not None]
    assert held == {k: (x, len(w), w.count("rare"), 0, w.count("été")) for k, x, w in plain if {"rare", "été"} & set(w)}
    assert df_of == Counter((x, t) for _, x, w in plain for t in set(w))
    assert heads == {y: (sum(x == y for _, x, _ in plain), sum(len(w) for _, x, w in plain if x == y)) for y in ("a", "b", None)}


def test_near_duplicates_of_large_groups_by_strips(spark, monkeypatch):
    r = np.random.default_rng(3)
    n = 9000
    v = r.normal(size=(n, 8))
    v[100:140] = v[7]  # copies
    key = np.where(np.arange(n) < 8990, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"edge_id": np.arange(n), "user": key, "vector": list(v)}), "edge_id long, user string, vector array<double>")
    df = df.unionByName(spark.createDataFrame([(n, "a", [1.0, 2.0]), (n + 1, "a", [1.0, 2.5]), (n + 2, None, [1.0] * 8), (n + 3, "a", [1.0, None])], df.schema))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    a, b = np.nonzero(np.tril((unit @ unit.T > 0.97) & (key[:, None] == key), -1))
    want = {*zip(a.tolist(), b.tolist(), strict=True), (n + 1, n)}
    monkeypatch.setattr(conflict, "STRIP", 2048)
    plan = conflict.near_duplicates(df, df, ["user"], 0.97, earlier=True)
    got = [(x["edge_id"], x["old_id"]) for x in plan.collect()]
    assert len(got) == len(want) and set(got) == want
    assert sorted(x["edge_id"] for x in conflict.with_near(df, df, ["user"], 0.97, earlier=True).collect()) == sorted({x for x, _ in want})
    assert "CartesianProduct" not in (text := plan._jdf.queryExecution().toString()) and "SortMergeJoin" not in text and "FlatMapCoGroupsInArrow" in text  # no pair is made as a row and dropped


def test_turns_are_stored_and_followed(spark, tmp_path):
    root, schema = str(tmp_path), "user_id string, session_id string, pos int, role string, content string, created_at timestamp_ntz, metadata string"
    for day, place in enumerate(("Delhi", "Paris")):
        rows = [("u", f"s{day}", 0, "user", f"I live in {place}.", DAY, None), ("u", f"s{day}", 1, "assistant", "I live in Rome.", DAY, None)]
        edges, review = pipeline.ingest_turn(spark.createDataFrame(rows, schema), root, P.Offline(), DAY + dt.timedelta(days=day))
    assert {r["object"]: r["invalid_at"] for r in edges.collect()} == {"Delhi": DAY + dt.timedelta(days=1), "Paris": None}
    assert review.isEmpty() and spark.read.parquet(f"{root}/episodes").count() == 4
    assert snapshots.read_snapshot(spark, f"{root}/profiles").where("key = 'location'").head()["value"] == "Paris"


def test_blank_queries_and_filters(spark):
    at = lambda k: DAY + dt.timedelta(hours=k)
    rows = [(k, "u" if k < 5 else "v", "USES", f"fact alpha {k}", 1.0, "confirmed", at(k), at(9) if k == 1 else None, at(9) if k in (1, 2) else None, "e", [1.0, float(k)]) for k in range(8)]
    schema = "edge_id int, user_id string, relation string, fact_string string, confidence double, review_status string, valid_at timestamp_ntz, invalid_at timestamp_ntz, retracted_at timestamp_ntz, episode_id string, vector array<double>"
    e = spark.createDataFrame(rows, schema)
    assert [r["edge_id"] for r in retrieval.hybrid(e, e, " ", [], user="u").orderBy("position").collect()] == [4, 3, 0]
    assert retrieval.bm25(e, " ").isEmpty() and retrieval.search(e, e, " ", [1.0, 1.0], True).isEmpty()
    assert {r["edge_id"] for r in retrieval.search(e, e, "x", [1.0, 1.0], True, user="u").collect()} == {0, 3, 4}
    assert {r["edge_id"] for r in retrieval.hybrid(e, e, "alpha", [1.0, 1.0], user="v").collect()} == {5, 6, 7}


def test_ingest_calls_models_and_closes_what_a_list_leaves_out(spark):
    class Model(P.Offline):
        def extract_structured(self, text, candidates):
            return [{"relation": "is paid by", "object": "Slice", "source_span": text}, {"relation": "bills hours through", "object": "Slice"}, {"relation": "zzz", "object": "Slice"}] if "Slice" in text else []

        def embed(self, text):
            return [1.0, 0.0] if text in ("is paid by", R.DESCRIPTIONS["WORKS_AT"]) else [0.0, 1.0] if text == R.DESCRIPTIONS["USES"] else [0.0, 0.0]

        def pick_relation(self, phrase):
            return {"bills hours through": "works_at", "zzz": "NO_SUCH"}.get(phrase)

    frame = lambda *rows: spark.createDataFrame(rows, "episode_id string, user_id string, content string")
    facts = pipeline.extract_facts(frame(("e1", "u", "Slice pays for it all"), ("e2", "u", "Nothing here")), Model())
    assert [(r["relation"], r["object"], r["source"]) for r in facts.collect()] == [("WORKS_AT", "Slice", "llm")]
    phrases = spark.createDataFrame([("is paid by",), ("bills hours through",), ("zzz",), ("uses",)], "phrase string")
    named = ontology.by_meaning(ontology.normalize(phrases, ontology.aliases(spark)), Model())
    assert {r["phrase"]: r["relation"] for r in named.where("tier = 'confirmed'").collect()} == {"is paid by": "WORKS_AT", "bills hours through": "WORKS_AT", "uses": "USES"}
    first, _, _ = pipeline.ingest(frame(("a", "u", "I uses Python."), ("b", "v", "I uses Go.")), P.Offline(), DAY)
    second, _, _ = pipeline.ingest(frame(("c", "u", "I only use Rust. I uses Rust.")), P.Offline(), DAY + dt.timedelta(days=1), first)
    got = {(r["user_id"], r["object"]): r["invalid_at"] for r in second.collect()}
    assert got == {("u", "Python"): DAY + dt.timedelta(days=1), ("u", "Rust"): None, ("v", "Go"): None}


def test_stream_restart_stores_once(spark, tmp_path):
    from recollect.streaming import ingest

    rows = [(str(k), f"u{k % 4}", "LIVES_IN", "ab"[k % 2], DAY + dt.timedelta(minutes=k), k, False) for k in range(40)]
    facts = spark.createDataFrame(rows, ingest.FACTS)
    at = {k: str(tmp_path / k) for k in ("in", "out", "checkpoint")}
    facts.where("ordinal < 20").coalesce(1).write.parquet(at["in"])
    run = lambda: ingest.ingest_stream(ingest.fact_stream(spark, at["in"], 1), at["out"], at["checkpoint"]).awaitTermination()
    run()
    facts.where("ordinal >= 20").coalesce(1).write.mode("append").parquet(at["in"])
    run()
    run()
    got = ingest.current_edges(spark, at["out"]).select("edge_id", "invalid_at").orderBy("edge_id").collect()
    assert got == resolve.resolve(facts).select("edge_id", "invalid_at").orderBy("edge_id").collect()


def test_byte_pair_counts_fill_the_budget(spark):
    import public_tokenizers
    import tiktoken

    from recollect.functions import tokens

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(k, t) for k, t in enumerate(["I work at Slice.", "", None, "naïve 😀 words", "x" * 50])]
    df = spark.createDataFrame(rows, "position int, fact string")
    count = tokens.bpe_count(path, public_tokenizers.PATTERN)
    encoding = tokens._encoding(path, public_tokenizers.PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    want = [max(1, len(encoding.encode_ordinary(t or ""))) for _, t in rows]
    got = retrieval.fit_budget(df, sum(want[:4]), count=count).orderBy("position").collect()
    assert [r["tokens"] for r in got] == want[:4]
