"""Sequential resolution: each fact sees the edges that facts before it left.

Facts are folded a user at a time in the order of storing. Fact strings are compared by a provider's embeddings: a near
duplicate of an open edge of its relation is skipped, one less near closes that edge. Two deviations from the original:
closing an edge that the same batch inserted closes the stored row, and a fact stored as retracted is no duplicate of
later ones.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import refdata as R
from ..functions import text as T
from ..providers import Offline, Provider

RESULT = "edge_id string, user_id string, relation string, object string, valid_at timestamp_ntz, invalid_at timestamp_ntz, retracted_at timestamp_ntz"


def _key(x: str) -> str:
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip()


def should_close(fr: str, fo: str, er: str, eo: str) -> bool:
    """conflict.invalidates without similarity, on keys of objects."""
    if fr == er and fo == eo:
        return False
    slot = R.SLOTS.get(fr)
    if slot and slot == R.SLOTS.get(er) and fo != eo:
        return True
    if fr in R.CURRENT_EMPLOYMENT and (er in R.PAST_EMPLOYMENT or er in R.TRANSITIONS or (er == "WORKS_AT" and fo != eo)):
        return True
    same_family = R.FAMILIES.get(fr) is not None and R.FAMILIES.get(fr) == R.FAMILIES.get(er)
    return fo == eo and (er in R.SUPERSEDES.get(fr, ()) or (fr != er and same_family))


def similarities(provider: Provider):
    """A function of a fact string and others: their cosines. Each distinct string is embedded once."""
    known: dict[str, np.ndarray] = {}

    def unit(x: str) -> np.ndarray:
        if x not in known:
            v = np.asarray(provider.embed(x), float)
            known[x] = v / (np.linalg.norm(v) or 1.0)
        return known[x]

    def compare(new: str, old: list[str]) -> list[float]:
        mine = unit(new)
        return [float(mine @ v) if v.shape == mine.shape else 0.0 for v in map(unit, old)]

    return compare


#: Relations whose edges a new fact may close, whatever their objects.
RIVALS = {
    r: tuple(dict.fromkeys([*(o for o, slot in R.SLOTS.items() if slot == R.SLOTS.get(r)), *((*R.PAST_EMPLOYMENT, *R.TRANSITIONS, "WORKS_AT") if r in R.CURRENT_EMPLOYMENT else ())]))
    for r in (*R.SLOTS, *R.CURRENT_EMPLOYMENT)
}


class OpenEdges:
    """A user's open edges, found by relation and by key, so that a fact meets those it may concern."""

    def __init__(self):
        self.by_relation: dict[str, dict[int, dict]] = defaultdict(dict)
        self.by_key: dict[str, dict[int, dict]] = defaultdict(dict)

    def add(self, e: dict) -> None:
        self.by_relation[e["relation"]][id(e)] = self.by_key[e["key"]][id(e)] = e

    def drop(self, e: dict) -> None:
        del self.by_relation[e["relation"]][id(e)], self.by_key[e["key"]][id(e)]

    def of(self, relation: str) -> list[dict]:
        return list(self.by_relation[relation].values()) if relation in self.by_relation else []

    def with_key(self, key: str) -> list[dict]:
        return list(self.by_key[key].values()) if key in self.by_key else []


def fold(facts: list[dict], provider: Provider | None = None) -> list[dict]:
    """Edges of one user's facts (edge_id, relation, object, valid_at, retraction, fact_string), in order of storing.

    Without a provider only relations and objects decide. Rows marked as stored are edges from before; an episode's
    retract_category closes the open edges of that category (USES alone) which the episode's facts do not name.
    """
    stored: list[dict] = []
    current = OpenEdges()
    compare = provider and similarities(provider)

    def close(e: dict, at: pd.Timestamp) -> None:
        e["invalid_at"], e["retracted_at"] = max(at, e["valid_at"] + pd.Timedelta(milliseconds=1)), at
        current.drop(e)

    def store(f: dict) -> None:
        rel, obj, said = f["relation"].upper(), _key(f["object"]), f.get("fact_string")
        if f.get("stored"):
            ends = {c: None if pd.isna(f[c]) else f[c] for c in ("invalid_at", "retracted_at")}
            stored.append({"edge_id": f["edge_id"], "user_id": f["user_id"], "relation": rel, "object": f["object"], "key": obj, "said": said, "valid_at": f["valid_at"], **ends})
            if ends["invalid_at"] is None:
                current.add(stored[-1])
            return
        if not f["retraction"]:
            if rel in R.PAST_EMPLOYMENT and current.of("WORKS_AT"):
                return
            slot, same = R.SLOTS.get(rel), current.with_key(obj)
            if any(e["relation"] == rel or (slot and R.SLOTS.get(e["relation"]) == slot) for e in same):
                return
            alike = current.of(rel) if compare else []
            near = compare(said, [e["said"] for e in alike]) if alike else []
            if any(s > R.DEDUP_THRESHOLD or (s >= R.DEDUP_MODEL_THRESHOLD and provider.same_fact(said, e["said"])) for e, s in zip(alike, near, strict=True)):
                return
            conflicting = [e for e, s in zip(alike, near, strict=True) if s >= R.CONFLICT_THRESHOLD and e["key"] != obj]
            rivals = [e for r in RIVALS.get(rel, ()) for e in current.of(r)] + same
            closed = {id(e): e for e in conflicting + [e for e in rivals if should_close(rel, obj, e["relation"], e["key"])]}
            for e in closed.values():
                close(e, f["valid_at"])
        row = {"edge_id": f["edge_id"], "user_id": f["user_id"], "relation": rel, "object": f["object"], "key": obj, "said": said, "valid_at": f["valid_at"], "invalid_at": None, "retracted_at": None}
        if f["retraction"]:
            row["invalid_at"], row["retracted_at"] = f["valid_at"] + pd.Timedelta(milliseconds=1), f["valid_at"]
        else:
            current.add(row)
        stored.append(row)

    for (at, _), batch in groupby(facts, lambda f: (f["valid_at"], f.get("episode_id"))):
        own = list(batch)
        for f in own:
            store(f)
        if any(str(f.get("retract_category")).upper() == "USES" for f in own):
            keep = {f["object"].strip().lower() for f in own if f["relation"].upper() == "USES" and not f["retraction"]}
            for e in current.of("USES"):
                if e["object"].strip().lower() not in keep:
                    close(e, at)
    return stored


def ordered(rows: pd.DataFrame) -> list[dict]:
    """Stored edges, then by batch (time, and the episode if it is told), the priority of the relation, the place in the batch."""
    rows = rows.assign(p=[R.STORE_PRIORITY.get(r.upper(), R.DEFAULT_PRIORITY) for r in rows["relation"]], fresh=~rows["stored"].astype(bool))
    return rows.sort_values(["fresh", "valid_at", "episode_id", "p", "ordinal"], kind="stable").to_dict("records")


def frame(edges: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(edges, columns=["edge_id", "user_id", "relation", "object", "valid_at", "invalid_at", "retracted_at"])
    return out.astype({c: "datetime64[us]" for c in ("valid_at", "invalid_at", "retracted_at")})


def rows(df: DataFrame, old: bool) -> DataFrame:
    """Facts, or stored edges, with the columns that the fold reads."""

    def column(name: str, kind: str):
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

    said = F.col("fact_string") if "fact_string" in df.columns else T.fact_string(F.lit("user"), F.col("relation"), F.col("object"))
    ends = [F.col(c) if old else F.lit(None).cast("timestamp_ntz").alias(c) for c in ("invalid_at", "retracted_at")]
    own = [F.lit(0).cast("long").alias("ordinal"), F.lit(False).alias("retraction")] if old else [F.col("ordinal").cast("long"), F.col("retraction")]
    batch = [F.lit(None).cast("string").alias(c) for c in ("episode_id", "retract_category")] if old else [column(c, "string") for c in ("episode_id", "retract_category")]
    return df.select(F.col("edge_id").cast("string"), F.col("user_id").cast("string"), "relation", "object", "valid_at", *own, said.alias("fact_string"), *batch, F.lit(old).alias("stored"), *ends)


def resolve(facts: DataFrame, provider: Provider | None = Offline(), stored: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """facts: edge_id, user_id, relation, object, valid_at, ordinal, retraction, perhaps fact_string, episode_id and retract_category.

    One shuffle on user_id. Without a fact string the user's own is made of relation and object; without a provider no
    similarity counts. The result holds the stored edges too, closed where facts close them; facts stored before are not stored again.
    """

    def group(own: pd.DataFrame) -> pd.DataFrame:
        return frame(fold(ordered(own), provider))

    every = rows(facts, False)
    if stored is not None:
        again = stored.select(F.col("edge_id").cast("string"), F.col("user_id").cast("string"))
        every = rows(stored, True).unionByName(every.join(again, ["edge_id", "user_id"], "left_anti"))
    return every.groupBy("user_id").applyInPandas(group, RESULT)
