"""Models as hooks. The defaults need no network and always give the same results."""

from __future__ import annotations

import json
import math
import re
import zlib
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import refdata as R


class Provider(Protocol):
    """extract_structured gives facts (subject, relation, object, confidence, source_span, temporal_status, retraction_signal),
    of which only relation and object are needed; retract_category in any of them names a category listed in full."""

    def embed(self, text: str) -> list[float]: ...
    def extract(self, text: str) -> list[dict]: ...
    def extract_structured(self, text: str, candidates: list[dict]) -> list[dict]: ...
    def classify(self, sentence: str) -> str: ...
    def same_fact(self, new: str, old: str) -> bool: ...
    def pick_relation(self, phrase: str) -> str | None: ...


@dataclass
class Offline:
    """Hashed bags of words, phrases of the ontology, and tense by plain words."""

    width: int = 768
    phrases: list[tuple[str, str]] = field(default_factory=lambda: sorted(R.ALIASES, key=lambda a: -len(a[0])))

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.width
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % self.width] += 1.0 if h >> 31 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def extract(self, text: str) -> list[dict]:
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            for phrase, _ in self.phrases:
                if m := re.search(rf"\b(I|[A-Z][a-z]+)\s+{re.escape(phrase)}\s+([A-Za-z0-9+#]+(?:\s[A-Z][a-z]+)*)", sentence):
                    out.append({"head": m[1], "label": phrase, "tail": m[2], "head_confidence": 0.9, "tail_confidence": 0.9, "span": m[0]})
                    break
        return out

    def extract_structured(self, text: str, candidates: list[dict]) -> list[dict]:
        return []

    def classify(self, sentence: str) -> str:
        low = sentence.lower()
        status = "PAST" if re.search(r"\b(used to|worked|lived|was|were|previously|had)\b", low) else "FUTURE" if re.search(r"\b(will|going to|plan to)\b", low) else "CURRENT"
        return json.dumps([{"clause": sentence, "status": status}])

    def same_fact(self, new: str, old: str) -> bool:
        return False

    def pick_relation(self, phrase: str) -> str | None:
        return None


def embedded(df: DataFrame, provider: Provider, text: str, out: str = "vector") -> DataFrame:
    """Each distinct text is embedded once a batch; blank texts get a zero vector."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        known = {t: provider.embed(t or "") for t in x.unique()}
        return x.map(known)

    return df.withColumn(out, run(F.coalesce(F.col(text), F.lit(""))))


CANDIDATES = "array<struct<head:string,label:string,tail:string,head_confidence:double,tail_confidence:double,span:string>>"


def extracted(df: DataFrame, provider: Provider, text: str = "content", out: str = "candidates") -> DataFrame:
    @F.pandas_udf(CANDIDATES)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: provider.extract(t or ""))

    return df.withColumn(out, run(F.col(text)))


STRUCTURED = "array<struct<subject:string,relation:string,object:string,confidence:double,source_span:string,temporal_status:string,retraction_signal:boolean,retract_category:string>>"
_FIELDS = {k.split(":")[0]: None for k in STRUCTURED[13:-2].split(",")}


def structured(df: DataFrame, provider: Provider, needed: Column, text: str = "content", candidates: str = "candidates", out: str = "structured") -> DataFrame:
    """The model's facts of the rows that need them; others have none, and the model isn't called for them."""

    @F.pandas_udf(STRUCTURED)
    def run(x: pd.Series, c: pd.Series, need: pd.Series) -> pd.Series:
        ask = lambda t, own: [{k: f.get(k) for k in _FIELDS} for f in provider.extract_structured(t, [dict(o) for o in own])]
        return pd.Series([ask(t, own) if n else [] for t, own, n in zip(x, c, need, strict=True)], dtype=object)

    return df.withColumn(out, run(F.col(text), F.col(candidates), F.coalesce(needed, F.lit(False))))


def picked(phrase: Column, provider: Provider) -> Column:
    """The model's choice among the described relations; null if it has none."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        each = ((provider.pick_relation(p) or "").upper() for p in x)
        return pd.Series([r if r in R.DESCRIPTIONS else None for r in each], dtype=object)

    return run(phrase)


def classified(sentence: Column, provider: Provider) -> Column:
    """The classifier's raw answer."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: provider.classify(s or ""))

    return run(sentence)
