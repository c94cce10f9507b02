"""Token counts of a byte-pair vocabulary, in Arrow batches; ``text.token_count`` is the estimate without one."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_count(path: str, pattern: str) -> Callable[[Column], Column]:
    """A function of a text column: its tokens by the ranks in a file, read once a worker; at least 1, as a budget's rows count."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        encode = _encoding(path, pattern).encode_ordinary
        return x.map(lambda t: max(1, len(encode(t or "")))).astype("int64")

    return run
