"""The default embedding provider: token hashing. A model can take its place: any Column of ARRAY<FLOAT>."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import tokens

DIMS = 64
_MOST_KNOWN = 500_000


def hashed(text: Column, dims: int = DIMS) -> Column:
    """Unit vector of token counts by bucket; zeros for null or blank text. The bucket is the number of the first eight hex digits of the token's MD5, modulo dims.

    Tokens are cut on the JVM and counted in Arrow batches: the work grows with the tokens, not with the dimensions.
    """

    def count(lists: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
        flat = np.empty(int(sizes.sum()), np.int64)
        i = 0
        for x in lists:
            for t in () if x is None else x:
                b = known.get(t)
                if b is None:
                    if len(known) > _MOST_KNOWN:
                        known.clear()
                    b = known[t] = int(hashlib.md5(t.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()[:8], 16) % dims
                flat[i] = b
                i += 1
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dims + flat, minlength=len(sizes) * dims).reshape(len(sizes), dims).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
        return pd.Series(list((counts / np.where(norm > 0, norm, 1)).astype(np.float32)), index=lists.index, dtype=object)

    return F.pandas_udf(count, "array<float>")(tokens(F.lower(F.coalesce(text, F.lit("")))))
