"""Bloom filters of bounded size over 64-bit hashes, built by an aggregation and tested where the rows are.

The filter is a broadcast of at most MAX_BITS bits (32 MiB), whatever the input's size. Beyond
MAX_BITS / 16 keys its false positives rise; those only send more rows on to an exact step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 28
HASHES = 3


def bits_for(keys: int) -> int:
    """A power of two of at least 16 bits a key, within 2**16 and MAX_BITS."""
    return min(MAX_BITS, 1 << max(16, (16 * max(keys, 1) - 1).bit_length()))


def cells(key: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)])


def filter_of(df: DataFrame, key: Column, bits: int, times: int = 1) -> np.ndarray:
    """The cells that at least so many rows set, as packed bits. times=2: the cells of keys that may be repeated."""
    per = df.select(F.explode(cells(key, bits)).alias("cell")).groupBy("cell").count().where(F.col("count") >= times)
    words = per.groupBy(F.expr("cell div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 32 AS int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def may_contain(df: DataFrame, key: Column, packed: np.ndarray) -> Column:
    """Whether all cells of a key are set. False: the key is surely not in the filter."""
    held, bits = df.sparkSession.sparkContext.broadcast(packed), len(packed) * 32

    @F.pandas_udf("boolean")
    def test(*hashes):
        ok = np.ones(len(hashes[0]), bool)
        for h in hashes:
            at = h.to_numpy().astype(np.int64)
            ok &= (held.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0
        return pd.Series(ok)

    return test(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)])
