"""Bloom filters over key columns, built and probed by native expressions.

m = floor(-n ln p / (ln 2)^2) bits and k = round(m / n ln 2) probes at (h1 + i h2) mod m.  A filter is a
set of 64-bit words (group, word, bits), the bits of a word united by bit_or with map-side combining, so
building is one shuffle of at most m / 64 rows a group and task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_for(n: int, fpp: float) -> tuple[int, int]:
    """Bits and probes for n members at a false-positive rate."""
    bits = max(1, math.floor(-max(n, 1) * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def positions(keys: Sequence[str], bits: int, probes: int) -> Column:
    """The distinct bits of a key; null keys have bits too."""
    one = F.xxhash64(*(F.col(k) for k in keys), F.lit(1))
    two = F.xxhash64(*(F.col(k) for k in keys), F.lit(2))
    each = F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.pmod(F.pmod(one, F.lit(bits)) + i * F.pmod(two, F.lit(bits)), F.lit(bits)))
    return F.array_distinct(each)


def build(rows: DataFrame, keys: Sequence[str], bits: int, probes: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., word, bits): the filter of each group of rows."""
    p = F.col("_p")
    at = rows.select(*by, F.explode(positions(keys, bits, probes)).alias("_p"))
    return at.groupBy(*by, F.shiftright(p, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(p, F.lit(64)).cast("int"))).alias("bits"))


def members(bloom: DataFrame, probes_df: DataFrame, keys: Sequence[str], bits: int, probes: int, by: Sequence[str] = ()) -> DataFrame:
    """The probe rows (with the group's columns) that a filter may contain: none that it does is left out."""
    want = probes_df.select(*keys, F.explode(positions(keys, bits, probes)).alias("_p"))
    need = probes_df.select(*keys, F.size(positions(keys, bits, probes)).alias("_need"))
    hit = want.withColumn("word", F.shiftright("_p", 6)).join(bloom, "word").where(F.call_function("getbit", F.col("bits"), F.pmod("_p", F.lit(64)).cast("int")) == 1)
    n = hit.groupBy(*by, *keys).agg(F.count_distinct("_p").alias("_n"))
    same = [n[k].eqNullSafe(need[k]) for k in keys]
    return n.join(need.distinct(), same).where("_n = _need").select(*(n[c] for c in (*by, *keys)))
