"""Reads: visibility, latest version, namespaces, ranges, lookups.

Filters on keys, tags and seq stand below the latest-version step, where Catalyst pushes them to the
scan; filters on values and tombstones stand above it, as they would otherwise bring back older
versions.  The step itself is a row_number of 1, which Spark prunes before the shuffle (one row a key
and map task leaves it) and which carries any value type.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.model import IS_TAGGED, SEQ, TAG, TOMBSTONE, UNSET

#: Lookups of at most so many keys become a filter that reaches the scan; more are joined.
INLINE_KEYS = 1000
#: Key tables of at most so many rows and bytes are broadcast to a join.
BROADCAST_KEYS, BROADCAST_BYTES = 200_000, 16 << 20


def namespace(tag: object = UNSET) -> Column:
    """Untagged rows where no tag is given, else the rows of that tag; None is a tag."""
    return ~F.col(IS_TAGGED) if tag is UNSET else F.col(IS_TAGGED) & F.col(TAG).eqNullSafe(F.lit(tag))


def visible(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Versions a snapshot sees: those with a seq below its own."""
    return log if seq is None else log.where(F.col(SEQ) < seq)


def latest(log: DataFrame, keys: Sequence[str], within_tags: bool = True) -> DataFrame:
    """The highest version of each key, tombstones too.

    Correct whatever the order and overlap of the files.  Null keys are one key; equal seqs of one key
    don't occur in a store (in other logs any one of them is taken).
    """
    by = [*([IS_TAGGED, TAG] if within_tags else []), *keys]
    return log.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(SEQ)))).where("_rank = 1").drop("_rank")


def live(resolved: DataFrame) -> DataFrame:
    """Without the keys whose latest version is a tombstone; apply after ``latest`` only."""
    return resolved.where(~F.col(TOMBSTONE))


def _order(row: Sequence[str], bound: Sequence[object], strict_below: bool) -> Column:
    """Null-safe lexicographic comparison of key columns with a bound; nulls stand before all else.

    strict_below: row < bound, else row > bound.
    """
    out, equal = F.lit(False), F.lit(True)
    for name, b in zip(row, bound, strict=True):
        c = F.col(name)
        if b is None:
            less, more = F.lit(False), c.isNotNull()
        else:
            less, more = c.isNull() | (c < F.lit(b)), c > F.lit(b)
        out = out | (equal & (less if strict_below else F.coalesce(more, F.lit(False))))
        equal = equal & c.eqNullSafe(F.lit(b))
    return out


def key_range(keys: Sequence[str], low: object = UNSET, high: object = UNSET) -> Column | None:
    """The rows with low <= key <= high; either bound may be left out, None is a bound, nulls come first."""
    tests = []
    for bound, below in ((low, True), (high, False)):
        if bound is UNSET:
            continue
        values = bound if len(keys) > 1 else (bound,)
        if len(keys) == 1 and values[0] is not None:
            # A plain comparison reaches the scan.
            c = F.col(keys[0])
            tests.append(c >= F.lit(values[0]) if below else c.isNull() | (c <= F.lit(values[0])))
        elif len(keys) > 1 and values[0] is not None:
            c = F.col(keys[0])  # a coarse test of the first column for the scan, then the exact one
            tests.append(c >= F.lit(values[0]) if below else c.isNull() | (c <= F.lit(values[0])))
            tests.append(~_order(keys, values, below))
        else:
            tests.append(~_order(keys, values, below))
    return reduce(lambda a, b: a & b, tests) if tests else None


def scan(log: DataFrame, keys: Sequence[str], low: object = UNSET, high: object = UNSET, tag: object = UNSET, seq: int | None = None, ordered: bool = True) -> DataFrame:
    """Live pairs of a namespace in a key range, ascending by key (nulls first)."""
    rows = visible(log, seq).where(namespace(tag))
    inside = key_range(keys, low, high)
    rows = rows if inside is None else rows.where(inside)
    out = live(latest(rows, keys, within_tags=False)).drop(IS_TAGGED, TAG, SEQ, TOMBSTONE)
    return out.orderBy(*(F.asc_nulls_first(k) for k in keys)) if ordered else out


def matches(keys: Sequence[str], wanted: Sequence[Sequence[object]]) -> Column:
    """Rows whose key is one of a few."""
    if len(keys) == 1:
        plain = [w[0] for w in wanted if w[0] is not None]
        test = F.col(keys[0]).isin(plain) if plain else F.lit(False)
        return test | F.col(keys[0]).isNull() if len(plain) < len(wanted) else test
    each = [reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, w, strict=True))) for w in wanted]
    return reduce(lambda a, b: a | b, each) if each else F.lit(False)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def small(keys: DataFrame, bound: int = BROADCAST_KEYS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has no more rows and bytes than may be broadcast; reads at most one row more."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in keys.columns), F.lit(0))
    n, size = keys.limit(bound + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return n <= bound and size <= most_bytes


def semi(log: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log rows of the wanted keys; broadcast where their number allows, else joined by shuffle."""
    probe = wanted.select(*keys).distinct()
    probe = F.broadcast(probe) if small(probe) else probe
    return log.join(probe, _same(log, probe, keys), "left_semi")


def get_multi(log: DataFrame, wanted: DataFrame, keys: Sequence[str], tag: object = UNSET, seq: int | None = None) -> DataFrame:
    """Live pairs of the wanted keys; repeated keys count once, missing ones don't appear."""
    rows = semi(visible(log, seq).where(namespace(tag)), wanted, keys)
    return live(latest(rows, keys, within_tags=False)).drop(IS_TAGGED, TAG, SEQ, TOMBSTONE)


def lookup(log: DataFrame, wanted: DataFrame, keys: Sequence[str], values: Sequence[str], tag: object = UNSET, seq: int | None = None) -> DataFrame:
    """Each distinct wanted key with ``found`` and its value columns (null where missing).

    Missing, removed and present with a null value stay apart by ``found``.
    """
    probe = wanted.select(*keys).distinct()
    got = get_multi(log, probe, keys, tag, seq).select(*(F.col(k).alias(f"_{k}") for k in keys), *values, F.lit(True).alias("_found"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return probe.join(got, same, "left").select(*keys, F.coalesce("_found", F.lit(False)).alias("found"), *values)


def has_keys(log: DataFrame, wanted: DataFrame, keys: Sequence[str], tag: object = UNSET, seq: int | None = None) -> DataFrame:
    """Each distinct wanted key with ``found``: exact, as of the snapshot; a removed key isn't found."""
    return lookup(log, wanted, keys, [], tag, seq)


def merge(*logs: DataFrame) -> DataFrame:
    """All versions of several sources."""
    return reduce(lambda a, b: a.unionByName(b), logs)
