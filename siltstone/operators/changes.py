"""Writes as DataFrames: batches of versions, read-modify-write, compare-and-swap."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.model import IS_TAGGED, SEQ, TAG, TOMBSTONE, UNSET
from siltstone.operators.resolve import lookup
from siltstone.sources.scratch import Written

POSITION = "_position"


def staged(rows: DataFrame, order: Sequence[Column | str], start: int, folder: str | None = None) -> tuple[DataFrame, int, Written]:
    """Rows with seq: start, start + 1, ... in the given order, dense; how many; and the table they lie in.

    Rows are range-partitioned by the order, then by all other columns, and written with their place in
    their partition; what is counted is what was written, so a lost executor can't change a seq.  A row
    for each partition comes to the driver.  The caller removes the table.
    """
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = {c for c in order if isinstance(c, str)}
    rest = [f.name for f in rows.schema.fields if f.name not in named and f.dataType.typeName() not in ("map", "variant")]
    laid = rows.repartitionByRange(width, *order, *rest).sortWithinPartitions(*order, *rest)
    # The id is the partition's number, 33 bits further left, and the row's place in the sorted partition.
    table = Written(laid.withColumn("_place", F.monotonically_increasing_id()), folder)
    counts = {r["part"]: r["count"] for r in table.df.groupBy(F.shiftright("_place", 33).alias("part")).count().collect()}
    before, total = {}, start
    for p in range(max(counts, default=-1) + 1):
        before[p], total = total, total + counts.get(p, 0)
    base = F.split(F.lit(",".join(str(before[p]) for p in sorted(before)) or "0"), ",").cast("array<bigint>")
    seq = F.element_at(base, (F.shiftright("_place", 33) + 1).cast("int")) + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return table.df.withColumn(SEQ, seq).drop("_place"), total - start, table


def number(rows: DataFrame, order: Sequence[Column | str], start: int) -> DataFrame:
    """``staged`` in the shared folder, for use outside a store."""
    return staged(rows, order, start)[0]


def as_versions(rows: DataFrame, keys: Sequence[str], values: Sequence[str], tag: object = UNSET, remove: bool = False) -> DataFrame:
    """Numbered rows as log rows of puts or removes."""
    own = [F.lit(None).cast(rows.schema[v].dataType).alias(v) if remove else F.col(v) for v in values if v in rows.columns or not remove]
    return rows.select(F.lit(tag is not UNSET).alias(IS_TAGGED), F.lit(None if tag is UNSET else tag).cast("string").alias(TAG), *keys, SEQ, F.lit(remove).alias(TOMBSTONE), *own)


def versions(pairs: DataFrame, keys: Sequence[str], values: Sequence[str], start: int, order: Sequence[Column | str], tag: object = UNSET, remove: bool = False) -> DataFrame:
    """Log rows of a batch of puts (or removes): one seq for each row, in order, so a later row of a key wins."""
    return as_versions(number(pairs, order, start), keys, values, tag, remove)


def apply(updater: Callable, keys: Sequence[str], values: Sequence[str]) -> list[Column]:
    """New value columns of an updater f(value) or f(key, value) over Columns.

    Of several key or value columns it gets (and for values returns) a dict by name.
    """
    key = F.col(keys[0]) if len(keys) == 1 else {k: F.col(k) for k in keys}
    value = F.col(values[0]) if len(values) == 1 else {v: F.col(v) for v in values}
    got = updater(key, value) if len(signature(updater).parameters) > 1 else updater(value)
    got = got if isinstance(got, dict) else {values[0]: got}
    return [(got[v] if isinstance(got[v], Column) else F.lit(got[v])) if v in got else F.col(v) for v in values]


def update_multi(log: DataFrame, wanted: DataFrame, keys: Sequence[str], values: Sequence[str], updater: Callable, default: object = UNSET, tag: object = UNSET, seq: int | None = None) -> DataFrame:
    """The pairs an update writes: f(value) where found; the default as it is where missing, or nothing.

    Repeated keys count once.  The number of rows is the number of keys written.
    """
    at = lookup(log, wanted, keys, values, tag, seq)
    new = apply(updater, keys, values)
    if default is UNSET:
        return at.where("found").select(*keys, *(c.cast(at.schema[v].dataType).alias(v) for c, v in zip(new, values, strict=True)))
    given = default if isinstance(default, dict) else dict(zip(values, default if len(values) > 1 else (default,), strict=True))
    return at.select(*keys, *(F.when(F.col("found"), c).otherwise(F.lit(given[v])).cast(at.schema[v].dataType).alias(v) for c, v in zip(new, values, strict=True)))


def get_with_default(log: DataFrame, wanted: DataFrame, keys: Sequence[str], values: Sequence[str], default: object = None, tag: object = UNSET, seq: int | None = None) -> DataFrame:
    """Every wanted key with its value, or the default where missing; a null value stays null."""
    at = lookup(log, wanted, keys, values, tag, seq)
    given = default if isinstance(default, dict) else dict(zip(values, default if len(values) > 1 and default is not None else (default,) * len(values), strict=True))
    return at.select(*keys, *(F.when(F.col("found"), F.col(v)).otherwise(F.lit(given[v])).cast(at.schema[v].dataType).alias(v) for v in values))


def cas_batch(log: DataFrame, swaps: DataFrame, keys: Sequence[str], values: Sequence[str], tag: object = UNSET, seq: int | None = None) -> DataFrame:
    """Of each swap (keys, old_<value>, new_<value>): swapped, and the value afterwards.

    A missing key equals a null old value; a swap that fails leaves the value.
    """
    at = lookup(log, swaps, keys, values, tag, seq).select(*(F.col(k).alias(f"_{k}") for k in keys), *values)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    ok = reduce(lambda a, b: a & b, (F.col(v).eqNullSafe(F.col(f"old_{v}")) for v in values))
    return swaps.join(at, same, "left").withColumn("swapped", ok).select(*keys, "swapped", *(F.when(F.col("swapped"), F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in values))
