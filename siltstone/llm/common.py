"""What the operators of this subpackage share: tables, the shared folder, ordered partitions."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Rows a partition of an ordered layout holds, on average, up to so many partitions.
ROWS_PER_PARTITION, MOST_PARTITIONS = 8192, 100_000
#: Rows sampled for each bound between partitions, and at most in all.
SAMPLE_PER_BOUND, MOST_SAMPLED = 64, 500_000
#: Leading bytes of the column that tells rows of one key apart.
TIE_BYTES = 24
_LEAST = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``, read by Spark (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster that raises ValueError, as
    a folder of one machine isn't seen by the others.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
        found = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing yet to be computed reads."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            df._written_to = None


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or absolute path."""
    return pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def write_whole(uri: str, chunks: Iterator[bytes]) -> None:
    """Write a file under a name of its own, then move it in place: a repeated task leaves one whole file."""
    fs, path = open_fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        for x in chunks:
            out.write(x)
    fs.move(part, path)


def partitions_for(spark: SparkSession, rows: int) -> int:
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION)), MOST_PARTITIONS)


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def keyed_join(rows: DataFrame, per_key: DataFrame, on: list[str], total: int, size: str = "size") -> DataFrame:
    """``rows`` joined with a table of one row a key, which tells in ``size`` how many rows its key has.

    Keys with more than a thousandth of ``total`` (at least the number of rows), of which there can't be
    more than a thousand, are broadcast, so that their rows stay where they are; all others are joined
    by shuffle.  Keys aren't null.
    """
    limit = total / 1000
    hot = F.broadcast(per_key.where(F.col(size) > limit).withColumn("_hot", F.lit(True)))
    told = rows.join(hot, on, "left")
    cold = told.where("_hot IS NULL").select(*rows.columns).join(per_key.where(F.col(size) <= limit), on)
    return told.where("_hot").select(*cold.columns).unionByName(cold)


def _sort_key(key: str, rest: str) -> Column:
    """Bytes in the order of (key, nulls first; the leading bytes of ``rest``)."""
    k = F.col(key).cast("bigint")
    number = F.concat(F.lit(bytearray(b"\1")), F.unhex(F.lpad(F.hex(k.bitwiseXOR(F.lit(_LEAST))), 16, "0")))
    return F.concat(F.coalesce(number, F.lit(bytearray(9))), F.coalesce(F.substring(F.col(rest).cast("binary"), 1, TIE_BYTES), F.lit(bytearray())))


def ordered(df: DataFrame, key: str, rest: str) -> DataFrame:
    """``key`` and ``rest`` in ascending order over partitions: partition i holds smaller rows than i+1, sorted.

    The bounds are quantiles that Spark samples.  Rows of one key (or with a null key, which come first) are
    ordered by ``rest``, text or binary, and spread over partitions by its leading bytes.
    """
    n = partitions_for(df.sparkSession, df.count())
    tie = F.substring(F.col(rest).cast("binary"), 1, TIE_BYTES)
    return df.select(key, rest).repartitionByRange(n, F.col(key).asc_nulls_first(), tie.asc_nulls_first()).sortWithinPartitions(key, rest)


def ordered_with_next(df: DataFrame, key: str, rest: str) -> DataFrame:
    """As ``ordered``, and each partition also gets, flagged ``_extra`` and last, the first row of the next
    one that has any (the last one gets the first of all), so that a scan sees every row's successor.

    The bounds are quantiles of a sample of bounded size; a second job over the keys finds what comes first
    in each partition (a row each comes to the driver, at most ``MOST_PARTITIONS``).  A first row that is repeated
    is sent as often.
    """
    spark, rows = df.sparkSession, df.count()
    n = partitions_for(spark, rows)
    part = min(1.0, min(SAMPLE_PER_BOUND * n, MOST_SAMPLED) / max(rows, 1))
    keys = df.select(_sort_key(key, rest).alias("_key"))
    sampled = keys.sample(part, seed=1) if part < 1 else keys
    width = 9 + TIE_BYTES
    seen = np.sort(np.array([r[0] for r in sampled.toArrow().to_pandas().itertuples(index=False)], f"S{width}"))
    bounds = seen[np.arange(1, n) * len(seen) // n] if len(seen) else seen

    @F.pandas_udf("int")
    def place(own: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, own.to_numpy().astype(f"S{width}"), "right").astype(np.int32))

    firsts = sorted((r["_part"], bytes(r["first"])) for r in keys.select(place("_key").alias("_part"), "_key").groupBy("_part").agg(F.min("_key").alias("first")).collect())
    before = [p for p, _ in firsts[-1:] + firsts[:-1]]
    listed = [(p, bytearray(k), b) for (p, k), b in zip(firsts, before, strict=True)]
    told = spark.createDataFrame(listed, "_part int, _key binary, _before int")
    out = df.select(key, rest, _sort_key(key, rest).alias("_key")).withColumn("_part", place("_key")).join(F.broadcast(told), ["_part", "_key"], "left")
    own = F.struct(F.col("_part").alias("p"), F.lit(False).alias("e"))
    to = F.struct(F.col("_before").alias("p"), F.lit(True).alias("e"))
    out = out.select(key, rest, F.explode(F.when(F.col("_before").isNotNull(), F.array(own, to)).otherwise(F.array(own))).alias("_to"))
    return out.select(key, rest, F.col("_to.p").alias("_part"), F.col("_to.e").alias("_extra")).repartitionById(n, F.col("_part")).sortWithinPartitions("_extra", key, rest)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """Something large that a Python worker keeps from task to task: one thing a worker, the last asked for."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what the worker keeps, before a task that needs the room for something else."""
    if _kept:
        _kept.clear()
        trim()


def trim() -> None:
    """Give back what the worker has freed: Arrow's pool and the C library hold on to it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def leaves_room(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that starts without the memory freed by the worker's tasks before, and leaves none.

    Workers live on between tasks and stages, and what they hold counts for the executor while they wait.
    """

    @functools.wraps(run)
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return within


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each value starts (n + 1 offsets); nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P, _PINV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[starts:ends], equal for equal bytes wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _power(_P, n), out=total[1:])
    got = (total[ends] - total[starts]) * _power(_PINV, n + 1)[starts]
    return mix64(got ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
