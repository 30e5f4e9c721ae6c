"""Segments: sorted Parquet files of log rows, written by executors, and their bounds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.model import IS_TAGGED, SEQ, TAG, Layout, StoreIOError
from siltstone.sources.files import Files
from siltstone.sources.manifest import Segment

FOLDER, MOST_TAGS = "segments", 64
#: Rows of a file at most, about, where its bytes aren't known before it is written.
ROWS_PER_FILE = 2_000_000


def write(files: Files, layout: Layout, rows: DataFrame, level: int, max_size: int, fpp: float, expected_bytes: int = 0, expected_rows: int = 0) -> list[Segment]:
    """Write log rows as files sorted by (namespace, key, newest first), range-partitioned, and read their bounds.

    Files are cut near ``max_size`` bytes by the expected size, or by rows where only those are known.  Level 2 and deeper are compressed harder.
    Rows of one key stay in one file.  Nothing counts until a manifest lists it, so a failed job leaves
    only files that vacuum removes.
    """
    folder = f"{FOLDER}/{level}-{uuid.uuid4().hex}"
    order = [F.col(IS_TAGGED).asc(), F.col(TAG).asc_nulls_first(), *(F.col(k).asc_nulls_first() for k in layout.key_names)]
    n = max(1, -(-expected_bytes // max(max_size, 1)), -(-expected_rows // ROWS_PER_FILE))
    # One file's worth of rows is gathered by a shuffle, so that what comes before it stays parallel.
    rows = rows.repartition(1) if n == 1 else rows.repartitionByRange(n, *order)
    rows = rows.sortWithinPartitions(*order, F.desc(SEQ))
    out = rows.select(*layout.schema.names).write.option("compression", "zstd" if level > 1 else "snappy")
    out = out.option("parquet.bloom.filter.enabled", "false")
    for f in layout.keys:
        if f.dataType.typeName() in ("long", "integer", "string", "double", "float", "binary"):
            out = out.option(f"parquet.bloom.filter.enabled#{f.name}", "true").option(f"parquet.bloom.filter.fpp#{f.name}", str(fpp))
            if expected_rows:  # else every file would hold a filter of the greatest size
                out = out.option(f"parquet.bloom.filter.expected.ndv#{f.name}", str(max(1, 2 * expected_rows // n)))
    try:
        out.parquet(files.path(folder))
    except PySparkException as e:
        raise StoreIOError("write", files.path(folder), e) from e
    return bounds(rows.sparkSession, files, layout, folder, level)


def bounds(spark: SparkSession, files: Files, layout: Layout, folder: str, level: int) -> list[Segment]:
    """A row of bounds for each file of a folder: one job over the key, tag and seq columns."""
    sizes = {name: size for name, size, is_dir in files.names(folder) if name.endswith(".parquet")}
    if not sizes:
        return []
    key = F.struct(*layout.key_names)
    rows = spark.read.schema(layout.schema).parquet(files.path(folder)).select(IS_TAGGED, TAG, *layout.key_names, SEQ, F.col("_metadata.file_name").alias("_file"))
    tags = F.slice(F.collect_set(F.when(F.col(IS_TAGGED), F.to_json(F.struct(F.col(TAG).alias("t")), {"ignoreNullFields": "false"})).otherwise("")), 1, MOST_TAGS + 1)
    got = rows.groupBy("_file").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min(SEQ).alias("s0"), F.max(SEQ).alias("s1"), F.count(F.lit(1)).alias("n"), tags.alias("tags")).collect()
    listed = []
    for r in got:
        spaces = None if len(r["tags"]) > MOST_TAGS else tuple((True, json.loads(t)["t"]) if t else False for t in sorted(r["tags"]))
        listed.append(Segment(f"{folder}/{r['_file']}", level, tuple(r["lo"]), tuple(r["hi"]), r["s0"], r["s1"], r["n"], sizes[r["_file"]], spaces))
    return sorted(listed, key=lambda f: f.path)


def read(spark: SparkSession, files: Files, layout: Layout, segments: Sequence[Segment]) -> DataFrame:
    """All versions in some files; an empty frame for none."""
    if not segments:
        return spark.createDataFrame([], layout.schema)
    return spark.read.schema(layout.schema).parquet(*(files.path(s.path) for s in segments))
