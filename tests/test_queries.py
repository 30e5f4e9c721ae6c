"""Every query with SQL gives what the SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from siltstone.sources import segments

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")
@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry_points.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted((tuple(repr(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=str)

    assert rows(got) == rows(want)


def test_the_flagship_query(spark):
    if os.path.isdir(SF):
        assert entry_points.entry(spark).count() > 0


def check_equals_sql(spark, con, folder, name):
    frame = entry_points.queries()[name](spark, str(folder))
    want = con.sql(entry_points.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")
@pytest.mark.parametrize("name", ["q33_overlap_targets", "q35_sweepable", "q32_level_stats", "q34_version_files"])
def test_commits_of_many_files_give_what_the_sql_gives(spark, duck, name, monkeypatch):
    monkeypatch.setattr(segments, "ROWS_PER_FILE", 100)
    check_equals_sql(spark, duck, SF, name)


def orders(folder, rows):
    """A table of these (o_orderkey, o_custkey), and a connection that sees it."""
    con = duckdb.connect()
    con.sql("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE)")
    for order, customer in rows:
        con.sql(f"INSERT INTO orders VALUES ({order}, {customer}, 'O', 1.5)")
    con.sql(f"COPY orders TO '{folder}/orders.parquet'")
    return con


@pytest.mark.parametrize("rows", [[(0, 1), (1, 5), (8, 20), (9, 30)], [(0, 20), (1, 30), (8, 1), (9, 5)], [(0, 1), (1, 2_000_000), (9, 1_000_001)], [(3, 4)], [(0, 4)], []])
def test_overlap_targets_of_keys_in_order_apart_or_missing(spark, tmp_path, rows):
    check_equals_sql(spark, orders(tmp_path, rows), tmp_path, "q33_overlap_targets")


@pytest.mark.parametrize("rows", [[(0, 1), (1, 2), (9, 3)], [(8, 1), (9, 2)], []])
def test_versions_count_transactions_without_orders(spark, tmp_path, rows):
    check_equals_sql(spark, orders(tmp_path, rows), tmp_path, "q34_version_files")
