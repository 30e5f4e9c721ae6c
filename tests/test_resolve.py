"""Reads over logs against a dictionary model."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.model import UNSET, Layout
from siltstone.operators import changes, resolve

SCHEMA = "is_tagged boolean, tag string, key bigint, seq bigint, is_tombstone boolean, value string"
K = ["key"]


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def put(key, seq, value, tag=UNSET, gone=False):
    return (tag is not UNSET, None if tag is UNSET else tag, key, seq, gone, value)


def pairs(df):
    return [(r["key"], r["value"]) for r in df.collect()]


def test_newest_wins_and_a_tombstone_hides_only_older_versions(spark):
    rows = log(spark, [put(1, 0, "a"), put(1, 5, "b"), put(2, 1, "x"), put(2, 2, None, gone=True), put(3, 3, None, gone=True), put(3, 4, "back")])
    assert pairs(resolve.scan(rows, K)) == [(1, "b"), (3, "back")]
    assert resolve.latest(rows, K).count() == 3


def test_bounds_are_inclusive_and_none_is_a_bound(spark):
    rows = log(spark, [put(k, i, str(k)) for i, k in enumerate([None, 1, 2, 3, 4])])
    assert [k for k, _ in pairs(resolve.scan(rows, K, 2, 3))] == [2, 3]
    assert [k for k, _ in pairs(resolve.scan(rows, K, low=None, high=None))] == [None]
    assert [k for k, _ in pairs(resolve.scan(rows, K, low=None, high=1))] == [None, 1]
    assert [k for k, _ in pairs(resolve.scan(rows, K, high=1))] == [None, 1]
    assert [k for k, _ in pairs(resolve.scan(rows, K, low=1, high=1))] == [1]
    assert pairs(resolve.scan(rows, K, 3, 2)) == []


def test_namespaces_are_apart_and_the_null_tag_is_one(spark):
    rows = log(spark, [put(1, 0, "plain"), put(1, 1, "a", tag="a"), put(1, 2, "none", tag=None)])
    assert pairs(resolve.scan(rows, K)) == [(1, "plain")]
    assert pairs(resolve.scan(rows, K, tag="a")) == [(1, "a")]
    assert pairs(resolve.scan(rows, K, tag=None)) == [(1, "none")]


def test_null_value_missing_and_removed_stay_apart(spark):
    rows = log(spark, [put(1, 0, None), put(2, 1, "x"), put(2, 2, None, gone=True)])
    want = spark.createDataFrame([(1,), (2,), (3,), (1,)], "key bigint")
    got = {r["key"]: (r["found"], r["value"]) for r in resolve.lookup(rows, want, K, ["value"]).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (False, None)}
    assert {r["key"]: r["value"] for r in changes.get_with_default(rows, want, K, ["value"], "d").collect()} == {1: None, 2: "d", 3: "d"}


def test_composite_keys_compare_column_by_column(spark):
    rows = spark.createDataFrame([(False, None, a, b, 10 * a + b, False, "v") for a in (1, 2, 3) for b in (1, 2, 3)], "is_tagged boolean, tag string, a int, b int, seq bigint, is_tombstone boolean, value string")
    got = [(r["a"], r["b"]) for r in resolve.scan(rows, ["a", "b"], (1, 3), (3, 1)).collect()]
    assert got == [(1, 3), (2, 1), (2, 2), (2, 3), (3, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_model_at_every_snapshot(spark, seed):
    r = random.Random(seed)
    ops = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice(["put", "put", "remove"]), f"v{i}") for i in range(60)]
    rows = log(spark, [put(k, i, None if op == "remove" else v, gone=op == "remove") for i, (k, op, v) in enumerate(ops)])
    shuffled = rows.repartition(5, "seq")
    for at in (0, 7, 30, 60):
        model = {}
        for k, op, v in ops[:at]:
            model[k] = v
            if op == "remove":
                del model[k]
        assert dict(pairs(resolve.scan(shuffled, K, seq=at))) == model


def test_numbers_are_dense_and_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key"), F.col("id").cast("string").alias("value"))
    got = [r["seq"] for r in changes.number(rows, ["key"], 50).orderBy("key").collect()]
    assert got == list(range(50, 1050))


def test_updates_insert_the_default_raw(spark):
    rows = log(spark, [put(1, 0, "a"), put(2, 1, "b"), put(2, 2, None, gone=True)])
    want = spark.createDataFrame([(1,), (2,), (3,), (3,)], "key bigint")
    f = lambda v: F.concat(v, F.lit("!"))
    assert dict(pairs(changes.update_multi(rows, want, K, ["value"], f))) == {1: "a!"}
    assert dict(pairs(changes.update_multi(rows, want, K, ["value"], f, default="d"))) == {1: "a!", 2: "d", 3: "d"}
    assert dict(pairs(changes.update_multi(rows, want, K, ["value"], lambda k, v: F.concat(k.cast("string"), v)))) == {1: "1a"}


def test_cas_takes_a_missing_key_as_null(spark):
    rows = log(spark, [put(1, 0, "a"), put(2, 1, "b")])
    swaps = spark.createDataFrame([(1, "a", "n"), (2, "x", "n"), (3, None, "n")], "key bigint, old_value string, new_value string")
    got = {r["key"]: (r["swapped"], r["value"]) for r in changes.cas_batch(rows, swaps, K, ["value"]).collect()}
    assert got == {1: (True, "n"), 2: (False, "b"), 3: (True, "n")}


def test_key_filters_reach_the_scan_and_value_filters_do_not(spark, tmp_path):
    log(spark, [put(k, k, "v") for k in range(10)]).write.parquet(str(tmp_path / "log"))
    plan = resolve.scan(spark.read.parquet(str(tmp_path / "log")), K, 2, 3, seq=9)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(key,2)" in pushed and "LessThan(seq,9)" in pushed and "is_tombstone" not in pushed


def test_layouts_refuse_keys_without_order():
    with pytest.raises(ValueError):
        Layout.of("key map<string,int>", "value string")
    with pytest.raises(ValueError):
        Layout.of("seq bigint", "value string")
