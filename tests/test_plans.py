"""The planner, manifests, Bloom filters and the key codec."""

import datetime as dt
import decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import bloom, codec
from siltstone.plans import levels as planner
from siltstone.plans.pruning import for_keys, for_range
from siltstone.model import UNSET
from siltstone.sources.manifest import Manifest, Segment


def seg(path, level, lo, hi, seq=0, size=1, tags=(False,)):
    return Segment(path, level, (lo,), (hi,), seq, seq + 9, 1, size, tags)


def test_level_zero_goes_whole_with_what_it_meets():
    files = [seg(f"0{i}", 0, i * 10, i * 10 + 15, i) for i in range(4)] + [seg("1a", 1, 0, 5), seg("1b", 1, 100, 200), seg("2", 2, 0, 500)]
    plan = planner.next_plan(Manifest(files=tuple(files)).levels(), planner.Limits())
    assert [f.path for f in plan.sources] == ["00", "01", "02", "03"] and [f.path for f in plan.targets] == ["1a"]
    assert plan.level == 1 and not plan.drop_tombstones


def test_deeper_levels_give_their_oldest_file():
    files = [seg("a", 1, 0, 5, seq=50, size=60), seg("b", 1, 6, 9, seq=10, size=60), seg("c", 2, 7, 7), seg("d", 2, 8, 30)]
    plan = planner.next_plan(Manifest(files=tuple(files)).levels(), planner.Limits(base_size=100))
    assert [f.path for f in plan.sources] == ["b"] and [f.path for f in plan.targets] == ["c", "d"] and plan.level == 2 and plan.drop_tombstones
    assert planner.next_plan(Manifest(files=tuple(files)).levels(), planner.Limits(base_size=1000)) is None
    assert planner.Limits(base_size=100).capacity(3) == 10_000


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20)), max_size=15), st.integers(0, 50), st.integers(0, 20))
def test_overlap_is_that_of_closed_ranges(spans, lo, n):
    files = [seg(str(i), 1, a, a + d) for i, (a, d) in enumerate(spans)]
    got = {f.path for f in planner.overlapping(files, (lo,), (lo + n,))}
    assert got == {str(i) for i, (a, d) in enumerate(spans) if any(lo <= x <= lo + n for x in range(a, a + d + 1))}


def test_pruning_and_null_keys():
    files = [seg("n", 1, None, 3), seg("t", 1, 5, 9, seq=100, tags=((True, "x"),)), seg("any", 1, 5, 9, tags=None)]
    assert [f.path for f in for_keys(files, [(None,)], UNSET, None)] == ["n"]
    assert [f.path for f in for_range(files, (4,), UNSET, "x", None)] == ["t", "any"]
    assert [f.path for f in for_range(files, UNSET, UNSET, "x", 50)] == ["any"]


def test_manifests_keep_bounds_of_any_type():
    keys = (1, "a", None, 1.5, True, b"\0x", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3), decimal.Decimal("1.20"))
    one = Manifest(3, 7, (Segment("p", 1, keys, keys, 0, 1, 2, 3, (False, (True, None))),), ("d",), {"key": []})
    assert Manifest.from_json(one.to_json()) == one


def test_blooms_have_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(1000).select(F.concat(F.lit("m"), "id").alias("key"))
    bits, probes = bloom.size_for(1000, 0.01)
    assert (bits, probes) == (9585, 7)
    kept = bloom.build(keys, ["key"], bits, probes)
    assert bloom.members(kept, keys, ["key"], bits, probes).count() == 1000
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert bloom.members(kept, others, ["key"], bits, probes).count() <= 0.02 * 20_000


_flat = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=5) | st.binary(max_size=5)
_any = st.recursive(_flat, lambda x: st.tuples(x, x) | st.lists(x, max_size=3), max_leaves=6)


@settings(max_examples=400, deadline=None)
@given(_any)
def test_keys_come_back(key):
    assert codec.decode(codec.encode(key)) == key


@settings(max_examples=400, deadline=None)
@given(st.one_of(*(st.tuples(x, x) for x in (st.integers() | st.floats(allow_nan=False), st.text(max_size=4), st.binary(max_size=4), st.lists(st.integers(-3, 3), max_size=3), st.tuples(st.integers(-2, 2), st.text(max_size=2))))))
def test_the_encoded_order_is_that_of_the_values(two):
    a, b = two
    assert (codec.encode(a) < codec.encode(b)) == (a < b) and (codec.encode(a) == codec.encode(b)) == (a == b)
