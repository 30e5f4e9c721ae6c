"""File pruning by key bounds, namespaces and seqs, before Spark lists or opens anything."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from siltstone.model import ANY, UNSET
from siltstone.plans.levels import less
from siltstone.sources.manifest import Segment


def may_hold_tag(f: Segment, tag: object) -> bool:
    return tag is ANY or f.tags is None or (False if tag is UNSET else [True, tag]) in [x if x is False else list(x) for x in f.tags]


def for_range(files: Iterable[Segment], low: object, high: object, tag: object, seq: int | None) -> list[Segment]:
    """Files that may hold visible rows of the namespace in the range (bounds are key tuples or UNSET)."""
    return [f for f in files if (seq is None or f.seq_min < seq) and may_hold_tag(f, tag) and not (low is not UNSET and less(f.key_max, low)) and not (high is not UNSET and less(high, f.key_min))]


def for_keys(files: Iterable[Segment], keys: Sequence[tuple], tag: object, seq: int | None) -> list[Segment]:
    """Files that may hold one of the keys."""
    return [f for f in for_range(files, UNSET, UNSET, tag, seq) if any(f.overlaps(k, k, less) for k in keys)]
