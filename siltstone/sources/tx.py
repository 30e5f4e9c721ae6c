"""Transactions: a pinned snapshot, the rows pending in it, and what their functions may return."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.model import TOMBSTONE, UNSET, Layout, ReadOnlyError, TransactionError
from siltstone.operators import changes, resolve
from siltstone.sources.scratch import Written

if TYPE_CHECKING:
    from siltstone.sources.store import Pin, Store


@dataclass(frozen=True)
class Commit:
    """Write what is pending and give the reply."""

    reply: object = "ok"


@dataclass(frozen=True)
class Abort:
    """Write nothing and give the reply."""

    reply: object = "error"


class Scan:
    """An ordered range scan that binds when it is used, not when it is made.

    ``df`` gives the live pairs as a DataFrame of the snapshot pinned by that call; the pin holds while
    the scan object lives.  Iterating yields (key, value) pairs.
    """

    def __init__(self, source: Store | Tx, low: object, high: object, tag: object) -> None:
        self._source, self._bounds, self._tag = source, (low, high), tag
        self._pins: list[Pin] = []
        self._pending = list(source.pending) if isinstance(source, Tx) else []

    def df(self, ordered: bool = True) -> DataFrame:
        if isinstance(self._source, Tx):
            self._source.check()
            pin, store = self._source.pin, self._source.store
        else:
            store = self._source
            pin = store.pin()
            self._pins.append(pin)
        layout = store.layout
        low, high = (x if x is UNSET else layout.key_row(x) for x in self._bounds)
        log = store.log(pin, low=low, high=high, tag=self._tag)
        for batch in self._pending:
            log = log.unionByName(batch)
        return resolve.scan(log, layout.key_names, *self._bounds, tag=self._tag, ordered=ordered)

    def __iter__(self):
        layout, before = self._source.layout, len(self._pins)
        rows = self.df()
        own = self._pins[before:]
        del self._pins[before:]
        try:
            for row in rows.toLocalIterator():
                yield layout.key_of(row), layout.value_of(row)
        finally:
            for pin in own:
                pin.release()

    def close(self) -> None:
        for pin in self._pins:
            pin.release()
        self._pins.clear()

    def __enter__(self) -> Scan:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Tx:
    """A transaction over one snapshot; reads see its own writes."""

    def __init__(self, store: Store, pin: Pin, writable: bool) -> None:
        self.store, self.pin, self.writable, self.alive = store, pin, writable, True
        self.next_seq = pin.manifest.next_seq
        self.pending: list[DataFrame] = []
        self._tables: list[Written] = []  # what frames were written to, until the end
        self._rows: list[tuple] = []  # rows given one by one, which the last pending frame holds

    @property
    def layout(self) -> Layout:
        return self.store.layout

    def check(self) -> None:
        if not self.alive:
            raise TransactionError("the transaction has ended")

    def _may_write(self) -> None:
        self.check()
        if not self.writable:
            raise ReadOnlyError

    # -- writes

    def put(self, key: object, value: object, tag: object = UNSET) -> Tx:
        return self.put_multi([(key, value)], tag)

    def put_multi(self, pairs: DataFrame | Mapping | Iterable, tag: object = UNSET, order: object = None) -> Tx:
        """A batch of pairs: a mapping, an iterable of pairs, or a DataFrame with the store's columns.

        Later pairs of a key win.  A DataFrame's order is that of its ``order`` columns (by default its
        keys); it may be of any size.
        """
        self._may_write()
        if isinstance(pairs, DataFrame):
            return self._add_frame(pairs, tag, order, False)
        pairs = pairs.items() if isinstance(pairs, Mapping) else pairs
        return self._add([(self.layout.key_row(k), self.layout.value_row(v)) for k, v in pairs], tag, False)

    def remove(self, key: object, tag: object = UNSET) -> Tx:
        return self.remove_multi([key], tag)

    def remove_multi(self, keys: DataFrame | Iterable, tag: object = UNSET) -> Tx:
        """Tombstones; also for keys that aren't there."""
        self._may_write()
        if isinstance(keys, DataFrame):
            return self._add_frame(keys, tag, None, True)
        none = (None,) * len(self.layout.values)
        return self._add([(self.layout.key_row(k), none) for k in keys], tag, True)

    def _add(self, rows: list[tuple[tuple, tuple]], tag: object, removed: bool) -> Tx:
        tagged, name = tag is not UNSET, None if tag is UNSET else tag
        new = [(tagged, name, *k, self.next_seq + i, removed, *v) for i, (k, v) in enumerate(rows)]
        if new:
            self.next_seq += len(new)
            if self._rows:
                self.pending.pop()
            self._rows += new
            self.pending.append(self.store.spark.createDataFrame(self._rows, self.layout.schema))
        return self

    def _add_frame(self, frame: DataFrame, tag: object, order: object, removed: bool) -> Tx:
        keys, values = self.layout.key_names, self.layout.value_names
        own = frame if removed else frame.select(*{*self.layout.pair_names, *(order or [])})
        numbered, n = self._stage(own, order or list(keys))
        log = changes.as_versions(numbered, keys, () if removed else values, tag, removed)
        for f in self.layout.values if removed else ():
            log = log.selectExpr("*", f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`")
        self._rows = []
        if n:
            self.pending.append(log.select(*self.layout.schema.names))
        return self

    def _stage(self, frame: DataFrame, order: list) -> tuple[DataFrame, int]:
        """The frame's rows, written to the store's folder and numbered from the next seq on."""
        rows, n, table = changes.staged(frame, order, self.next_seq, self.store.files.path("scratch"))
        self._tables.append(table)
        self.next_seq += n
        return rows, n

    @property
    def bytes(self) -> int:
        """Of what frames hold that were written in this transaction."""
        return sum(t.bytes for t in self._tables)

    def put_changes(self, frame: DataFrame, removed: str, tag: object = UNSET, order: object = None) -> Tx:
        """A batch of puts and removes in one order: rows whose ``removed`` flag holds are tombstones."""
        self._may_write()
        keys, values = self.layout.key_names, self.layout.value_names
        own = frame.select(*{*self.layout.pair_names, removed, *(order or [])})
        numbered, n = self._stage(own, order or list(keys))
        log = changes.as_versions(numbered, keys, [*values, removed], tag)
        gone = F.coalesce(F.col(removed), F.lit(False))
        log = log.withColumn(TOMBSTONE, gone).withColumns({v: F.when(~gone, F.col(v)) for v in values})
        self._rows = []
        if n:
            self.pending.append(log.select(*self.layout.schema.names))
        return self

    # -- reads

    def _log(self, keys: list[tuple] | None, tag: object) -> DataFrame:
        self.check()
        log = self.store.log(self.pin, keys=keys, tag=tag)
        for batch in self.pending:
            log = log.unionByName(batch)
        return log

    def get(self, key: object, default: object = None, tag: object = UNSET) -> object:
        found = self.get_multi([key], tag)
        return found[_hashable(key)] if found else default

    def get_multi(self, keys: Iterable | DataFrame, tag: object = UNSET) -> dict | DataFrame:
        """The values of the keys found: a dict, or for a DataFrame of keys a DataFrame of pairs."""
        layout = self.layout
        if isinstance(keys, DataFrame):
            return resolve.get_multi(self._log(None, tag), keys, layout.key_names, tag)
        wanted = list(dict.fromkeys(layout.key_row(k) for k in keys))
        if not wanted:
            self.check()
            return {}
        if len(wanted) > resolve.INLINE_KEYS:
            frame = self.store.spark.createDataFrame(wanted, key_schema(layout))
            rows = resolve.get_multi(self._log(None, tag), frame, layout.key_names, tag)
        else:
            log = self._log(wanted, tag).where(resolve.namespace(tag)).where(resolve.matches(layout.key_names, wanted))
            rows = resolve.live(resolve.latest(log, layout.key_names, within_tags=False))
        return {_hashable(layout.key_of(r)): layout.value_of(r) for r in rows.select(*layout.pair_names).collect()}

    def has_key(self, key: object, tag: object = UNSET) -> bool:
        """Whether the key is there, exactly and as of the snapshot."""
        return bool(self.get_multi([key], tag))

    def scan(self, low: object = UNSET, high: object = UNSET, tag: object = UNSET) -> Scan:
        """A scan with the writes made so far; it can be used while the transaction lives."""
        self.check()
        return Scan(self, low, high, tag)

    # -- ends

    @staticmethod
    def commit(reply: object = "ok") -> Commit:
        return Commit(reply)

    @staticmethod
    def abort(reply: object = "error") -> Abort:
        return Abort(reply)

    def written(self) -> DataFrame | None:
        out = None
        for batch in self.pending:
            out = batch if out is None else out.unionByName(batch)
        return out

    def end(self) -> None:
        self.alive = False
        for table in self._tables:
            table.remove()
        self._tables.clear()
        self.pin.release()


def _hashable(key: object) -> object:
    return tuple(_hashable(k) for k in key) if isinstance(key, (list, tuple)) else key


def key_schema(layout: Layout) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in layout.keys])

