"""The versioned log: its columns, the marks for absent options, and the errors.

A log row is one version of one key: ``is_tagged, tag, key columns, seq, is_tombstone, value columns``.
Untagged data is a namespace of its own, apart from every tag, the null tag included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class _Unset:
    def __repr__(self) -> str:
        return "UNSET"

    def __bool__(self) -> bool:
        return False


#: "Not given", so that None stays a legal key, bound, tag, default or value.
UNSET = _Unset()
#: All namespaces.
ANY = object()

IS_TAGGED, TAG, SEQ, TOMBSTONE = "is_tagged", "tag", "seq", "is_tombstone"


class StoreError(Exception):
    """Any error of the store."""


class StoreIOError(StoreError):
    """A storage operation that failed: what was done, where, and why."""

    def __init__(self, operation: str, path: str, reason: object) -> None:
        super().__init__(f"{operation} failed on {path}: {reason}")
        self.operation, self.path, self.reason = operation, path, reason


class CorruptManifestError(StoreError):
    """The newest readable manifest doesn't match the files."""


class ReadOnlyError(StoreError, ValueError):
    """A write within a read transaction."""

    def __init__(self) -> None:
        super().__init__("Operation not allowed during read")


class TransactionError(StoreError):
    """A transaction used in a way that isn't allowed: nested, after its end, or with an odd result."""


class ConflictError(StoreError):
    """Another process committed first."""


@dataclass(frozen=True)
class Layout:
    """The typed columns of a store: what a key is, what a value is."""

    keys: tuple[T.StructField, ...]
    values: tuple[T.StructField, ...]
    key_names: tuple[str, ...] = field(init=False)
    value_names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "key_names", tuple(f.name for f in self.keys))
        object.__setattr__(self, "value_names", tuple(f.name for f in self.values))
        names = [IS_TAGGED, TAG, SEQ, TOMBSTONE, *self.key_names, *self.value_names]
        if not self.keys or not self.values or len(set(names)) < len(names):
            raise ValueError(f"key and value columns must be given, distinct, and none of the log's own: {names}")
        for f in self.keys:
            if isinstance(f.dataType, (T.MapType, T.VariantType)):
                raise ValueError(f"a key must be orderable; {f.name} is {f.dataType.simpleString()}")

    @classmethod
    def of(cls, key: str | T.StructType, value: str | T.StructType) -> Layout:
        """From DDL ("key bigint") or struct types."""
        parse = lambda x: tuple((T._parse_datatype_string(x) if isinstance(x, str) else x).fields)
        bare = lambda x, name: f"{name} {x}" if isinstance(x, str) and " " not in x.strip() else x
        return cls(parse(bare(key, "key")), parse(bare(value, "value")))

    @property
    def schema(self) -> T.StructType:
        """The log's schema."""
        free = lambda fields: [T.StructField(f.name, f.dataType, True) for f in fields]
        return T.StructType([T.StructField(IS_TAGGED, T.BooleanType()), T.StructField(TAG, T.StringType()), *free(self.keys), T.StructField(SEQ, T.LongType()), T.StructField(TOMBSTONE, T.BooleanType()), *free(self.values)])

    @property
    def pair_names(self) -> list[str]:
        return [*self.key_names, *self.value_names]

    def key_row(self, key: object) -> tuple:
        """A key as a tuple of its columns: a composite key is given as a tuple, a single one bare."""
        return tuple(key) if len(self.keys) > 1 else (key,)

    def value_row(self, value: object) -> tuple:
        if len(self.values) == 1:
            return (value,)
        return (None,) * len(self.values) if value is None else tuple(value[n] for n in self.value_names) if isinstance(value, dict) else tuple(value)

    def key_of(self, row: object) -> object:
        got = tuple(row[n] for n in self.key_names)
        return got if len(got) > 1 else got[0]

    def value_of(self, row: object) -> object:
        got = tuple(row[n] for n in self.value_names)
        return got if len(got) > 1 else got[0]
