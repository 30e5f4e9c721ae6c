"""Lempel-Ziv phrase fingerprints (operator 10).

A text's UTF-8 bytes are parsed into LZ78 phrases; the set of phrase hashes is kept as its ``SIZE``
smallest members (a minimum-hash signature), written as text.  The likeness of two fingerprints is the
share of common members among the smallest of both together: an estimate of the phrase sets' Jaccard
similarity, exact while a set has no more than ``SIZE`` phrases.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ordered_with_next, span_hashes

SIZE = 128


class Parse:
    """An LZ78 parse that can be taken up again: ``ends`` of the phrases so far, and the trie."""

    def __init__(self) -> None:
        self.trie: dict[int, int] = {}
        self.next, self.node, self.at = 256, 0, 0

    def feed(self, data: bytes) -> list[int]:
        """Parse on; returns where phrases that are new end.  A last phrase met before adds nothing."""
        trie, node, fresh = self.trie, self.node, self.next
        get, ends, i = trie.get, [], self.at
        for c in data:
            i += 1
            to = get(node + c)
            if to is None:
                trie[node + c] = fresh
                fresh += 256
                ends.append(i)
                node = 0
            else:
                node = to
        self.node, self.next, self.at = node, fresh, i
        return ends

    def branch(self, data: bytes) -> list[int]:
        """As ``feed``, without keeping what it adds."""
        held, before = (self.node, self.next, self.at), self.next
        ends = self.feed(data)
        for _ in range((self.next - before) // 256):
            self.trie.popitem()
        self.node, self.next, self.at = held
        return ends


def sketch(data: bytes, ends: list[int]) -> np.ndarray:
    """The smallest hashes of the phrases, ascending."""
    if not ends:
        return np.zeros(0, np.uint32)
    to = np.asarray(ends, np.int64)
    start = np.concatenate(([0], to[:-1]))
    return np.unique((span_hashes(np.frombuffer(data, np.uint8), start, to) >> np.uint64(32)).astype(np.uint32))[:SIZE]


def to_text(sk: np.ndarray) -> str:
    return base64.b64encode(sk.astype("<u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty sketches are alike.  Only the part of the order that both sketches cover counts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if len(a) >= SIZE or len(b) >= SIZE:
        both = both[:SIZE]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= both[-1]) / len(both))


def edited(text: str, following: str) -> tuple[str, str]:
    """The text without its last quarter, and what stands there instead: the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n], following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document its fingerprint, that of its edited text, and the likenesses to it and to the next.

    The next document is the one that follows in ascending id (after the last: the first); rows of one
    id are ordered by text, null ids come first, null texts count as empty.  A document alone is its
    own next.  An empty text has the empty fingerprint; two of them are alike.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    laid = ordered_with_next(rows, "id", "text")
    kinds = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, {k: [] for k in kinds}

        def flush(doc: tuple, following: str, next_sketch: np.ndarray) -> None:
            key, text, parse, ends, kept, tail_ends, own = doc
            new = following[: len(text) // 4].encode()
            other = sketch(kept + new, ends + parse.branch(new))
            for k, v in zip(kinds, (key, len(text), hashlib.sha256(kept + new).hexdigest(), to_text(own), to_text(other), likeness(own, other), likeness(own, next_sketch)), strict=True):
                done[k].append(v)

        for batch in batches:
            for key, text, extra in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "_extra")), strict=True):
                if extra and held is None:
                    break
                parse, cut = Parse(), len(text) - len(text) // 4
                kept, tail = text[:cut].encode(), text[cut:].encode()
                ends = parse.feed(kept)
                tail_ends = parse.branch(tail)
                own = sketch(kept + tail, ends + tail_ends)
                if held is not None:
                    flush(held, text, own)
                held = None if extra else (key, text, parse, ends, kept, tail_ends, own)
                if len(done["id"]) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(done[k], t) for k, t in kinds.items()], names=list(kinds))
                    done = {k: [] for k in kinds}
        yield pa.RecordBatch.from_arrays([pa.array(done[k], t) for k, t in kinds.items()], names=list(kinds))

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return laid.select("id", "text", "_extra").mapInArrow(run, schema).withColumnRenamed("id", id_col)
