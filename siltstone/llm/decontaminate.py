"""Benchmark decontamination by winnowing (operator 2).

Words of both sides are hashed, k-grams of ``K`` words formed, and of each ``W`` k-grams in a row the
one with the least hash is kept (the last of equals).  Any span of K + W - 1 = ``SPAN`` shared words
holds W k-grams in a row that are equal on both sides, so the same k-gram is kept on both: joining the
kept fingerprints finds every such span.  Each joined pair is then extended word by word, within the
windows that hold it, and counts if SPAN words in a row agree.

Items go to the workers in blocks of at most ``BLOCK_BYTES`` of text (chosen by a hash of the item), so
what is broadcast has a fixed bound; each block is held against all documents and the blocks' spans are
united.  A benchmark within the bound is one block, and documents aren't shuffled at all.  Items of one text
are looked for once, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, leaves_room, materialise, mix64, release, span_hashes, utf8
from siltstone.llm.token_counts import slices

K, W = 5, 4
SPAN = K + W - 1
#: Bytes of text worked on at once: hashing takes some fifty times as much, and powers as long are kept.
BLOCK_BYTES, SLICE = 8 << 20, 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
_STEP = np.uint64(0xD1342543DE82EF95)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start (n + 1 offsets)."""
    data = LOWER[data]
    inside = WORD[data]
    filled = np.diff(at) > 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][filled]] = False
    after[at[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, at)


def kgrams(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; k - 1 places fewer than words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = w[:n].copy()
    for i in range(1, k):
        h *= _STEP
        h += w[i : i + n]
    return mix64(h)


def fingerprints(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each kept k-gram; windows lie within one text."""
    h = kgrams(w, K)
    n = len(h) - W + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, place = h[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, W):
        less = h[i : i + n] <= best
        best[less] = h[i : i + n][less]
        place[less] = i
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = text[:n] == text[SPAN - 1 : SPAN - 1 + n]
    kept = np.unique((place + np.arange(n))[whole])
    return h[kept], kept


class ItemIndex:
    """Fingerprints of items with at least SPAN words; whole hashes of those with fewer.

    ``ids`` lists the items of each text; texts of fewer than ``least`` words are left out.
    """

    def __init__(self, ids: list, texts: list, least: int = 1) -> None:
        of: dict[str, list] = {}
        for i, t in zip(ids, texts, strict=True):
            of.setdefault(t, []).append(i)
        kinds = [t for t in of if least < 2 or np.diff(words(*utf8(pa.array([t], pa.string())))[1])[0] >= least]
        self.ids = [of[t] for t in kinds]
        data, offsets = utf8(pa.array(kinds, pa.string()))
        self.words, self.at = words(data, offsets)
        n = np.diff(self.at)
        self.item = np.repeat(np.arange(len(kinds)), n)
        h, place = fingerprints(self.words, self.at)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], place[order]
        self.short = {}
        for size in sorted({int(x) for x in n if 0 < x < SPAN}):
            own = np.flatnonzero(n == size)
            whole = kgrams(self.words, size)[self.at[own]]
            order = np.argsort(whole, kind="stable")
            self.short[size] = (whole[order], own[order])
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    @staticmethod
    def _meet(keys: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (probe, key) pair that is equal; keys ascend."""
        lo, hi = np.searchsorted(keys, probes), np.searchsorted(keys, probes, "right")
        n = hi - lo
        first = np.repeat(np.arange(len(probes)), n)
        return first, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def hits(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of hit words: first word, word after the last, item's place."""
        runs = []
        h, place = fingerprints(w, at)
        some = self.mask[(h & np.uint64(0xFFFFF)).astype(np.int64)]
        h, place = h[some], place[some]
        text_first = np.repeat(at[:-1], np.diff(at))
        text_after = np.repeat(at[1:], np.diff(at))
        for i in range(0, len(h), 1 << 16):
            probe, entry = self._meet(self.hashes, h[i : i + (1 << 16)])
            p, q = place[i : i + (1 << 16)][probe], self.places[entry]
            item = self.item[q]
            lo, hi = np.maximum(text_first[p] - p, self.at[item] - q), np.minimum(text_after[p] - p, self.at[item + 1] - q)
            a, b = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            back, on = np.ones(len(p), bool), np.ones(len(p), bool)
            for step in range(1, W):
                back &= -step >= lo
                back[back] = w[p[back] - step] == self.words[q[back] - step]
                a -= back
            for step in range(SPAN):
                on &= step < hi
                on[on] = w[p[on] + step] == self.words[q[on] + step]
                b += on
            good = b - a >= SPAN
            runs.append(np.stack((p + a, p + b, item))[:, good])
        for size, (keys, own) in self.short.items():
            whole = kgrams(w, size)
            fits = text_first[: len(whole)] == text_first[size - 1 : size - 1 + len(whole)]
            places = np.flatnonzero(fits)
            probe, entry = self._meet(keys, whole[places])
            runs.append(np.stack((places[probe], places[probe] + size, own[entry])))
        both = np.concatenate(runs, 1) if runs else np.zeros((3, 0), np.int64)
        return both[0], both[1], both[2]


def _spans(firsts: np.ndarray, afters: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, afters, -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


OUT = "id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<first:bigint,after:bigint>>, items array<string>"


def _rows(ids: pa.Array, at: np.ndarray, mask: np.ndarray, found: dict[int, set], least: int) -> pa.RecordBatch:
    """The result rows of some texts; found: the items' ids for each text that has any."""
    n_hit = np.add.reduceat(np.append(mask, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0) if len(at) > 1 else np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    cut = np.zeros(len(mask), bool)
    cut[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(mask & ((edge[:-1] == 1) | cut))
    ends = np.flatnonzero(mask & ((edge[1:] == -1) | np.append(cut[1:], True))) + 1
    spans: list[list] = [[] for _ in range(len(at) - 1)]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        spans[text[a]].append({"first": int(a - at[text[a]]), "after": int(b - at[text[a]])})
    names = [sorted(str(x) for x in found.get(i, ()) if x is not None) for i in range(len(at) - 1)]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    none = _digest([])
    cols = [ids, pa.array(np.diff(at), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([_digest(x) if x else none for x in names]), pa.array([len(x) >= least for x in names]), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items with text, in blocks of about ``block_bytes`` at most."""
    held = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0).dropDuplicates(["item", "text"])
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [held.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).orderBy("item", "text") for i in range(n)]


def drop_contaminated(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, least_words: int = SPAN) -> DataFrame:
    """The documents in which no window of any item occurs, all columns kept; block after block of items.

    Items of fewer than ``least_words`` words (SPAN: those without a whole window) rule no document out, as a
    common word would rule out all.  A null or empty text holds nothing and stays; repeated rows, null
    ids and further columns stay as they are; a very long text is read whole.  Without items all stay.
    """
    for block in _blocks(items, item_col, text_col, block_bytes):
        own = block.collect()
        sent = docs.sparkSession.sparkContext.broadcast(([r["item"] for r in own], [r["text"] for r in own]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            release()
            index = ItemIndex(*sent.value, least_words)
            for batch in batches:
                data, offsets = utf8(batch.column(text_col))
                for a, b in slices(np.diff(offsets).tolist(), SLICE):
                    w, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    clean = np.ones(b - a, bool)
                    clean[np.searchsorted(at, index.hits(w, at)[0], "right") - 1] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        docs = docs.mapInArrow(leaves_room(run), docs.schema)
    return docs


def contamination(docs: DataFrame, items: DataFrame, min_items: int = 2, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each document: n_words, n_hit, n_items, items_sha256, contaminated, and the spans and items hit.

    A null text has no words; an item without words occurs nowhere; items of one id count once and a
    null item id isn't listed (its words still count as hit).  Repeated rows and ids stay apart.  With more
    than one block of items the texts are first written to the shared folder with a number for each row,
    by which the blocks' finds are united.
    """
    spark = docs.sparkSession
    held = _blocks(items, item_col, text_col, block_bytes)
    blocks = len(held)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    if blocks > 1:
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    def scan(block: int, whole: bool) -> DataFrame:
        own = held[block].collect()
        sent = spark.sparkContext.broadcast(([r["item"] for r in own], [r["text"] for r in own]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*sent.value)
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                for a, b in slices(np.diff(offsets).tolist(), SLICE):
                    w, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    first, after, item = index.hits(w, at)
                    mask = _spans(first, after, len(w))
                    found: dict[int, set] = {}
                    texts = np.searchsorted(at, first, "right") - 1
                    for key in np.unique(texts.astype(np.int64) << 32 | item).tolist():
                        found.setdefault(key >> 32, set()).update(index.ids[key & 0xFFFFFFFF])
                    out = _rows(batch.column("id").slice(a, b - a), at, mask, found, min_items)
                    yield out if whole else pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *out.columns], names=["row", *out.schema.names])

        return rows.mapInArrow(run, OUT if whole else f"row bigint, {OUT}")

    if blocks == 1:
        return scan(0, True).withColumnRenamed("id", id_col)
    parts = [materialise(scan(i, False), "hits") for i in range(blocks)]
    discard(rows)
    rest = parts[0]
    for x in parts[1:]:
        rest = rest.unionByName(x.where(F.size("spans") > 0))
    merged = rest.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def joined(spans: Column, x: Column) -> Column:
        """The spans so far with one more, whose first word isn't before theirs."""
        last = F.element_at(spans, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["after"], x["after"]).alias("after"))
        return F.when((F.size(spans) > 0) & (last["after"] >= x["first"]), F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(longer))).otherwise(F.concat(spans, F.array(x)))

    none = F.array().cast("array<struct<first:bigint,after:bigint>>")
    merged = merged.withColumn("spans", F.aggregate("spans", none, joined))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["after"] - x["first"])
    n_items = F.size("items").cast("bigint")
    return merged.select(id_col, "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"), "spans", "items")
