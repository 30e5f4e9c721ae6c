"""Language-model scores from a log-frequency Bloom filter (operator 6).

The filter holds word and word-pair counts on a log scale: a count of level q is stored as q members
(n-gram, 1) .. (n-gram, q), and read back by probing level after level until one is missing.  A level read
back stands for the mean count of the n-grams of training texts that are read back with it, so that the
counts of all words, and of all pairs, keep their sums.  It is cut
into cells by the n-gram's hash, and a cell into blocks; the cells grow with the text and a cell's blocks
with its members, so every count is stored whatever the corpus, and no task or driver holds more than a
cell.  Probes are routed to the cells: a slice of documents sends each cell its distinct n-grams and how
often they occur for training; the cell sums these up, builds its blocks and answers with the levels
found there, a byte each.  Slices are given by a hash of the row, so they are the same when the answers
come back to the texts.

Words are known by a 64-bit hash of their bytes.  Exact word counts (for the base score) stay
distributed: the ``HEAD`` most frequent are broadcast, all others joined by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, mix64, span_hashes, utf8

SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
START, END = np.uint64(0x5BD1E995A54FF53A), np.uint64(0x3C6EF372FE94F82B)
BASE, LEVELS, PROBES = 1.12, 250, 10
BLOCK_BITS, BITS_A_MEMBER = 1 << 19, 32
#: Bytes of text a slice has, and for which there is a cell, on average.
HEAD, SLICE, CELL = 1 << 18, 2 << 20, 4 << 20
PSEUDO = 0.1


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is taken as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts with one end after each text; tokens of each text."""
    data = LOWER[data]
    inside = ~SPACES[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    heads = at[:-1][np.diff(at) > 0]
    before[heads] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[at[1:][np.diff(at) > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    words = span_hashes(data, starts, ends)
    upto = np.searchsorted(starts, at)
    n = np.diff(upto) + 1
    out = np.full(len(words) + len(n), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n) - 1] = False
    out[keep] = words
    return out, n


def before_each(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each; START before a text's first."""
    prev = np.empty_like(words)
    prev[1:] = words[:-1]
    prev[np.cumsum(n) - n] = START
    return prev


def pairs(prev: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(prev * np.uint64(0x9E3779B97F4A7C15) + words)


def _least_counts() -> np.ndarray:
    """The least count of each level from 1 on: one more each time, then by the factor ``BASE``."""
    out = [1]
    while len(out) < LEVELS:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BASE)))
    return np.array(out)


LEAST_COUNT = _least_counts()


def levels(counts: np.ndarray) -> np.ndarray:
    """The level of each count; counts up to 9 have one of their own."""
    return np.searchsorted(LEAST_COUNT, counts, "right")


class LogBloom:
    """The filter: ``blocks`` x BLOCK_BITS bits."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None) -> None:
        self.blocks = blocks
        self.bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8) if bits is None else bits

    def block(self, h: np.ndarray) -> np.ndarray:
        """The block of each n-gram, by bits that don't tell its cell."""
        return (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % self.blocks

    @staticmethod
    def places(h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """The bits of each member in its block, probe after probe."""
        g = mix64(h + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        step = g >> np.uint64(33) | np.uint64(1)
        for _ in range(PROBES):
            yield (g & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
            g = g + step

    @staticmethod
    def build_block(h: np.ndarray, q: np.ndarray) -> np.ndarray:
        """One block's bytes."""
        bits = np.zeros(BLOCK_BITS, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            for at in LogBloom.places(h[q >= level], level):
                bits[at] = True
        return np.packbits(bits, bitorder="little")

    @classmethod
    def build(cls, h: np.ndarray, q: np.ndarray, room: int) -> LogBloom:
        """A filter with a block for each ``room`` members."""
        out = cls(max(1, -(-int(q.sum()) // room)))
        block = out.block(h)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(out.blocks + 1))
        for i in range(out.blocks):
            own = order[cuts[i] : cuts[i + 1]]
            out.bits[i * BLOCK_BITS // 8 : (i + 1) * BLOCK_BITS // 8] = cls.build_block(h[own], q[own])
        return out

    def false_rate(self) -> float:
        """How often an n-gram that isn't in the filter is found there: the blocks' mean."""
        filled = np.unpackbits(self.bits).reshape(self.blocks, -1).mean(1)
        return float((filled**PROBES).mean())

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level stored for each n-gram: probes level after level, for those still present."""
        q, left = np.zeros(len(h), np.int64), np.arange(len(h))
        own, start = h, self.block(h) * BLOCK_BITS
        for level in range(1, LEVELS + 1):
            here = np.ones(len(own), bool)
            for at in self.places(own, level):
                at += start
                here &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left, own, start = left[here], own[here], start[here]
            if not len(left):
                break
            q[left] = level
        return q


class Slice:
    """The n-grams of some texts: the distinct words (and START) ``u`` and pairs ``p``, and each token's place there."""

    def __init__(self, text: pa.ChunkedArray) -> None:
        w, self.n = tokens(*utf8(text))
        self.first = np.cumsum(self.n) - self.n
        self.u, back = np.unique(np.append(w, START), return_inverse=True)
        self.word, self.start = back[:-1], back[-1]
        self.prev = np.empty_like(self.word)
        self.prev[1:] = self.word[:-1]
        self.prev[self.first] = self.start
        self.p, self.pair = np.unique(pairs(before_each(w, self.n), w), return_inverse=True)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)


def cut(h: np.ndarray, cells: int) -> np.ndarray:
    """Where the cells of ascending hashes start (cells + 1 places): ranges of the upper 32 bits."""
    return np.searchsorted((h >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32), np.arange(cells + 1, dtype=np.uint64))


def ask(slice_id: int, text: pa.ChunkedArray, train: np.ndarray, cells: int) -> pa.Table:
    """A slice's rows for the cells: n-grams, first the words, and their counts in training texts (by planes of bytes)."""
    own = Slice(text)
    counted = train[own.doc].astype(float)
    cu = np.bincount(own.word, weights=counted, minlength=len(own.u))
    cu[own.start] += train.sum()
    cp = np.bincount(own.pair, weights=counted, minlength=len(own.p))
    at_u, at_p = cut(own.u, cells), cut(own.p, cells)
    out: list[tuple] = []
    for i in np.flatnonzero((np.diff(at_u) > 0) | (np.diff(at_p) > 0)).tolist():
        u, p = slice(at_u[i], at_u[i + 1]), slice(at_p[i], at_p[i + 1])
        c = np.concatenate((cu[u], cp[p])).astype("<u4")
        out.append((i, slice_id, int(at_u[i + 1] - at_u[i]), np.concatenate((own.u[u], own.p[p])).tobytes(), c.view(np.uint8).reshape(-1, 4).T.tobytes()))
    kinds = {"cell": pa.int32(), "slice": pa.int64(), "words": pa.int32(), "h": pa.binary(), "c": pa.binary()}
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))


def answer(asked: pa.Table, min_pair_count: int, room: int) -> pa.Table:
    """A cell's levels for the n-grams of each slice; and one row with its words and their counts.

    That row also tells of the n-grams of training texts, for each level read back, how many there are and
    the sum of their counts (of words, then of pairs), and the filter's rate of false finds.
    """
    hs = [np.frombuffer(x, np.uint64) for x in asked.column("h").to_pylist()]
    size, words = np.array([len(x) for x in hs]), asked.column("words").to_numpy()
    c = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in asked.column("c").to_pylist()])
    ends = np.cumsum(size)
    is_word = np.arange(len(c)) - np.repeat(ends - size, size) < np.repeat(words, size)
    h, back = np.unique(np.concatenate(hs), return_inverse=True)
    n = np.bincount(back, weights=c, minlength=len(h)).astype(np.int64)
    word = np.zeros(len(h), bool)
    word[back[is_word]] = True
    stored = (n > 0) & (word | (n >= min_pair_count))
    bloom = LogBloom.build(h[stored], levels(n[stored]), room)
    found = bloom.levels(h).astype(np.uint8)
    own = word & (n > 0) & (h != START)
    sums = [np.bincount(found[of], weights, LEVELS + 1) for of in (own, ~word & (n > 0)) for weights in (None, n[of].astype(float))]
    found = found[back]
    k = len(hs)
    return pa.table({
        "slice": pa.concat_arrays([asked.column("slice").combine_chunks(), pa.array([None], pa.int64())]),
        "cell": pa.concat_arrays([asked.column("cell").combine_chunks(), pa.array([None], pa.int32())]),
        "words": pa.concat_arrays([asked.column("words").combine_chunks(), pa.array([None], pa.int32())]),
        "levels": pa.array([*(found[b - s : b].tobytes() for b, s in zip(ends.tolist(), size.tolist(), strict=True)), None], pa.binary()),
        "word_h": pa.array([None] * k + [h[own].view(np.int64)], pa.list_(pa.int64())),
        "word_n": pa.array([None] * k + [n[own]], pa.list_(pa.int64())),
        "sums": pa.array([None] * k + [np.concatenate(sums)], pa.list_(pa.float64())),
        "wrong": pa.array([None] * k + [bloom.false_rate()], pa.float64()),
    })


class Model:
    """What scoring needs besides the levels: the counts they stand for, and the sums of all counts.

    p(word) = (c(word) + 0.1) / (all + 0.1 (V + 1)), and p(word | previous) =
    (c(previous, word) + s p(word)) / (c(previous) + s + f V); f V is what the V words are expected to
    count in false finds.  Over all words and one unknown both sum to 1, up to the rounding of levels.
    """

    def __init__(self, sums: np.ndarray, wrong: float, vocabulary: int, texts: int, smoothing: float) -> None:
        words, word_counts, pairs, pair_counts = sums.reshape(4, LEVELS + 1)
        plain = LEAST_COUNT.astype(float)  # of levels nothing is read back with
        mean = lambda n, c: np.append(0.0, np.where(n[1:] > 0, c[1:] / np.maximum(n[1:], 1), plain))
        self.word, self.pair = mean(words, word_counts), mean(pairs, pair_counts)
        self.all = word_counts.sum() + PSEUDO * (vocabulary + 1)
        self.texts, self.smoothing, self.wrong = texts, smoothing, wrong * vocabulary

    def logp(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | previous) by the pairs' levels, the previous ones' counts and the words' levels."""
        both = np.where((before > 0) & (word > 0), self.pair[pair], 0.0)
        return np.log10((both + self.smoothing * (self.word[word] + PSEUDO) / self.all) / (before + self.smoothing + self.wrong))


def lm_scores(docs: DataFrame, train: Column, smoothing: float = 100.0, id_col: str = "doc_id", text_col: str = "text", min_pair_count: int = 1, with_tokens: bool = False) -> DataFrame:
    """Scores of every document by the counts of those for which ``train`` holds.

    Returns id, n_tokens, n_known, train_tokens, base_score and score, and with ``with_tokens`` logp, the
    tokens' shares of the score in their order.  ``score`` is the sum of log10 p(word | previous) of
    ``Model`` over the tokens; c(previous) is exact for the ``HEAD`` most frequent words.  Null texts count as
    empty (one token, the end).  Repeated rows and ids, null ids too, stay apart.  A text is always scored
    whole, in one task.  Other columns aren't read.  Without training rows every count is 0 and N = V = 0.
    Word pairs below ``min_pair_count`` aren't stored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)), F.count_if("train")).first()
    cells, room = max(1, -(-size // CELL)), BLOCK_BITS // BITS_A_MEMBER
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-size // SLICE)))))

    def ask_cells(key: tuple, part: pa.Table) -> pa.Table:
        return ask(key[0].as_py(), part.column("text"), part.column("train").to_numpy(), cells)

    def answer_slices(part: pa.Table) -> pa.Table:
        return answer(part, min_pair_count, room)

    asked = rows.groupBy("slice").applyInArrow(ask_cells, "cell int, slice bigint, words int, h binary, c binary")
    answers = materialise(asked.groupBy("cell").applyInArrow(answer_slices, "slice bigint, cell int, words int, levels binary, word_h array<bigint>, word_n array<bigint>, sums array<double>, wrong double"), "answers")
    own_rows = answers.where("slice IS NULL")
    words = own_rows.select(F.explode(F.arrays_zip("word_h", "word_n")).alias("t")).select(F.col("t.word_h").alias("h"), F.col("t.word_n").alias("n"))
    n_all, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    share = n_all + PSEUDO * (v + 1)
    sums = np.zeros(4 * (LEVELS + 1))
    for r in own_rows.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        sums[r["at"]] = r["x"]
    model = Model(sums, own_rows.agg(F.avg("wrong")).first()[0] or 0.0, v, texts, smoothing)
    head = words.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    hh, hc = head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(hh)
    sent = spark.sparkContext.broadcast((np.append(hh[order], np.uint64((1 << 64) - 1)), np.append(hc[order], 0), model))
    kinds = {"row": pa.int64(), "id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "tail_h": pa.list_(pa.int64()), "tail_n": pa.list_(pa.int64())}
    if with_tokens:
        kinds["logp"] = pa.list_(pa.float64())

    def run(key: tuple, part: pa.Table, got: pa.Table) -> pa.Table:
        common, cs, model = sent.value
        own = Slice(part.column("text"))
        got = got.sort_by("cell")
        split = [(np.frombuffer(x, np.uint8), k) for x, k in zip(got.column("levels").to_pylist(), got.column("words").to_pylist(), strict=True)]
        stored, stored_pair = np.concatenate([x[:k] for x, k in split]), np.concatenate([x[k:] for x, k in split])
        place = np.searchsorted(common, own.u)
        inside = common[place] == own.u
        c = np.where(inside, cs[place], 0)
        base = np.where(inside, np.log10((c + PSEUDO) / share), 0.0)
        context = np.where(inside, c, model.word[stored])
        context[own.start] = model.texts
        logp = model.logp(stored_pair[own.pair], context[own.prev], stored[own.word])
        rare = ~inside[own.word]
        tail, kn = np.unique(own.doc[rare].astype(np.int64) << 32 | own.word[rare], return_counts=True)
        at = pa.array(np.searchsorted(tail, np.arange(len(own.n) + 1, dtype=np.int64) << 32), pa.int32())
        columns = [
            pa.array((key[0].as_py() << 32) + np.arange(len(own.n))), part.column("id"), pa.array(own.n), pa.array(np.add.reduceat((c > 0)[own.word].astype(np.int64), own.first)),
            pa.array(np.add.reduceat(base[own.word], own.first)), pa.array(np.add.reduceat(logp, own.first)),
            pa.ListArray.from_arrays(at, pa.array(own.u[tail & 0xFFFFFFFF].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(kn.astype(np.int64))),
        ]
        if with_tokens:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(own.first, len(logp)), pa.int32()), pa.array(logp)))
        return pa.table(columns, names=list(kinds))

    told = answers.where("slice IS NOT NULL").select("slice", "cell", "words", "levels")
    schema = "row bigint, id bigint, n_tokens bigint, known bigint, base double, score double, tail_h array<bigint>, tail_n array<bigint>" + ", logp array<double>" * with_tokens
    scored = materialise(rows.drop("train").groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, schema), "scored")
    sent.destroy()
    rare = scored.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("k"))
    found = rare.join(words, "h", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + PSEUDO) / F.lit(share))).alias("rest")
    )
    both = scored.where("size(tail_h) > 0").join(found, "row").unionByName(scored.where("size(tail_h) = 0").withColumns({"more": F.lit(0).cast("bigint"), "rest": F.lit(0.0)}))
    out = both.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"), (F.col("base") + F.col("rest")).alias("base_score"), "score", *["logp"] * with_tokens)
    return out
