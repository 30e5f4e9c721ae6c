"""Quality scores by attention-based multiple-instance learning (operator 1).

A document is a bag of passages of ``PASSAGE`` words.  A passage is described by shares of byte classes,
by its words hashed to ``HASHED`` buckets and by word statistics, encoded by a learned layer, and weighted
by gated attention learned from the documents' labels alone; the weighted sum of the encodings gives the
document's score.  The model has a fixed size and is broadcast; documents are scored where they are read,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import mix64, span_hashes, utf8
from siltstone.llm.decontaminate import LOWER
from siltstone.llm.token_counts import slices

PASSAGE, SLICE = 100, 2 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def _classes() -> np.ndarray:
    """The class of each byte: each ASCII sign its own, letters and digits by kind, bytes over 127 by lead."""
    out, n = np.zeros(256, np.int64), 0
    for b in range(256):
        if chr(b).isalnum() and b < 128 and b not in (0x30, 0x41, 0x61):
            out[b] = out[0x30 if b < 0x3A else 0x41 if b < 0x61 else 0x61]
        elif 0x01 <= b < 0x20 and b != 10:
            out[b] = out[0]
        elif b > 0x80 and b != 0xC0:
            out[b] = out[0x80 if b < 0xC0 else 0xC0]
        else:
            out[b], n = n, n + 1
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
EXTRA, HASHED = 7, 64
WIDTH = N_CLASSES + EXTRA + HASHED
#: Passages of one document that are used to fit, evenly spaced over it.
MOST_PASSAGES = 16


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of all texts, and where each text's passages start.

    A text without words is one passage without words.
    """
    inside = ~SPACES[data]
    filled = np.diff(at) > 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][filled]] = False
    after[at[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    upto = np.searchsorted(starts, at)
    n = np.diff(upto)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    total = int(first[-1])
    text = np.repeat(np.arange(len(n)), n)
    order = np.arange(len(starts)) - upto[:-1][text]
    own = first[:-1][text] + order // PASSAGE
    out = np.zeros((total, WIDTH), np.float32)
    # Bytes belong to the passage of the word they follow.
    heads = np.flatnonzero(order % PASSAGE == 0)
    edge = np.zeros(total, np.int64)
    edge[own[heads]] = starts[heads]
    edge[first[:-1]] = at[:-1]
    size = np.diff(np.append(edge, len(data)))
    hist = np.bincount(np.repeat(np.arange(total), size) * N_CLASSES + CLASS[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(hist / np.maximum(size, 1)[:, None])
    if not len(starts):
        return out, first
    words = span_hashes(LOWER[data], starts, ends)
    per = np.bincount(own, minlength=total)
    some = np.maximum(per, 1)
    kinds = np.unique(mix64(words + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(own[kinds], minlength=total)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    seen = np.unique(mix64(words + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)[1]
    new = np.bincount(own[seen], minlength=total)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(own, length, total) / some
    out[:, N_CLASSES] = distinct / some
    out[:, N_CLASSES + 1] = np.bincount(own, again, total) / some
    out[:, N_CLASSES + 2] = new / some
    out[:, N_CLASSES + 3] = np.log1p(mean)
    out[:, N_CLASSES + 4] = np.sqrt(np.maximum(np.bincount(own, length**2, total) / some - mean**2, 0)) / 8
    out[:, N_CLASSES + 5] = np.log1p(per) / 5
    out[:, N_CLASSES + 6] = np.bincount(own, length <= 3, total) / some
    buckets = np.bincount(own * HASHED + (words % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
    out[:, N_CLASSES + EXTRA :] = np.sqrt(buckets / some[:, None])
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """encode: e = tanh(x A + a); weigh: softmax over w . (tanh(e V) * sigmoid(e U)); score: sigmoid(bag . c + d)."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.p = parts

    @staticmethod
    def start(width: int, hidden: int = 32, gate: int = 16, seed: int = 7) -> AttentionModel:
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, a**-0.5, (a, b))
        return AttentionModel({"A": draw(width, hidden), "a": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1), "mean": np.zeros(width), "scale": np.ones(width)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, heads = self.p, first[:-1]
        z = np.clip((x - p["mean"]) / p["scale"], -6, 6)
        e = np.tanh(z @ p["A"] + p["a"])
        t, s = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        g = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(heads)), np.diff(first))
        g = np.exp(g - np.maximum.reduceat(g, heads)[bag])
        att = g / np.add.reduceat(g, heads)[bag]
        pooled = np.add.reduceat(att[:, None] * e, heads)
        return {"z": z, "e": e, "t": t, "s": s, "att": att, "bag": bag, "pooled": pooled, "y": _sigmoid(pooled @ p["c"] + p["d"][0])}

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        """Of the mean logistic loss with squared weights."""
        p, f, heads = self.p, self.forward(x, first), first[:-1]
        dy = (f["y"] - label) / len(label)
        grad = {"c": f["pooled"].T @ dy, "d": np.array([dy.sum()])}
        dpool = (dy[:, None] * p["c"])[f["bag"]]
        de = f["att"][:, None] * dpool
        datt = (dpool * f["e"]).sum(1)
        dg = f["att"] * (datt - np.add.reduceat(f["att"] * datt, heads)[f["bag"]])
        grad["w"] = (f["t"] * f["s"]).T @ dg
        both = dg[:, None] * p["w"]
        dt, ds = both * f["s"] * (1 - f["t"] ** 2), both * f["t"] * f["s"] * (1 - f["s"])
        grad["V"], grad["U"] = f["e"].T @ dt, f["e"].T @ ds
        de = (de + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["e"] ** 2)
        grad["A"], grad["a"] = f["z"].T @ de, de.sum(0)
        return {k: v + decay * p[k] for k, v in grad.items()}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-5) -> None:
        """Adam over whole passes."""
        self.p["mean"], self.p["scale"] = x.mean(0), x.std(0) + 1e-2
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            for k, g in self.gradient(x, first, label, decay).items():
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                self.p[k] = self.p[k] - rate * (one[k] / (1 - 0.9**i)) / (np.sqrt(two[k] / (1 - 0.99**i)) + 1e-9)


def train(docs: DataFrame, labels: DataFrame, rows: Column, sample: int = 4000, most_passages: int = MOST_PASSAGES, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", **options: int) -> AttentionModel:
    """Fit on labelled documents for which ``rows`` holds.

    About ``sample`` of them at most, chosen by a hash of the id; what comes to the driver are the features
    of their passages, of at most ``most_passages`` of each, evenly spaced, so a long text has its part
    in the fit and takes no more room than others.  A document labelled more than once counts by its mean
    label; null ids and labels aren't used.
    """
    known = labels.where(rows & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1))))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = texts.join(F.broadcast(chosen), "id")  # a sample of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            rows = []
            for a, b in slices(np.diff(at).tolist(), SLICE):
                x, first = passages(data[at[a] : at[b]], at[a : b + 1] - at[a])
                for i, n in zip(first[:-1], np.diff(first), strict=True):
                    used = min(int(n), most_passages)
                    rows.append(x[i + np.arange(used) * n // used].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, pa.binary())], names=["id", "label", "x"])

    got = sorted(tuple(r) for r in held.mapInArrow(run, "id bigint, label int, x binary").collect())
    model = AttentionModel.start(WIDTH)
    if got:
        bags = [np.frombuffer(x, "<f4").reshape(-1, WIDTH) for _, _, x in got]
        first = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
        model.fit(np.concatenate(bags).astype(np.float64), first, np.array([y for _, y, _ in got], float), **options)
    return model


def quality_scores(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted, and the attention of each passage, for every whole text.

    Null texts count as empty, and an empty text as one passage without words; a very long text is scored
    whole.  Repeated rows and null ids are kept, equal texts score alike, and a score of 0.5 is predicted
    1.  Columns other than id and text aren't read, whatever their names.  An empty table gives an empty
    result; without training rows the scores are those of the untrained model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = AttentionModel(sent.value)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for a, b in slices(np.diff(at).tolist(), SLICE):
                x, first = passages(data[at[a] : at[b]], at[a : b + 1] - at[a])
                f = own.forward(x, first)
                att = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(f["att"].astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(f["y"]), pa.array((f["y"] >= 0.5).astype(np.int32)), att], names=["id", "score", "predicted", "attention"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id bigint, score double, predicted int, attention array<float>").withColumnRenamed("id", id_col)
