"""Language identification with spans (operator 8).

A word's script narrows the languages it may belong to; its score for each of those is the smoothed
log-likelihood of its letter trigrams.  Viterbi over a text's words, with a penalty for each switch,
labels spans; the language with most letters is the text's.  Where no span of another language can
gain half a switch, the path of the best single language is the best path, and the search is skipped.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import kept, leaves_room, utf8
from siltstone.llm.token_counts import slices


# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)),
}
NAMES = list(SCRIPTS)
#: Words a worker keeps with their scores at most: some 50 MB with four languages.
BUCKETS, CACHE, LEAST_ROWS = 1 << 15, 300_000, 32
#: Bytes of text cut into words at once by the filter.
SLICE = 1 << 18
UNDETERMINED = "und"
_ranges = sorted((a, b, i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_STARTS = np.array([a for a, _, _ in _ranges], np.uint32)
_ENDS = np.array([b for _, b, _ in _ranges], np.uint32)
_KINDS = np.array([i for _, _, i in _ranges])
#: A word is a run of letters (and of number signs that aren't decimal digits, which count for nothing).
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Of each code point its script's place in ``SCRIPTS``; their number for any other."""
    at = np.maximum(np.searchsorted(_STARTS, codes, "right") - 1, 0)
    return np.where((codes >= _STARTS[at]) & (codes <= _ENDS[at]), _KINDS[at], len(NAMES))


def describe(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some words (with letters): trigram buckets, the word of each trigram, number of letters, commonest script."""
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    h = (joined[:-2] * np.uint32(7919) + joined[1:-1] * np.uint32(263) + joined[2:]) * np.uint32(2654435761)
    word = np.repeat(np.arange(len(words)), size + 2)
    whole = word[:-2] == word[2:]
    buckets = (h >> np.uint32(7)).astype(np.int64) % BUCKETS
    inner = (joined != 2) & (joined != 3)
    per = np.bincount(word[inner] * (len(NAMES) + 1) + scripts_of(joined[inner]), minlength=len(words) * (len(NAMES) + 1)).reshape(len(words), -1)
    return buckets[whole], word[:-2][whole], size, per.argmax(1)


class Model:
    """languages; log-likelihood of a trigram bucket by language; which scripts each language uses."""

    def __init__(self, languages: list[str], table: np.ndarray, uses: np.ndarray, switch: float = 12.0, weight: float = 0.7) -> None:
        self.languages, self.switch, self.uses = languages, switch, uses
        self.table = (table - table.mean(1, keepdims=True)) * weight if len(languages) else table
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((1 << 16, len(self.languages)), np.float32)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.strange = np.zeros(1 << 16, bool)

    def learn(self, words: list[str]) -> None:
        """Score words not met before.  A script that no language uses says nothing."""
        n = len(self.at)
        while len(self.scores) < n + len(words):
            self.scores, self.sizes = np.concatenate((self.scores, np.zeros_like(self.scores))), np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.strange = np.concatenate((self.strange, np.zeros_like(self.strange)))
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        plain = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
        some = np.array([i for i, w in enumerate(plain) if w], np.int64)
        if not len(some):
            return
        buckets, word, size, script = describe([plain[i] for i in some])
        score = np.add.reduceat(self.table[buckets], np.flatnonzero(np.diff(word, prepend=-1))).clip(-8, 8)
        may = self.uses[script]
        score = np.where(may.any(1, keepdims=True), np.where(may, score, -20.0), 0.0)
        self.scores[n + some], self.sizes[n + some], self.strange[n + some] = score, size, ~may.any(1)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of scores, the number of letters, and whether no language uses its script, for each word."""
        new = list(set(words).difference(self.at))
        if len(self.at) + len(new) > CACHE:
            self.forget()
            new = list(set(words))
        if new:
            self.learn(new)
        idx = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return self.scores[idx].astype(np.float64), self.sizes[idx].astype(np.int64), self.strange[idx]

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best label for each word: the sum of scores less ``switch`` for each change is greatest."""
        n, k = s.shape
        total = s.sum(0)
        best = int(total.argmax())
        run = np.cumsum(s - s[:, best : best + 1], 0)
        low = np.minimum.accumulate(np.vstack((np.zeros((1, k)), run[:-1])), 0)
        if k == 1 or (run - low).max() <= self.switch / 2:
            return np.full(n, best)
        v, back = s[0].copy(), np.empty((n, k), np.int32)
        stay = np.arange(k)
        for t in range(1, n):
            top = int(v.argmax())
            jump = v[top] - self.switch > v
            back[t] = np.where(jump, top, stay)
            v = np.where(jump, v[top] - self.switch, v) + s[t]
        out = np.empty(n, np.int64)
        out[-1] = v.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def labels(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Of each text its language, score from 0 to 1, and spans (first word, word after the last, language)."""
        return [own for own, _ in self.told(texts)]

    def told(self, texts: list[str | None]) -> list[tuple[tuple[str, float, list[tuple[int, int, str]]], float]]:
        """The labels, and the part of each text's letters in words of a script some language uses."""
        cut = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in cut]).tolist()
        if not self.languages or not ends or not ends[-1]:
            return [((UNDETERMINED, 0.0, []), 0.0)] * len(texts)
        s, sizes, strange = self.lookup([w for own in cut for w in own])
        all_to, used_to = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(sizes * ~strange))
        parts = [(b - len(own), b) for own, b in zip(cut, ends, strict=True)]
        return [(self._label(s[a:b], sizes[a:b]), float((used_to[b] - used_to[a]) / max(all_to[b] - all_to[a], 1))) for a, b in parts]

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        return self.labels([text])[0]

    def _label(self, s: np.ndarray, sizes: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        if not sizes.any():
            return UNDETERMINED, 0.0, []
        path = self.path(s)
        share = np.bincount(path, weights=sizes, minlength=len(self.languages))
        total = s.sum(0)
        best = max(range(len(self.languages)), key=lambda k: (share[k], total[k], self.languages[k]))
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        spans = [(a, b, self.languages[int(path[a])]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        sure = 1.0 / np.exp(np.clip(total - total[best], -700, 700)).sum() if len(spans) == 1 else 1.0
        return self.languages[best], float(share[best] / share.sum() * sure), spans


def _worker_model(key: str, parts: tuple) -> Model:
    """A worker's model with the words it has met."""
    return kept(key, lambda: Model(*parts, 1.0))


def train(docs: DataFrame, rows: Column, sample: int = 8000, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", **options: float) -> Model:
    """Learn from the rows for which ``rows`` holds and language and text aren't null.

    About ``sample`` of them, as many of each language as far as it has them (and ``LEAST_ROWS`` at
    least), chosen by a hash of the id (null ids by chance); what comes to the driver is a count for each language, and for
    each language and trigram bucket.
    """
    usable = docs.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    sizes = usable.groupBy("lang").count().collect()
    each = max(LEAST_ROWS, sample // max(len(sizes), 1))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, each / r["count"]))) for r in sizes], "lang string, bound bigint")
    chosen = usable.join(F.broadcast(bounds), "lang").where(F.when(F.col("id").isNull(), F.rand(11) * (1 << 30)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 30))) < F.col("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            out: list[tuple[str, int, int]] = []
            for lang, own in seen.items():
                met = [(w, c) for w, c in own.items() if w.isalpha()]
                if not met:
                    continue
                n = np.array([c for _, c in met])
                buckets, word, size, script = describe([w for w, _ in met])
                counts = np.bincount(buckets, n[word], BUCKETS + len(NAMES) + 1) + np.bincount(BUCKETS + script, n * size, BUCKETS + len(NAMES) + 1)
                out += [(lang, int(i), int(counts[i])) for i in np.flatnonzero(counts)]
            langs, at, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["lang", "at", "n"])

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in got})
    counts = np.zeros((BUCKETS + len(NAMES) + 1, len(languages)))
    for r in got:
        counts[r["at"], languages.index(r["lang"])] = r["n"]
    seen, scripts = counts[:BUCKETS], counts[BUCKETS:]
    table = np.log((seen + 0.2) / (seen.sum(0) + 0.2 * BUCKETS)) if languages else np.zeros((BUCKETS, 0))
    uses = scripts >= 0.02 * np.maximum(scripts.sum(0), 1)
    return Model(languages, table, uses, **options)


def label_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and spans of every whole text.

    ``und`` with score 0 and no spans where the text is null or has no letter (or nothing was learned).
    Repeated rows and null ids are kept, and an empty table gives an empty result; of languages that tie the
    one that sorts last is taken.  A text is read whole, with a row of scores for each word in memory.
    Other columns aren't read.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.uses, model.switch)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker_model(key, sent.value)
        span = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                got = own.labels(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([[dict(zip(("first", "after", "lang"), x, strict=True)) for x in g[2]] for g in got], span)], names=["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, lang_pred string, score double, spans array<struct<first int, after int, lang string>>").withColumnRenamed("id", id_col)


def filter_languages(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text", known: float = 0.0, given: str | None = None, sure: float = 0.9) -> DataFrame:
    """The documents whose language could be told with a score of at least ``least``, all columns kept.

    known: the least part of a text's letters in words of a script that some learned language uses.
    given: the column of the language a document is said to have.  Where that is another learned language
    than the text's, told with a score of at least ``sure``, the document goes; where it is null, the
    text's is filled in.  A text that is null or has no letter goes; repeated rows are told apart by nothing
    and share their fate; an empty table stays empty.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.uses, model.switch)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker_model(key, sent.value)
        learned = set(own.languages)
        for batch in batches:
            for a, b in slices(np.diff(utf8(batch.column(text_col))[1]).tolist(), SLICE):
                part = batch.slice(a, b - a)
                got = own.told(part.column(text_col).to_pylist())
                keep = [g[0] != UNDETERMINED and g[1] >= least and used >= known for g, used in got]
                if given:
                    said = part.column(given).to_pylist()
                    keep = [k and not (x in learned and x != g[0] and g[1] >= sure) for k, x, (g, _) in zip(keep, said, got, strict=True)]
                    told = pa.array([g[0] if x is None else x for x, (g, _) in zip(said, got, strict=True)], part.schema.field(given).type)
                    part = part.set_column(part.schema.get_field_index(given), part.schema.field(given), told)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(leaves_room(run), docs.schema)
