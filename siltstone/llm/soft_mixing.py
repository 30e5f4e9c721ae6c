"""Mixing documents to target weights of domains they belong to in part (operator 5).

A classifier learned from a labelled table gives each document a posterior over domains.  Documents get
nonnegative rates such that the expected tokens of each domain, sum of rate x tokens x posterior, come
as near as possible, in least squares, to the targets, by projected gradient descent from rates of 1:

    rate <- clip(rate - sum_k posterior_k g_k),  g_k = (total_k - target_k) / total_k at rates of 1

In these units (tokens as the metric, each domain by its own size) the largest eigenvalue is 1, so the
step of 1 is safe.  A rate is a fold over the steps' g and depends on the posterior alone, so totals are
kept by posterior on a grid of ``GRID`` steps: every iteration is one aggregation over a table whose size
the grid bounds, and rates are an expression on a document's own row, without a join.

DataFrame expressions only; what comes to the driver are word lists, moments and totals of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, materialise

GRID, STEPS, TOLERANCE, LEXICON = 1000, 60, 1e-4, 64
LABELLED_ROWS, LEAST_ROWS = 6000, 500
BLANK = r"[ \t\n\x0B\f\r]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _plain(text: Column) -> Column:
    """Words in lower case without the signs around them, for the lexicons."""
    return F.split(F.lower(text), r"[\s\p{Punct}]+")


class Classifier:
    """One logistic function for each domain over some numbers of a text, scaled to sum to one."""

    def __init__(self, domains: list[str], lexicons: list[list[str]], weights: list[list[float]], learned: list[bool]) -> None:
        self.domains, self.lexicons, self.weights, self.learned = domains, lexicons, weights, learned

    @staticmethod
    def inputs(rows: DataFrame, text: str, lexicons: list[list[str]]) -> tuple[DataFrame, list[Column]]:
        """Rows with what the inputs are made from, and the inputs.

        1; shares of capitals, of signs, of distinct words; word length; number of words; lexicon hits.
        Word arrays and the words of any lexicon are columns of their own, so they are made once.
        """
        known = sorted({w for own in lexicons for w in own})
        rows = rows.withColumns({"_words": _words(F.col(text)), "_hits": F.array_intersect(_plain(F.col(text)), _strings(known)) if known else F.array().cast("array<string>")})
        n = F.greatest(F.length(text), F.lit(1)).cast("double")
        some = F.greatest(F.size("_words"), F.lit(1)).cast("double")
        share = lambda those: (F.length(text) - F.length(F.regexp_replace(text, those, ""))) / n
        hits = [F.log1p(F.size(F.array_intersect("_hits", _strings(own))).cast("double")) if own else F.lit(0.0) for own in lexicons]
        return rows, [F.lit(1.0), 3 * share("[A-Z]+"), 3 * share(r"[!-/:-@\[-`{-~]+"), F.size(F.array_distinct("_words")) / some, F.log1p(n / some), F.log1p(some) / 5, *hits]

    def one(self, inputs: list[Column], i: int) -> Column:
        own = self.weights[i]
        return self._sigmoid(sum((x * w for x, w in zip(inputs[1:], own[1:], strict=True)), F.lit(own[0])))

    @staticmethod
    def _sigmoid(at: Column) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))

    def posterior(self, inputs: list[Column]) -> list[Column]:
        ones = [self.one(inputs, i) for i in range(len(self.domains))]
        return [x / sum(ones[1:], ones[0]) for x in ones]


def _strings(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _ints(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _dot(v: Column, weights: list[float]) -> Column:
    own = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(F.zip_with(v, own, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """A small linear system by elimination with pivots."""
    n, m = len(b), [[*row, y] for row, y in zip(a, b, strict=True)]
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[top] = m[top], m[i]
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (m[i][n] - sum(m[i][j] * out[j] for j in range(i + 1, n))) / m[i][i]
    return out


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = LABELLED_ROWS, rounds: int = 7, ridge: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Learn from ``labelled`` (id, domain); about ``rows`` of its documents, chosen by a hash.

    Of a domain that would come to less than ``LEAST_ROWS`` in these, as many more are taken, and weigh less.
    Lexicons are the words whose presence tells a domain most (at most ``LEXICON`` each); the logistic
    functions are fitted by Newton's method, each round one aggregation.  Without labelled rows every
    posterior is equal.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("domain").alias("domain"))
    have = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    part = min(1.0, rows / max(sum(have.values()), 1))
    own = {d: min(1.0, max(part, LEAST_ROWS / n)) for d, n in have.items()}
    bound, weight = F.lit(0), F.lit(1.0)
    for d, x in own.items():
        bound, weight = F.when(F.col("domain") == d, int((1 << 30) * x)).otherwise(bound), F.when(F.col("domain") == d, part / x).otherwise(weight)
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = materialise(texts.join(F.broadcast(chosen), "id"), "labelled")  # a sample of bounded size
    sizes = {r["domain"]: r["count"] for r in held.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier(domains, [[] for _ in domains], [[0.0] * (6 + len(domains)) for _ in domains], [False] * len(domains))
    seen = held.select("domain", F.explode(F.array_distinct(_plain(F.col("text")))).alias("word")).where("word <> '' AND length(word) < 40").groupBy("word").agg(F.count(F.lit(1)).alias("all"), *(F.count(F.when(F.col("domain") == d, 1)).alias(f"in_{i}") for i, d in enumerate(domains)))
    seen_table = materialise(seen.where(F.col("all") >= 5), "seen")
    seen = seen_table.coalesce(4)
    lexicons = []
    for i, d in enumerate(domains):
        p = sizes.get(d, 0) / total
        z = (F.col(f"in_{i}") - F.col("all") * p) / F.sqrt(F.col("all") * max(p * (1 - p), 1e-9))
        lexicons.append([r["word"] for r in seen.select("word", z.alias("z")).where("z > 5").orderBy(F.desc("z"), "word").limit(LEXICON).collect()])
    wide, inputs = Classifier.inputs(held, "text", lexicons)
    inputs_table = materialise(wide.select("domain", weight.alias("w"), F.array(*inputs).alias("v")), "inputs")
    x = inputs_table.coalesce(4)
    k = len(inputs)
    weighed = {d: n * part / own[d] for d, n in sizes.items()}
    total = sum(weighed.values())
    weights = [[math.log((weighed.get(d, 0) + 0.5) / (total - weighed.get(d, 0) + 0.5)), *[0.0] * (k - 1)] for d in domains]
    # Entries (a, b) of each second-derivative matrix; (a, -1) of each gradient.
    entries = [(a, b) for a in range(k) for b in (-1, *range(a, k))]
    entry = F.explode(F.arrays_zip(_ints([a for a, _ in entries]), _ints([b for _, b in entries])))
    for _ in range(rounds):
        ones = F.array(*(F.struct(F.lit(i).alias("i"), Classifier._sigmoid(_dot(F.col("v"), own)).alias("s"), F.when(F.col("domain") == d, 1.0).otherwise(0.0).alias("y")) for i, (d, own) in enumerate(zip(domains, weights, strict=True))))
        each = x.select("w", "v", F.explode(ones).alias("o")).select("w", "v", "o", entry.alias("e")).select("o.*", "w", "v", F.col("e.0").alias("a"), F.col("e.1").alias("b"))
        term = F.when(F.col("b") < 0, (F.col("y") - F.col("s"))).otherwise(F.col("s") * (1 - F.col("s")) * F.element_at("v", F.greatest(F.col("b"), F.lit(0)) + 1))
        got = {(r["i"], r["a"], r["b"]): r["t"] for r in each.groupBy("i", "a", "b").agg(F.sum(F.col("w") * term * F.element_at("v", F.col("a") + 1)).alias("t")).collect()}
        moved = 0.0
        for i in range(len(domains)):
            keep = lambda a: ridge * total * (a > 0) + 1e-9
            grad = [got[i, a, -1] - keep(a) * weights[i][a] for a in range(k)]
            hess = [[got[i, min(a, b), max(a, b)] + keep(a) * (a == b) for b in range(k)] for a in range(k)]
            step = _solve(hess, grad)
            most = max(map(abs, step))
            weights[i] = [w + s * min(1.0, 8.0 / max(most, 1e-12)) for w, s in zip(weights[i], step, strict=True)]
            moved = max(moved, most)
        if moved < 1e-3:
            break
    discard(held, seen_table, inputs_table)
    return Classifier(domains, lexicons, weights, [sizes.get(d, 0) > 0 for d in domains])


def _rate(p: Column, steps: list[list[float]], most: float | None) -> Column:
    """The rate after the steps, for a posterior ``p`` (array): a fold over a literal."""
    flat = F.split(F.lit(";".join(",".join(map(repr, s)) for s in steps)), ";") if steps else F.array().cast("array<string>")

    def one(rate: Column, step: Column) -> Column:
        moved = F.aggregate(F.zip_with(p, F.split(step, ",").cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        new = F.greatest(F.lit(0.0), rate - moved)
        return F.least(F.lit(float(most)), new) if most is not None else new

    return F.aggregate(flat, F.lit(1.0), one)


class Mix:
    """Rates for documents: an expression on the text."""

    def __init__(self, model: Classifier, steps: list[list[float]], most: float | None, totals: list[float], targets: list[float], reached: list[float]) -> None:
        self.model, self.steps, self.most = model, steps, most
        self.totals, self.targets, self.reached = totals, targets, reached

    def rate(self, p: Column) -> Column:
        return _rate(p, self.steps, self.most)


def score(docs: DataFrame, model: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, _tokens, and _p: the posteriors on the grid.  A null text counts as empty."""
    held = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    made, inputs = Classifier.inputs(held, "_text", model.lexicons)
    wide = made.select(*keep, F.size("_words").cast("bigint").alias("_tokens"), *(c.alias(f"_x{i}") for i, c in enumerate(inputs)))
    p = F.array(*model.posterior([F.col(f"_x{i}") for i in range(len(inputs))]))
    return wide.select(*keep, "_tokens", F.transform(p, lambda v: F.round(v * GRID) / GRID).alias("_p"))


def fit(scored: DataFrame, model: Classifier, shares: Mapping[str, float], most: float | None = None, steps: int = STEPS) -> Mix:
    """Find the steps for documents of ``score``.

    shares: each domain's part of the tokens wanted, scaled to sum to one.  The total wanted is that of
    the documents.  With ``most`` (the greatest rate) 1 or less, the domain wanted most sets it, so that
    it stays whole; domains with less than their share stay whole too, and only those with more are
    thinned.  Domains that weren't learned or have no tokens are left as they are.
    """
    k, whole = len(model.domains), sum(shares.values())
    want = [shares.get(d, 0.0) / whole for d in model.domains]
    cells_table = materialise(scored.groupBy("_p").agg(F.sum("_tokens").alias("_tokens")), "cells")
    n = cells_table.count()
    cells = cells_table.coalesce(max(1, n // 20_000))  # bounded by the grid

    def totals(rate: Column) -> list[float]:
        got = cells.agg(*(F.sum(rate * F.col("_tokens") * F.element_at("_p", i + 1)).alias(f"t{i}") for i in range(k))).first()
        return [float(x or 0.0) for x in got]

    start = totals(F.lit(1.0))
    total = sum(start)
    targets = [w * total for w in want]
    if most is not None and most <= 1:
        there = [a and t > 0 for a, t in zip(model.learned, start, strict=True)]
        first = max((i for i in range(k) if there[i]), key=lambda i: want[i], default=None)
        total = start[first] / want[first] if first is not None and want[first] else 0.0
        targets = [most * (min(t, w * total) if a else t) for t, w, a in zip(start, want, there, strict=True)]
    now, done = start, []
    for _ in range(steps):
        if max((abs(t - g) / max(s, 1.0) for t, g, s in zip(now, targets, start, strict=True)), default=0.0) < TOLERANCE:
            break
        done.append([(t - g) / s if s > 0 else 0.0 for t, g, s in zip(now, targets, start, strict=True)])
        now = totals(_rate(F.col("_p"), done, most))
    discard(cells_table)
    return Mix(model, done, most, start, targets, now)


def copies(rate: Column, id_col: Column) -> Column:
    """How many times a document is taken: its rate rounded up or down by a hash of its id."""
    return F.floor(rate + (F.pmod(F.xxhash64(id_col, F.lit("copies")), F.lit(1 << 30)) + 0.5) / float(1 << 30)).cast("bigint")


def mixed(docs: DataFrame, labelled: DataFrame, shares: Mapping[str, float], most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mix]:
    """id, n_tokens, a posterior p_<domain> each, rate and n_copies of every document; and the mix.

    Null texts count as empty (no tokens); repeated rows and null ids are kept, one row out for each in;
    domains without labelled documents get posteriors near 0, and their targets aren't met.
    """
    model = train(docs, labelled, list(shares), id_col=id_col, text_col=text_col)
    scored = materialise(score(docs, model, [id_col], text_col), "posteriors")
    mix = fit(scored, model, shares, most)
    out = scored.select(id_col, F.col("_tokens").alias("n_tokens"), *(F.element_at("_p", i + 1).alias(f"p_{d}") for i, d in enumerate(model.domains)), mix.rate(F.col("_p")).alias("rate"))
    return out.withColumn("n_copies", copies(F.col("rate"), F.col(id_col))), mix


def thinned(docs: DataFrame, labelled: DataFrame, shares: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents themselves, mixed with rates of at most 1: each is kept or dropped by its rate.

    Rates are worked out on each row, so rows aren't joined; they are read twice.
    """
    model = train(docs, labelled, list(shares), id_col=id_col, text_col=text_col)
    mix = fit(score(docs, model, [], text_col), model, shares, most=1.0)
    names = docs.columns
    own = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    # A row for each copy: a filter would be pushed below the scores and work them out many times.
    taken = F.explode(F.array_repeat(F.lit(0), copies(mix.rate(F.col("_p")), F.col("_id")).cast("int")))
    rated = score(own, model, ["_row", "_id"], "_t").select("_row", taken)
    return rated.select(*(F.col("_row").getField(c).alias(c) for c in names))
