"""Main text of web pages by the maximum-scoring subsequence (operator 3).

A page becomes a row of words and tags.  A word scores the log-odds of standing in main text, given
the element and the class names around it and whether it is a link's; a tag costs something.  Both
sets of weights are learned from labelled pages; names met within an article have weights of their own,
learned within articles.  One linear scan finds the contiguous region with the greatest sum; blocks
inside it that a named noise element holds (an advert, a comment) are left out, all others stay.

Reading a page is linear in its length, whatever its markup: every search that fails is remembered.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labelled_pages import pages as labelled

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOLDERS = frozenset("article main section nav header footer aside form div ul ol table figure details dialog menu address blockquote a button label".split())
NOISE = frozenset("nav footer aside form dialog menu button label".split())
# Elements whose content is no text of the page; of some an end that is missing is that of the page.
OPAQUE = frozenset("script style title textarea noscript template svg iframe select datalist math object canvas audio video xmp noembed".split())
TO_THE_END = frozenset("script style title textarea iframe xmp noembed".split())
NAME, EDGE = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[\"'>]")
BLANK = " \t\n\r\f"
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARK = re.compile(r"data-(main|rest)\b")
PARTS = re.compile(r"[a-z]+")
# A name such as "site-footer" also counts as its last part, "comment-list" as its first one, as a list
# is but a box; but "has-sidebar" tells a state of the element and is no name of a sidebar.
STATES = frozenset("has with without no not is js hide show hidden open closed".split())
BOXES = frozenset("area bar block body box card container content form group item link list panel section slot unit widget wrap wrapper".split())
# The least score of one stretch of words, so that an advert can't split a text; and of one within an
# article or main element, where even one word after it must outweigh it.
LEAST, LEAST_INSIDE = -8.0, -1.0
LINK = frozenset(("<a", "in <a"))
MARKERS = frozenset(("in", "out", "quote"))


def scan(page: str) -> Iterator[tuple]:
    """("text", from, to), ("open", name, attributes) and ("close", name), in page order."""
    missing: dict[str, int] = {}
    n = len(page)

    def find(what: str, at: int) -> int:
        if at >= missing.get(what, n + 1):
            return -1
        if (got := page.find(what, at)) < 0:
            missing[what] = at
        return got

    def tag_end(at: int) -> int:
        """The place after a tag's ">".  A quoted value may hold one, if its end looks like a value's end."""
        i = at
        while m := EDGE.search(page, i):
            i = m.end()
            if m[0] == ">":
                return i
            j = m.start() - 1
            while j > at and page[j] in BLANK:
                j -= 1
            if page[j] != "=" or (close := find(m[0], i)) < 0:
                continue
            if page.find(">", i, close) < 0 or page[close + 1 : close + 2] in BLANK + "/>":
                i = close + 1
        return n

    at = text = 0
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        m = NAME.match(page, lt + 2 if closing else lt + 1)
        found: tuple | None = None
        if m:
            end, name = tag_end(m.end()), m[0].lower()
            whole = page[end - 1] == ">"
            attributes = page[m.end() : end - whole]
            if whole:  # a tag cut off by the page's end is none
                found = ("close", name) if closing else ("open", name, attributes)
                if name in OPAQUE:
                    found = None
                    if not closing and not attributes.endswith("/"):
                        end = _opaque_end(page, name, end, missing)
        elif page.startswith("<!--", lt):
            ends = [x for x in (find("-->", lt + 2), find("--!>", lt + 4)) if x >= 0]
            end = page.index(">", min(ends)) + 1 if ends else n
        elif page.startswith("<![CDATA[", lt) and (close := find("]]>", lt)) >= 0:
            end = close + 3
        elif after in ("!", "?", "/"):
            close = find(">", lt)
            end = close + 1 if close >= 0 else n
        elif not after:
            end = n
        else:  # a sign of the text
            at = lt + 1
            continue
        if lt > text:
            yield "text", text, lt
        if found:
            yield found
        at = text = end
    if text < n:
        yield "text", text, n


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I)


def _opaque_end(page: str, name: str, at: int, missing: dict[str, int]) -> int:
    """The place after an element's closing tag; without one that of the page, or its opening tag's."""
    key = f"</{name}"
    m = _closing(name).search(page, at) if at < missing.get(key, len(page) + 1) else None
    if m:
        close = page.find(">", m.end())
        return close + 1 if close >= 0 else len(page)
    missing[key] = min(at, missing.get(key, at))
    return len(page) if name in TO_THE_END else at


@lru_cache(8192)
def _short_names(found: str) -> tuple[str, ...]:
    out: dict[str, None] = {}
    for token in found.lower().split():
        parts = [p[:-1] if len(p) > 3 and p.endswith("s") and not p.endswith("ss") else p for p in PARTS.findall(token)]
        if not parts:
            continue
        out["-".join(parts)] = None
        if len(parts) > 1 and not STATES & set(parts):
            out[parts[0] if parts[-1] in BOXES else parts[-1]] = None
    return tuple(out)


def _names(attributes: str) -> tuple[str, ...]:
    found = " ".join("".join(m) for m in NAMES.findall(attributes))
    return _short_names(found) if len(found) < 500 else _short_names.__wrapped__(found)


def _signs(kind: str, attributes: str, above: frozenset[str], known: frozenset[str] | None, lenient: bool) -> frozenset[str]:
    """What is known of words inside an element: what holds it, its kind, its names.

    The outermost article or main element's own names say nothing of its text.  lenient: nor does what
    holds it, nor that a form does.
    """
    inside = "in" in above
    if kind in ("article", "main"):
        if not inside:
            return (frozenset() if lenient else above - {"out"}) | {"in", "<article"}
        own = {f"in .{x}" for x in _names(attributes)}
    else:
        before = "in " if inside else ""
        own = {f"{before}.{x}" for x in _names(attributes)}
        if kind == "a":
            own.add(f"{before}<a")
        elif kind == "blockquote":
            own.add("quote")
        elif kind in NOISE and not (kind == "footer" and "quote" in above) and not (kind == "form" and lenient) or kind == "header" and not inside:
            own.add(f"<{kind}")
    return above | (own if known is None else own & known)


class Weights:
    """Log-odds of the signs and costs of the tags, from labelled pages."""

    def __init__(self, examples: list[str]) -> None:
        good, bad, tag_in, tag_out = Counter(), Counter(), Counter(), Counter()
        total = [0, 0]
        for page in examples:
            for what in read(page):
                if what[0] == "tag":
                    (tag_in if what[2] else tag_out)[what[1]] += 1
                else:
                    n = len(what[1].split())
                    total[what[3]] += n
                    for s in what[2]:
                        (good if what[3] else bad)[s] += n
        self.start = math.log((total[1] + 1) / (total[0] + 1))
        rate = lambda s: math.log((good[s] + 0.5) / (total[1] + 1)) - math.log((bad[s] + 0.5) / (total[0] + 1))
        self.sign = {s: rate(s) for s in good | bad if abs(rate(s)) > 0.2 and s not in ("in", "quote", "in <a")}
        self.known = frozenset(self.sign) | MARKERS | LINK
        outside, inside = sum(tag_out.values()) + 1, sum(tag_in.values()) + 1
        self.tag = {t: min(-0.05, 0.15 * (math.log((tag_in[t] + 0.5) / inside) - math.log((tag_out[t] + 0.5) / outside)) - 0.1) for t in tag_in | tag_out}

    def word(self, signs: frozenset[str]) -> float:
        """Of the signs against main text the strongest counts before any for it."""
        own = [self.sign[s] for s in signs if s in self.sign]
        low, high = min(own, default=0.0), max(own, default=0.0)
        return max(-4.0, min(4.0, self.start + high + (3 * low if low < -0.5 else low)))


def read(page: str, known: frozenset[str] | None = None, lenient: bool = False) -> Iterator[tuple]:
    """("tag", name, marked, breaks a block) and ("text", text, signs, marked), in page order.

    known: the signs that matter; others aren't kept.
    """
    items = list(scan(page))
    has_main = any(x[0] == "open" and x[1] in ("article", "main") for x in items)
    stack: list[tuple[str, frozenset[str], bool]] = []
    open_now: Counter[str] = Counter()
    made: dict[tuple, frozenset[str]] = {}
    signs, marked = frozenset({"out"} if has_main else ()), False
    for item in items:
        if item[0] == "text":
            yield "text", page[item[1] : item[2]], signs, marked
            continue
        kind, name, attributes = (*item, "")[:3]
        yield "tag", name, marked, name not in INLINE
        note = MARK.search(attributes) if "data-" in attributes else None
        if kind == "close":
            while open_now.get(name):
                last, signs, marked = stack.pop()
                open_now[last] -= 1
                if last == name:
                    break
        elif (name in HOLDERS or note) and name not in VOID and not attributes.endswith("/"):
            if name == "a" and stack and stack[-1][0] == "a":
                _, signs, marked = stack.pop()
                open_now["a"] -= 1
            stack.append((name, signs, marked))
            open_now[name] += 1
            key = (name, attributes, signs)
            if (got := made.get(key)) is None:
                got = made[key] = _signs(name, attributes, signs, known, lenient)
            signs = got
            marked = note[1] == "main" if note else marked


@cache
def default_weights() -> Weights:
    return Weights(labelled())


def _best(page: str, weights: Weights, lenient: bool) -> list[str]:
    """The blocks of the region with the greatest sum."""
    known: dict[frozenset[str], tuple[float, bool]] = {}
    items: list[tuple[float, str | None, bool]] = []  # score; text; of a text whether it may stay, of a tag whether it ends a block
    for what in read(page, weights.known, lenient):
        if what[0] == "tag":
            items.append((weights.tag.get(what[1], -0.1), None, what[3]))
        else:
            if (own := known.get(what[2])) is None:
                # Whether a block stays doesn't depend on its words being links.
                own = known[what[2]] = (weights.word(what[2]), weights.word(what[2] - LINK) > 0)
            items.append((max(own[0] * len(what[1].split()), LEAST_INSIDE if "in" in what[2] else LEAST), what[1], own[1]))
    best = total = 0.0
    first = start = 0
    last = -1
    for i, (score, _, _) in enumerate(items):
        total += score
        if total > best:
            best, first, last = total, start, i
        if total <= 0:
            total, start = 0.0, i + 1
    if last < 0:
        return []
    # The region takes whole blocks: a link at a paragraph's edge belongs to it.
    ends_block = lambda i: items[i][1] is None and items[i][2]
    while first and not ends_block(first - 1):
        first -= 1
    while last + 1 < len(items) and not ends_block(last + 1):
        last += 1
    blocks, own = [], []
    for _, text, flag in [*items[first : last + 1], (0.0, None, True)]:
        if text is not None:
            if flag:
                own.append(html.unescape(text))
        elif flag and own:
            if block := " ".join("".join(own).split()):
                blocks.append(block)
            own = []
    return blocks


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The blocks of the best region, a line each; null or no main text: empty.

    If the elements around an article would rule all text out, they and any form don't count.
    """
    if not page:
        return ""
    weights = weights or default_weights()
    return "\n".join(_best(page, weights, False) or _best(page, weights, True))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the kept columns, text and n_chars (code points) of every page.

    Null html counts as empty; a page without main text has an empty text.  Repeated rows and null ids
    are kept; an empty table gives an empty result.  A page is read whole in time linear in its length
    and a few times its size of memory.  Other columns aren't read; kept ones may not be named as the
    result's own, which raises ValueError.
    """
    if taken := {"text", "n_chars", id_col} & set(keep):
        raise ValueError(f"columns of these names are in the result: {sorted(taken)}")
    rows = pages.select(F.col(id_col).cast("bigint").alias(id_col), *keep, F.col(html_col).cast("string").alias("_html"))
    weights = default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [main_text(x, weights) for x in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (id_col, *keep)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, *keep, "text", "n_chars"])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:-1])
    return rows.mapInArrow(run, f"`{id_col}` bigint{kept}, text string, n_chars bigint")
