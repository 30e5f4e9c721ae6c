"""N-gram Jaccard join with a MinHash LSH forest (operator 7).

Documents with equal sets of word shingles form a class; only one of each goes on.  Its minhash values
are its paths in ``TREES`` prefix tries: ``DEEPEST`` values of 16 bits a tree, written so that paths sort
as bytes and a prefix is a substring.  A trie's level is a grouping by prefix.  All documents are grouped
at the shortest prefix that may be needed; who is alone there has no neighbour in that tree, and only
nodes of more than ``SMALL`` documents are looked at further down.  Each document then starts from the
longest prefixes and shortens them, in all trees together and nodes with few members first, until a pair
at the threshold is met with the wanted recall, given the depths it has come to in its trees (``choose``).
Documents below one node take its shortest choice, so what meets doesn't depend on who asks.

Candidates are verified exactly, each pair in one place.  The nodes' members are first linked to their
least member (never to each other), and the connected groups this gives hold every candidate pair, so a
document's shingles are sent to its group once.  A large group is cut into tiles of two blocks of at most
about ``TILE`` documents and ``TILE_BYTES`` of shingles each, which separate tasks verify by a product of
sparse incidence rows, so no task holds more than two blocks.  If a group is so loose that its nodes
together hold far fewer pairs than it, its nodes are tiled instead, and a pair counts in the first tree
in which it meets.  A task returns each document's number of links and a spanning forest of them: pairs
are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, keyed_join, leaves_room, materialise, mix64, release, utf8
from siltstone.llm.decontaminate import kgrams, words
from siltstone.llm.token_counts import slices

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 24, 9, 0.995
#: Nodes of at most so many documents aren't looked at further down.
SMALL = 8
TILE, TILE_BYTES, SLICE = 512, 16 << 20, 1 << 18


def met_within(depths: Sequence[int], threshold: float) -> float:
    """How often a pair at the threshold shares a prefix of those lengths, one a tree, in some tree."""
    return 1 - float(np.prod([1 - threshold**d for d in depths]))


def depths_for(threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """The prefix lengths of the forest, shortest first.

    The shortest is one less than the longest that would do alone in all trees, so that trees with long
    prefixes can be made up for; the longest is two more.  A recall that prefixes of one value can't
    reach raises ValueError.
    """
    enough = [d for d in range(1, DEEPEST + 1) if met_within([d] * TREES, threshold) >= recall]
    if not enough:
        raise ValueError(f"{TREES} trees can't reach a recall of {recall} at a similarity of {threshold}")
    return list(range(max(1, enough[-1] - 1), min(DEEPEST, enough[-1] + 2) + 1))


def choose(sizes: np.ndarray, depths: Sequence[int], threshold: float, recall: float) -> np.ndarray:
    """Of each document the place in ``depths`` of its prefix in each tree (documents x trees).

    sizes: members of its nodes (documents x trees x depths).  A document takes in each tree the shortest
    prefix with at most c members, and the longest where all have more; c is doubled until its trees
    meet a pair at the threshold with the wanted recall.
    """
    miss = np.log1p(-(float(threshold) ** np.asarray(depths, float)) + 1e-300)
    out, left, c = np.zeros(sizes.shape[:2], np.int64), np.arange(len(sizes)), SMALL
    while len(left):
        fits = sizes[left] <= c
        some, at = fits.any(2), fits.argmax(2)
        reached = np.where(some, miss[at], 0.0).sum(1) <= np.log(1 - recall)
        out[left[reached]] = np.where(some, at, len(depths) - 1)[reached]
        left, c = left[~reached], 2 * c
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's start.

    A text of fewer than ``size`` words, but not none, has one shingle of all its words.
    """
    w, own = words(data, at)
    n = np.diff(own)
    text = np.repeat(np.arange(len(n)), n)
    h = kgrams(w, size)
    if len(h):
        whole = text[: len(h)] == text[size - 1 :]
        h, t = h[whole], text[: len(h)][whole]
    else:
        t = np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.array([kgrams(w[own[i] : own[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short], np.uint64)
        h, t = np.concatenate((h, extra)), np.concatenate((t, short))
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[first], t[first]
    return h, np.searchsorted(t, np.arange(len(n) + 1))


_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 32, TREES * DEEPEST, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint32)


def paths(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of each text's path in every tree (texts x TREES * 2 DEEPEST); zeros without shingles."""
    filled = np.diff(at) > 0
    starts = at[:-1][filled]
    out = np.zeros((len(at) - 1, TREES * DEEPEST), ">u2")
    if len(starts):
        low = ((h >> np.uint64(32)) ^ (h & np.uint64(0xFFFFFFFF))).astype(np.uint32)
        values = np.zeros((len(starts), TREES * DEEPEST), np.uint16)
        for i in range(TREES * DEEPEST):
            x = low * _A[i]
            x ^= x >> np.uint32(15)
            x += _B[i]
            x *= np.uint32(0x2C1B3C6D)
            values[:, i] = np.minimum.reduceat(x, starts) & np.uint32(0xFFFF)
        out[filled] = values
    return out.view(np.uint8)


def signatures(docs: DataFrame) -> DataFrame:
    """id, n (shingles), same (a 128-bit digest of the shingle set), paths (those of all trees, end to end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(np.diff(offsets).tolist(), SLICE):
                h, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                own, n = paths(h, at), np.diff(at)
                both = np.zeros((b - a, 2), np.uint64)
                if len(h):
                    starts = at[:-1][n > 0]
                    both[n > 0, 0] = np.add.reduceat(mix64(h), starts)
                    both[n > 0, 1] = np.add.reduceat(mix64(h ^ np.uint64(0x94D049BB133111EB)), starts)
                same = [x.tobytes() for x in both]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], names=["id", "n", "same", "paths"])

    return docs.mapInArrow(leaves_room(run), "id bigint, n bigint, same binary, paths binary")


def shingle_rows(docs: DataFrame) -> DataFrame:
    """id and the shingle set of each text, as ascending 64-bit integers in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(np.diff(offsets).tolist(), SLICE):
                h, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(leaves_room(run), "id bigint, shingles binary")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(id, root): the least id each id is connected with, for ids that have an edge (a, b).

    Large-star and small-star steps in turn; each step's edges are written to the shared folder, and
    their number never exceeds that of the edges given.  Centres with many edges don't go to one task.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    marks = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = now.agg(*marks).first()
    while True:
        least = both(now).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size"))
        # Both steps start from a written table: plans would double with each use of the one before.
        large = keyed_join(both(now).where("v > u"), least, ["u"], 2 * mark[0]).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        down = materialise(large.where("u <> v").distinct(), tag)
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))
        small = keyed_join(down, low, ["u"], mark[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, materialise(small, tag)
        discard(before, down)
        was, mark = mark, now.agg(*marks).first()
        if was == mark:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """The forest's nodes with at least two documents: id, tree, key (the node), least (id), size, bytes.

    classes: rep, n (shingles), paths.
    """
    depths = depths_for(threshold, recall)
    prefix = lambda d: F.substring("path", 1, 2 * d)
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.expr("paths").substr(t * (2 * DEEPEST) + 1, F.lit(2 * DEEPEST)).alias("path"))))
    leaves = classes.select(F.col("rep").alias("id"), "n", each.alias("l")).select("id", "n", "l.tree", "l.path")
    total = TREES * classes.count()
    inside = (F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), (F.sum("n") * 8).alias("bytes"))
    nodes = materialise(leaves.groupBy("tree", prefix(depths[0]).alias("prefix")).agg(*inside).where("size > 1"), "nodes")
    met = materialise(keyed_join(leaves.withColumn("prefix", prefix(depths[0])), nodes, ["tree", "prefix"], total), "met")
    key = lambda c: F.xxhash64(F.lit(len(depths)), c).alias("key")
    few = met.where(F.col("size") <= SMALL).select("id", "tree", key(F.col("prefix")), "least", "size", "bytes")
    crowded = met.where(F.col("size") > SMALL)
    rows = crowded.count()
    if not rows:
        return _done(few, nodes, met)
    deeper = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), prefix(d).alias("sub")) for i, d in enumerate(depths) if i)))
    below = crowded.select("id", "tree", deeper.alias("d")).select("id", "tree", "d.*")
    counted = below.groupBy("tree", "at", "sub").agg(F.count(F.lit(1)).alias("size"))
    sized = keyed_join(below, counted, ["tree", "at", "sub"], rows * (len(depths) - 1)).select("id", "tree", "at", "size")
    sized = sized.unionByName(crowded.select("id", "tree", F.lit(0).alias("at"), "size")).groupBy("id").agg(F.collect_list(F.struct("tree", "at", "size")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("of")
            flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), n)
            tree, at, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("tree", "at", "size"))
            sizes = np.ones((len(n), TREES, len(depths)), np.int64)
            sizes[doc, tree, at] = size
            got = choose(sizes, depths, threshold, recall)
            own = at == 0
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc[own])), pa.array(tree[own], pa.int32()), pa.array(got[doc[own], tree[own]], pa.int32())], names=["id", "tree", "at"])

    chosen = materialise(sized.mapInArrow(run, "id bigint, tree int, at int"), "chosen")
    placed = crowded.select("id", "n", "tree", "path", "prefix").join(chosen, ["id", "tree"])
    shortest = placed.groupBy("tree", "prefix").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("size"))
    placed = keyed_join(placed.drop("at"), shortest, ["tree", "prefix"], rows)
    cut = F.lit(None).cast("binary")
    for i, d in enumerate(depths):
        cut = F.when(F.col("at") == i, prefix(d)).otherwise(cut)
    placed = materialise(placed.select("id", "n", "tree", key(cut)), "placed")
    groups = placed.groupBy("tree", "key").agg(*inside).where("size > 1")
    many = keyed_join(placed.drop("n"), groups, ["tree", "key"], rows)
    return _done(few.unionByName(many.select(*few.columns)), nodes, met, chosen, placed)


def _done(out: DataFrame, *temporary: DataFrame) -> DataFrame:
    out = materialise(out, "candidates")
    discard(*temporary)
    return out


def _incidence(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 0 and 1 over the shingles that at least two of the sets have."""
    flat = np.concatenate(sets)
    values, back, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    shared = n[back] > 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), int((n > 1).sum())), np.float32)
    out[row[shared], column[back[shared]]] = 1
    return out


def verify(ids: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, keys: np.ndarray | None, tree: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each document within a tile (to ``copies`` documents each), and a spanning forest of them.

    left: for tiles of two blocks, which rows are of the first (pairs across count); else all pairs.
    keys: of each document its node in each tree (0: none); only pairs that meet in no tree before ``tree``
    count.  Columns are taken in strips, so memory
    is bounded whatever the texts' length.
    """
    n = len(ids)
    common = np.zeros((n, n), np.float32)
    strip = max(1, int(4e6 // max(n, 1)))
    full = np.concatenate(sets)
    cuts = np.quantile(full, np.linspace(0, 1, max(2, len(full) // strip + 2))).astype(np.uint64) if len(full) > strip else np.array([0, 0], np.uint64)
    for i in range(len(cuts) - 1):
        part = sets if len(cuts) == 2 else [s[np.searchsorted(s, cuts[i]) if i else 0 : np.searchsorted(s, cuts[i + 1]) if i < len(cuts) - 2 else len(s)] for s in sets]
        x = _incidence(part)
        common += x @ x.T
    size = np.array([len(s) for s in sets], np.float64)
    ok = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    ok &= ids[:, None] != ids[None, :]
    if left.any() and not left.all():
        ok &= left[:, None] != left[None, :]
    if keys is not None and tree:
        a, b = np.nonzero(np.triu(ok, 1))
        met = ((keys[a, :tree] == keys[b, :tree]) & (keys[a, :tree] != 0)).any(1)
        ok[a[met], b[met]] = ok[b[met], a[met]] = False
    forest, seen = [], np.zeros(n, bool)
    for start in range(n):
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(ok[at] & ~seen)
            seen[new] = True
            todo += new.tolist()
            forest += [(int(ids[at]), int(ids[j])) for j in new]
    return ok @ copies, forest


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links, copy_of, n_copies: one row for each document.

    n_links: other documents whose shingle sets have a Jaccard similarity of at least ``threshold``
    (equal sets count).  class_id: the least id that links lead to.  copy_of: the least id with the same
    shingle set, n_copies how many have it.  A text without words is linked to nothing and a class of its
    own.  Rows of one id are one document (of its longest text, and of these the greatest); null ids are
    left out, as they name no document.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = materialise(signatures(rows).groupBy("id").agg(F.max_by(F.struct("n", "same", "paths"), F.struct("n", "same")).alias("s")).select("id", "s.*"), "signatures")
    classes = signed.where("n > 0").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"))
    classes = materialise(classes, "classes")
    met = candidates(classes, threshold, recall)
    groups = materialise(components(met.select(F.col("id").alias("a"), F.col("least").alias("b")), "groups"), "grouped")
    weighed = groups.join(classes.select(F.col("rep").alias("id"), "n"), "id")
    sizes = weighed.groupBy("root").agg(F.count(F.lit(1)).alias("members"), (F.sum("n") * 8).alias("weight"))
    # A node's members share a root: that of its least member.
    work = met.where("id = least").select("id", "tree", "key", "size").join(groups, "id").groupBy("root").agg(F.sum(F.col("size").cast("double") ** 2).alias("pairs"))
    plan = materialise(sizes.join(work, "root").select("root", "members", "weight", ((F.col("members") > TILE) & (F.col("members").cast("double") ** 2 > 4 * F.col("pairs"))).alias("loose")), "plan")
    placed = groups.join(plan, "root")
    tight = placed.where("not loose").select("id", F.lit(-1).alias("tree"), F.col("root").alias("key"), F.col("members").alias("size"), F.col("weight").alias("bytes"))
    loose = met.join(placed.where("loose").select("id"), "id").select("id", "tree", "key", "size", "bytes")
    # Blocks of a group and the tiles each takes part in: (i, j) for i <= j.
    spread = tight.unionByName(loose).withColumn("blocks", F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("id", "tree"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = spread.select("id", "tree", "key", "block", other.alias("other"))
    tiles = tiles.select("id", "tree", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    texts = rows.join(groups.select("id").distinct(), "id", "left_semi")
    sets = shingle_rows(texts).groupBy("id").agg(F.max_by("shingles", F.struct(F.octet_length("shingles"), F.col("shingles"))).alias("shingles"))
    nodes_of = met.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("m"))  # at most one a tree
    keys = nodes_of.select("id", F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0).cast("bigint"))).alias("keys"))
    sets = materialise(sets.join(classes.select(F.col("rep").alias("id"), "copies"), "id").join(keys, "id"), "shingles")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        release()
        tree, _, i, j = key
        ids = part["id"].to_numpy(np.int64)
        own = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        marks = np.stack(part["keys"].to_numpy()) if tree >= 0 else None
        left = part["block"].to_numpy() == i if i != j else np.zeros(len(ids), bool)
        if i != j and left.all() or not len(ids):
            return pd.DataFrame({"id": [], "links": [], "to": []}, dtype=np.int64)
        n, forest = verify(ids, own, part["copies"].to_numpy(np.int64), left, marks, int(tree), threshold)
        out = pd.DataFrame({"id": ids, "links": n, "to": ids})
        edges = pd.DataFrame({"id": [a for a, _ in forest], "links": 0, "to": [b for _, b in forest]}, dtype=np.int64)
        return pd.concat([out[out["links"] > 0], edges])

    found = materialise(tiles.join(sets, "id").groupBy("tree", "key", "i", "j").applyInPandas(run, "id bigint, links bigint, to bigint"), "links")
    discard(met, groups, plan, sets)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")), "linked")
    by_class = classes.select("same", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = by_class.select("same", F.col("rep").alias("copy_of"), F.col("copies").alias("n_copies"), F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = signed.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("copy_of"), F.lit(1).cast("bigint").alias("n_copies"))
    rest = signed.where("n > 0").select("id", "same").join(by_class, "same").select("id", "class_id", "n_links", "copy_of", "n_copies")
    out = rest.unionByName(alone).withColumnRenamed("id", id_col)
    out._temporary = (signed, classes, found)
    return out


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the near copies: of each class the one with the least id stays, all columns kept.

    Of rows of one id one stays; rows with a null id, which name no document, all stay.
    """
    found = jaccard_join(docs, threshold, id_col=id_col, text_col=text_col)
    gone = materialise(found.where(F.col(id_col) != F.col("class_id")).select(id_col), "gone")
    discard(*found._temporary)
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if twice.isEmpty():
        return kept
    rest = kept.join(twice, id_col, "left_anti")
    chosen = kept.join(twice, id_col, "left_semi").groupBy(id_col).agg(F.max_by(F.struct(*docs.columns), F.struct(F.length(text_col), F.col(text_col))).alias("_row"))
    return rest.unionByName(chosen.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))).select(*docs.columns)
