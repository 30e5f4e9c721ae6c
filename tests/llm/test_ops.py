"""The training-data operators against brute force, round trips and held-out accuracy.

Fixtures hold nulls, empty texts, ties, repeated rows, a very long text and columns with clashing names.
"""

import hashlib
import html
import json
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import attention_quality, bloom_lm, common, decontaminate, html_text, language_id, lsh_forest, lz_fingerprint, packed_ids, soft_mixing, token_counts
from siltstone.llm.common import ordered, ordered_with_next, table
from siltstone.llm.queries import SHARES, domains, oracle_sql, queries, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def awkward():
    """doc_id, text: nulls, empties, ties, copies, near copies, a very long text."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, prose(100 + i, 40 + i)) for i in range(30)]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "One."), (34, "Größe über alles"), (35, "12 34 !!"), (36, "中文"), (37, prose(9, 60_000))]
    rows += [(40 + i, base) for i in range(5)] + [(50, " ".join(near)), (51, base.upper() + "!"), (52, base + " one two")]
    return [(*r, f"s{r[0] % 3}", "clash", -r[0]) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), "doc_id bigint, text string, source string, id string, row bigint").repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in awkward()}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# -- 9, 4: tokens


def pieces(seed, alphabet, n=1500):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(14))) for _ in range(n)]


SIGNS = [*" \n\t\r" * 3, *"abTheS,.123'", "é", "Ñ", "中", "\0", "\x1c", "<|endoftext|>", "<|", "İ", "Σ", "é", "́", "²", "½", "\xa0", " ", "'s", "_", "▁", "</s>", "\r\n", "     "]


def test_piece_counts_equal_whole_encoding():
    own = token_counts.counter(vocabulary("piece_bpe_32k.model"))
    assert own.safe
    some = [*pieces(1, SIGNS), prose(2, 5000), "", "x" * 5000]
    assert own.counts(some) == [len(own.model.encode(t)) for t in some]


def test_word_ids_equal_whole_encoding():
    own = packed_ids.WordEncoder(vocabulary("word_bpe_49k.json"))
    assert own.safe
    some = [*pieces(3, SIGNS), prose(4, 5000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == [x.ids for x in own.model.encode_batch(some, add_special_tokens=False)]


def test_token_counts(docs, empty, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model")).collect()}
    model = token_counts.counter(vocabulary("piece_bpe_32k.model")).model
    want = {k: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for k, t in texts.items()}
    assert got == want and token_counts.token_counts(empty, vocabulary("piece_bpe_32k.model")).count() == 0
    assert token_counts.token_counts(docs.limit(2), vocabulary("byte_bpe_50k.json")).count() == 2


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = packed_ids.pack(ids, bits)
    assert len(data) == math.ceil(1001 * bits / 8) and (packed_ids.unpack(data, bits, 1001) == ids).all()
    assert packed_ids.bits_for(49408) == 16 and packed_ids.bits_for(2) == 1 and packed_ids.bits_for(65537) == 17


def test_shards_give_random_access(tmp_path):
    r = np.random.default_rng(0)
    docs = [(i, r.integers(0, 5000, r.integers(0, 90)).astype("<u4")) for i in range(200)]
    writer = packed_ids.ShardWriter(13, 5000, block=64)
    (tmp_path / "x").write_bytes(b"".join(writer.chunks((i, x.tobytes()) for i, x in docs)))
    shard, flat = packed_ids.Shard(str(tmp_path / "x")), np.concatenate([x for _, x in docs])
    for _ in range(50):
        a, b = sorted(r.integers(0, len(flat) + 1, 2).tolist())
        assert (shard.ids(a, b) == flat[a:b]).all()
    assert shard.docs.tolist() == list(range(200)) and shard.tokens == len(flat)


def test_written_ids_are_read_back_in_order(spark, docs, empty, texts):
    more = docs.unionByName(docs.where("doc_id = 33")).unionByName(docs.where("doc_id = 34").withColumn("doc_id", F.lit(None).cast("bigint")))
    folder = packed_ids.write_ids(more, vocabulary("word_bpe_49k.json"))
    got = [tuple(r) for r in packed_ids.read_ids(spark, folder).collect()]
    model, start, want = packed_ids.encoder(vocabulary("word_bpe_49k.json")).model, 0, []
    for k, t in sorted([*texts.items(), (33, texts[33]), (None, texts[34])], key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((k, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert packed_ids.read_ids(spark, packed_ids.write_ids(empty, vocabulary("word_bpe_49k.json"))).count() == 0
    assert packed_ids.read_ids(spark, folder, True).where("size(ids) <> n_tokens").count() == 0


def in_partitions(laid):
    parts = {}
    for r in laid.withColumn("p", F.spark_partition_id()).collect():
        parts.setdefault(r["p"], []).append(r)
    return [parts[p] for p in sorted(parts)]


def in_order(r):
    return r["k"] is not None, r["k"] or 0, r["v"]


def test_ordered_partitions_follow_each_other(spark):
    rows = spark.createDataFrame([(r * 37 % 1000 if r % 97 else None, str(r)) for r in range(3000)], "k bigint, v string")
    flat = [r for part in in_partitions(ordered(rows, "k", "v")) for r in part]
    assert [in_order(r) for r in flat] == sorted(map(in_order, rows.collect()))
    parts = in_partitions(ordered_with_next(rows, "k", "v"))
    own = [[r for r in part if not r["_extra"]] for part in parts]
    flat = [in_order(r) for part in own for r in part]
    assert flat == sorted(map(in_order, rows.collect())) and len(own) == 4
    for part, following in zip(parts, own[1:] + own[:1], strict=True):
        extra = [r for r in part if r["_extra"]]
        assert part[-len(extra) :] == extra and in_order(extra[0]) == in_order(following[0])
    assert ordered(rows.where("false"), "k", "v").count() == ordered_with_next(rows.where("false"), "k", "v").count() == 0


@pytest.mark.parametrize("kind", ["outlier", "nulls", "repeats"])
def test_ordered_partitions_are_even(spark, monkeypatch, kind):
    """One far id, a third of the ids null, or a third of them one id: no partition holds twice the mean."""
    monkeypatch.setattr(common, "ROWS_PER_PARTITION", 2000)
    key = {"outlier": "IF(id = 7, 1152921504606846976, id)", "nulls": "IF(id % 3 = 0, NULL, id)", "repeats": "IF(id % 3 = 0, 5, id)"}[kind]
    rows = spark.range(26_000).selectExpr(f"{key} AS k", "md5(string(id)) AS v")
    for laid in (ordered(rows, "k", "v"), ordered_with_next(rows, "k", "v").where("NOT _extra")):
        sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 26_000 and len(sizes) == 13 and max(sizes) < 2 * 2000


def test_the_shared_folder_is_not_made_up_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, other: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


# -- 10


def lz_phrases(data):
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_parses_are_those_of_the_textbook():
    for data in (b"", b"a", b"abababab" * 20, prose(5, 300).encode()):
        p, at, got = lz_fingerprint.Parse(), 0, set()
        half = len(data) // 2
        ends = p.feed(data[:half])
        spare = p.branch(b"something else")
        ends += p.branch(data[half:])
        for e in ends:
            got.add(data[at:e])
            at = e
        assert got == lz_phrases(data) and len(spare) > 0


def test_fingerprints(docs, empty, texts):
    got = {r["doc_id"]: r for r in lz_fingerprint.fingerprints(docs).collect()}
    order = sorted(texts)
    for k, following in zip(order, order[1:] + order[:1], strict=True):
        t, nxt, r = texts[k] or "", texts[following] or "", got[k]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b = lz_phrases(t.encode()), lz_phrases(edited.encode())
        if len(a) <= lz_fingerprint.SIZE > len(b) and (a or b):
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 1e-9
    assert len({got[i]["fingerprint"] for i in range(40, 45)}) == 1 and got[41]["near_next"] == 1.0
    assert got[37]["near_edited"] > 0.4 > got[37]["near_next"] and lz_fingerprint.fingerprints(empty).count() == 0


# -- 2


def brute_hits(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        k = min(8, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), len(hit), found


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_every_shared_window_is_found(spark, block_bytes):
    r = random.Random(0)
    items = [(i, " ".join(f"x{r.randrange(6)}" for _ in range(n))) for i, n in enumerate([0, 1, 3, 7, 8, 9, 12, 30, 60, 60])] + [(99, None), (8, "Extra, words of one id again here")]
    docs = [(i, " ".join(f"x{r.randrange(6)}" for _ in range(r.randrange(200)))) for i in range(40)] + [(50, None), (51, ""), (52, items[8][1].upper()), (53, "say " + items[9][1] + ". " + items[7][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    for x in got:
        n, hit, found = brute_hits(dict(docs)[x["doc_id"]], items)
        names = sorted(map(str, found))
        assert (x["n_words"], x["n_hit"], x["n_items"]) == (n, hit, len(found)), x
        assert x["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and x["contaminated"] == (len(found) >= 2) and x["items"] == names
        assert sum(s["after"] - s["first"] for s in x["spans"]) == hit
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    clean = decontaminate.drop_contaminated(df, benchmark, block_bytes=block_bytes, least_words=1)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(x["doc_id"] for x in got if not x["n_items"])
    long = [(i, t) for i, t in items if len(words(t)) >= 8]
    clean = decontaminate.drop_contaminated(df.withColumn("items", F.lit("clash")), benchmark, block_bytes=block_bytes)
    assert clean.columns == ["doc_id", "text", "items"] and sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, t in docs if not brute_hits(t, long)[2])
    nothing = decontaminate.contamination(df, spark.createDataFrame([], "item_id bigint, text string"))
    assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == len(docs)


def test_items_of_a_common_word_and_long_or_repeated_documents(spark):
    items = spark.createDataFrame([(i, "the") for i in range(500)] + [(1000, prose(3, 20)), (1000, prose(3, 20))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "the " * 20_000), (1, "the " * 20_000), (None, None), (2, prose(8, 50_000) + " " + prose(3, 20)), (3, "clean")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert got[1]["n_hit"] == 20_000 and got[1]["n_items"] == 500 and got[2]["n_items"] == 1 and got[2]["n_hit"] >= 20 and got[None]["n_words"] == 0
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()]
    assert sorted(kept, key=str) == [1, 1, 3, None]


# -- 7


def brute_links(texts):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links, root = Counter(), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, {k: find(k) for k in sets}


def test_the_join_finds_the_links_of_brute_force(spark, docs, empty, texts):
    r, extra = random.Random(4), {}
    for g in range(6):
        base = prose(500 + g, 150)
        for i in range(5):
            w = base.split()
            for _ in range(i):
                w[r.randrange(150)] = f"edit{r.randrange(10**6)}"
            extra[1000 + 10 * g + i] = " ".join(w)
    both = docs.select("doc_id", "text", "id").unionByName(spark.createDataFrame([(k, t, "") for k, t in extra.items()], "doc_id bigint, text string, id string"))
    got = {x["doc_id"]: x for x in lsh_forest.jaccard_join(both).collect()}
    links, roots = brute_links(texts | extra)
    assert {k: x["n_links"] for k, x in got.items()} == {k: links[k] for k in got} and {k: x["class_id"] for k, x in got.items()} == roots
    assert len(got) == len(texts) + len(extra) and got[41]["copy_of"] == 40 and got[41]["n_copies"] == 6
    assert lsh_forest.jaccard_join(empty).count() == 0
    twice = both.unionByName(both.where("doc_id < 5")).unionByName(both.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("bigint")))
    kept = [x["doc_id"] for x in lsh_forest.drop_near_copies(twice).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({k for k, c in roots.items() if k == c}) and kept.count(None) == 1


@pytest.mark.parametrize("tile", [4, 512])
def test_large_groups_are_tiled_without_loss(spark, monkeypatch, tile):
    monkeypatch.setattr(lsh_forest, "TILE", tile)
    r, base, texts = random.Random(5), prose(77, 200).split(), {}
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(200)] = f"e{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    got = {x["doc_id"]: x for x in lsh_forest.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    links, roots = brute_links(texts)
    off = sum(abs(got[k]["n_links"] - links[k]) for k in texts)
    assert off <= 0.01 * sum(links.values()) and {k: x["class_id"] for k, x in got.items()} == roots


def test_prefixes_are_shortened_until_the_recall_is_reached():
    depths = lsh_forest.depths_for()
    assert depths == [6, 7, 8, 9] and lsh_forest.met_within([7] * lsh_forest.TREES, 0.8) >= lsh_forest.RECALL > lsh_forest.met_within([8] * lsh_forest.TREES, 0.8)
    r = np.random.default_rng(6)
    sizes = np.sort(np.exp(r.uniform(0, 12, (300, lsh_forest.TREES, 4)) * r.random((300, 1, 1))).astype(np.int64), 2)[:, :, ::-1]
    at = lsh_forest.choose(sizes, depths, 0.8, lsh_forest.RECALL)
    for own, chosen in zip(sizes, at, strict=True):
        assert lsh_forest.met_within([depths[i] for i in chosen], 0.8) >= lsh_forest.RECALL
        # No shorter than needed: with half the members allowed the recall isn't reached.
        c = max((own[t, i] for t, i in enumerate(chosen) if i < 3), default=1)
        fewer = [next((d for d, s in zip(depths, x, strict=True) if s <= max(c // 4, 4)), None) for x in own]
        assert c <= 2 * lsh_forest.SMALL or lsh_forest.met_within([d for d in fewer if d], 0.8) < lsh_forest.RECALL
    assert (lsh_forest.choose(np.ones((1, lsh_forest.TREES, 4), np.int64), depths, 0.8, lsh_forest.RECALL) == 0).all()
    assert len(set(at.ravel().tolist())) == 4
    with pytest.raises(ValueError):
        lsh_forest.depths_for(0.05)


@pytest.mark.parametrize("crowd", [0, 300])
def test_recall_near_the_threshold(spark, crowd):
    """Pairs with a similarity of 0.8 to 0.9 against brute force; crowd: among many texts with a common half."""
    r, texts, wanted = random.Random(12), {}, set()
    common = prose(5, 100, 10**6).split()
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    while len(wanted) < (120 if crowd else 600):
        base = ((common if crowd else []) + [f"v{r.randrange(10**6)}" for _ in range(120)])[-180:]
        other = list(base)
        for _ in range(r.choice([1, 2, 2, 3])):
            other[r.randrange(len(base))] = f"e{r.randrange(10**6)}"
        a, b = sets(base), sets(other)
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            k = len(texts)
            texts[k], texts[k + 1] = " ".join(base), " ".join(other)
            wanted.add((k, k + 1))
    for i in range(crowd):
        texts[len(texts)] = " ".join([*common, *(f"u{r.randrange(10**6)}" for _ in range(60))])
    got = {x["doc_id"]: x for x in lsh_forest.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    links, _ = brute_links(texts)
    assert sum(got[a]["class_id"] == got[b]["class_id"] for a, b in wanted) >= 0.99 * len(wanted)
    found, all_links = sum(x["n_links"] for x in got.values()), sum(links.values())
    assert 0.99 * all_links <= found <= all_links and all(got[k]["n_links"] <= links[k] for k in got)


def test_hot_centres_are_joined_like_all_others(spark):
    r = random.Random(3)
    edges = [(i, 0) for i in range(1, 3000)] + [(5000 + i, 5000 + i + 1) for i in range(40)] + [(r.randrange(6000, 9000), r.randrange(6000, 9000)) for _ in range(1500)]
    root = {k: k for e in edges for k in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["id"]: x["root"] for x in lsh_forest.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    assert got == {k: find(k) for k in {x for e in edges if e[0] != e[1] for x in e}}


# -- 6


def test_base_scores_are_exact_and_the_filter_keeps_every_count(spark, docs, empty, texts, monkeypatch):
    monkeypatch.setattr(bloom_lm, "HEAD", 50)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r for r in bloom_lm.lm_scores(docs, ~held).collect()}
    tok = lambda t: [*((t or "").encode().lower().split()), 0]
    train = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10 for w in tok(t))
    n, v = sum(train.values()), len(train)
    for k, t in texts.items():
        own, r = tok(t), got[k]
        want = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and -math.inf < r["score"] < 0
    assert bloom_lm.lm_scores(empty, ~held).count() == 0
    alone = bloom_lm.lm_scores(docs.limit(3), F.lit(False)).collect()
    assert len(alone) == 3 and all(r["n_known"] == 0 for r in alone)


def test_stored_counts_are_never_too_low():
    r = np.random.default_rng(1)
    h = bloom_lm.mix64(r.integers(0, 1 << 63, 500).astype(np.uint64))
    q = bloom_lm.levels(r.integers(1, 10_000, 500))
    f = bloom_lm.LogBloom(1, bloom_lm.LogBloom.build_block(h, q))
    assert (f.levels(h) >= q).all() and (f.levels(h) == q).mean() > 0.95
    far = r.integers(0, 1 << 63, 200_000).astype(np.uint64)
    assert abs((f.levels(far) > 0).mean() - f.false_rate()) < 0.2 * f.false_rate() + 1e-4
    counts = np.arange(1, 10**6)
    got = bloom_lm.levels(counts)
    assert (got[:9] == counts[:9]).all() and (np.diff(got) >= 0).all() and (np.diff(got) <= 1).all() and bloom_lm.levels(np.array([10**12]))[0] <= bloom_lm.LEVELS < 256
    least = bloom_lm.LEAST_COUNT[got - 1]
    assert (least <= counts).all() and (counts <= least * bloom_lm.BASE + 1).all()


def test_blocks_grow_with_the_members():
    """No level is left out, whatever the number of n-grams."""
    r = np.random.default_rng(2)
    h = bloom_lm.mix64(r.integers(0, 1 << 63, 150_000).astype(np.uint64))
    q = bloom_lm.levels(r.integers(1, 3, 150_000))
    assert (bloom_lm.LogBloom(1, bloom_lm.LogBloom.build_block(h, q)).levels(h) >= q).all()
    f = bloom_lm.LogBloom.build(h, q, bloom_lm.BLOCK_BITS // bloom_lm.BITS_A_MEMBER)
    assert f.blocks > 9 and (f.levels(h) >= q).all() and f.false_rate() < 1e-5


@pytest.mark.parametrize("cell", [1 << 14, 4 << 20])
def test_scores_are_those_of_brute_force_counts(spark, docs, texts, monkeypatch, cell):
    """Counts rounded to levels, in one cell or many; enough bits that hardly any n-gram is found by chance."""
    monkeypatch.setattr(bloom_lm, "CELL", cell)
    monkeypatch.setattr(bloom_lm, "SLICE", 4 * cell)
    monkeypatch.setattr(bloom_lm, "BITS_A_MEMBER", 256)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r["score"] for r in bloom_lm.lm_scores(docs, ~held).collect()}
    tok = lambda t: [1, *((t or "").encode().lower().split()), 0]
    known = [tok(t) for k, t in texts.items() if zlib.crc32(str(k).encode()) % 10]
    one, two = Counter(w for x in known for w in x[1:]), Counter(p for x in known for p in zip(x[:-1], x[1:], strict=True))
    share = sum(one.values()) + 0.1 * (len(one) + 1)
    level = lambda c: int(bloom_lm.levels(np.array([c]))[0])

    def means(counts):
        by_level = {}
        for c in counts.values():
            by_level.setdefault(level(c), []).append(c)
        return {q: sum(x) / len(x) for q, x in by_level.items()}

    word, pair = means(one), means(two)

    def logp(a, b):
        context = len(known) if a == 1 else one[a]
        both = pair[level(two[a, b])] if two[a, b] else 0.0
        return math.log10((both + 100 * ((word[level(one[b])] if one[b] else 0.0) + 0.1) / share) / (context + 100))

    want = {k: sum(logp(a, b) for a, b in zip(tok(t)[:-1], tok(t)[1:], strict=True)) for k, t in texts.items()}
    assert all(abs(got[k] - want[k]) < 1e-3 * abs(want[k]) for k in want), {k: (got[k], want[k]) for k in want}


def test_probabilities_sum_to_one(spark):
    """p(word | previous) over the vocabulary and one unknown word, for common and rare words before."""
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    seen = Counter(w for r in docs for w in (r["text"] or "").lower().encode().split())
    ranked = [w.decode() for w, _ in seen.most_common()]
    before = [*ranked[:5], ranked[200], ranked[2000], ranked[-1]]
    probes = [(-1 - i * 10**6 - j, f"{a} {w}") for i, a in enumerate(before) for j, w in enumerate([*ranked, "unmet-" + "x" * 30])]
    probes += [(-1 - len(before) * 10**6 - i, a) for i, a in enumerate(before)]
    rows = spark.createDataFrame([*((r["doc_id"], r["text"]) for r in docs), *probes], "doc_id bigint, text string")
    got = bloom_lm.lm_scores(rows, F.col("doc_id") >= 0, with_tokens=True).where("doc_id < 0")
    by_id = {r["doc_id"]: r["logp"] for r in got.select("doc_id", "logp").collect()}
    for i, a in enumerate(before):
        total = sum(10 ** by_id[-1 - i * 10**6 - j][1] for j in range(len(ranked) + 1))
        end = 10 ** by_id[-1 - len(before) * 10**6 - i][1]
        assert abs(total + end - 1) < 0.02, (a, total + end)


def test_scores_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None), (3, "a b"), (3, "c"), (4, "a " * 300_000)], "doc_id bigint, text string")
    got = bloom_lm.lm_scores(rows, F.lit(True)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (0, 3), (0, 3), (3, 2), (3, 3), (4, 300_001)]
    assert len({r["score"] for r in got if r["n_tokens"] == 3}) == 1


# -- 8


def test_languages_of_mixed_and_odd_texts(spark):
    r = random.Random(3)
    make = lambda parts: lambda n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
    one, two, three = make(["the", "ing", "er", "an"]), make(["çio", "ñe", "los", "ado"]), make(["и", "нов", "ка", "ший"])
    rows = [(i, f(60), lang) for i, (f, lang) in enumerate([(one, "en"), (two, "es"), (three, "ru")] * 30)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 !! 34", "es"), (203, one(30) + " " + two(80), None), (204, "中文字", None), (205, three(1), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(docs, ~held)
    got = {x["doc_id"]: x for x in language_id.label_languages(docs, model).collect()}
    assert all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 for k, _, lang in rows[:90])
    assert [got[k]["lang_pred"] for k in (200, 201, 202)] == ["und"] * 3 and got[204]["lang_pred"] in ("en", "es", "ru") and got[205]["lang_pred"] == "ru"
    spans = [(s["lang"], s["after"] - s["first"]) for s in got[203]["spans"]]
    assert got[203]["lang_pred"] == "es" and [s[0] for s in spans] == ["en", "es"] and abs(spans[0][1] - 30) < 4
    assert {x["doc_id"] for x in language_id.filter_languages(docs, model).collect()} == {k for k in got if got[k]["lang_pred"] != "und"}
    untrained = language_id.train(docs, F.lit(False))
    assert {x["lang_pred"] for x in language_id.label_languages(docs, untrained).collect()} == {"und"}


def test_the_pipeline_rejects_texts_of_no_learned_language(spark):
    import corpus_pipeline

    texts = ["the thing and the other " * 5, "los niños del año pasado " * 5]
    rows = [(i, texts[i % 2], ("en", "es")[i % 2]) for i in range(40)]
    rows += [(50, "中文字", None), (51, "中文字 " * 9 + "the", None), (52, "the thing and the other 中文", None), (53, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {x["doc_id"] for x in corpus_pipeline.tell_language(spark, docs, "").collect()} == {*range(40), 52}


def test_given_languages_are_held_against_the_texts(spark):
    texts = {"en": "the thing and the other " * 8, "es": "los niños del año pasado " * 8}
    rows = [(i, texts[("en", "es")[i % 2]], ("en", "es")[i % 2], "x") for i in range(40)]
    rows += [(50, texts["en"], "es", "wrong"), (51, texts["es"], None, "filled"), (52, texts["en"], "xx", "unknown"), (52, texts["en"], "xx", "unknown"), (None, None, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    model = language_id.train(docs.where("doc_id < 40"), F.lit(True))
    kept = language_id.filter_languages(docs, model, given="lang").where("doc_id >= 40").collect()
    assert sorted((r["doc_id"], r["lang"], r["lang_pred"]) for r in kept) == [(51, "es", "filled"), (52, "xx", "unknown"), (52, "xx", "unknown")]
    assert language_id.filter_languages(docs.where("false"), model, given="lang").count() == language_id.label_languages(docs.where("false"), model).count() == 0


def test_languages_of_held_out_documents_and_long_texts(spark):
    docs, held = table(spark, SF.replace("0.001", "0.01"), "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(docs, ~held)
    got = language_id.label_languages(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.97
    long = spark.createDataFrame([(1, ("the other thing and " * 50_000))] * 2, "doc_id bigint, text string")
    rows = language_id.label_languages(long, model).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and len(rows[0]["spans"]) >= 1


def test_the_sample_of_null_ids_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('the thing ', id) AS text", "'en' AS lang")
    model = language_id.train(rows, F.lit(True), sample=500)
    assert model.languages == ["en"]


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the thing and the other {i}", "en") for i in range(3000)] + [(5000 + i, "los niños del año pasado", "es") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2)
    model = language_id.train(docs, F.lit(True), sample=40)
    assert model.languages == ["en", "es"] and model.label("del año pasado los niños")[0] == "es"


def test_paths_are_best():
    r = np.random.default_rng(0)
    for _ in range(200):
        s = r.normal(size=(r.integers(1, 40), 4)) * 6
        m = language_id.Model(["a", "b", "c", "d"], np.zeros((language_id.BUCKETS, 4)), np.ones((len(language_id.NAMES) + 1, 4), bool), switch=7.0)
        p, v = m.path(s), s[0]
        for t in range(1, len(s)):
            v = np.maximum(v, v.max() - 7.0) + s[t]
        assert abs(v.max() - (s[np.arange(len(s)), p].sum() - 7.0 * np.count_nonzero(np.diff(p)))) < 1e-9


# -- 1


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(2)
    m = attention_quality.AttentionModel.start(6, 5, 4)
    x, first, y = r.normal(size=(9, 6)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, first)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = m.gradient(x, first, y, 0.0)
    for name, g in grad.items():
        at = tuple(r.integers(0, n) for n in g.shape)
        held, e = m.p[name][at], 1e-6
        m.p[name][at] = held + e
        up = loss()
        m.p[name][at] = held - e
        down = loss()
        m.p[name][at] = held
        assert abs((up - down) / (2 * e) - g[at]) < 1e-6, name


def test_passages_do_not_depend_on_their_neighbours():
    some = ["", "a", " \n", prose(1, 99), prose(2, 101), "Ein Wört " * 150, "x " * 250]
    import pyarrow as pa

    from siltstone.llm.common import utf8

    whole, first = attention_quality.passages(*utf8(pa.array(some)))
    for i, t in enumerate(some):
        own, at = attention_quality.passages(*utf8(pa.array([t])))
        assert np.allclose(own, whole[first[i] : first[i + 1]]) and len(own) == max(1, -(-len(t.split()) // 100))


def test_quality_is_told_on_held_out_documents(spark, empty):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = attention_quality.train(docs, labels, ~held)
    got = attention_quality.quality_scores(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97 and got.score.between(0, 1).all()
    assert attention_quality.quality_scores(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "x")], "doc_id bigint, text string")
    rows = attention_quality.quality_scores(odd, model).collect()
    assert len(rows) == 3 and rows[0]["score"] == rows[1]["score"]


def test_quality_that_shows_in_words_alone_is_learned(spark):
    r = random.Random(4)
    names = [f"{a}{b}{c}" for a in "kst" for b in "aeiou" for c in "lmnr"]
    r.shuffle(names)
    rows = []
    for i in range(1500):
        good = i % 2
        likely = names[:15] if good else names[15:30]
        rows.append((i, " ".join(r.choice(likely if r.random() < 0.4 else names) for _ in range(150)), good))
    given = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = attention_quality.train(given.drop("quality"), given.drop("text"), F.col("doc_id") % 5 > 0)
    got = attention_quality.quality_scores(given, model).join(given, "doc_id").where("doc_id % 5 = 0").toPandas()
    assert len(got) == 300 and (got.predicted == got.quality).mean() > 0.95


def test_scores_are_those_of_each_text_alone(spark, docs, texts):
    import pyarrow as pa

    from siltstone.llm.common import utf8

    model = attention_quality.AttentionModel.start(attention_quality.WIDTH)
    got = {r["doc_id"]: r for r in attention_quality.quality_scores(docs, model).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        f = model.forward(*attention_quality.passages(*utf8(pa.array([t or ""]))))
        assert abs(got[i]["score"] - f["y"][0]) < 1e-6 and len(got[i]["attention"]) == max(1, -(-len((t or "").split()) // 100))
    model.p["c"][:] = 0
    assert {(r["score"], r["predicted"]) for r in attention_quality.quality_scores(docs, model).collect()} == {(0.5, 1)}


def test_long_texts_are_used_to_fit(spark):
    rows = [(i, ("low words here " if i % 2 else "Some Other, Text. ") * (80_000 if i % 2 else 40), i % 2) for i in range(8)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(2)
    model = attention_quality.train(given, given, F.lit(True), label_col="quality", steps=60)
    got = attention_quality.quality_scores(given, model).collect()
    assert len(got) == 8 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


# -- 3

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad --><div class="ad">Buy now, buy here!</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;part   <b>bold</b> of
it.<p>Second <a href="#">linked</a> part &eacute;&#233;.</p><div class="advert">Not this one.</div><p>Third.</p>
<section class="comments"><p>I say so too and so does my aunt.</p></section></article><aside><p>Other reads for you.</p></aside>
<form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""


def test_the_article_without_the_rest():
    assert html_text.main_text(PAGE) == "Title & more\nFirst part bold of it.\nSecond linked part éé.\nThird."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text(PAGE[: PAGE.index("linked")] + "link</") == "Title & more\nFirst part bold of it.\nSecond link"


def test_given_pages_equal_their_articles(spark):
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") + 9 :].split("</article>")[0]
        parts = re.split(r"<(?!/?b>)[^>]*>", re.sub(r"<[^>]*$", "", body))
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in parts) if x)
        assert got[r["page_id"]] == (want, len(want))
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", PAGE)], "page_id bigint, url string, html string")
    assert html_text.extract(odd).count() == 3


ARTICLE = """<h1>Title</h1><p>Some words of the article stand here and more of them follow.</p><p><a href="#">Only a link</a></p>
<h2><a href="#">A linked heading</a></h2><ul><li><a href="a">one</a></li><li><a href="b">two more</a></li></ul><section class="legal"><p>Of law.</p></section>
<div class="todo-list post"><p>Named, but no noise.</p></div><div class="ad-slot">Buy now.</div><p>The end.</p>"""
ARTICLE_TEXT = "Title\nSome words of the article stand here and more of them follow.\nOnly a link\nA linked heading\none\ntwo more\nOf law.\nNamed, but no noise.\nThe end."


@pytest.mark.parametrize("opening", ['<article class="post comments-open">', '<article class="has-sidebar">', '<main class="menu-open">', '<div class="with-sidebar"><article>', '<div class="page header-fixed"><main>', '<div class="sidebar"><article>', '<form id="all"><article>', '<article class="comment">'])
def test_names_around_an_article_do_not_rule_it_out(opening):
    closing = "".join(f"</{x}>" for x in reversed(re.findall(r"<(\w+)", opening)))
    page = f'<body class="sidebar-right"><nav><a href="/">Home</a></nav>{opening}{ARTICLE}{closing}<div class="related"><p>Other reads.</p></div><footer>Foot</footer></body>'
    assert html_text.main_text(page) == ARTICLE_TEXT


def test_odd_markup():
    text = html_text.main_text
    assert text('<article><p>Go <a href="x>link</a> and on.</p><p class="y z">More.</p></article>') == "Go link and on.\nMore."
    assert text("<article><p>One <![CDATA[ x > y ]]> two.</p></article>") == "One two."
    assert text('<article><p title="a > b">x < y and 3 > 2 &lt;b&gt;</p><!-- <p>no</p> --><!--> shown</article>') == "x < y and 3 > 2 <b>\nshown"
    assert text('<script>var a = "<article>";</script><div class="content"><p>Plain words here.</p></div>') == "Plain words here."
    assert text("<article><p>a</p><svg>not closed<p>b</p></article>") == "a\nnot closed\nb"
    assert text("<article><blockquote><p>Said.</p><footer>A. Uthor</footer></blockquote><footer>out</footer></article>") == "Said.\nA. Uthor"


@pytest.mark.parametrize("unit", ['<a b="x" c ', "<a b='x\" c=\"y' ", '<a b="x>', "<!-- ", '<div class="a">', "<section>", "<svg>", "<![CDATA[", "class=' ", "<"])
def test_time_is_linear_in_the_page(unit):
    def seconds(n):
        page = "<article>" + unit * (n // len(unit)) + '"' + "</div>" * (n // 20)
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    assert seconds(1 << 20) < max(0.5, 40 * seconds(1 << 16))


def test_extraction_of_odd_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string, text string")
    assert html_text.extract(pages).count() == 0
    long = "<article>" + "<p>A word or two.</p>" * 100_000 + "</article>"
    odd = spark.createDataFrame([(1, "u", long, "clash"), (1, "u", long, "clash"), (None, None, "<p", "clash")], "page_id bigint, url string, html string, text string")
    got = html_text.extract(odd).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 1_499_999), (1, 1_499_999)]
    with pytest.raises(ValueError):
        html_text.extract(odd, keep=("text",))


# -- 5


def test_rates_meet_the_targets(spark):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    found, mix = soft_mixing.mixed(docs, domains(labels), SHARES)
    got = found.toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all()
    p = got[[f"p_{d}" for d in SHARES]].to_numpy()
    assert np.allclose((got.rate.to_numpy() * got.n_tokens.to_numpy()) @ p, mix.targets, rtol=2e-3)
    # The same descent in numpy.
    t, rate, start = got.n_tokens.to_numpy(float), np.ones(len(got)), got.n_tokens.to_numpy(float) @ p
    for _ in range(len(mix.steps)):
        rate = np.maximum(0, rate - p @ (((rate * t) @ p - mix.targets) / start))
    assert np.allclose(rate, got.rate, atol=1e-6)
    assert abs(got.n_copies.sum() - got.rate.sum()) < 4 * math.sqrt(len(got))
    known = got.merge(labels.toPandas(), on="doc_id")
    assert known[(known.quality == 1) & (known.toxic == 0)].p_good.mean() > 0.8 > 0.4 > known[known.quality == 0].p_good.mean()


def test_mixing_without_labels_or_texts(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    found, _ = soft_mixing.mixed(docs, none, SHARES)
    assert found.count() == docs.count() and found.where("rate < 0 OR rate IS NULL").count() == 0
    assert soft_mixing.mixed(empty, none, SHARES)[0].count() == 0
    kept = soft_mixing.thinned(docs, none, SHARES)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("seen", [("good", "poor", "toxic"), ("good", "poor"), ("good",), ()])
def test_scarce_domains_do_not_thin_good_documents(spark, monkeypatch, seen):
    """A rare, a missing and no labelled domain: good and rare documents stay, only the frequent unwanted are thinned."""
    monkeypatch.setattr(soft_mixing.train, "__defaults__", (200, *soft_mixing.train.__defaults__[1:]))
    r = random.Random(8)
    kinds = ["toxic" if i % 200 == 7 else "poor" if i % 4 == 1 else "good" for i in range(4000)]
    kinds = [d if d in seen or not seen else "good" for d in kinds]
    rows = [(i, " ".join(f"{d}{r.randrange(20)}" if r.random() < 0.5 else f"w{r.randrange(400)}" for _ in range(40))) for i, d in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, d) for i, d in enumerate(kinds) if seen], "doc_id bigint, domain string")
    kept = Counter(kinds[x["doc_id"]] for x in soft_mixing.thinned(docs, labels, SHARES).collect())
    had = Counter(kinds)
    assert kept["good"] > 0.97 * had["good"]
    if seen:
        assert all(kept[d] > 0.85 * had[d] for d in seen if d == "toxic")
        assert "poor" not in seen or 0.02 * had["good"] < kept["poor"] < 0.1 * had["good"]
    else:
        assert kept == had


# -- all


def test_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op"))
    assert names == list(range(1, 11)) and "pipeline" in queries() and set(oracle_sql()) <= set(queries())


class Rows:
    """Stands for a table of one batch: what its worker runs is run here, and the memory measured."""

    def __init__(self, spark, batch):
        self.sparkSession, self.schema, self.batch = spark, None, batch

    def mapInArrow(self, run, schema):
        tracemalloc.start()
        self.rows, self.peak = sum(x.num_rows for x in run(iter([self.batch]))), tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return self


@pytest.mark.parametrize("stage", ["language", "signatures", "shingles", "benchmark"])
def test_the_pipelines_workers_need_little_memory_and_give_it_back(spark, monkeypatch, stage):
    texts = [prose(i, 6000, 5000) for i in range(300)]
    docs = Rows(spark, pa.RecordBatch.from_pydict({"id": list(range(300)), "text": texts}))
    model = language_id.train(spark.createDataFrame([(i, prose(i, 50), "en") for i in range(40)], "doc_id bigint, text string, lang string"), F.lit(True))
    items = spark.createDataFrame([(1, prose(-1, 20, 10**9))], "item_id bigint, text string")
    trimmed = []
    monkeypatch.setattr(common, "trim", lambda: trimmed.append(True))
    run = {"language": lambda: language_id.filter_languages(docs, model), "signatures": lambda: lsh_forest.signatures(docs), "shingles": lambda: lsh_forest.shingle_rows(docs), "benchmark": lambda: decontaminate.drop_contaminated(docs, items)}[stage]
    run()
    assert docs.rows == 300 and docs.peak < 36e6 and len(trimmed) >= 2


def test_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    named, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        rows = kept.collect()
        assert kept.columns == named and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.collect()}, name
        kept = spark.createDataFrame(rows, docs.schema)
        if name == "n-gram Jaccard join":
            links, roots = brute_links({r["doc_id"]: r["text"] for r in before.collect()})
            assert {r["doc_id"] for r in rows} == {k for k, c in roots.items() if k == c}
        if name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect() if not brute_hits(r["text"], items)[2]}
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in kept.collect())
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null" and len(corpus_pipeline.STAGES) == 5
