"""Token ids in a packed binary file format (operator 4).

A shard holds the ids of consecutive documents, each id in the minimum bits for the vocabulary
(least bit first), in blocks of ``BLOCK`` ids; blocks start on whole bytes, so block b of a shard is
found by one multiplication and unpacked by numpy without its neighbours.  Layout, little-endian:

    header   magic "PKIDS\\0\\0\\1", u32 bits, u32 block, u64 vocabulary
    payload  the blocks, the last one padded to a whole byte
    index    i64 document ids, u64 first token of each document and the total, u64 offset of each block
    trailer  u64 documents, u64 tokens, u64 blocks, u64 offset of the index, magic

Shards are written in ascending document order, one a partition, under a temporary name and then
moved, so a repeated task leaves the same whole file.  ``manifest.json`` lists them with the number of
tokens before each.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import fresh_dir, kept, open_fs, ordered, utf8, write_whole
from siltstone.llm.token_counts import slices

MAGIC, BLOCK, CACHE = b"PKIDS\0\0\1", 1 << 16, 400_000
# Letters whose kind and lower case need no context; with an apostrophe a suffix may be split off differently.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
ODD = re.compile(f"[^\\x00-&(-\\x7f{LATIN}]")
PIECES = re.compile(f"[{LATIN}]+|[0-9]+|[^ \\t\\n\\v\\f\\r0-9{LATIN}]+")
NULL_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits``-bit fields, least bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's splitter drops white space and keeps runs of letters apart from other signs, so no
    token crosses such a boundary: texts are cut there, the pieces a worker hasn't met are batch-encoded,
    the rest looked up.  Texts of Latin letters and ASCII alone (all stable under the tokenizer's
    normalisation) are cut at either kind of boundary, others at ASCII spaces and line ends only.
    ``safe`` is read off the tokenizer's own settings; a tokenizer of another kind encodes texts whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.vocabulary = self.model.get_vocab_size()
        spec = json.loads(self.model.to_str())
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        words = split.get("invert") is True and split.get("behavior") == "Removed" and str(split.get("pattern", {}).get("Regex")).endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        self.safe = words and kinds == ["NFC", "Replace", "Lowercase"] and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 4096):  # the library's results are much larger than the ids
            for x in self.model.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False):
                yield np.asarray(x.ids, "<u4").tobytes()

    def cut(self, text: str) -> list[str]:
        if ODD.search(text) or self.special.search(text):
            return text.replace("\n", " ").split(" ")
        return PIECES.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        if not self.safe:
            return list(self._encode(texts))
        cut = [self.cut(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known = {"": b""}
            new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self._encode(new), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in cut]


def encoder(path: str) -> WordEncoder:
    """A worker's encoder, kept from task to task."""
    return kept(("encoder", path), lambda: WordEncoder(path))


class ShardWriter:
    """Gathers documents; ``chunks`` yields the file's bytes as blocks fill, so one block is in memory."""

    def __init__(self, bits: int, vocabulary: int, block: int = BLOCK) -> None:
        self.bits, self.vocabulary, self.block = bits, vocabulary, block
        self.docs: list[int] = []
        self.firsts: list[int] = [0]
        self.offsets: list[int] = []

    def chunks(self, docs: Iterator[tuple[int, bytes]]) -> Iterator[bytes]:
        yield (head := MAGIC + struct.pack("<IIQ", self.bits, self.block, self.vocabulary))
        at, held, have = len(head), [], 0
        for doc, ids in docs:
            self.docs.append(doc)
            self.firsts.append(self.firsts[-1] + len(ids) // 4)
            held.append(ids)
            have += len(ids) // 4
            while have >= self.block:
                flat = np.frombuffer(b"".join(held), "<u4")
                full = len(flat) // self.block * self.block
                for i in range(0, full, self.block):
                    self.offsets.append(at)
                    yield (x := pack(flat[i : i + self.block], self.bits))
                    at += len(x)
                held, have = [flat[full:].tobytes()], len(flat) - full
        if have:
            self.offsets.append(at)
            yield (x := pack(np.frombuffer(b"".join(held), "<u4"), self.bits))
            at += len(x)
        yield np.asarray(self.docs, "<i8").tobytes() + np.asarray(self.firsts, "<u8").tobytes() + np.asarray(self.offsets, "<u8").tobytes()
        yield struct.pack("<QQQQ", len(self.docs), self.firsts[-1], len(self.offsets), at) + MAGIC


class Shard:
    """Random access to a shard: its index, and the ids of any range of tokens."""

    def __init__(self, uri: str) -> None:
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(24, 0), self.file.read_at(40, size - 40)
        if head[:8] != MAGIC or tail[32:] != MAGIC:
            raise ValueError(f"not a shard of packed ids: {uri}")
        self.bits, self.block, self.vocabulary = struct.unpack("<IIQ", head[8:])
        n, self.tokens, blocks, index = struct.unpack("<QQQQ", tail[:32])
        raw = self.file.read_at(size - 40 - index, index)
        self.docs = np.frombuffer(raw, "<i8", n)
        self.firsts = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks, 8 * (2 * n + 1)).astype(np.int64), index)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        base = int(self.offsets[a])
        parts = [unpack(raw[int(self.offsets[i]) - base : int(self.offsets[i + 1]) - base], self.bits, min(self.block, self.tokens - i * self.block)) for i in range(a, b)]
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", out_dir: str | None = None) -> str:
    """Encode whole texts and write shards in ascending document order; returns the folder.

    Null texts count as empty; an empty text has the end id alone.  Rows of one id stay apart, in the
    order of their texts; a null id is written as the least long.  An empty table gives no shard.
    """
    spark = docs.sparkSession
    out = out_dir or fresh_dir(spark, "ids")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    laid = ordered(rows, "id", "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = iter(batches)
        first = next((b for b in it if b.num_rows), None)
        if first is None:
            return
        model = encoder(tokenizer_path)
        shard = TaskContext.get().partitionId()
        writer = ShardWriter(bits_for(model.vocabulary), model.vocabulary)

        def encoded() -> Iterator[tuple[int, bytes]]:
            batch = first
            while batch is not None:
                text, ids = batch.column("text"), batch.column("id").fill_null(NULL_ID).to_pylist()
                for a, b in slices(np.diff(utf8(text)[1]).tolist()):
                    for doc, x in zip(ids[a:b], model.encode(text.slice(a, b - a).to_pylist()), strict=True):
                        yield doc, x + end
                batch = next(it, None)

        uri = f"{out}/shard-{shard:07d}.ids"
        write_whole(uri, writer.chunks(encoded()))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "uri": [uri], "docs": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([writer.firsts[-1]], pa.int64())})

    # A row for each partition, of fixed size: the manifest.
    shards = laid.mapInArrow(run, "shard bigint, uri string, docs bigint, tokens bigint").collect()
    total, listed = 0, []
    for s in sorted(shards, key=lambda s: s["shard"]):
        listed.append({"shard": s["shard"], "uri": s["uri"], "docs": s["docs"], "tokens": s["tokens"], "start": total})
        total += s["tokens"]
    write_whole(f"{out}/manifest.json", iter([json.dumps({"tokens": total, "shards": listed}).encode()]))
    return out


def read_manifest(folder: str) -> dict:
    fs, path = open_fs(f"{folder}/manifest.json")
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from the shards: doc_id, start, n_tokens, ids_crc32 (and ids if asked for)."""
    shards = read_manifest(folder)["shards"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    listed = spark.createDataFrame([(i, s["uri"], s["start"]) for i, s in enumerate(shards)], "part int, uri string, start bigint")
    if shards:
        listed = listed.repartitionById(len(shards), F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard, step = Shard(uri), 2048
                for i in range(0, len(shard.docs), step):
                    firsts = shard.firsts[i : i + step + 1]
                    flat = shard.ids(int(firsts[0]), int(firsts[-1])).astype("<u4")
                    at = firsts - firsts[0]
                    crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    own = shard.docs[i : i + step]
                    out = [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(start + firsts[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return listed.select("uri", "start").mapInArrow(run, schema)
