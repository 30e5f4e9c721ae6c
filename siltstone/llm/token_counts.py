"""Token counts of whole texts (operator 9).

Arrow functions get batches of texts, cut them into slices of about equal bytes, split every text at
boundaries no token can cross, batch-encode the pieces a worker hasn't met, and return lengths only.
A text's count is the sum of its pieces' counts; which boundaries are safe is read off the vocabulary
when it is loaded, and without them a text is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SLICE_BYTES, CACHE = 4 << 20, 800_000


class PieceCounter:
    """Lengths of sentencepiece encodings, with the counts of met pieces kept (at most ``CACHE``)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        lines = any("\n" in p for p in pieces)
        one = lambda text, want: self.model.encode(text, out_type=str) == want
        self.safe = not inner and not lines and one("a", [SPACE + "a"]) and one("\n", [SPACE, "<0x0A>"]) and one("a   ", [SPACE + "a", SPACE * 3])
        self.known: dict[str, int] = {}
        self.cut = re.compile(r" *[^ \n]+|\n| +")

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text: " x" begins with a space, "\\nx" with a line end, "x" follows one space."""
        text = text.replace(SPACE, " ")
        if text[0] > " " and text[-1] != " " and "  " not in text and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        found = self.cut.findall(f" {text}")
        return [x[1:] if x[0] == " " and x[1:2] > " " else x if x[0] in " \n" else f"\n{x}\n" for x in found]

    def _encode(self, pieces: list[str]) -> Iterator[int]:
        """How many tokens each piece adds.  The model puts one space token before what it is given."""
        plain = [x if x[0] == "\n" else x[1:] if x[0] == " " else x for x in pieces]
        mid = [x[:-1] if len(x) > 2 and x[0] == x[-1] == "\n" else x for x in plain]
        for x, text, ids in zip(pieces, mid, self.model.encode(mid, num_threads=1), strict=True):
            if x[0] == "\n":
                yield len(ids) - (2 if text != x else 1)
            else:
                yield len(ids) if text else 1

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        cut = [self.pieces(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(set().union(*cut))
        self.known.update(zip(new, self._encode(new), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in cut]


class WholeCounter:
    """Lengths by a .json tokenizer, texts encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(path: str) -> PieceCounter | WholeCounter:
    return PieceCounter(path) if path.endswith(".model") else WholeCounter(path)


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is one by itself."""
    start = total = 0
    for i, x in enumerate(sizes):
        if i > start and total + x > most:
            yield start, i
            start, total = i, 0
        total += x
    if start < len(sizes):
        yield start, len(sizes)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row.

    Null texts count as empty (0 bytes, 0 tokens).  Repeated rows and null ids are kept, one row out for
    each row in; other columns are neither read nor returned.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            column = batch.column("text").fill_null("")
            sizes = pc.binary_length(column).cast(pa.int64())
            got: list[int] = []
            for a, b in slices(sizes.to_pylist()):
                got += model.counts(column.slice(a, b - a).to_pylist())
            n = pa.array(got, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, n, pc.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
