"""A corpus made ready for training: language, near copies, benchmark passages, mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  Every stage's result is written as Parquet to the shared folder and read again as the next
one's docs, so a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, language_id, lsh_forest, packed_ids, soft_mixing
from siltstone.llm.common import discard, materialise, table
from siltstone.llm.queries import SHARES, domains, vocabulary


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, and is the one given.

    Those go that have no letters, less than half of them in a script of a learned language, a score no
    better than an even split over the languages, or a given language other than the text's, told with a
    score of 0.9 at least.  A language that isn't given is filled in.
    """
    model = language_id.train(docs, F.lit(True))
    k = len(model.languages)
    return language_id.filter_languages(docs, model, least=(1 + 1e-6) / k if k > 1 else 0.0, known=0.5, given="lang")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with word shingles alike by 0.8 or more: the one with the least id."""
    return lsh_forest.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of 8 words of a benchmark item; items of fewer words rule none out."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the domains' shares: rates are at most 1, good and scarce domains are kept whole."""
    return soft_mixing.thinned(docs, domains(table(spark, sf_dir, "labels")), SHARES)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents in packed shards, and what is read back from them."""
    return packed_ids.read_ids(spark, packed_ids.write_ids(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language ID", tell_language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("mixing to target weights", mix),
    ("token-ID output", token_ids),
]

#: Language models, minhash classes and descent steps aren't expressible in SQL; tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i}")
            discard(before)
    return docs
