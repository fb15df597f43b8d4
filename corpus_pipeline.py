"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisect.llm import line_dedup, mixing, pieces, quality, simhash
from orbisect.llm.common import workspace
from orbisect.session import reachable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's and source's fences go."""
    reachable(spark)
    return quality.filtered(docs)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text. Documents without text left stay, empty."""
    reachable(spark)
    kept = line_dedup.deduplicated(docs, min_docs=10, min_chars=1)
    named = {"n_chars": F.length("text").cast("long")}
    return kept.select(*(named.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id. Near copies share 0.8 or more of
    their shingles of five words, by the sets themselves."""
    reachable(spark)
    return simhash.one_of_each(docs, simhash.grouped_by_similarity(docs, size=5, least=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch that the mix takes words of; its text is those words."""
    reachable(spark)
    return mixing.mixed_texts(docs, mixing.Mix())


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the SentencePiece ids of each text."""
    reachable(spark)
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", drop_frequent_lines),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL has neither XXH64 nor SentencePiece; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = workspace(spark, "pipeline")
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
