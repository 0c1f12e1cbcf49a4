"""From raw documents to token ids, in stages. Each stage's result is written and is the next one's input.

Null texts count as empty in all stages: the classifier scores them by their structure, of several one stays
in exact dedup, they are near copies of nothing, the mix takes none of them. Null doc_ids count as smallest
in exact dedup and stay in the join. Very long texts go through whole. Repeated rows are exact copies.
Ties are broken by doc_id and text. Empty tables give empty results, and columns of any further names come
along to the last stage, which returns ids and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm import bpe, exact_dedup, mixing, ngram_join, quality_fm
from querylens.llm.common import stored, table, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on ``labels``, scores at 0.5 or more."""
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return quality_fm.with_score(docs, model, name).where(F.col(name) >= 0.5).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source's target takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    encoded = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))
    return bpe.digests(encoded, F.col("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can't express the classifier and the merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage-{number}")
    return docs
