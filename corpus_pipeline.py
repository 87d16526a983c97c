"""From raw documents to encoded training text: five stages, each one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickertide.llm import bpe, mixing, ngram_join, quality, toxicity
from tickertide.llm.common import table
from tickertide.llm.queries import vocabulary_path
from tickertide.session import cut_lineage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more; empty texts are scored too."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(model)("text") >= quality.THRESHOLD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5."""
    grammar = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(grammar)("text") < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id."""
    return ngram_join.one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: one row per document and pass with the words it takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and a digest of what they decode to."""
    coded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
    return docs


# Learned models and a byte-pair coder have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None
