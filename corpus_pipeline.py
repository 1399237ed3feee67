"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. The quality classifier is fitted on labels that aren't held
out; documents that it rejects go. Of each class of near duplicates one document stays. Passages that repeat across the
documents that are left go from their texts. Documents that hold a benchmark passage go. The rest is packed.

In every stage null texts are empty, empty tables (documents, labels, benchmark) are allowed, rows that repeat are judged as
often as they come, texts of any length are read whole, and further columns come along under any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from plinth.llm._common import fresh, shared_dir, small_batches, table

#: A passage of more than fifty words has more bytes than this.
PASSAGE_BYTES = 200


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier scores 0.5 or more; without labels, all. A score of exactly 0.5 stays."""
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "__score")[0]
    return quality.with_score(docs, model, name=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least key, of equal keys that with the least text id."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE_BYTES that also stand elsewhere; n_chars follows. A text may become empty."""
    small_batches(spark)
    return suffix_dedup.remove_repeats(docs, least=PASSAGE_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; without items, all."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place there; an empty text is one piece of one id."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can't state the classifier, the walks or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
