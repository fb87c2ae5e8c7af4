"""The corpus pipeline: quality filter, exact and near deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.llm import exact_dedup, near_dedup, packing, quality
from benthos.llm.queries import tokenizer_path
from benthos.session import materialize, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is kept, null for null; rows that share a doc_id stay or go together.

    Only the columns of documents are read, so others may have any names.
    """
    ids = ids.select(F.col("doc_id").alias("kept_id"))
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of the labels, does not reject.

    Rows are judged one by one: repeated rows alike, null and empty texts by the labels' share
    of good ones, rows without doc_id by their text. Without labels nothing is rejected.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.select_kept(docs, model).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts: the longest, then the smallest doc_id.

    Null and empty texts are one group. Rows that share a doc_id stay or go together.
    """
    return _keep(docs, exact_dedup.exact_duplicates(docs).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component: five-word shingles, similarity 0.8.

    Null and empty texts and rows without doc_id are linked with nothing and stay.
    """
    return _keep(docs, near_dedup.near_duplicates(docs, near_dedup.NearDedup(shingle=5, threshold=80)).where("kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, all tokens bearing loss; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: A learnt classifier and a tokenizer cannot be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
