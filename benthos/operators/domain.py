"""The applicability-domain report: leverage, structure, taxonomy and what training has seen, per query row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.functions.features import domain_label
from benthos.operators.joins import prefix_similarity, seen_in_train
from benthos.operators.models import leverage
from benthos.operators.similarity import best_other_tanimoto, pack


def applicability_report(rows: DataFrame, queries: Column, descriptors: list[str], bits: str, width: int, seen: list[str], taxonomy: list[str], least_similarity: float, least_prefix: float) -> DataFrame:
    """Per query row (id): h, cutoff, outside, max_similarity, max_prefix, seen_<column> flags and the label.

    ``rows`` has id, train, the descriptors and a list of fingerprint bits. The chemical is in the
    domain where its leverage is within the cutoff and a training structure (of another id) is
    similar enough; the species, where its taxonomic prefix is. ``queries`` states the query set.
    """
    h = leverage(rows, descriptors)
    words = rows.select("id", "train", pack(F.col(bits), width).alias("words"))
    asked = rows.where(queries).select("id")
    nearest = best_other_tanimoto(words.join(asked, "id").select(F.col("id").alias("query_id"), "words"), words.where("train").select("id", "words"))
    flags = seen_in_train(rows, F.col("train"), seen).select("id", *[f"seen_{c}" for c in seen])
    prefix = prefix_similarity(rows, rows.where("train"), taxonomy).select("id", "max_prefix")
    d = asked.join(h, "id").join(flags, "id").join(prefix, "id").join(nearest.select(F.col("query_id").alias("id"), "max_similarity"), "id", "left").fillna(0.0, ["max_similarity"])
    chem = F.coalesce(~F.col("outside"), F.lit(False)) & (F.col("max_similarity") >= least_similarity)
    return d.withColumn("label", domain_label(chem, F.col("max_prefix") >= least_prefix))
