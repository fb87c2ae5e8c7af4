"""Joins of the evidence tables: star and wide views, checks, alignment, list membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The projection to ``columns``; a missing one is an error before anything runs."""
    gone = sorted(set(columns) - set(df.columns))
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df.select(*columns)


def star_view(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of a fact table with its dimensions: (dimension, key in what is joined so far, key of the dimension).

    No hint is given: small dimensions are broadcast by the optimiser from their real sizes.
    """
    for dim, own, other in dims:
        fact = fact.join(dim, F.col(own) == F.col(other), "left")
    return fact


def enrich(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Adds ``column`` of ``lookup`` by key; an error if the column is there already."""
    if column in df.columns:
        raise ValueError(f"column {column} already exists")
    return df.join(lookup.select(key, column), key, "left")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, name: str, count_nulls: bool = False) -> DataFrame:
    """(relation, n_orphans): rows whose key the parent lacks; null keys count only if asked for."""
    rows = child if count_nulls else child.where(F.col(key).isNotNull())
    return rows.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").agg(F.count("*").alias("n_orphans")).select(F.lit(name).alias("relation"), "n_orphans")


def strict_join(split: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Inner join that must be one to one and complete for the split: else an error at run time."""
    n = source.groupBy(key).agg(F.count("*").alias("__n"))
    checked = split.join(n, key, "left").withColumn(key, F.when(F.coalesce(F.col("__n"), F.lit(0)) == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no single source row for "), F.col(key).cast("string")))))
    return checked.drop("__n").join(source, key)


def aligned(predictions: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cohort rows with their prediction, ``exact_expected`` and ``scored``; faults stay visible.

    fault: why a row breaks the contract (an identity on one side only, a target or head that
    differs, an infinite value); NULL rows are in order. A null prediction is no estimate.
    """
    p = predictions.select(F.col("stable_record_id"), F.col("prediction"), F.col("target").alias("p_target"), F.col("model_head").alias("p_head"), F.lit(True).alias("in_p"))
    c = cohort.withColumn("in_c", F.lit(True))
    inf = float("inf")
    both = c.join(p, "stable_record_id", "full_outer")
    fault = (
        F.when(F.col("in_c").isNull(), "prediction_without_cohort").when(F.col("in_p").isNull(), "cohort_without_prediction")
        .when(~F.col("target").eqNullSafe(F.col("p_target")), "target_differs").when(~F.col("model_head").eqNullSafe(F.col("p_head")), "head_differs")
        .when((F.abs("target") == inf) | (F.abs("prediction") == inf), "infinite")
    )
    expected = ~F.coalesce("is_censored", F.lit(False)) & F.col("target").isNotNull()
    return both.withColumns({"fault": fault, "exact_expected": expected, "scored": expected & F.col("prediction").isNotNull()}).drop("in_c", "in_p", "p_target", "p_head")


def compare_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): keys on both sides, or on one only."""
    x, y = a.select(key).distinct().withColumn("l", F.lit(1)), b.select(key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    return x.join(y, key, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def seen_in_train(rows: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """For each column a flag ``seen_<column>``: the value occurs in a training row."""
    for c in columns:
        known = rows.where(train & F.col(c).isNotNull()).select(c).distinct().withColumn(f"seen_{c}", F.lit(True))
        rows = rows.join(known, c, "left").withColumn(f"seen_{c}", F.coalesce(f"seen_{c}", F.lit(False)))
    return rows


def prefix_similarity(rows: DataFrame, train: DataFrame, levels: list[str]) -> DataFrame:
    """Deepest taxonomic prefix shared with a training row, as a share of all levels.

    One equality join per level on the distinct training prefixes; no pairs are made.
    """
    out = rows.withColumn("max_prefix", F.lit(0))
    for i in range(1, len(levels) + 1):
        known = train.select(*levels[:i]).dropna().distinct().withColumn("__hit", F.lit(i))
        out = out.join(known, levels[:i], "left").withColumn("max_prefix", F.greatest("max_prefix", F.coalesce("__hit", F.lit(0)))).drop("__hit")
    return out.withColumn("max_prefix", F.col("max_prefix") / len(levels))


def sources_pass(rows: DataFrame, ids: str, key: str, ledger: DataFrame) -> DataFrame:
    """(key, passes, reasons): a row passes only if the ledger passes all of its sources."""
    per = rows.select(key, F.explode(ids).alias("source_id")).join(ledger, "source_id", "left")
    return per.groupBy(key).agg(F.min(F.coalesce("ok", F.lit(False))).alias("passes"), F.array_sort(F.collect_set(F.when(~F.coalesce("ok", F.lit(False)), F.coalesce("reason", F.lit("unknown_source"))))).alias("reasons"))
