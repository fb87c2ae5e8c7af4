"""Searches, facets and rankings over species and effect tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.operators.ranks import range_rank


def text_search(rows: DataFrame, columns: list[str], words: str, keep: list[str], limit: int, metrics: DataFrame | None = None) -> DataFrame:
    """Distinct ``keep`` rows with the text in any column: exact matches first, then known R2 and MAE, then the count; top ``limit``.

    The text is compared without regard to case; % and _ are ordinary characters.
    ``metrics`` has keep's first column with r2 and mae.
    """
    low = words.strip().lower()
    hit, exact = F.lit(False), F.lit(False)
    for c in columns:
        text = F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
        hit, exact = hit | text.contains(low), exact | (text == low)
    found = rows.where(hit).groupBy(*keep).agg(F.count("*").alias("n"), F.max(exact).alias("exact"))
    if metrics is not None:
        found = found.join(metrics.select(keep[0], "r2", "mae"), keep[0], "left")
        return found.orderBy(F.desc("exact"), F.desc_nulls_last("r2"), F.asc_nulls_last("mae"), F.desc("n"), *keep).limit(limit)
    return found.orderBy(F.desc("exact"), F.desc("n"), *keep).limit(limit)


def options(rows: DataFrame, keep: list[str], metric: str, limit: int, rising: bool = False) -> DataFrame:
    """The best ``limit`` rows by a metric, missing values last, ties by the kept columns."""
    order = F.asc_nulls_last(metric) if rising else F.desc_nulls_last(metric)
    return rows.select(*keep).orderBy(order, *keep).limit(limit)


def facet(rows: DataFrame, level: str, limit: int, filters: dict[str, str] | None = None, words: str = "") -> DataFrame:
    """(facet, n): values of a taxonomy level under equality filters and a text, the most frequent first."""
    for c, v in (filters or {}).items():
        rows = rows.where(F.lower(F.trim(c)) == v.strip().lower())
    name = F.trim(F.col(level))
    rows = rows.where((F.coalesce(name, F.lit("")) != "") & F.lower(name).contains(words.strip().lower()))
    return rows.groupBy(name.alias("facet")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facet").limit(limit)


# Words of a habitat text that admit it to a medium.
MEDIUM_WORDS = {"aquatic": ("water", "aquatic", "marine"), "sediment": ("sediment",), "soil": ("soil", "terrestrial")}


def medium_filter(habitat: Column, medium: str) -> Column:
    """Whether a habitat text may stand for the medium; a missing one may, non-soil is no soil; an unknown medium admits all."""
    low = F.lower(F.trim(F.coalesce(habitat, F.lit(""))))
    if medium not in MEDIUM_WORDS:
        return F.lit(True)
    hit = low == ""
    for w in MEDIUM_WORDS[medium]:
        hit = hit | low.contains(w)
    return hit & ~low.contains("non-soil") if medium == "soil" else hit


def ranked_options(rows: DataFrame, option: str, metric: str, rising: bool = False) -> DataFrame:
    """(option, n, mean) ordered by the mean metric, options without one last."""
    m = rows.groupBy(option).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
    return m.orderBy(F.asc_nulls_last("mean") if rising else F.desc_nulls_last("mean"), option)


def natural_order(rows: DataFrame, text: str, tie: str) -> DataFrame:
    """Adds pos from 1: texts that are whole numbers first, by value, then all others by text; ties by ``tie``.

    All rows are numbered, in ranges of the order with summed offsets.
    """
    order = [F.asc_nulls_last(F.col(text).try_cast("bigint")), F.asc_nulls_last(text), F.col(tie).asc()]
    return range_rank(rows, order).withColumn("pos", F.col("rank") + 1).drop("rank")
