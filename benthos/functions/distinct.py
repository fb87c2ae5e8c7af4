"""Rules over texts with few distinct values: evaluated once per distinct combination, not once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.session import materialize


def by_distinct(df: DataFrame, columns: list[str], rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``rule`` adds to the distinct rows of ``columns``; null counts as a value.

    The distinct rows are found with a partial aggregate before anything moves. They are
    written, so that their size is known when they are joined back without a hint: ``df`` is
    not shuffled where they are short.
    """
    codes = materialize(rule(df.select(*columns).distinct()), "distinct")
    other = codes.select(*[F.col(c).alias(f"__d_{c}") for c in columns], *[c for c in codes.columns if c not in columns])
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__d_{c}"))
    return df.join(other, on).drop(*[f"__d_{c}" for c in columns])
