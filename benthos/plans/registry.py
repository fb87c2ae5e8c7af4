"""Where queries and their SQL are registered; access to the tables of a run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder: ``t("orders")``; ``t.sql(text)`` runs SQL over those it names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self(name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(name: str, sql: str | None = None):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def pick(index: str, values: list, start: int = 0) -> str:
    """SQL that picks a literal by an integer expression modulo the number of literals."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"CASE ({index}) % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values, start)) + " END"


def values(rows: list[tuple]) -> str:
    """A SQL VALUES list."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
