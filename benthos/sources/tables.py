"""Readers and writers: dictionaries, JSON-line caches, partitioned views, replaceable splits, manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.sources.versioned import VersionedTable, spread_by_bytes
from benthos.session import scratch_dir


def round_trip_csv(df: DataFrame, label: str, encoding: str = "UTF-8") -> DataFrame:
    """Written as CSV with a header and read back as texts."""
    path = scratch_dir(df.sparkSession, label)
    df.write.option("header", True).option("encoding", encoding).csv(path)
    return read_csv(df.sparkSession, path, encoding)


def read_csv(spark, path: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).csv(path)


def probe_encoding(spark, path: str, candidates: tuple[str, ...] = ("utf-8", "gbk")) -> str:
    """The first candidate that reads the first line of a text file (one line is read); a byte order mark is skipped."""
    first = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").csv(path).take(1)
    raw = first[0][0].encode("latin-1") if first else b""
    for name in candidates:
        try:
            raw.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    raise ValueError(f"{path}: none of {', '.join(candidates)} reads its first line")


def read_dictionary(spark, path: str, key_columns: list[str]) -> DataFrame:
    """A CSV dictionary in whatever encoding it has, with cas_key added.

    Spark's reader knows no GBK: such a file is read byte by character, and its texts are decoded
    afterwards (no byte of a GBK character is a comma, a quote or a line feed).
    """
    name = probe_encoding(spark, path)
    if name == "utf-8":
        return dictionary(read_csv(spark, path), key_columns)

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x.encode("latin-1").decode(name, "replace"), na_action="ignore")

    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    return dictionary(raw.select(*[decoded(F.col(f"`{c}`")).alias(c.encode("latin-1").decode(name)) for c in raw.columns]), key_columns)


def read_table(spark, path: str, required: list[str] | None = None) -> DataFrame:
    """A whole Parquet table; missing required columns are an error before anything runs."""
    df = spark.read.parquet(path)
    if gone := sorted(set(required or []) - set(df.columns)):
        raise ValueError(f"{path}: missing columns: {', '.join(gone)}")
    return df


def round_trip_text(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.text(path)
    return df.sparkSession.read.text(path)


def dictionary(df: DataFrame, key_columns: list[str]) -> DataFrame:
    """Adds cas_key: digits of the first candidate column that holds anything."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in key_columns]
    return df.withColumn("cas_key", F.regexp_replace(F.coalesce(*parts), "[^0-9]", ""))


def last_json_lines(lines: DataFrame, schema: str, key: str, order: str) -> DataFrame:
    """One row per key from JSON lines (``value``): broken lines are skipped, the latest by ``order`` wins."""
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")
    rest = [c for c in parsed.columns if c != key]
    return parsed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(key, "r.*")


def read_json_cache(spark, path: str, schema: str, key: str) -> DataFrame:
    """One row per key from files of JSON lines: broken lines are skipped, the last line wins (files in order of their names)."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("__at"))
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "__at").where("r is not null and r._corrupt is null").select("r.*", "__at").drop("_corrupt")
    rest = [c for c in parsed.columns if c not in (key, "__at")]
    return parsed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), "__at").alias("r")).select(key, "r.*")


def require_coverage(states: DataFrame) -> DataFrame:
    """The cached rows, if every required id is in order; else an error when it runs, with the id and its state."""
    return states.withColumn("state", F.when(F.col("state") == "ok", F.col("state")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("feature cache:"), F.col("id").cast("string"), F.col("state")))))


def cache_coverage(required: DataFrame, cache: DataFrame, vector: str, width: int) -> DataFrame:
    """Required ids with their cached row and a state: ok, missing, wrong_width or not_finite."""
    bad = F.exists(vector, lambda x: F.isnan(x) | x.isNull())
    return required.join(cache, "id", "left").withColumn("state", F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != width, "wrong_width").when(bad, "not_finite").otherwise("ok"))


def write_partitions(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """As many files per combination of ``by`` as its bytes ask for, read back with partition columns."""
    path = scratch_dir(df.sparkSession, label)
    spread_by_bytes(df, by).write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_splits(existing: DataFrame, new: DataFrame, label: str, by: str = "split_name") -> DataFrame:
    """Rows of ``new`` take the place of all existing rows with the same split name; others stay.

    A versioned table of its own: version 1 the existing rows, version 2 with the new ones, which
    touches no other split's files. Tables that last are kept as ``VersionedTable``.
    """
    table = VersionedTable(existing.sparkSession, scratch_dir(existing.sparkSession, label), by)
    table.replace(existing)
    table.replace(new.select(*existing.columns))
    return table.read()


def write_table(df: DataFrame, label: str) -> str:
    """Written as Parquet to a new folder; its path."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return path


def manifest(one_row: DataFrame, label: str) -> DataFrame:
    """A one-row table written as a JSON manifest and read back."""
    path = scratch_dir(one_row.sparkSession, label)
    one_row.coalesce(1).write.json(path)
    return one_row.sparkSession.read.schema(one_row.schema).json(path)


def batch_rows(df: DataFrame, defaults: dict[str, str], rules: dict) -> tuple[DataFrame, DataFrame]:
    """Scoring input with defaults for blank texts, as (rows that keep all rules, rows that do not, with the rules' names as ``reasons``)."""
    filled = with_defaults(df, defaults)
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    marked = filled.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Blank and missing texts get their default."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)) for c, v in defaults.items()})
