"""Counts, contracts, comparisons and leakage audits of evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benthos.operators.ranks import quantiles


def quality_report(rows: DataFrame, distinct: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row: n_rows, ``n_<column>`` distinct values and ``n_<flag>`` rows for which a flag holds."""
    return rows.agg(F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct], *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()])


def best_row_per_key(rows: DataFrame, key: str, value: Column, order: list[str], keep: list[str]) -> DataFrame:
    """(key, keep..., n_rows, n_values): the first row that has a value, else the first row, in ``order``.

    n_rows counts the key's rows and n_values its distinct values, so duplicates and conflicts show.
    """
    first = F.min_by(F.struct(*keep), F.struct(value.isNull().cast("int").alias("__m"), *order))
    return rows.groupBy(key).agg(first.alias("__b"), F.count("*").alias("n_rows"), F.countDistinct(value).alias("n_values")).select(key, *[F.col(f"__b.{c}").alias(c) for c in keep], "n_rows", "n_values")


def count_by(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """Rows per combination of the named columns, as ``n``."""
    return rows.groupBy(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()]).agg(F.count("*").alias("n"))


def views(rows: DataFrame, censored: str) -> dict[str, DataFrame]:
    """The frame as it is (all), its exact rows and its censored rows; a missing flag counts as exact."""
    flag = F.coalesce(F.col(censored), F.lit(False))
    return {"all": rows, "exact": rows.where(~flag), "censored": rows.where(flag)}


def single_dimension(rows: DataFrame, key: str, dimension: str) -> DataFrame:
    """(key, dimensions, single): distinct target dimensions per key, and whether there is at most one."""
    n = F.countDistinct(dimension)
    return rows.groupBy(key).agg(n.alias("dimensions"), (n <= 1).alias("single"))


def fetch_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed; the list may repeat and be of any length."""
    return rows.join(ids.select(key), key, "left_semi")


def alignment_faults(features: DataFrame, data: DataFrame, key: str, values: str | None = None) -> DataFrame:
    """(fault, n): keys on one side only, repeated keys, and feature rows with a missing or infinite number."""
    def lone(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return a.select(key).join(b.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")

    def repeated(a: DataFrame, name: str) -> DataFrame:
        return a.groupBy(key).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit(name).alias("fault"), "n")

    out = lone(features, data, "features_only").unionByName(lone(data, features, "data_only"))
    out = out.unionByName(repeated(features, "features_repeated")).unionByName(repeated(data, "data_repeated"))
    if values:
        bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        out = out.unionByName(features.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("n")).select(F.lit("not_finite").alias("fault"), "n"))
    return out


def structure_overlap(assignments: DataFrame, structure: str, part: str = "split_part") -> DataFrame:
    """(left_part, right_part, n_common): structures that two parts share, for each pair of parts with any."""
    d = assignments.select(structure, part).distinct()
    y = d.withColumnRenamed(part, "right_part")
    met = d.withColumnRenamed(part, "left_part").join(y, structure).where("left_part < right_part")  # parts are few
    return met.groupBy("left_part", "right_part").agg(F.count("*").alias("n_common"))


def leakage_audit(assignments: DataFrame, single: list[str], lists: list[str], part: str = "split_part") -> DataFrame:
    """(kind, n_ids, n_crossing) for each id column and each id list column: ids found in more than one part."""
    kinds = [assignments.select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id"), part) for c in single]
    kinds += [assignments.select(F.lit(c).alias("kind"), F.explode(F.transform(c, lambda x: x.cast("string"))).alias("id"), part) for c in lists]
    every = kinds[0]
    for x in kinds[1:]:
        every = every.unionByName(x)
    per = every.where("id is not null").groupBy("kind", "id").agg((F.min(part) != F.max(part)).alias("crosses"))
    return per.groupBy("kind").agg(F.count("*").alias("n_ids"), F.count_if("crosses").alias("n_crossing"))


def similarity_summary(rows: DataFrame, similarity: str, shares: tuple[float, ...] = (0.65, 0.80)) -> DataFrame:
    """One row: n, mean, nearest-rank p50 and p90 (half to even, no interpolation), max and the share at or above each bound."""
    n = rows.agg(F.count(similarity)).first()[0]
    # an exact quantile at round(q (n - 1)) / (n - 1) is the value of that rank; halves go to even
    p = {name: (round(q * (n - 1)) / (n - 1) if n > 1 else 0.0) for name, q in (("p50", 0.5), ("p90", 0.9))}
    share = [(F.count_if(F.col(similarity) >= b) / F.count(similarity)).alias(f"share_ge_{round(100 * b)}") for b in shares]
    return quantiles(rows, [], similarity, p, F.count(similarity).alias("n"), F.avg(similarity).alias("mean"), F.max(similarity).alias("max"), *share)




def chemical_units(records: DataFrame, key: str, order: str, fields: list[str], head: str) -> DataFrame:
    """(key, n_rows, fields..., heads): rows per canonical key, each field's first non-empty value in order, the head set."""
    def first(c: str) -> Column:
        filled = F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull()
        return F.min_by(F.when(filled, F.col(c)), F.when(filled, F.col(order)))

    return records.groupBy(key).agg(F.count("*").alias("n_rows"), *[first(c).alias(c) for c in fields], F.array_sort(F.collect_set(head)).alias("heads"))


def group_summary(units: DataFrame, group: str, member: str, rows: str, scaffold: str, name: str, top: int = 5) -> DataFrame:
    """(group, n_rows, n_members, n_scaffolds, top_names): the first names in order are kept, not all of them."""
    named = units.where(F.col(name).isNotNull()).select(group, name).distinct()
    w = F.row_number().over(Window.partitionBy(group).orderBy(name))
    best = named.withColumn("__i", w).where(F.col("__i") <= top).groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("top_names"))
    per = units.groupBy(group).agg(F.sum(rows).alias("n_rows"), F.countDistinct(member).alias("n_members"), F.countDistinct(scaffold).alias("n_scaffolds"))
    return per.join(best, group, "left")


def missing_structures(units: DataFrame, structure: str, by: str) -> DataFrame:
    """(by, n, n_missing): units without a structure per value of ``by``."""
    gone = F.coalesce(F.trim(F.col(structure)) == "", F.lit(True))
    return units.groupBy(by).agg(F.count("*").alias("n"), F.count_if(gone).alias("n_missing"))


def boundary_audit(rows: DataFrame, value: Column, bounds: list[float], tolerance: float, **by: Column | str) -> DataFrame:
    """Per combination of ``by``: n and n_near_boundary, rows within a relative tolerance of a bin's bound."""
    near = F.lit(False)
    for b in bounds:
        near = near | (F.abs(value - b) <= tolerance * b)
    return rows.groupBy(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in by.items()]).agg(F.count("*").alias("n"), F.count_if(near).alias("n_near_boundary"))


def identity_hash(rows: DataFrame, by: list[str], ids: str) -> DataFrame:
    """(by, n_ids, identity_sha256) of the set of ids, in any order and however often each is there.

    The hash covers the number of distinct ids and the sum of their hashes, so a set of any size
    is a few numbers per task. ``listed_hash`` is the form over the sorted list.
    """
    d = rows.select(*by, F.col(ids).cast("string").alias("__i")).where("__i is not null").distinct()
    return d.groupBy(*by).agg(F.count("*").alias("n_ids"), F.sha2(F.concat_ws("|", F.count("*"), F.sum(F.xxhash64("__i").cast("decimal(38,0)"))), 256).alias("identity_sha256"))


def listed_hash(rows: DataFrame, by: str, ids: str) -> DataFrame:
    """(by, identity_sha256): SHA-256 of the JSON list of the group's sorted distinct ids; groups must be short enough to list."""
    return rows.groupBy(by).agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.col(ids).cast("string")))), 256).alias("identity_sha256"))


def unique_structures(rows: DataFrame, structure: str, sources: str) -> DataFrame:
    """(structure, n, n_sources): trimmed structures that are not empty, rows and distinct sources of each."""
    s = F.nullif(F.trim(F.col(structure)), F.lit(""))
    return rows.select(s.alias(structure), sources).where(F.col(structure).isNotNull()).groupBy(structure).agg(F.count("*").alias("n"), F.countDistinct(sources).alias("n_sources"))


def snapshot_validation(rows: DataFrame, record: str, head: str, value: str, part: str) -> DataFrame:
    """Per part: n, n_unique, n_heads, n_not_finite and the identity hash of its records."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    counts = rows.groupBy(part).agg(F.count("*").alias("n"), F.countDistinct(record).alias("n_unique"), F.countDistinct(head).alias("n_heads"), F.count_if(bad).alias("n_not_finite"))
    return counts.join(identity_hash(rows, [part], record), part, "left")


def frame_contract(rows: DataFrame, required: list[str], record: str, head: str, scale: str, one_value: list[str]) -> DataFrame:
    """(rule, n_violations) before fitting: missing columns, repeated ids, empty heads, several target scales or routes."""
    gone = sorted(set(required) - set(rows.columns))
    checks = {"missing_columns": F.lit(len(gone)).cast("long")}
    if not gone:
        checks |= {"repeated_ids": F.count("*") - F.countDistinct(record), "empty_head": F.count_if(F.coalesce(F.trim(F.col(head).cast("string")) == "", F.lit(True)))}
        checks |= {f"several_{c}": F.greatest(F.lit(0), F.countDistinct(c) - 1) for c in [scale, *one_value]}
    wide = rows.agg(*[c.cast("long").alias(k) for k, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n_violations")) for k in checks])).alias("x")).select("x.*")


def row_differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(side, n): rows, as often as they occur, that one frame has and the other has not."""
    a, b = a.select(*columns), b.select(*columns)
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(a.exceptAll(b), "left_only").unionByName(count(b.exceptAll(a), "right_only"))


def union_frames(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All rows of both, missing columns null; ``duplicate`` marks a key that is there more than once."""
    both = a.unionByName(b, allowMissingColumns=True)
    twice = both.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key, F.lit(True).alias("duplicate"))
    return both.join(twice, key, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def distinct_by_id(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n_variants, conflict): different rows per id; more than one is a conflict."""
    d = rows.select(key, *columns).dropDuplicates()
    return d.groupBy(key).agg(F.count("*").alias("n_variants")).withColumn("conflict", F.col("n_variants") > 1)


def disjointness(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """(pair, n_common): values of ``column`` that two frames share, for each pair of named frames."""
    names, out = list(frames), None
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            n = frames[x].select(column).intersect(frames[y].select(column)).where(F.col(column).isNotNull()).agg(F.count("*").alias("n_common")).select(F.lit(f"{x}_{y}").alias("pair"), "n_common")
            out = n if out is None else out.unionByName(n)
    return out


def set_equality(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """One row (only_left, only_right): ids that only one side has."""
    x, y = a.select(F.col(left).alias("k")), b.select(F.col(right).alias("k"))
    return x.subtract(y).agg(F.count("*").alias("only_left")).crossJoin(y.subtract(x).agg(F.count("*").alias("only_right")))  # one row each


def view_violations(exact: DataFrame, both: DataFrame, key: str) -> DataFrame:
    """(rule, n) over an exact view and a view with censored rows (columns target, op, value, bound_lower, bound_upper, is_censored).

    exact_rows: exact rows that differ between the views; two_sided: bounds on both sides;
    direction: an inequality whose bound is on the wrong side (``<`` bounds -log10 from below);
    bound_value: a bound that is not -log10 of the value.
    """
    columns = [key, "target"]
    again = both.where("not is_censored").select(*columns)
    differing = row_differences(exact, again, columns).agg(F.sum("n").alias("n")).select(F.lit("exact_rows").alias("rule"), "n")
    c = both.where("is_censored")
    low, high, less = F.col("bound_lower"), F.col("bound_upper"), F.col("op").isin("<", "<=")
    bound = F.coalesce(low, high)
    rules = {
        "two_sided": low.isNotNull() & high.isNotNull(),
        "direction": (less & low.isNull()) | (F.col("op").isin(">", ">=") & high.isNull()),
        "bound_value": bound.isNull() | (F.abs(bound + F.log10("value")) > 1e-9),
    }
    wide = c.agg(*[F.count_if(F.coalesce(r, F.lit(True))).alias(k) for k, r in rules.items()])
    return differing.unionByName(wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("x.*"))


def conflict_flags(aggregates: DataFrame, references: str, value_range: str, threshold: float, flag: str) -> DataFrame:
    """Adds new_flag, the conflict flag by the threshold, and changed, whether the stored one differs."""
    new = ((F.col(references) > 1) & (F.col(value_range) > threshold)).cast("int")
    return aggregates.withColumn("new_flag", new).withColumn("changed", ~F.col("new_flag").eqNullSafe(F.col(flag)))


def recovered_times(rows: DataFrame, key: str, ids: str, source: DataFrame, source_id: str, time: str) -> DataFrame:
    """(key, times, n_times, multi_time): exposure times of a row's sources.

    A source that is not there is the time UNKNOWN_SOURCE, one without a time UNKNOWN_TIME.
    """
    per = rows.select(key, F.explode_outer(ids).alias("__i")).join(source.select(F.col(source_id).alias("__i"), F.col(time).cast("string").alias("__t"), F.lit(True).alias("__in")), "__i", "left")
    mark = F.when(F.col("__i").isNull(), None).when(F.col("__in").isNull(), "UNKNOWN_SOURCE").otherwise(F.coalesce("__t", F.lit("UNKNOWN_TIME")))
    out = per.groupBy(key).agg(F.array_sort(F.collect_set(mark)).alias("times"))
    return out.withColumns({"n_times": F.size("times").cast("long"), "multi_time": F.size("times") > 1})


def list_overlap(rows: DataFrame, ids: str, side: Column) -> DataFrame:
    """(n_left, n_right, n_shared): distinct listed ids of the rows for which ``side`` holds, of the others, and of both."""
    each = rows.select(side.alias("s"), F.explode(ids).alias("id")).where("id is not null")
    per = each.groupBy("id").agg(F.bool_or(F.col("s")).alias("l"), F.bool_or(~F.col("s")).alias("r"))
    return per.agg(F.count_if("l").alias("n_left"), F.count_if("r").alias("n_right"), F.count_if(F.col("l") & F.col("r")).alias("n_shared"))


def json_list_contains(text: Column, value: str) -> Column:
    """Whether a JSON list of texts holds the value; false for anything that is no list."""
    return F.coalesce(F.array_contains(F.from_json(text, "array<string>"), value), F.lit(False))


def censored_to_split(rows: DataFrame, key: str, identifiers: list[str], conditions: list[str], lookup: DataFrame, fallback: Column) -> DataFrame:
    """(key, split_part): the one part in which either identifier has the same conditions.

    ``lookup`` has (identifier, conditions..., split_part). Several parts give none; no match
    gives train where ``fallback`` holds.
    """
    each = rows.select(key, *conditions, F.explode(F.array(*[F.col(c).cast("string") for c in identifiers])).alias("identifier")).where("identifier is not null")
    keys = ["identifier", *conditions]
    met = each.join(lookup.select(F.col("identifier").cast("string"), *conditions, "split_part").distinct(), keys).groupBy(key).agg(F.min("split_part").alias("__a"), F.max("split_part").alias("__b"))
    part = F.when(F.col("__a") == F.col("__b"), F.col("__a")).when(F.col("__a").isNull() & fallback, "train")
    return rows.join(met, key, "left").select(key, part.alias("split_part"))
