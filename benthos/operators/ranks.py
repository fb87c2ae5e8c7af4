"""Ranks and exact quantiles over any number of rows, without one task for all of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benthos.session import materialize

#: Rows that one rank bucket is sized for, and rows of a group up to which one aggregate holds its values (some 100
#: bytes each, of many groups in one task).
BUCKET_ROWS, GROUP_ROWS = 50_000, 100_000


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null; b's keys are dropped."""
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(other, on, "left").drop(*[f"__{k}" for k in keys])


def global_rank(df: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` from 0 in the order of a hexadecimal hash, per group of ``within`` if given (null is a group).

    Rows are bucketed by the hash's first digits, as many as the row count asks for; bucket
    sizes are summed up to offsets, and ranks are taken inside buckets. So a group that holds
    most rows is spread over many tasks.
    """
    keys = list(within or [])
    digits = max(1, math.ceil(math.log(max(1, df.count()) / BUCKET_ROWS, 16))) if not df.isEmpty() else 1
    b = df.withColumn("__b", F.substring(key, 1, digits))
    sizes = b.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "__b", F.coalesce(before, F.lit(0)).alias("__o"))  # a row per group and bucket
    inner = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(key))
    return null_safe_join(b, offsets, [*keys, "__b"]).withColumn("rank", F.col("__o") + inner - 1).drop("__b", "__o")


def range_rank(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds ``rank`` from 0 in the stated order, over any number of rows and without one task for all.

    Rows are dealt into ranges of the order and written, since the sampled borders may differ
    when they are drawn again; sizes of ranges are summed up to offsets, and ranks are taken
    inside ranges. Only rows that are equal in the whole order must share a range.
    """
    dealt = deal_ranges(df, [], order, parts).withColumnRenamed("__range", "__p")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__o"))  # one row per range
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.join(offsets, "__p").withColumn("rank", F.col("__o") + inner - 1).drop("__p", "__o")


def deal_ranges(df: DataFrame, group: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows in ranges of (group, order), numbered in ``__range`` and written; one range per BUCKET_ROWS rows.

    A group that holds most rows is dealt over many ranges; only rows that are equal in group
    and order must share one.
    """
    k = parts or max(1, math.ceil(df.count() / BUCKET_ROWS))
    return materialize(df.repartitionByRange(k, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def range_scan(dealt: DataFrame, group: list[str], order: list[Column], **scans: tuple[str, Column, str]) -> DataFrame:
    """Adds running values within each group (null is one) to rows from ``deal_ranges``.

    name=(kind, value, side): kind sum, max or min; side before (up to the row, itself included),
    after (from the row on) or all. Values run within each range, and what other ranges of the
    group contribute comes from a table of one row per group and range; null values are skipped.
    Spark computes a frame that ends with the partition anew for every row, so what runs from the
    end runs over the rows' numbers in falling order.
    """
    folds = {"sum": F.sum, "max": F.max, "min": F.min}
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
    here = Window.partitionBy(*group, "__range").orderBy(*order)
    there = Window.partitionBy(*group).orderBy("__range")
    first = Window.unboundedPreceding
    falling = Window.partitionBy(*group, "__range").orderBy(F.col("__nth").desc()).rowsBetween(first, 0)
    back = Window.partitionBy(*group).orderBy(F.col("__range").desc())
    rows = {"before": (here.rowsBetween(first, 0), there.rowsBetween(first, -1)), "after": (falling, back.rowsBetween(first, -1))}
    per = dealt.groupBy(*group, "__range").agg(*[folds[k](v).alias(f"__{n}") for n, (k, v, _) in scans.items()])
    carried = [(folds[k](f"__{n}").over(Window.partitionBy(*group)) if side == "all" else folds[k](f"__{n}").over(rows[side][1])).alias(f"__{n}") for n, (k, _, side) in scans.items()]
    met = null_safe_join(dealt, per.select(*group, "__range", *carried), [*group, "__range"])
    if any(side == "after" for _, _, side in scans.values()):
        met = met.withColumn("__nth", F.row_number().over(here))
    own = {n: F.col(f"__{n}") if side == "all" else both[k](F.col(f"__{n}"), folds[k](v).over(rows[side][0])) for n, (k, v, side) in scans.items()}
    return met.withColumns(own).drop("__nth", *[f"__{n}" for n in scans])


def average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the rank from 1 of ``value`` in its group, ties sharing their mean rank; null for null values.

    Works on counts per value: their running sums are taken over ranges of (group, value).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__k"))
    dealt = materialize(counts.repartitionByRange(F.col(group), F.col(value)).withColumn("__p", F.spark_partition_id()), "ranges")
    per = dealt.groupBy(group, "__p").agg(F.sum("__k").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.sum("__k").over(Window.partitionBy(group, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = null_safe_join(dealt, per.select(group, "__p", before.alias("__o")), [group, "__p"])
    ranked = ranked.select(group, value, (F.col("__o") + inner - (F.col("__k") - 1) / 2.0).alias(name))
    return null_safe_join(df, ranked, [group, value])


def largest_group(rows: DataFrame, keys: list[str], value: str) -> int:
    return rows.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0


def quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], *more: Column, largest: int | None = None, written: bool = False) -> DataFrame:
    """Per group: exact interpolated quantiles of ``value`` by name, and further aggregates.

    Groups of up to GROUP_ROWS rows are one aggregate each. If any group is larger, all go
    through counts instead (see ``counted_quantiles``). A group without values has null
    quantiles. ``largest``: the size of the largest group, if it is known already; ``written``:
    the rows are read from a table, not made anew each time.
    """
    slim = rows if written else materialize(rows.select(*keys, value), "quantile-rows")
    if largest is None:
        largest = largest_group(slim, keys, value)
    rows = rows if more else slim
    if largest <= GROUP_ROWS:
        exact = [F.percentile(value, p).alias(name) for name, p in probabilities.items()]
        return rows.groupBy(*keys).agg(*exact, *more) if keys else rows.agg(*exact, *more)
    return counted_quantiles(rows, keys, value, probabilities, *more, scan=slim)


def counted_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], *more: Column, cells: int = 1024, few: int | None = None, scan: DataFrame | None = None) -> DataFrame:
    """``quantiles`` by counts per cell, whatever the size of the groups.

    The stretch between a group's ends is cut into equal-width cells; the counts tell which
    cells hold the wanted ranks, and each of these, between the ends of its own values, is cut
    in the next round. Once a stretch holds one value or ``few`` rows, its distinct values are
    counted. Only counts are shuffled before that, and no aggregate holds more than cells.
    ``scan``: the same rows from a table, for what reads them several times.
    """
    scan = rows if scan is None else scan
    few = BUCKET_ROWS if few is None else few
    x = F.col(value)
    finite = F.when(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), x)
    ends = [F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.min(finite).alias("__a"), F.max(finite).alias("__b")]
    groups = materialize(rows.groupBy(*keys).agg(*ends, F.count(value).alias("__n"), *more), "quantile-groups")
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()]))
    at = F.col("__q.p") * (F.col("__n") - 1)
    ranks = F.explode(F.array(F.struct(F.floor(at).alias("r"), (1 - (at - F.floor(at))).alias("w")), F.struct(F.ceil(at).alias("r"), (at - F.floor(at)).alias("w"))))
    stretch = [*keys, "__lo", "__hi", "__a", "__b", "__n"]
    # of each wanted rank: the stretch of values that it lies in, and its place there
    wanted = groups.where("__n > 0").withColumn("__q", named).withColumn("__r", ranks).where("__r.w > 0")
    wanted = materialize(wanted.select(*stretch, F.col("__q.name").alias("__name"), F.col("__r.r").alias("__at"), F.col("__r.w").alias("__w")), "quantile-ranks")

    def inside(stretches: DataFrame) -> DataFrame:
        """Each row with the stretches of its group that it lies in."""
        on = (x >= F.col("__lo")) & (x <= F.col("__hi"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return scan.select(*keys, value).join(stretches.withColumnsRenamed({k: f"__k_{k}" for k in keys}), on).drop(*[f"__k_{k}" for k in keys])

    share = (x / 2 - F.col("__a") / 2) / (F.col("__b") / 2 - F.col("__a") / 2)
    cell = F.when(x < F.coalesce("__a", x), -1).when(F.col("__a").isNull() | (x > F.col("__b")), F.when(F.isnan(x), cells + 1).when(x < 0, -1).otherwise(cells)).when(F.col("__b") > F.col("__a"), F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1))).otherwise(0)
    left = None
    while True:
        wide = (F.col("__n") > few) & (F.col("__lo") < F.col("__hi"))
        now = wanted.where(wide).agg(F.count("*"), F.sum("__n")).first()
        if not now[0] or now == left:  # nothing is wide, or nothing can be cut further
            break
        left = now
        spots = wanted.where(wide).select(*stretch).distinct()
        counts = inside(spots).groupBy(*keys, F.col("__lo").alias("__from"), F.col("__hi").alias("__to"), cell.alias("__c")).agg(*ends, F.count("*").alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*keys, "__from", "__to").orderBy("__c"))
        counts = counts.withColumn("__u", upto)
        of = wanted.where(wide).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), "__name", "__at", "__w")
        on = (F.col("__from") == F.col("__l")) & (F.col("__to") == F.col("__h")) & (F.col("__at") < F.col("__u")) & (F.col("__at") >= F.col("__u") - F.col("__n"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cut = counts.join(of, on).select(*stretch, "__name", (F.col("__at") - (F.col("__u") - F.col("__n"))).alias("__at"), "__w")
        wanted = materialize(wanted.where(~wide).unionByName(cut), "quantile-ranks")
    one = wanted.where("__lo = __hi").select(*keys, "__name", "__w", F.col("__lo").alias("__v"))
    open_ = wanted.where("__lo < __hi")
    counts = inside(open_.select(*keys, "__lo", "__hi").distinct()).groupBy(*keys, "__lo", "__hi", value).agg(F.count("*").alias("__k"))
    counts = counts.withColumn("__u", F.sum("__k").over(Window.partitionBy(*keys, "__lo", "__hi").orderBy(value)))
    found = null_safe_join(open_, counts.select(*keys, "__lo", "__hi", value, "__u", "__k"), [*keys, "__lo", "__hi"]).where("__at < __u and __at >= __u - __k")
    parts = one.unionByName(found.select(*keys, "__name", "__w", x.alias("__v"))).groupBy(*keys).agg(*[F.sum(F.when(F.col("__name") == n, F.col("__v") * F.col("__w"))).alias(n) for n in probabilities])
    groups = groups.drop("__lo", "__hi", "__a", "__b", "__n")  # before the join, as quantiles may have these names
    return null_safe_join(groups, parts, keys) if keys else groups.crossJoin(parts)  # one row by one row
