"""Quality control, merging of repeated studies, and regression metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benthos.functions.text_rules import recency_weight
from benthos.operators.ranks import deal_ranges, global_rank, largest_group, null_safe_join, quantiles, range_scan
from benthos.operators.splits import hash_key
from benthos.session import materialize


def strict_merge(rows: DataFrame, keys: list[str], value: str, ids: str) -> DataFrame:
    """Rows equal in every key (null equals null) as one: median, mean, sample deviation (0 for one row), count, range, ids."""
    return quantiles(
        rows, keys, value, {"target_median": 0.5}, F.avg(value).alias("target_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("target_std"),
        F.count(value).alias("target_count"), F.min(value).alias("target_min"), F.max(value).alias("target_max"), F.array_sort(F.collect_list(ids)).alias("result_ids"),
    )  # the id list is the result asked for: as long as the rows that are equal in all keys


def robust_stats(rows: DataFrame, keys: list[str], value: str, written: bool = False) -> DataFrame:
    """Per group: n, median, median absolute deviation, mean, population deviation. ``written``: the rows are read from a table."""
    rows = rows.select(*keys, value) if written else materialize(rows.select(*keys, value), "robust")  # read several times below
    most = largest_group(rows, keys, value)
    first = quantiles(rows, keys, value, {"qc_median": 0.5}, F.count(value).alias("qc_n"), F.avg(value).alias("qc_mean"), F.stddev_pop(value).alias("qc_std"), largest=most, written=True)
    first = materialize(first, "robust-median")
    off = null_safe_join(rows, first.select(*keys, "qc_median"), keys).withColumn("__off", F.abs(F.col(value) - F.col("qc_median")))
    return null_safe_join(first, quantiles(off, keys, "__off", {"qc_mad": 0.5}, largest=most, written=True), keys)


def robust_screen(rows: DataFrame, keys: list[str], value: str, min_n: int = 50, limit: float = 4.0, stats: DataFrame | None = None) -> DataFrame:
    """Adds robust_z, qc_n, qc_status and qc_reason.

    z is 0.6745 (x - median) / MAD, or (x - mean) / deviation where the MAD vanishes, or 0.
    Rows beyond the limit are excluded in groups of ``min_n`` or more; smaller groups are
    left for audit. ``stats`` may come from other rows, such as the training part.
    """
    if stats is None:
        rows = materialize(rows, "screen")  # read by the statistics and below
        stats = robust_stats(rows, keys, value, written=True)
    d = null_safe_join(rows, materialize(stats, "screen-stats"), keys)  # a row per group, of known size
    x = F.col(value)
    z = F.when(F.col("qc_mad") > 1e-12, 0.6745 * (x - F.col("qc_median")) / F.col("qc_mad")).when(F.col("qc_std") > 1e-12, (x - F.col("qc_mean")) / F.col("qc_std")).otherwise(0.0)
    d = d.withColumn("robust_z", z)
    out = (F.col("qc_n") >= min_n) & (F.abs("robust_z") > limit)
    return d.withColumns({"qc_status": F.when(out, "excluded").otherwise("included"), "qc_reason": F.when(out, f"robust_z_gt_{limit:g}").when(F.col("qc_n") < min_n, "small_group_manual_audit")}).drop("qc_median", "qc_mad", "qc_mean", "qc_std")


def recency_weights(rows: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Adds reference_weight: by age against the latest year of the group, over all rows given.

    The latest years, a row per group, are written before they are joined, so a short table moves no rows.
    """
    latest = materialize(rows.groupBy(*keys).agg(F.max(year).alias("__latest")), "latest")
    return null_safe_join(rows, latest, keys).withColumn("reference_weight", recency_weight(F.col(year), F.col("__latest"))).drop("__latest")


def reference_merge(rows: DataFrame, keys: list[str], value: str, reference: str, test: str, conflict_above: float = 0.3) -> DataFrame:
    """Two levels: median per (reference, test), then weighted mean, deviation, range and conflict flag per key."""
    rows = materialize(rows.select(*keys, value, reference, test, "reference_weight"), "merge")  # read three times below
    raw = quantiles(rows, keys, value, {"unweighted_median": 0.5}, F.count(value).alias("n_rows"), written=True)
    # apart, so that what is not asked for is not counted
    raw = null_safe_join(raw, rows.groupBy(*keys).agg(F.countDistinct(reference).alias("n_references"), F.countDistinct(test).alias("n_tests")), keys)
    unit_keys = [*keys, reference, test]
    units = rows.groupBy(*unit_keys).agg(F.percentile(value, 0.5).alias("u"), F.avg("reference_weight").alias("w"))
    total, plain = F.sum("w"), F.avg("u")
    merged = units.groupBy(*keys).agg(
        F.when(total > 0, F.sum(F.col("w") * F.col("u")) / total).otherwise(plain).alias("weighted_mean"), (F.max("u") - F.min("u")).alias("value_range"),
        total.alias("weight_sum"), F.avg("w").alias("mean_weight"), F.count("*").alias("n_units"), F.sum(F.col("w") * F.col("u") * F.col("u")).alias("__square"),
    )
    variance = F.col("__square") / F.col("weight_sum") - F.col("weighted_mean") * F.col("weighted_mean")
    merged = merged.withColumn("weighted_std", F.when(F.col("n_units") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0)).drop("__square")
    return null_safe_join(merged, raw, keys).withColumn("conflict_flag", ((F.col("n_references") > 1) & (F.col("value_range") > conflict_above)).cast("int"))


def regression_metrics(y: str = "target", p: str = "prediction") -> list[Column]:
    """n, mae, rmse, r2 over rows where both are there; r2 is NULL for under two rows or a constant target."""
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    yy, e = F.when(ok, F.col(y)), F.when(ok, F.col(p) - F.col(y))
    sst = F.var_pop(yy) * F.count(yy)
    return [F.count(yy).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when((F.count(yy) >= 2) & (sst > 0), 1 - F.sum(e * e) / sst).alias("r2")]


def huber(y: str, p: str, delta: float = 1.0) -> Column:
    e = F.abs(F.col(p) - F.col(y))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def head_and_pooled(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics per head with coverage, and one row of pooled, macro and median values over defined heads."""
    d = aligned.withColumns({"y": F.when(F.col("scored"), F.col("target")), "p": F.when(F.col("scored"), F.col("prediction"))})
    expected = F.sum(F.col("exact_expected").cast("int"))
    heads = d.groupBy("model_head").agg(F.count("*").alias("n_cohort"), expected.alias("n_exact_expected"), *regression_metrics("y", "p"))
    heads = heads.withColumns({"coverage": F.when(F.col("n_exact_expected") > 0, F.col("n") / F.col("n_exact_expected")), "r2_status": F.when(F.col("r2").isNotNull(), "DEFINED").when(F.col("n") < 2, "N_LT_2").otherwise("CONSTANT_TARGET")})
    pooled = d.agg(*[c.alias(f"pooled_{n}") for n, c in zip(("n", "mae", "rmse", "r2"), regression_metrics("y", "p"))])
    macro = heads.agg(*[f(m).alias(f"{k}_{m}") for m in ("mae", "rmse", "r2") for k, f in (("macro", F.avg), ("median", lambda c: F.percentile(c, 0.5)))], F.count("*").alias("n_heads"))
    return heads, pooled.crossJoin(macro)  # one row by one row


def seed_ensemble(predictions: DataFrame, seeds: int, require_all: bool = True) -> DataFrame:
    """Mean over seeds per record: only where every seed has an estimate, or over those that have one."""
    g = predictions.groupBy("stable_record_id").agg(F.count("prediction").alias("members"), F.avg("prediction").alias("mean"), F.stddev_samp("prediction").alias("sd"))
    return g.select("stable_record_id", "members", (F.when(F.col("members") == seeds, F.col("mean")) if require_all else F.col("mean")).alias("prediction"), "sd")


def rank_window(partition: list[str], *order: Column):
    return Window.partitionBy(*partition).orderBy(*order)


def holm(p: DataFrame, family: list[str], value: str = "p") -> DataFrame:
    """Adds p_holm: step-down over the whole family; what cannot be estimated counts as 1 and stays NULL.

    The running maximum goes over ranges of the order, so a family may be larger than a task.
    """
    order = [F.col("__q"), F.col("contrast")]
    dealt = deal_ranges(p.withColumn("__q", F.coalesce(F.col(value).cast("double"), F.lit(1.0))), family, order)
    ranked = range_scan(dealt, family, order, __rank=("sum", F.lit(1), "before"), __m=("sum", F.lit(1), "all"))
    step = F.least(F.lit(1.0), (F.col("__m") - F.col("__rank") + 1) * F.col("__q"))
    run = range_scan(ranked.withColumn("__s", step), family, order, __max=("max", F.col("__s"), "before"))
    return run.withColumn("p_holm", F.when(F.col(value).isNotNull(), F.col("__max"))).select(*p.columns, "p_holm")


def benjamini_hochberg(p: DataFrame, family: list[str], value: str = "p") -> DataFrame:
    """Adds q_bh over the family's estimable contrasts, by a running minimum over ranges of the order."""
    order, group = [F.col(value), F.col("contrast")], [*family, "__none"]
    dealt = deal_ranges(p.withColumn("__none", F.col(value).isNull()), group, order)
    ranked = range_scan(dealt, group, order, __rank=("sum", F.lit(1), "before"), __m=("sum", F.lit(1), "all"))
    run = range_scan(ranked.withColumn("__r", F.col(value) * F.col("__m") / F.col("__rank")), group, order, __min=("min", F.col("__r"), "after"))
    return run.withColumn("q_bh", F.when(F.col(value).isNotNull(), F.least(F.lit(1.0), F.col("__min")))).select(*p.columns, "q_bh")


def cluster_bootstrap(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, delta_pooled, delta_macro) from cells (cluster, head, n, s), clusters drawn with replacement.

    Draw j of a replicate takes the cluster numbered by a hash, so draws need no shared random
    stream. Multiplicities are counted before they meet the cells. The macro value is NULL
    where a head has no drawn row.
    """
    clusters = cells.select("cluster").distinct()
    # numbers 0..P-1 in hash order, ranked in buckets
    numbered = global_rank(clusters.withColumn("__k", hash_key(seed, "cluster")), "__k").select("cluster", F.col("rank").alias("number"))
    p = clusters.count()
    draws = cells.sparkSession.range(replicates * p).select(F.expr(f"id div {p}").alias("replicate"), (F.col("id") % p).alias("j"))  # over many tasks
    pick = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "replicate", "j"), 256), 1, 8), 16, 10).cast("bigint") % p
    weights = draws.groupBy("replicate", pick.alias("number")).agg(F.count("*").alias("m")).join(numbered, "number")
    heads = cells.select("head").distinct().agg(F.count("*").alias("h"))
    per = weights.join(cells, "cluster").groupBy("replicate", "head").agg(F.sum(F.col("m") * F.col("n")).alias("n"), F.sum(F.col("m") * F.col("s")).alias("s"))
    out = per.groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("delta_pooled"), F.avg(F.col("s") / F.col("n")).alias("macro"), F.count("*").alias("k"))
    return out.crossJoin(F.broadcast(heads)).select("replicate", "delta_pooled", F.when(F.col("k") == F.col("h"), F.col("macro")).alias("delta_macro"))
