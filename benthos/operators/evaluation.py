"""Evaluation of predictions: comparisons of variants, strata, rankings and tests per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.operators.aggregates import cluster_bootstrap, regression_metrics, seed_ensemble
from benthos.operators.ranks import average_rank, quantiles, range_rank


def paired_errors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, delta): absolute error of ``a`` less that of ``b`` on the records that both score."""
    e = lambda d, n: d.where("scored").select(key, F.abs(F.col("prediction") - F.col("target")).alias(n))
    return e(a, "__a").join(e(b, "__b"), key).select(key, (F.col("__a") - F.col("__b")).alias("delta"))


def within_task_r2(rows: DataFrame, head: str, y: str, p: str) -> DataFrame:
    """One row: 1 - (sum of squared errors) / (sum over tasks of squares around the task's mean); null if that is 0."""
    e = F.col(p) - F.col(y)
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    per = rows.where(ok).groupBy(head).agg(F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return per.agg(F.when(F.sum("sst") > 0, 1 - F.sum("sse") / F.sum("sst")).alias("within_r2"))


def replay_ensemble(members: DataFrame, stored: DataFrame, seeds: int, tolerance: float = 1e-6) -> DataFrame:
    """(stable_record_id, members, prediction, stored, state): means over the members there are, held against a stored table.

    state: same, differs, missing (not stored) or extra (stored only).
    """
    mean = seed_ensemble(members, seeds, require_all=False)
    both = mean.join(stored.select("stable_record_id", F.col("prediction").alias("stored"), F.lit(True).alias("__s")), "stable_record_id", "full_outer")
    close = F.coalesce(F.abs(F.col("prediction") - F.col("stored")) <= tolerance, F.col("prediction").isNull() & F.col("stored").isNull())
    state = F.when(F.col("__s").isNull(), "missing").when(F.col("members").isNull(), "extra").when(close, "same").otherwise("differs")
    return both.select("stable_record_id", "members", "prediction", "stored", state.alias("state"))


def direction_counts(heads: DataFrame, base: str, variant: str) -> DataFrame:
    """One row: tasks in which the variant's error is smaller (better), larger (worse) or equal."""
    a, b = F.col(base), F.col(variant)
    return heads.agg(F.count_if(b < a).alias("better"), F.count_if(b > a).alias("worse"), F.count_if(b == a).alias("equal"))


def perturbation_summary(rows: DataFrame, key: str, prediction: str, target: str) -> DataFrame:
    """(key, n, mean, sd, error): replicates' mean and population deviation, and the mean's error."""
    return rows.groupBy(key).agg(F.count(prediction).alias("n"), F.avg(prediction).alias("mean"), F.stddev_pop(prediction).alias("sd"), (F.avg(prediction) - F.avg(target)).alias("error"))


def preferred_metrics(rows: DataFrame, by: list[str], preferred: Column) -> DataFrame:
    """Regression metrics per group over its preferred rows (such as evaluation rows), or over all where it has none."""
    d = rows.withColumn("__p", F.coalesce(preferred, F.lit(False)))
    has = d.groupBy(*by).agg(F.bool_or("__p").alias("__has"))
    return d.join(has, by).where(~F.col("__has") | F.col("__p")).groupBy(*by).agg(*regression_metrics())


def binned_profile(rows: DataFrame, x: str, y: str, bins: int = 28, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(bin, n, mean, q25, q75) of ``y`` over equal bins of ``x`` between two of its quantiles; rows outside are left out."""
    q = quantiles(rows.select(x), [], x, {"lo": low, "hi": high}).first()
    lo, hi = q["lo"], q["hi"]
    if lo is None:
        lo = hi = 0.0
    inside = rows.where(F.col(x).between(lo, hi))
    step = (hi - lo) / bins
    b = F.least(F.floor((F.col(x) - lo) / step) + 1, F.lit(bins)) if step > 0 else F.lit(1).cast("long")  # the last edge is closed
    named = inside.select(b.alias("bin"), F.col(y).alias("__y"))
    return quantiles(named, ["bin"], "__y", {"q25": 0.25, "q75": 0.75}, F.count("*").alias("n"), F.avg("__y").alias("mean"))


def validation_winner(heads: DataFrame, models: list[str]) -> DataFrame:
    """One row (winner, macro_mae): the model with the smallest mean over heads, ties by the order of ``models``."""
    m = heads.agg(*[F.avg(c).alias(c) for c in models])
    each = F.explode(F.array(*[F.struct(F.col(c).alias("macro_mae"), F.lit(i).alias("i"), F.lit(c).alias("winner")) for i, c in enumerate(models)]))
    return m.select(each.alias("x")).where("x.macro_mae is not null").agg(F.min("x").alias("x")).select("x.winner", "x.macro_mae")


def risk_coverage(rows: DataFrame, score: str, error: str, cutoffs: list[float]) -> DataFrame:
    """(cutoff, kept, mae): rows at or above each frozen cutoff, and their mean absolute error.

    Rows are counted once, in the band between two cutoffs; a cutoff adds up the bands above it.
    """
    cuts = sorted(cutoffs)
    band = F.lit(-1)
    for i, c in enumerate(cuts):
        band = F.when(F.col(score) >= c, i).otherwise(band)
    per = rows.groupBy(band.alias("__b")).agg(F.count(error).alias("k"), F.sum(error).alias("e"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff")) for i, c in enumerate(cuts)]))
    grid = rows.sparkSession.range(1).select(levels.alias("x")).select("x.*")
    return grid.join(per, F.col("__b") >= F.col("i"), "left").groupBy("cutoff").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("kept"), (F.sum("e") / F.sum("k")).alias("mae"))  # both sides as short as the cutoff list


def scope_effect(rows: DataFrame, head: str, low: Column, error: str, least: int = 20) -> DataFrame:
    """(head, n_low, n_high, effect): mean error at low support less that at high support, where both sides have enough rows."""
    e, n = F.col(error), F.col(error).isNotNull()
    g = rows.groupBy(head).agg(F.count_if(low & n).alias("n_low"), F.count_if(~low & n).alias("n_high"), (F.avg(F.when(low, e)) - F.avg(F.when(~low, e))).alias("__d"))
    return g.select(head, "n_low", "n_high", F.when(F.least("n_low", "n_high") >= least, F.col("__d")).alias("effect"))


def quartile_bands(rows: DataFrame, value: str) -> Column:
    """q1..q4 by the quartiles of ``value`` over the rows; a value on a quartile is in the lower band."""
    q = quantiles(rows, [], value, {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    v = F.col(value)
    return F.when(v <= q["a"], "q1").when(v <= q["b"], "q2").when(v <= q["c"], "q3").when(v.isNotNull(), "q4") if q["a"] is not None else F.lit(None).cast("string")


def bands(value: Column, cuts: list[tuple[float, str]], above: str) -> Column:
    """The name of the first cut that the value is below, else ``above``; null for null."""
    out = F.when(value.isNotNull(), above)
    for cut, name in reversed(cuts):
        out = F.when(value < cut, name).otherwise(out)
    return out


def stratified_metrics(rows: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """(stratum, band, n, mae, rmse, r2) for each named band column; rows without a band or a score are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), c.alias("band")) for k, c in strata.items()]))
    d = rows.select("target", "prediction", each.alias("x")).where("x.band is not null and target is not null and prediction is not null")
    return d.groupBy("x.stratum", "x.band").agg(*regression_metrics())


def spearman_by_task(rows: DataFrame, head: str, a: str, b: str) -> DataFrame:
    """(head, n, rho): correlation of mean ranks within each task, over rows that have both values."""
    d = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(head, F.col(a).alias("__a"), F.col(b).alias("__b"))
    ranked = average_rank(average_rank(d, head, "__a", "__ra"), head, "__b", "__rb")
    return ranked.groupBy(head).agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho"))


def task_fraction(tasks: DataFrame, size: str, name: str, share: float, totals: list[str]) -> DataFrame:
    """One row: the largest ``share`` of tasks (rounded up; ties by name), their number and the sums of their columns."""
    k = tasks.count()
    ranked = range_rank(tasks, [F.col(size).desc(), F.col(name).asc()])
    return ranked.where(F.col("rank") < F.ceil(F.lit(k * share))).agg(F.count("*").alias("n_tasks"), *[F.sum(c).alias(f"sum_{c}") for c in totals])


def seed_mean_sd(rows: DataFrame, by: list[str], seed: str, error: str) -> DataFrame:
    """(by, n, mean, sd): the seeds' mean errors, their mean and sample deviation."""
    per = rows.groupBy(*by, seed).agg(F.avg(error).alias("__m"))
    return per.groupBy(*by).agg(F.count("__m").alias("n"), F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("sd"))


def bootstrap_test(cells: DataFrame, replicates: int, seed: int, least_valid: int = 0) -> DataFrame:
    """One row (valid, low, high, p, status): percentile interval and two-sided p of the pooled difference.

    Below ``least_valid`` replicates with a value, interval and p are null and the status says so.
    """
    b = cluster_bootstrap(cells, replicates, seed)
    x = F.col("delta_pooled")
    side = F.least(F.count_if(x <= 0), F.count_if(x >= 0))
    g = b.agg(F.count(x).alias("valid"), F.percentile(x, 0.025).alias("low"), F.percentile(x, 0.975).alias("high"), F.least(F.lit(1.0), 2 * (side + 1) / (F.count(x) + 1)).alias("p"))  # a row per replicate
    enough = (F.col("valid") >= least_valid) & (F.col("valid") > 0)
    status = F.when(~enough, "TOO_FEW_REPLICATES").when((F.col("low") > 0) | (F.col("high") < 0), "EXCLUDES_ZERO").otherwise("INCLUDES_ZERO")
    return g.select("valid", *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high", "p")], status.alias("status"))


def sign_flip_test(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(head, n_clusters, n_extreme, p): cluster signs flipped by hash; null for a head with one cluster.

    Each cell is seen once per replicate; sums per (replicate, head) are formed before anything moves.
    """
    obs = cells.groupBy("head").agg(F.sum("s").alias("obs"), F.count("*").alias("n_clusters"))
    flips = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    sign = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "rep", "cluster"), 256), 1, 8), 16, 10).cast("bigint") % 2
    v = flips.groupBy("rep", "head").agg(F.sum(F.when(sign == 0, F.col("s")).otherwise(-F.col("s"))).alias("v"))
    g = v.join(obs, "head").groupBy("head").agg(F.first("n_clusters").alias("n_clusters"), F.count_if(F.abs("v") >= F.abs("obs") - 1e-9).alias("x"))
    many = F.col("n_clusters") > 1
    return g.select("head", "n_clusters", F.when(many, F.col("x")).alias("n_extreme"), F.when(many, (F.col("x") + 1) / (replicates + 1)).alias("p"))


def best_metric_row(rows: DataFrame, key: str, record: str, priority: Column, size: Column, matches: Column) -> DataFrame:
    """(key, record): rows that match first, then by priority, then the largest size, then the smallest record."""
    order = F.struct((~F.coalesce(matches, F.lit(False))).alias("m"), priority.alias("p"), (-size).alias("s"), F.col(record).alias("r"))
    return rows.groupBy(key).agg(F.min_by(record, order).alias(record))


def member_ensemble(predictions: DataFrame, key: str, require: int | None = None) -> DataFrame:
    """(key, members, prediction, sd): mean over members (null unless ``require`` are there), sample deviation or 0."""
    g = predictions.groupBy(key).agg(F.count("prediction").alias("members"), F.avg("prediction").alias("__m"), F.coalesce(F.stddev_samp("prediction"), F.lit(0.0)).alias("sd"))
    mean = F.col("__m") if require is None else F.when(F.col("members") == require, F.col("__m"))
    return g.select(key, "members", mean.alias("prediction"), "sd")


def censored_hinge(rows: DataFrame, head: str, prediction: str, bound: str, left: Column) -> DataFrame:
    """(head, n, hinge): mean squared distance of predictions beyond a one-sided bound.

    ``left`` says that the true value lies at or above the bound (so lower predictions are short).
    """
    short = F.when(left, F.col(bound) - F.col(prediction)).otherwise(F.col(prediction) - F.col(bound))
    return rows.groupBy(head).agg(F.count(short).alias("n"), F.avg(F.pow(F.greatest(F.lit(0.0), short), 2)).alias("hinge"))
