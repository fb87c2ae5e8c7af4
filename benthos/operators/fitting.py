"""What is fitted on training rows: scales, category maps, weights, supports and feature matrices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.functions.text_rules import hash_bin
from benthos.operators.ranks import deal_ranges, global_rank, null_safe_join, quantiles, range_rank, range_scan
from benthos.operators.splits import hash_key
from benthos.session import materialize

GLOBAL = "__global__"
MODES = ("none", "identity", "global", "per_task", "per_target", "per_task_target", "per_adapter", "per_task_adapter")


def _floor(sd: Column) -> Column:
    return F.when(sd > 1e-12, sd).otherwise(1.0)


def scale_numeric(rows: DataFrame, train: Column, columns: list[str], clip: float = 6.0) -> DataFrame:
    """Adds z_<column>, by the training rows' mean and population deviation (1 where that vanishes), clipped, and clipped_<column>."""
    s = rows.where(train).agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), _floor(F.stddev_pop(c)).alias(f"__s_{c}"))])
    d = rows.crossJoin(F.broadcast(s))  # one row
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in columns}
    out = {f"z_{c}": F.when(x.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), x))) for c, x in z.items()}  # least and greatest skip nulls
    return d.withColumns(out | {f"clipped_{c}": F.coalesce(F.abs(x) > clip, F.lit(False)) for c, x in z.items()}).drop(*s.columns)


def clipped_counts(scaled: DataFrame) -> DataFrame:
    """(column, n_clipped) of what scale_numeric made."""
    names = [c for c in scaled.columns if c.startswith("clipped_")]
    wide = scaled.agg(*[F.count_if(c).alias(c) for c in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c[8:]).alias("column"), F.col(c).alias("n_clipped")) for c in names])).alias("x")).select("x.*")


def scale_key(mode: str, task: Column, target: Column, adapter: Column) -> Column:
    """The key of a row's scale under one of eight modes."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")
    keys = {"per_task": task, "per_target": target, "per_adapter": adapter, "per_task_adapter": F.concat_ws("|", task, adapter), "per_task_target": F.concat_ws("|", task, target)}
    return keys.get(mode, F.lit(GLOBAL))


def fit_target_scaler(train: DataFrame, value: str, key: Column) -> DataFrame:
    """(key, count, mean, std, min, max) per key, and for all rows as the global key; std is 1 where it vanishes."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    stats = [F.count(v).alias("count"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), _floor(F.stddev_pop(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    own = train.groupBy(key.alias("key")).agg(*stats)
    whole = train.agg(*stats).select(F.lit(GLOBAL).alias("key"), "count", "mean", "std", "min", "max")
    return own.where(F.col("key") != GLOBAL).unionByName(whole)


def apply_target_scaler(rows: DataFrame, stats: DataFrame, value: str, key: Column, mode: str, out: str, inverse: bool = False) -> DataFrame:
    """Adds ``out``: the scaled value (or, inverse, the value back); unknown keys take the global scale; none and identity change nothing."""
    if mode in ("none", "identity"):
        return rows.withColumn(out, F.col(value).cast("double"))
    own = stats.select(F.col("key").alias("__key"), F.col("mean").alias("__m"), F.col("std").alias("__s"))
    whole = stats.where(F.col("key") == GLOBAL).select(F.col("mean").alias("__gm"), F.col("std").alias("__gs"))
    d = rows.withColumn("__key", key).join(own, "__key", "left").crossJoin(F.broadcast(whole))  # one row
    m, s = F.coalesce("__m", "__gm"), F.coalesce("__s", "__gs")
    return d.withColumn(out, F.col(value) * s + m if inverse else (F.col(value) - m) / s).drop("__key", "__m", "__s", "__gm", "__gs")


def category_codes(rows: DataFrame, train: Column, column: str, out: str, min_count: int = 1, dialect: str = "reserved") -> DataFrame:
    """Adds ``out``, the code of a category learnt from training rows.

    reserved: missing 1, unknown 2, rare (fewer than min_count) 3, the others from 4 in the order
    of their names. frequency: unknown and rare 0, the others from 1 by falling count, then name;
    a missing value counts as the category ``<missing>``.
    """
    name = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    if dialect == "frequency":
        name = F.coalesce(name, F.lit("<missing>"))
    elif dialect != "reserved":
        raise ValueError(f"unknown dialect {dialect}")
    d = rows.withColumn("__v", name)
    n = d.where(train & F.col("__v").isNotNull()).groupBy("__v").agg(F.count("*").alias("__n"))
    kept = n.where(F.col("__n") >= min_count)
    order, first = ([F.col("__v").asc()], 4) if dialect == "reserved" else ([F.col("__n").desc(), F.col("__v").asc()], 1)
    codes = range_rank(kept, order).select("__v", (F.col("rank") + first).cast("long").alias("__c"))
    j = d.join(n, "__v", "left").join(codes, "__v", "left")
    other = F.when(F.col("__v").isNull(), 1).when(F.col("__n").isNull(), 2).otherwise(3) if dialect == "reserved" else F.lit(0)
    return j.withColumn(out, F.coalesce("__c", other.cast("long"))).drop("__v", "__n", "__c")


def tabular_encoding(rows: DataFrame, train: Column, numbers: list[str], category: str, key: str, masked: frozenset[str] = frozenset(), most_levels: int = 30, bins: int = 16) -> tuple[DataFrame, list[str]]:
    """((key, features), names): numbers filled with training medians and the category's training levels.

    Levels below max(2, 1 % of the training rows) are pooled as ``<rare>``; an unknown level sets
    nothing. Up to ``most_levels`` levels are one column each, more are hashed into ``bins`` columns by
    MD5. Names in ``masked`` are zero, and columns that are constant over the training rows are
    dropped. The names and the level list (a row per level, most_levels + 1 at most) reach the driver.
    """
    t = rows.where(train)
    n = t.count()
    medians = quantiles(t.select(*[F.col(c).cast("double").alias(c) for c in numbers], F.lit(1).alias("__g")), ["__g"], numbers[0], {numbers[0]: 0.5}) if numbers else None
    fill = {numbers[0]: medians.first()[numbers[0]] if medians is not None and n else 0.0} if numbers else {}
    for c in numbers[1:]:
        fill[c] = quantiles(t.select(F.col(c).cast("double").alias(c)), [], c, {"m": 0.5}).first()["m"]
    counts = t.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("__k"))
    levels = counts.select(category, F.when(F.col("__k") >= F.greatest(F.lit(2), F.ceil(F.lit(n * 0.01))), F.col(category).cast("string")).otherwise("<rare>").alias("__level"))
    names = [r[0] for r in levels.select("__level").distinct().orderBy("__level").limit(most_levels + 1).collect()]
    d = rows.join(levels, category, "left")
    plain = [F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c] or 0.0))) for c in numbers]
    if len(names) <= most_levels:
        hot, columns = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("__level")) - 1, [f"{category}={x}" for x in names]
    else:
        hot, columns = hash_bin(F.col(category).cast("string"), bins), [f"{category}#{i}" for i in range(bins)]
    # written with one column for all levels, so that rules are run once a row, not once a column
    slim = materialize(d.select(key, train.alias("__train"), hot.alias("__hot"), *[x.alias(f"n{i}") for i, x in enumerate(plain)]), "tabular")
    values = {c: F.col(f"n{i}") for i, c in enumerate(numbers)} | {c: F.coalesce((F.col("__hot") == i).cast("double"), F.lit(0.0)) for i, c in enumerate(columns)}
    values = {k: F.lit(0.0) if k in masked or category in masked and k in columns else v for k, v in values.items()}
    wide = slim.select(key, "__train", *[v.alias(f"f{i}") for i, v in enumerate(values.values())])
    ends = wide.where("__train").agg(*[(F.min(f"f{i}") < F.max(f"f{i}")).alias(f"f{i}") for i in range(len(values))]).first()
    kept = [i for i in range(len(values)) if ends[i]]
    out = wide.select(key, F.array(*[F.col(f"f{i}") for i in kept]).cast("array<double>").alias("features"))
    return materialize(out, "tabular-features"), [list(values)[i] for i in kept]  # read entry by entry


def task_weights(train: DataFrame, head: str, group: str, bases: dict[str, float], exponent: float = 0.5, low: float = 0.25, high: float = 4.0, manual: dict[str, float] | None = None) -> DataFrame:
    """(head, n, weight): base of the head's group (1 if not named) times a manual factor times (median count / count)^exponent, clipped."""
    n = train.groupBy(head).agg(F.count("*").alias("n"), F.min(group).alias("__g"))
    pick = lambda c, d: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[c], F.lit(1.0)) if d else F.lit(1.0)
    base = pick(F.col("__g"), bases) * pick(F.col(head), manual or {})
    middle = n.agg(F.percentile("n", 0.5).alias("__md"))  # a row per head
    w = base * F.pow(F.col("__md") / F.col("n"), F.lit(exponent))
    return n.crossJoin(F.broadcast(middle)).select(head, "n", F.greatest(F.lit(low), F.least(F.lit(high), w)).alias("weight"))


def clipped_to_mean(values: list[float], counts: list[float], low: float, high: float, goal: float = 1.0) -> list[float]:
    """Values times one factor, clipped, with the factor chosen so that their weighted mean is ``goal`` (if that can be)."""
    clip = lambda f: [min(high, max(low, v * f)) for v in values]
    total = sum(counts)
    if not total or low > goal or high < goal:
        return clip(1.0)
    mean = lambda f: sum(c * x for c, x in zip(counts, clip(f))) / total
    small, large = 0.0, 1.0
    while mean(large) < goal and large < 1e12:
        large *= 2
    for _ in range(100):
        middle = (small + large) / 2
        small, large = (middle, large) if mean(middle) < goal else (small, middle)
    return clip(large)


def level_weights(train: DataFrame, level: str, beta: float, low: float, high: float) -> DataFrame:
    """(level, n, weight): count^-beta per effect level, brought to mean 1 over the rows within [low, high].

    The factor is found on the table of levels, which is one small task.
    """
    counts = train.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("n"))

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].astype(float)
        raw = n**-beta
        raw = raw / ((raw * n).sum() / n.sum())
        pdf["weight"] = clipped_to_mean(raw.tolist(), n.tolist(), min(low, high), max(low, high))
        return pdf

    kind = dict(counts.dtypes)[level]
    return counts.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda pdf: balance(pdf.drop(columns="__all")), f"{level} {kind}, n long, weight double")


def bin_sampling_weights(train: DataFrame, record: str, head: str, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(record, head, bin, weight): inverse frequency of equal-width target bins within a task, clipped, task mass kept.

    The largest value stays in the last bin. A task whose values are all equal has one bin.
    Each task's factor is found on its bins.
    """
    r = train.groupBy(head).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / width) + 1, F.lit(bins))).otherwise(1)
    b = train.select(record, head, value).join(r, head).select(record, head, at.cast("long").alias("bin"))
    counts = b.groupBy(head, "bin").agg(F.count("*").alias("n"))

    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].astype(float)
        raw = n.sum() / (len(n) * n)
        pdf["weight"] = clipped_to_mean(raw.tolist(), n.tolist(), low, high)
        return pdf[[head, "bin", "weight"]]

    kind = dict(counts.dtypes)[head]
    weights = counts.groupBy(head).applyInPandas(balance, f"{head} {kind}, bin long, weight double")
    return b.join(weights, [head, "bin"]).select(record, head, "bin", "weight")


def shrinkage(train: DataFrame, head: str, family: str, tau: float) -> DataFrame:
    """(head, n, family, n_family, shrinkage): n / (n + tau), how far a head leaves its family's value."""
    n = train.groupBy(head).agg(F.count("*").alias("n"), F.min(family).alias(family))
    whole = n.groupBy(family).agg(F.sum("n").alias("n_family"))
    return n.join(whole, family, "left").select(head, "n", family, "n_family", (F.col("n") / (F.col("n") + tau)).alias("shrinkage"))


def similarity_weights(rows: DataFrame, low: float, high: float, similarity: str | None = None, alpha: float = 1.0, distance: str | None = None, decay: float = 1.0) -> DataFrame:
    """Adds weight: (1 + alpha similarity) and/or exp(-decay distance), divided by its mean over all rows, clipped."""
    w = F.lit(1.0)
    if similarity:
        w = w * (1 + alpha * F.col(similarity))
    if distance:
        w = w * F.exp(-decay * F.col(distance))
    d = rows.withColumn("__w", w)
    mean = d.agg(F.avg("__w").alias("__m"))
    return d.crossJoin(F.broadcast(mean)).withColumn("weight", F.when(F.col("__w").isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col("__w") / F.col("__m"))))).drop("__m", "__w")  # one row


def stratified_anchor(rows: DataFrame, task: str, record: str, size: int, seed: int) -> DataFrame:
    """Rows in hash order within their task, up to a quota proportional to the task's size (at least one)."""
    n = rows.groupBy(task).agg(F.count("*").alias("__n"))
    quota = n.crossJoin(F.broadcast(n.agg(F.sum("__n").alias("__all")))).select(task, F.greatest(F.lit(1), F.floor(F.lit(size) * F.col("__n") / F.col("__all"))).alias("__q"))  # one row
    ranked = global_rank(rows.withColumn("__k", hash_key(seed, record)), "__k", [task])
    return null_safe_join(ranked, quota, [task]).where("rank < __q").drop("__k", "rank", "__q")


def internal_validation(rows: DataFrame, task: str, record: str, share: float, seed: int) -> DataFrame:
    """Adds is_valid: the first floor(share n) rows of a task in hash order, at least one, and at least one left over."""
    n = rows.groupBy(task).agg(F.count("*").alias("__n"))
    ranked = null_safe_join(global_rank(rows.withColumn("__k", hash_key(seed, record)), "__k", [task]), n, [task])
    take = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.floor(F.col("__n") * share)))
    return ranked.withColumn("is_valid", F.col("rank") < take).drop("__k", "rank", "__n")


def task_filter(rows: DataFrame, head: str, train: Column, minima: tuple[int, int, int], allowed: list[str] | None = None) -> DataFrame:
    """(head, n, n_train, n_eval) of allowed heads with enough rows in all, in training and in evaluation."""
    d = rows.where(F.col(head).isin(allowed)) if allowed is not None else rows
    g = d.groupBy(head).agg(F.count("*").alias("n"), F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_eval"))
    total, least_train, least_eval = minima
    return g.where((F.col("n") >= total) & (F.col("n_train") >= least_train) & (F.col("n_eval") >= least_eval))


def reference_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median): what a request with these keys is told."""
    rows = materialize(rows.select(*keys, value), "reference")  # read several times
    return quantiles(rows, keys, value, {"median": 0.5}, F.count(value).alias("n"), written=True)


def support_counts(reference: DataFrame, task: list[str], species: str) -> DataFrame:
    """(task, species, by_task, by_species, by_species_task, max_species_task): reference rows per task, species and both."""
    cell = reference.groupBy(*task, species).agg(F.count("*").alias("by_species_task"))
    by_task = cell.groupBy(*task).agg(F.sum("by_species_task").alias("by_task"), F.max("by_species_task").alias("max_species_task"))
    by_species = cell.groupBy(species).agg(F.sum("by_species_task").alias("by_species"))
    return null_safe_join(null_safe_join(cell, by_task, task), by_species, [species])


def _log_support(n: Column, most: Column) -> Column:
    return F.when((n > 0) & (most > 0), F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(most.cast("double")))).otherwise(0.0)


#: How much a request is supported by a task that has seen its taxon, by the deepest level seen.
TAXON_LEVELS = {"latin_name": 1.0, "genus": 0.85, "family": 0.70, "tax_order": 0.55, "class_name": 0.40, "phylum": 0.25, "kingdom": 0.25}


def nearest_support(requests: DataFrame, reference: DataFrame, record: str, task: list[str], value: str, logarithmic: bool = False) -> DataFrame:
    """(record, support): 1 - distance to the task's nearest reference value, over its 5-95 % span; null without values or span.

    Each request value finds its neighbours among the task's distinct values by two running
    maxima and minima over ranges of the order, not by pairs or one window per task.
    """
    v = F.col(value).cast("double")
    known = reference.where(v.isNotNull() & ~F.isnan(v)).select(*task, v.alias("__v"))
    span = quantiles(known, task, "__v", {"__a": 0.05, "__b": 0.95})
    asked = requests.where(v.isNotNull()).select(*task, v.alias("__v")).distinct().withColumn("__known", F.lit(False))
    both = known.distinct().withColumn("__known", F.lit(True)).unionByName(asked).groupBy(*task, "__v").agg(F.bool_or("__known").alias("__known"), F.bool_or(~F.col("__known")).alias("__asked"))
    mine, order = F.when(F.col("__known"), F.col("__v")), [F.col("__v")]
    scanned = range_scan(deal_ranges(both, task, order), task, order, __lo=("max", mine, "before"), __hi=("min", mine, "after"))
    near = null_safe_join(scanned.where("__asked").drop("__known", "__asked", "__range"), span, task)
    f = (lambda c: F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))) if logarithmic else (lambda c: c)
    q = f(F.col("__v"))
    width = f(F.col("__b")) - f(F.col("__a"))
    away = F.least(q - f(F.col("__lo")), f(F.col("__hi")) - q)  # least skips a side that is not there
    support = F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - away / width)))
    return null_safe_join(requests.select(record, *task, v.alias("__v")), near.select(*task, "__v", support.alias("support")), [*task, "__v"]).select(record, "support")


def support_scores(requests: DataFrame, reference: DataFrame, record: str, task: list[str], taxa: dict[str, float], stage: str, numbers: dict[str, bool], axes: list[str] | None = None) -> DataFrame:
    """(record, task_support, taxon_support, stage_support, experiment_support, density_support, overall) per request.

    ``taxa``: taxonomy columns, deepest first, with the support of a match; ``numbers``: columns and
    whether they are compared as logarithms. task: log-count against the largest task; stage: the
    life stage's log-count within the task; experiment: mean of the numbers' nearest supports;
    density: log-count of reference rows that agree in the deepest taxon, stage and numbers.
    overall is the geometric mean of what is there (at least 1e-9 each), with further axes of
    ``requests`` named in ``axes``.
    """
    requests = requests.select(record, *task, *taxa, stage, *numbers, *(axes or []))
    n_task = reference.groupBy(*task).agg(F.count("*").alias("__n"))
    most = n_task.agg(F.max("__n").alias("__most"))
    d = null_safe_join(requests, n_task, task).crossJoin(F.broadcast(most))  # one row
    d = d.withColumn("task_support", _log_support(F.coalesce("__n", F.lit(0)), F.coalesce("__most", F.lit(0))))
    d = d.withColumn("taxon_support", F.lit(0.0))
    for c, share in taxa.items():
        seen = reference.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").select(*task, c).distinct().withColumn("__hit", F.lit(share))
        d = null_safe_join(d, seen, [*task, c]).withColumn("taxon_support", F.greatest("taxon_support", F.coalesce("__hit", F.lit(0.0)))).drop("__hit")
    n_stage = reference.groupBy(*task, stage).agg(F.count("*").alias("__ns"))
    told = (F.coalesce(F.trim(F.col(stage).cast("string")), F.lit("")) != "") & (F.col("__n") > 0)
    d = null_safe_join(d, n_stage, [*task, stage]).withColumn("stage_support", F.when(told, _log_support(F.coalesce("__ns", F.lit(0)), F.col("__n"))))
    for c, logarithmic in numbers.items():
        d = d.join(nearest_support(requests, reference, record, task, c, logarithmic).withColumnRenamed("support", f"__e_{c}"), record, "left")
    each = F.filter(F.array(*[F.col(f"__e_{c}") for c in numbers]), lambda x: x.isNotNull())
    d = d.withColumn("experiment_support", F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each)))
    near = [*task, next(iter(taxa)), stage, *numbers]
    agreeing = reference.groupBy(*near).agg(F.count("*").alias("__nd"))
    d = null_safe_join(d, agreeing, near).withColumn("density_support", F.when(F.col("__n") > 0, _log_support(F.coalesce("__nd", F.lit(0)), F.col("__n"))))
    parts = [F.col("task_support"), F.col("taxon_support"), F.col("stage_support"), F.col("experiment_support"), F.when(F.col("density_support") > 0, F.col("density_support")), *map(F.col, axes or [])]
    there = F.filter(F.array(*parts), lambda x: x.isNotNull())
    mean = F.exp(F.aggregate(F.transform(there, lambda x: F.log(F.greatest(x, F.lit(1e-9)))), F.lit(0.0), lambda a, x: a + x) / F.size(there))
    return d.select(record, "task_support", "taxon_support", "stage_support", "experiment_support", "density_support", F.least(F.lit(1.0), mean).alias("overall"))


#: Named feature sets of an ablation: what each leaves out (molecular views, context parts).
ABLATIONS: dict[str, frozenset[str]] = {
    "full": frozenset(),
    "no_fingerprint": frozenset(["fingerprint"]),
    "no_descriptors": frozenset(["descriptors"]),
    "descriptors_with_context": frozenset(["fingerprint"]),
    "fingerprint_with_context": frozenset(["descriptors"]),
    "no_molecular_input": frozenset(["descriptors", "fingerprint"]),
    "descriptors_only": frozenset(["fingerprint", "numeric", "duration", "species", "category", "medium"]),
    "fingerprint_only": frozenset(["descriptors", "numeric", "duration", "species", "category", "medium"]),
    "no_effect_level": frozenset(["effect_level"]),
    "no_species_lifestage": frozenset(["species"]),
    "no_duration": frozenset(["duration"]),
    "no_other_categorical_context": frozenset(["category"]),
    "no_context": frozenset(["numeric", "duration", "species", "category", "medium"]),
    "no_medium_adapter": frozenset(["medium"]),
}


def ablation_masks(feature_sets: dict[str, list[str]], ablation: str, columns: tuple[str, ...] = ()) -> frozenset[str]:
    """The columns that an ablation sets to zero: those of the sets it leaves out, and any named ones."""
    if ablation not in ABLATIONS:
        raise ValueError(f"unknown ablation {ablation}; one of {', '.join(ABLATIONS)}")
    return frozenset(c for name, cols in feature_sets.items() if name in ABLATIONS[ablation] for c in cols) | frozenset(columns)


def feature_matrix(rows: DataFrame, train: Column, key: str, numbers: list[str], levels: dict[str, list[str]], structure: str, width: int, target: str, scale: Column, mode: str, masked: frozenset[str] = frozenset()) -> DataFrame:
    """(key, features, scaled_target): z-scored numbers (missing ones 0), locked one-hot levels, the structure's vector, the scaled target.

    ``levels`` fixes each category's columns. A missing structure, or one of another width, is a
    vector of zeros; masked columns (numbers, categories or the structure) are zeros too.
    """
    stats = fit_target_scaler(rows.where(train), target, scale)
    d = apply_target_scaler(scale_numeric(rows, train, numbers), stats, target, scale, mode, "scaled_target")
    zero = F.lit(0.0)
    parts = [zero if c in masked else F.coalesce(f"z_{c}", zero) for c in numbers]
    parts += [zero if c in masked else F.coalesce((F.col(c).cast("string") == x).cast("double"), zero) for c, xs in levels.items() for x in xs]
    nothing = F.array_repeat(zero, width)
    vector = nothing if structure in masked else F.when(F.size(structure) == width, F.col(structure).cast("array<double>")).otherwise(nothing)
    return d.select(key, F.concat(F.array(*parts).cast("array<double>"), vector).alias("features"), "scaled_target")
