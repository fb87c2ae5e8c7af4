"""Admission of points and mean limits, external habitat flags, quotas, weights and feature matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.functions import evidence_rules as E
from benthos.functions.text_rules import raw_unit_text

# Units that are volumes per volume and lack a density.
VOLUME_UNITS = ("ul/l", "nl/l", "ai ul/l", "ai nl/l")


def point_ledger(points: DataFrame, minimum: dict[str, int]) -> DataFrame:
    """Adds admission_reason: the structure's reason, then volume units, then too few retained points per route and head.

    Reads route, model_head, structure_reason (null: retained) and from_volume_unit.
    """
    first = F.coalesce("structure_reason", F.when(F.col("from_volume_unit"), "volume_concentration_missing_density_or_mass_equivalence"))
    d = points.withColumn("__first", first)
    n = d.where("__first is null").groupBy("route", "model_head").agg(F.count("*").alias("__n"))
    least = F.create_map(*[F.lit(x) for kv in minimum.items() for x in kv])[F.col("route")]
    few = F.when(F.coalesce("__n", F.lit(0)) < least, "below_route_head_minimum_after_structure_correction")
    return d.join(n, ["route", "model_head"], "left").withColumn("admission_reason", F.coalesce("__first", few, F.lit("retained"))).drop("__first", "__n")


def mean_limits(rows: DataFrame) -> DataFrame:
    """Adds pending_reason, route, bound_lower and bound_upper of censored means.

    Reads mean_op, raw_unit, mean_value_v2, unit_family_v2, mw, medium_domains and task_status.
    The first reason that applies is kept; an admitted row has none.
    """
    op = F.replace(F.replace(F.trim(F.coalesce("mean_op", F.lit(""))), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    family, value, mw = F.col("unit_family_v2"), F.col("mean_value_v2"), F.col("mw")
    known = family.isin("water_mol_l", "water_mg_l", "soil_mg_kg")
    route = F.when(family == "soil_mg_kg", "M00").when(known, "W00")
    domain = F.when(family == "soil_mg_kg", "soil").otherwise("aquatic")
    reason = (
        F.when(raw_unit_text(F.col("raw_unit")).isin(*VOLUME_UNITS), "volume_concentration_missing_density_or_mass_equivalence")
        .when(~op.isin(*E.INEQUALITIES), "unsupported_mean_operator").when(value.isNull() | (value <= 0), "missing_nonpositive_or_nonfinite_mean_bound")
        .when(family.isNull() | ~known, "unit_outside_W00_M00").when((family != "water_mol_l") & (mw.isNull() | (mw <= 0)), "missing_or_invalid_molecular_weight")
        .when(~F.array_contains("medium_domains", domain), "outside_legacy_route_medium_domains").when(F.col("task_status") != "included", "task_mapping")
    )
    d = rows.withColumns({"pending_reason": reason, "route": route})
    ok = F.col("pending_reason").isNull()
    bound = -F.log10(F.when(family == "water_mol_l", value).otherwise(value / (1000 * mw)))
    return d.withColumns({"bound_lower": F.when(ok & op.startswith("<"), bound), "bound_upper": F.when(ok & op.startswith(">"), bound)})


def habitat_from_flags(marine: Column, brackish: Column, fresh: Column, land: Column) -> Column:
    """struct(medium, labels, confidence, status) of external environment flags; NULL where none is set."""
    on = lambda c: F.coalesce(c == 1, F.lit(False))
    water, dry = on(marine) | on(brackish) | on(fresh), on(land)
    pick = lambda both, wet, land_only: F.when(water & dry, both).when(water, wet).when(dry, land_only)
    return F.struct(pick("aquatic", "aquatic", "terrestrial").alias("medium"), pick("aquatic;amphibious", "aquatic", "terrestrial").alias("labels"), pick(0.78, 0.88, 0.86).alias("confidence"), pick("review_recommended", "accepted", "accepted").alias("status"))
