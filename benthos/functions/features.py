"""Model features, bins, qualifiers and report labels as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SHORT_HOURS = {"h": 1.0, "d": 24.0, "min": 1.0 / 60}
# Centres (hours) and width of the radial features of a duration.
CENTERS, GAMMA = (24, 48, 96, 168, 336, 720), 0.35


def duration_features(hours: Column) -> dict[str, Column]:
    """log1p, square root, inverse and six radial features; missing radial features are 0."""
    h = F.greatest(F.lit(0.0), hours)
    log = F.log1p(h)
    out = {"duration_log1p_h": log, "duration_sqrt_h": F.sqrt(h), "duration_inv_log1p_h": 1 / (1 + log)}
    return out | {f"duration_rbf_{c}h": F.coalesce(F.exp(-GAMMA * F.pow(log - F.log1p(F.lit(float(c))), 2)), F.lit(0.0)) for c in CENTERS}


def effect_features(level: Column, masked: frozenset[str] = frozenset()) -> dict[str, Column]:
    """Value, share, log and presence of an effect level; masked ones are 0."""
    x = F.coalesce(level, F.lit(0.0))
    out = {"effect_level": x, "effect_share": x / 100, "effect_log1p": F.log1p(x), "effect_present": level.isNotNull().cast("double")}
    return {k: F.lit(0.0) if k in masked else v for k, v in out.items()}


def toxicity_bin(value: Column, bins: list[tuple[str, float | None, float | None]]) -> Column:
    """Name of the bin with low <= value < high (None: open)."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bins):
        inside = value.isNotNull() & (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value < high)
        out = F.when(inside, name).otherwise(out)
    return out


def assign_toxicity_bin(family: Column, value: Column, weight: Column, scheme: dict[str, dict], unsupported: tuple[str, ...] = (), multiplier: float = 1.0, tolerance: float = 0.0) -> dict[str, Column]:
    """label, status, standard_value, conversion and boundary_flag by the rule of the row's unit family.

    ``scheme`` has per family: enabled, bins (name, low, high) and needs_weight, whether the value is
    in mol and is brought to mass by the molecular weight. The first reason that applies is the
    status: no rule, a rule that is off, no value, no weight, a value that is not positive, no
    bin; else active. boundary_flag: within a relative ``tolerance`` of a bound, for active rows.
    """
    inf = float("inf")
    label = standard = conversion = status = F.lit(None)
    near = F.lit(False)
    for name, rule in scheme.items():
        own = family == name
        mass = rule.get("needs_weight", False)
        v = F.when((weight > 0) & (weight < inf), value * weight * 1000) if mass else value
        bins = [(n, None if a is None else a * multiplier, None if b is None else b * multiplier) for n, a, b in rule["bins"]]
        found = toxicity_bin(v, bins)
        close = F.lit(False)
        for bound in sorted({x for _, a, b in bins for x in (a, b) if x}):
            close = close | (F.abs(v - bound) <= tolerance * bound)
        if not rule.get("enabled", True):
            status = F.when(own, "disabled_for_aux_loss").otherwise(status)
            continue
        why = F.when(value.isNull() | F.isnan(value), "missing_standard_value")
        why = why.when(v.isNull(), "missing_molecular_weight") if mass else why
        why = why.when((v <= 0) | (v == inf), "non_positive_or_invalid_standard_value").when(found.isNull(), "no_matching_bin").otherwise("active")
        status, standard = F.when(own, why).otherwise(status), F.when(own, v).otherwise(standard)
        label, near = F.when(own & (why == "active"), found).otherwise(label), (own & (why == "active") & close) | near
        conversion = F.when(own, "mol_to_mass" if mass else "none").otherwise(conversion)
    status = F.when(family.isin(*unsupported), F.lit(None)).otherwise(status) if unsupported else status
    return {"label": F.when(status == "active", label), "status": F.coalesce(status, F.lit("no_authoritative_threshold")), "standard_value": standard, "conversion": conversion, "boundary_flag": F.coalesce(near, F.lit(False)) & F.coalesce(status == "active", F.lit(False))}


def short_hours(value: Column, unit: Column) -> Column:
    """Hours of a duration in h, d or min; null for other units."""
    key = F.lower(F.trim(unit))
    factor = F.lit(None).cast("double")
    for name, f in SHORT_HOURS.items():
        factor = F.when(key == name, f).otherwise(factor)
    return value * factor


def log_hours(value: Column, unit: Column) -> Column:
    """log1p of the hours of a short duration."""
    return F.log1p(short_hours(value, unit))


def censor_operator(*ops: Column) -> Column:
    """The first inequality among the qualifiers."""
    return F.coalesce(*[F.when(F.trim(o).isin("<", ">", "<=", ">="), F.trim(o)) for o in ops])


def censor_direction(op: Column) -> Column:
    """left for an upper limit of the concentration (<, <=), right for a lower one; null without an inequality."""
    return F.when(op.isin("<", "<="), "left").when(op.isin(">", ">="), "right")


def exact_reason(op: Column, value: Column) -> Column:
    """Why a row is no strict point; NULL if it is one."""
    q = F.trim(F.coalesce(op, F.lit("")))
    return F.when(value.isNull(), "missing_value").when(q.isin("", "=", "=="), None).when(q == "~", "approximate").when(q.isin("<", ">", "<=", ">="), "censored").otherwise("unknown_qualifier")


def condition_key(values: Column, exact: bool = False, applies: Column | None = None) -> Column:
    """Sorted distinct values: the value's text for one, a JSON list for several, UNKNOWN for none.

    ``exact``: numbers are keyed by the text of their double, also in the list, so equal keys are
    equal bits. Where ``applies`` is false the condition does not exist: NA.
    """
    v = F.array_sort(F.array_distinct(F.array_compact(F.transform(values, lambda x: x.cast("double")) if exact else values)))
    text = F.transform(v, lambda x: x.cast("string"))
    key = F.when(F.size(v) == 0, "UNKNOWN").when(F.size(v) == 1, F.get(text, F.lit(0))).otherwise(F.to_json(text if exact else v))
    key = F.coalesce(key, F.lit("UNKNOWN"))
    return key if applies is None else F.when(applies, key).otherwise("NA")


def route_head(head: Column, family: Column, mode: str) -> Column:
    """The head itself, or with the target family (``head__family``); a missing family leaves the head alone."""
    if mode == "task_head":
        return head
    if mode == "task_head_target_family":
        return F.concat_ws("__", head, F.nullif(F.trim(family), F.lit("")))
    raise ValueError(f"unknown head mode {mode}")


def stage_contract(contract: Column, actual: dict[str, Column], legacy: tuple[str, ...] = ()) -> dict[str, Column]:
    """(contract map, mismatches, state) of a ``k=v|k=v`` text against the row's own values.

    mismatches: the keys whose value differs or is missing, in order. state: ok, legacy (only
    ``legacy`` keys differ: such rows are dropped and counted) or mismatch (an error for the caller).
    """
    said = F.str_to_map(F.coalesce(contract, F.lit("")), F.lit("\\|"), F.lit("="))
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(said[k] == v.cast("string"), F.lit(False)), k) for k, v in actual.items()]))
    state = F.when(F.size(wrong) == 0, "ok").when(F.size(F.array_except(wrong, F.array(*map(F.lit, legacy)) if legacy else F.array().cast("array<string>"))) == 0, "legacy").otherwise("mismatch")
    return {"contract": said, "mismatches": wrong, "state": state}


def molar_shift(target: Column, weight: Column) -> Column:
    """-log10 of mol/kg from -log10 of mg/kg: 3 + log10(molecular weight) more."""
    return target + 3 + F.log10(weight)


def back_transform(pred: Column, family: Column, weight: Column, rmse: float, most: float = 1e12) -> dict[str, Column]:
    """mol_l, mg_l and mg_kg of a prediction, each with _low and _high at 1.96 errors; null where a unit does not apply.

    Water families predict -log10(mol/L) or -log10(mg/L), soil -log10(mol/kg) or -log10(mg/kg), oral
    -log10(mg/kg/d). Mass and moles need a positive weight. Values are clamped to at most ``most``.
    """
    sides = {"": F.lit(0.0), "_low": F.lit(1.96 * rmse), "_high": F.lit(-1.96 * rmse)}
    w = F.when(weight > 0, weight)
    out: dict[str, Column] = {}
    clamp = lambda x: F.when(x.isNotNull(), F.least(F.lit(most), x))
    for name, shift in sides.items():
        raw = F.pow(F.lit(10.0), -(pred + shift))
        mol, mg = F.when(family == "water_mol_l", raw).when(family == "water_mg_l", raw / (1000 * w)), F.when(family == "water_mg_l", raw).when(family == "water_mol_l", raw * w * 1000)
        kg = F.when(family.isin("soil_mg_kg", "oral_mg_kg_d"), raw).when(family == "soil_mol_kg", raw * w * 1000)
        out |= {f"mol_l{name}": clamp(mol), f"mg_l{name}": clamp(mg), f"mg_kg{name}": clamp(kg)}
    return out


def domain_label(chem: Column, species: Column) -> Column:
    return F.when(chem & species, "in_domain").when(chem, "species_out_of_domain").when(species, "chemical_out_of_domain").otherwise("out_of_domain")


def level_label(level: Column) -> Column:
    """Effect level as text, without a fraction if whole."""
    return F.when(level.isNull(), "none").when(level == F.floor(level), F.floor(level).cast("string")).otherwise(level.cast("string"))


def durations_agree(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(0.05), 0.002 * F.greatest(F.abs(a), F.abs(b)))


def join_durations(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Pairs of rows with equal keys whose durations agree, joined on keys and a cell of the duration.

    Cells are half of an hour up to 50 h and half a percent wide beyond, wider than any tolerance,
    so a row meets its own cell and the two beside it only.
    """
    size = lambda c: F.abs(F.col(c))
    cell = lambda c: (F.when(size(c) < 50, F.floor(size(c) * 2)).otherwise(100 + F.floor(F.log(size(c) / 50) / 0.005)) * F.signum(F.col(c)) * 1.0).cast("long")
    spread = b.where(F.col(right).isNotNull()).withColumn("__c", F.explode(F.array(cell(right) - 1, cell(right), cell(right) + 1)))
    met = a.where(F.col(left).isNotNull()).withColumn("__c", cell(left)).join(spread, [*keys, "__c"])
    return met.where(durations_agree(F.col(left), F.col(right))).drop("__c")


def confidence_label(support: Column, chem: Column, species: Column, task_seen: Column) -> Column:
    """high, medium or low by support and domain; without a support by the domain alone."""
    inside = chem & species
    known = F.when((support >= 0.70) & inside & task_seen, "high").when(support >= 0.45, "medium").otherwise("low")
    return F.when(support.isNotNull(), known).when(inside & task_seen, "high").when(inside, "medium").otherwise("low")


def domain_warning(chem: Column, species: Column, task_seen: Column) -> Column:
    """One of five states of extrapolation."""
    return F.when(chem & species & task_seen, "in_domain").when(chem & species, "task_extrapolation").when(~chem & ~species, "chemical_and_species_extrapolation").when(~chem, "chemical_extrapolation").otherwise("species_extrapolation")


def medium_text(curated: Column, *others: Column) -> Column:
    """The curated domain alone where it is a known one, else all that is there, in lower case and joined by blanks."""
    low = F.lower(F.trim(curated))
    parts = [F.nullif(F.lower(F.trim(c)), F.lit("")) for c in others]
    return F.when(low.isin("aquatic", "soil", "sediment", "solid", "terrestrial_nonsoil"), low).otherwise(F.concat_ws(" ", *parts))


def medium_part(text: Column, train: tuple[str, ...], test: tuple[str, ...], unknown: str = "excluded") -> Column:
    """train or test by medium words: whole tokens (test first), then substrings, then common words, else ``unknown``.

    Tokens are split at blanks, underscores counting as hyphens, and also at ``:`` and before ``/``.
    """
    if unknown not in ("train", "valid", "test", "excluded"):
        raise ValueError("unknown must be train, valid, test or excluded")
    t = F.coalesce(text, F.lit(""))
    hyphen = F.replace(t, F.lit("_"), F.lit("-"))
    tokens = F.array_union(F.split(hyphen, r"\s+"), F.split(F.replace(F.replace(hyphen, F.lit(":"), F.lit(" ")), F.lit("/"), F.lit(" /")), r"\s+"))
    words = lambda names: F.array(*[F.lit(n.lower()) for n in names])
    inside = lambda names: F.exists(words(names), lambda n: F.contains(t, n))
    part = F.when(t == "", unknown).when(F.arrays_overlap(tokens, words(test)), "test").when(F.arrays_overlap(tokens, words(train)), "train")
    part = part.when(inside(test), "test").when(inside(train), "train")
    return part.when(t.contains("water") | t.contains("aquatic"), "train").when(t.contains("soil") | t.contains("sediment"), "test").otherwise(unknown)
