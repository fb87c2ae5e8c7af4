"""Exposure medium, task heads, toxicity values, log targets and full unit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.functions.distinct import by_distinct
from benthos.functions.text_rules import code, media_code, one_of, raw_unit_text

# ---- exposure medium ----------------------------------------------------------------------

# Codes of exposure media and exposure types, and the order of domains.
MEDIA = {"aquatic": ("FW", "SW", "AQU"), "sediment": ("SED", "SEDIMENT"), "soil": ("NAT", "ART", "UKS", "MIN", "HYP"), "terrestrial_nonsoil": ("NONE", "FLT", "AGR", "LIT", "FAB", "POP")}
CULTURE, AQUEOUS_EXPOSURE, SOIL_EXPOSURE = "CUL", ("AQ", "CM", "MM", "HP", "NR"), ("PR", "SS")
DOMAINS = ("sediment", "aquatic", "soil", "terrestrial_nonsoil")


def exposure_medium(habitat: Column, media: Column, exposure: Column, target: Column | None = None) -> Column:
    """struct(medium_domain, medium_domains, medium_conflict_flag).

    Evidence comes from the media code, then the habitat, the exposure type and the target
    text; the first gives the primary domain, all together the list in fixed order.
    """
    text = lambda c: F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    h, m, e = text(habitat), media_code(media), media_code(exposure)
    t = text(target) if target is not None else F.lit("")
    water, soil, other = h == "water", h == "soil", h.isin("non-soil", "nonsoil")
    culture = F.when(water | one_of(e, AQUEOUS_EXPOSURE), "aquatic").when(soil | one_of(e, SOIL_EXPOSURE), "soil").when(other, "terrestrial_nonsoil")
    by_media = F.when(m == CULTURE, culture)
    for domain, codes in MEDIA.items():
        by_media = by_media.when(one_of(m, codes), domain)
    by_habitat = F.when(water, "aquatic").when(soil, "soil").when(other, "terrestrial_nonsoil")
    by_exposure = F.when(one_of(e, AQUEOUS_EXPOSURE), "aquatic").when(one_of(e, SOIL_EXPOSURE), "soil")
    by_target = F.when(t.contains("sediment") | t.startswith("mg/kg:sed"), "sediment").when(t.startswith("mg/kg:soil"), "soil")
    evidence = F.array_compact(F.array(by_media, by_habitat, by_exposure, by_target))
    found = F.array_intersect(F.array(*map(F.lit, DOMAINS)), evidence)
    none = F.size(evidence) == 0
    return F.struct(
        F.when(none, "unknown").otherwise(F.get(evidence, F.lit(0))).alias("medium_domain"),
        F.when(none, F.array(F.lit("unknown"))).otherwise(found).alias("medium_domains"),
        (F.size(found) > 1).alias("medium_conflict_flag"),
    )


def with_exposure_medium(df: DataFrame, habitat: str = "habitat", media: str = "media_type", exposure: str = "exposure_type") -> DataFrame:
    """Adds medium_domain, medium_domains and medium_conflict_flag; the rules run once per distinct combination."""
    def rule(codes: DataFrame) -> DataFrame:
        m = exposure_medium(F.col(habitat), F.col(media), F.col(exposure))
        return codes.withColumn("__m", m).select(habitat, media, exposure, "__m.medium_domain", "__m.medium_domains", "__m.medium_conflict_flag")

    return by_distinct(df, [habitat, media, exposure], rule)


# ---- task heads ---------------------------------------------------------------------------

# Code sets of effect families, in the order in which they are tried.
EFFECTS = {
    "Mortality": ("MOR", "MORT", "SURV"),
    "Growth": ("GRO", "WGHT", "LGTH", "GGRO", "BMAS", "HGHT", "GAIN", "SIZE", "VGOR", "MMTE"),
    "Reproduction": ("REP", "GERM", "PROG", "FCND", "GREP", "FERZ"),
    "Population": ("POP", "ABND", "PGRT", "GPOP", "CNTL", "COVR", "CHLA", "DVRS", "DMTR", "DBMS"),
    "Immobilization": ("ITX", "IMBL"),
    "Development": ("DVP", "EMRG", "HTCH", "DVLP", "DFRM", "STGE", "ABNM"),
    "Behavior": ("BEH", "SWIM", "LOCO", "EQUL", "PHTR", "AVO", "CHEM"),
    "Morphology": ("MPH", "SMIX"),
    "Physiology": ("PHY", "PSYN", "PSII", "HTRT", "HRM", "CEL"),
    "Biochemical": ("ENZ", "BCM", "CTLS", "SODA", "GSTR", "ACHE", "GLPX", "MLDH", "PRCO", "GLTH"),
    "GeneticDamage": ("GEN", "DAMG", "GEXP", "ERAM"),
    "Injury": ("INJ", "HIS", "GINJ"),
    "Feeding": ("FDB", "FDNG", "FCNS"),
    "Molting": ("MLT", "MULT"),
    "Accumulation": ("ACC", "RSDE", "GACC"),
}
DOSE_RESPONSE = r"^(EC|LC|IC|AC|ED|LD|BMD|BMC)([0-9]+(\.[0-9]+)?)$"


def endpoint_class(endpoint: Column) -> tuple[Column, Column, Column, Column]:
    """(family, group, effect level, reason for exclusion) of a normalised endpoint code."""
    e = endpoint
    prefix, level = F.nullif(F.regexp_extract(e, DOSE_RESPONSE, 1), F.lit("")), F.regexp_extract(e, DOSE_RESPONSE, 2).try_cast("double")
    reason = F.when(e == "", "missing_endpoint").when(e.startswith("NR"), "excluded_endpoint:NR").when(e == "LT50", "excluded_endpoint:LT50").when(e.isin("BAF", "BCF", "BCFD"), "bioaccumulation_endpoint_requires_factor_target")
    family = F.when(e.isin("NOEC", "NOEL"), "NOEC").when(e.isin("LOEC", "LOEL"), "LOEC").when(e == "MATC", "MATC").when(prefix.isin("EC", "LC"), "ECx").when(prefix.isNotNull(), F.concat(prefix, F.lit("x")))
    family = F.when(reason.isNull(), family)
    reason = F.coalesce(reason, F.when(family.isNull(), F.concat(F.lit("unsupported_endpoint:"), e)))
    group = F.when(family.isin("ECx", "NOEC", "LOEC"), "main_toxicity").when(family.isNotNull(), "toxicity_aux")
    return family, group, F.when(family.isNotNull(), level), reason


EFFECT_RANKS = {c: i for i, codes in enumerate(EFFECTS.values()) for c in codes}


def effect_family(effect: Column, measurement: Column) -> tuple[Column, Column]:
    """(family, reason for exclusion) of two normalised codes: the first code set that holds either."""
    ranks = F.create_map(*[F.lit(x) for kv in EFFECT_RANKS.items() for x in kv])
    first = F.array_min(F.array(ranks[effect], ranks[measurement]))
    family = F.get(F.array(*map(F.lit, EFFECTS)), first)
    return family, F.when((effect == "") & (measurement == ""), "missing_effect_and_measurement").when(first.isNull(), "unsupported_effect_family")


def with_task_head(df: DataFrame) -> DataFrame:
    """Adds task_head, task_group, task_family, effect_family, effect_level_x, task_status, task_excluded_reason.

    Reads endpoint, effect, measurement, target_name and target_basis; the rules run once per
    distinct combination of their codes.
    """
    names = {"__endpoint": "endpoint", "__effect": "effect", "__measurement": "measurement", "__name": "target_name", "__basis": "target_basis"}

    def rule(codes: DataFrame) -> DataFrame:
        d = codes.withColumns({k: code(F.col(c)) for k, c in names.items()})
        family, group, level, reason = endpoint_class(F.col("__endpoint"))
        effects, no_effect = effect_family(F.col("__effect"), F.col("__measurement"))
        oral = (F.col("__name") == "NEG_LOG10_MG_KG_BW_DAY") | (F.col("__basis") == "MG/KG/DAY")
        d = d.withColumns({"__f": family, "__g": group, "__x": level, "__r": reason, "__e": effects, "__n": no_effect, "__o": oral})
        d = d.withColumn("__why", F.when(F.col("__o"), "excluded_oral_target").otherwise(F.coalesce("__r", "__n")))
        ok, held = F.col("__why").isNull(), ~F.col("__o") & F.col("__r").isNull()
        out = d.withColumns({
            "task_head": F.when(ok, F.concat_ws("_", "__f", "__e")), "task_group": F.when(held, F.col("__g")), "task_family": F.when(held, F.col("__f")),
            "effect_family": F.when(ok, F.col("__e")), "effect_level_x": F.when(held, F.col("__x")), "task_status": F.when(ok, "included").otherwise("excluded"), "task_excluded_reason": F.col("__why"),
        })
        return out.drop(*[c for c in out.columns if c.startswith("__")])

    return by_distinct(df, list(names.values()), rule)


# ---- toxicity value and log target --------------------------------------------------------

INEQUALITIES = ("<", ">", "<=", ">=")


def toxicity_value(mean: Column, low: Column, high: Column, mean_op: Column, low_op: Column, high_op: Column) -> Column:
    """struct(value, source, imputed, quality, excluded_reason): the mean, else the middle of the range."""
    op = lambda c: F.trim(F.coalesce(c, F.lit("")))
    has_mean, has_range = mean.isNotNull(), low.isNotNull() & high.isNotNull()
    cut_mean = one_of(op(mean_op), INEQUALITIES)
    cut_range = one_of(op(low_op), INEQUALITIES) | one_of(op(high_op), INEQUALITIES)
    pick = lambda cut, plain, cut_r, plain_r, none: F.when(has_mean & cut_mean, cut).when(has_mean, plain).when(has_range & cut_range, cut_r).when(has_range, plain_r).otherwise(none)
    return F.struct(
        F.when(has_mean, mean).when(has_range, (low + high) / 2).alias("value"),
        pick("mean_censored", "mean", "min_max_midpoint_censored", "min_max_midpoint", "excluded").alias("source"),
        (~has_mean & has_range).alias("imputed"),
        pick("censored", F.when(op(mean_op) == "~", "approx").otherwise("exact"), "censored_midpoint", "midpoint", "missing").alias("quality"),
        pick("censored_toxicity_value", None, "censored_min_or_max_toxicity_value", None, "missing_mean_and_invalid_min_max_midpoint").alias("excluded_reason"),
    )


# Family, standard unit, target name, target family, basis; in the order tried.
TARGETS = [
    ("water_mol_l", "mol/L", "ptox_mol_l", "aquatic_pTox_mol_L", "mol/L"),
    ("water_mg_l", "mg/L", "ptox_mol_l", "aquatic_pTox_mol_L", "mol/L_from_mg/L"),
    ("soil_mg_kg", "mg/kg", "neg_log10_mg_kg", "solid_neglog_mg_kg", "mg/kg:"),
    ("diet_mg_kg", "mg/kg diet", "neg_log10_mg_kg_diet", "diet_oral_neglog_mg_kg", "mg/kg diet"),
    ("oral_mg_kg_d", "mg/kg/d", "neg_log10_mg_kg_bw_day", "diet_oral_neglog_mg_kg", "mg/kg/day"),
    ("soil_g_ha", "g/ha", "neg_log10_g_ha", "application_neglog_g_ha", "g/ha"),
    ("soil_l_ha", "L/ha", "neg_log10_l_ha", "application_neglog_l_ha", "L/ha"),
    ("seed_g_kg", "g/kg seed", "neg_log10_g_kg_seed", "seed_treatment_neglog", "g/kg seed"),
    ("seed_ml_kg", "mL/kg seed", "neg_log10_ml_kg_seed", "seed_treatment_neglog", "mL/kg seed"),
    ("percent", "%", "neg_log10_percent", "percent_neglog", "percent"),
    ("mass_per_organism_mg", "mg/organism", "neg_log10_mg_per_organism", "organism_dose_neglog", "mg/organism"),
    ("mass_per_experimental_unit_mg", "mg/experimental_unit", "neg_log10_mg_per_experimental_unit", "organism_dose_neglog", "mg/experimental_unit"),
]


def target_rule(family: Column, unit: Column) -> Column:
    """Number of the first target whose family or standard unit is the row's; null without one."""
    f, u = F.trim(F.coalesce(family, F.lit(""))), F.trim(F.coalesce(unit, F.lit("")))
    which = F.lit(None).cast("int")
    for i, row in reversed(list(enumerate(TARGETS))):
        which = F.when((f == row[0]) | (u == row[1]), i).otherwise(which)
    return which


def log_target(tox: Column, family: Column, unit: Column, weight: Column, medium: Column, rule: Column | None = None) -> Column:
    """struct(target_value, target_name, target_family, target_basis, target_status, excluded_reason).

    ``rule``: a column that holds target_rule(family, unit) already.
    """
    f, u = F.trim(F.coalesce(family, F.lit(""))), F.trim(F.coalesce(unit, F.lit("")))
    which = target_rule(family, unit) if rule is None else rule
    value, no_weight = tox["value"], (which == 1) & F.coalesce(weight <= 0, F.lit(True))
    reason = tox["excluded_reason"]
    reason = F.coalesce(reason, F.when(value <= 0, "non_positive_toxicity_value").when(no_weight, "missing_or_invalid_molecular_weight_for_mg_l_to_mol_l").when(which.isNull(), F.concat(F.lit("unsupported_unit_family:"), F.when(f != "", f).when(u != "", u).otherwise("missing"))))
    ok = reason.isNull()
    of = lambda i: F.get(F.array(*[F.lit(r[i]) for r in TARGETS]), which)
    place = F.trim(F.coalesce(medium, F.lit("")))
    basis = F.when(which == 2, F.concat(F.lit("mg/kg:"), F.when(place == "", "unknown_medium").otherwise(place))).otherwise(of(4))
    return F.struct(
        F.when(ok, -F.log10(F.when(which == 1, value / 1000 / weight).otherwise(value))).alias("target_value"),
        F.when(ok, of(2)).alias("target_name"), F.when(ok, of(3)).alias("target_family"), F.when(ok, basis).alias("target_basis"),
        F.when(ok, "included").otherwise("excluded").alias("target_status"), reason.alias("excluded_reason"),
    )


def with_log_target(df: DataFrame, numbers: list[Column], ops: list[Column], family: Column, unit: Column, weight: Column, medium: Column) -> DataFrame:
    """Adds target: the log_target of the toxicity_value of mean, low and high (``numbers``) and their operators (``ops``).

    All but the number depends on texts, on which numbers there are and on signs, and is read once
    per distinct combination of these, with stand-ins for the numbers.
    """
    mean, low, high = numbers
    value = F.when(mean.isNotNull(), mean).when(low.isNotNull() & high.isNotNull(), (low + high) / 2)
    state = {f"__has{i}": c.isNotNull() for i, c in enumerate(numbers)} | {f"__op{i}": c for i, c in enumerate(ops)}
    state |= {"__positive": F.coalesce(~(value <= 0), F.lit(True)), "__weighed": ~F.coalesce(weight <= 0, F.lit(True)), "__family": family, "__unit": unit, "__medium": medium}

    def rule(codes: DataFrame) -> DataFrame:
        x = F.when(F.col("__positive"), 1.0).otherwise(-1.0)
        tox = toxicity_value(*[F.when(F.col(f"__has{i}"), x) for i in range(3)], *[F.col(f"__op{i}") for i in range(3)])
        c = codes.withColumns({"__tox": tox, "__which": target_rule(F.col("__family"), F.col("__unit"))})
        made = log_target(F.col("__tox"), F.col("__family"), F.col("__unit"), F.when(F.col("__weighed"), 1.0).otherwise(-1.0), F.col("__medium"), F.col("__which"))
        return c.withColumn("target", made).drop("__tox")

    out = by_distinct(df.withColumns(state), list(state), rule)
    number = -F.log10(F.when(F.col("__which") == 1, value / 1000 / weight).otherwise(value))
    return out.withColumn("target", F.col("target").withField("target_value", F.when(F.col("target.target_status") == "included", number))).drop("__which", *state)


# ---- full unit rules ----------------------------------------------------------------------

# Raw unit and factor, by family, standard unit, confidence and note (U: the unit).
UNIT_RULES = [
    ("soil_mg_kg", "mg/kg", "high", "U_to_mg/kg", {1.0: ["mg/kg", "mg/kg soil", "mg/kg dry soil", "mg/kg dry wt", "ai mg/kg", "ai mg/kg soil", "ai mg/kg dry soil", "ug/g", "ug/g soil", "ug/g dry soil", "ug/g dry wt", "ug/g bdwt"], 1000.0: ["g/kg soil", "g/kg dry soil", "ai g/kg", "mg/g soil"], 0.001: ["ug/kg soil", "ai ug/kg soil", "ug/kg dry soil", "ng/g soil", "ng/g dw soil"]}),
    ("soil_g_ha", "g/ha", "high", "U_to_g/ha", {1000.0: ["kg/ha", "ai kg/ha", "ae kg/ha"], 1.0: ["g/ha", "ai g/ha", "ae g/ha"], 1120.85116: ["lb/acre", "ai lb/acre", "ae lb/acre"], 70.0531975: ["oz/acre", "ai oz/acre"], 10000.0: ["g/m2", "ai g/m2"], 100000.0: ["mg/cm2"], 100.0: ["ug/cm2", "ai ug/cm2"]}),
    ("soil_l_ha", "L/ha", "medium", "U_to_L/ha", {1.0: ["l/ha", "ai l/ha"], 0.001: ["ml/ha", "ai ml/ha"], 9.353956: ["gal/acre"], 0.073078: ["fl oz/acre"], 10000.0: ["l/m2"], 10.0: ["ml/m2"]}),
    ("water_mg_l", "mg/L", "high", "U_to_mg/L", {1.0: ["mg/l", "mg/l diet", "ai mg/l", "ae mg/l", "mg/dm3", "ug/ml", "ai ug/ml"], 1000.0: ["g/l", "ai g/l", "ae g/l", "mg/ml", "ai mg/ml"], 0.001: ["ug/l", "ai ug/l", "ae ug/l", "ng/ml", "ul/l"], 0.000001: ["nl/l", "ng/l", "ai ng/l"]}),
    ("water_mol_l", "mol/L", "high", "U_to_mol/L", {1.0: ["m"], 1e-3: ["mm", "mmol/l", "umol/ml", "mol/m3"], 1e-6: ["um", "umol/l", "nmol/ml"], 1e-9: ["nmol/l", "nm"]}),
    ("seed_g_kg", "g/kg seed", "medium", "U_seed_treatment", {1.0: ["g/kg sd", "ai g/kg sd"], 0.01: ["ai g/100 kg sd", "g/100 kg sd"], 0.001: ["mg/kg sd"]}),
    ("seed_ml_kg", "mL/kg seed", "medium", "U_seed_treatment", {1.0: ["ml/kg sd"]}),
    ("diet_mg_kg", "mg/kg diet", "medium", "U_to_mg/kg_diet", {1.0: ["mg/kg diet", "ai mg/kg diet", "ppm diet", "ai ppm diet", "ug/g diet", "ug/g dry diet"], 0.001: ["ppb diet", "ug/kg diet"]}),
    ("oral_mg_kg_d", "mg/kg/d", "medium", "U_to_mg/kg/day_or_bw", {1.0: ["mg/kg/d", "mg/kg bdwt/d", "mg/kg bw/d", "mg/kg/day", "mg/kg bdwt", "mg/kg bw"], 0.001: ["ug/kg/d", "ug/kg bdwt/d"]}),
    ("mass_per_organism_mg", "mg/organism", "low", "U_to_mg/organism", {0.001: ["ug/org", "ug"], 1.0: ["mg/org", "mg"], 1000.0: ["g"]}),
    ("mass_per_experimental_unit_mg", "mg/experimental_unit", "low", "U_to_mg/eu", {1.0: ["mg/eu", "ai mg/eu"], 1000.0: ["g/eu", "ai g/eu"]}),
    ("percent", "%", "low", "U_kept_as_percent", {1.0: ["%", "ai %", "% v/v", "% w/v"]}),
]
# Parts per million and per billion, read by the medium: units, factor, note in water and in solids.
PARTS = [
    (["ppm", "ppmw", "ai ppm", "ae ppm"], 1.0, "ppm_assumed_mg_per_l_for_aqueous_matrix", "ppm_assumed_mg_per_kg_for_solid_matrix"),
    (["ppb", "ai ppb", "ae ppb"], 0.001, "ppb_assumed_ug_per_l_for_aqueous_matrix", "ppb_assumed_ug_per_kg_for_solid_matrix"),
]
CONTEXT_UNITS = [u for units, *_ in PARTS for u in units]


def unit_rule_rows() -> list[tuple]:
    """(unit, place, family, standard unit, factor, confidence, note); place is * unless the medium decides."""
    rows = [(u, "*", family, std, factor, sure, note.replace("U", u, 1)) for family, std, sure, note, factors in UNIT_RULES for factor, units in factors.items() for u in units]
    for units, factor, water, solid in PARTS:
        for u in units:
            rows += [(u, "water", "water_mg_l", "mg/L", factor, "medium", water), (u, "solid", "soil_mg_kg", "mg/kg", factor, "medium", solid)]
    return rows


def unit_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(unit_rule_rows(), "rule_unit string, place string, rule_family string, rule_std string, factor double, confidence string, note string")


def normalize_units(df: DataFrame) -> DataFrame:
    """Adds unit_family_v2, standard_unit_v2, mean/min/max_value_v2, source, confidence, note, path and flags.

    Reads std_mean/std_min/std_max, std_family, std_unit, raw_mean/raw_min/raw_max (doubles),
    raw_unit, mw and medium_domain. A standardized value wins unless the raw unit depends on
    the medium; otherwise the rule table, a broadcast of fixed size, is joined on the unit.
    Unit texts are normalised once per distinct (raw_unit, medium_domain).
    """
    rules = unit_rules(df.sparkSession)

    def rule(codes: DataFrame) -> DataFrame:
        c = codes.withColumn("rule_unit", raw_unit_text(F.col("raw_unit"))).withColumn("__context", F.col("rule_unit").isin(*CONTEXT_UNITS))
        side = F.when(F.col("medium_domain") == "aquatic", "water").when(F.col("medium_domain").isin("soil", "sediment", "terrestrial_nonsoil"), "solid").otherwise("none")
        return c.withColumn("place", F.when(F.col("__context"), side).otherwise("*")).join(F.broadcast(rules), ["rule_unit", "place"], "left")  # a fixed table

    joined = by_distinct(df, ["raw_unit", "medium_domain"], rule)
    fam = F.trim(F.coalesce("std_family", F.lit("")))
    joined = joined.withColumns({
        "__given": (fam != "") & (fam != "other") & ~F.col("__context") & (F.col("std_mean").isNotNull() | (F.col("std_min").isNotNull() & F.col("std_max").isNotNull())),
        "__molar": F.coalesce((F.col("rule_unit") == "mmol/kg soil") & (F.col("mw") > 0), F.lit(False)),
    })
    given, molar = F.col("__given"), F.col("__molar")
    joined = joined.withColumn("__factor", F.when(molar, F.col("mw")).otherwise(F.col("factor")))
    factor = F.col("__factor")
    family = F.when(given, fam).when(molar, "soil_mg_kg").otherwise(F.col("rule_family"))
    std = F.when(given, F.nullif(F.trim(F.coalesce("std_unit", F.lit(""))), F.lit(""))).when(molar, "mg/kg").otherwise(F.col("rule_std"))
    scaled = lambda s, r: F.when(given, F.col(s)).when(factor.isNotNull(), F.col(r) * factor).otherwise(F.col(r))
    reason = F.when(F.col("rule_unit") == "", "missing_raw_unit").otherwise("unsupported_raw_unit")
    ruled = factor.isNotNull()
    out = joined.withColumns({
        "unit_family_v2": family, "standard_unit_v2": std,
        "mean_value_v2": scaled("std_mean", "raw_mean"), "min_value_v2": scaled("std_min", "raw_min"), "max_value_v2": scaled("std_max", "raw_max"),
        "unit_conversion_source": F.when(given, "source_standardized").when(ruled, "raw_unit_rule").otherwise("unsupported"),
        "unit_conversion_confidence": F.when(given, "high").when(molar, "medium").when(ruled, F.col("confidence")).otherwise("none"),
        "unit_conversion_note": F.when(given, None).when(molar, "mmol/kg_soil_to_mg/kg_using_molecular_weight").when(ruled, F.col("note")).otherwise(F.concat_ws(":", reason, F.coalesce("raw_unit", F.lit("")))),
        "active_ingredient_basis": F.col("rule_unit").startswith("ai ") | F.col("rule_unit").startswith("ae "),
        "acid_equivalent_basis": F.col("rule_unit").startswith("ae "),
    })
    path = conversion_path(F.col("unit_family_v2"), F.col("standard_unit_v2"))
    path = F.when(F.col("unit_conversion_source") == "source_standardized", F.concat(F.lit("source_standardized:"), F.coalesce("standard_unit_v2", "unit_family_v2"))).otherwise(path)
    return out.withColumn("conversion_path", path).drop("rule_unit", "place", "rule_family", "rule_std", "factor", "confidence", "note", "__context", "__given", "__molar", "__factor")


def conversion_path(family: Column, unit: Column) -> Column:
    """How a value of this family gets to its log target."""
    return (
        F.when((family == "water_mg_l") & (unit == "mg/L"), "raw_to_mg_L_to_mol_L_to_pTox")
        .when((family == "water_mol_l") & (unit == "mol/L"), "raw_to_mol_L_to_pTox")
        .when((family == "soil_mg_kg") & (unit == "mg/kg"), "raw_to_mg_kg_to_neglog")
        .when((family == "soil_g_ha") & (unit == "g/ha"), "raw_to_g_ha_to_neglog")
        .when(family.isin("diet_mg_kg", "oral_mg_kg_d"), "raw_to_diet_or_oral_mg_kg_to_neglog")
        .when(family.isNotNull(), F.concat(F.lit("raw_to_"), family, F.lit("_to_neglog")))
    )


def standard_values(family: Column, unit: Column, mean: Column, weight: Column) -> dict[str, Column]:
    """One of six columns gets the mean; mg/L also gives mol/L where the molecular weight is known."""
    kinds = [("mg_l", "water_mg_l", "mg/L"), ("mol_l", "water_mol_l", "mol/L"), ("mg_kg", "soil_mg_kg", "mg/kg"), ("g_ha", "soil_g_ha", "g/ha"), ("mg_kg_diet", "diet_mg_kg", "mg/kg diet"), ("mg_kg_bw_day", "oral_mg_kg_d", "mg/kg/d")]
    f, u = F.coalesce(family, F.lit("")), F.coalesce(unit, F.lit(""))
    first = F.lit(None).cast("string")
    for name, fam, std in reversed(kinds):
        first = F.when((f == fam) | (u == std), name).otherwise(first)
    out = {f"standard_value_{name}": F.when(first == name, mean) for name, _, _ in kinds}
    out["standard_value_mol_l"] = F.coalesce(out["standard_value_mol_l"], F.when((first == "mg_l") & (weight > 0), mean / 1000 / weight))
    return out


def concentration_interval(value: Column, op: Column, factor: float = 1.0) -> tuple[Column, Column]:
    """Bounds of -log10 of a concentration; an inequality turns around; an unknown sign is an error."""
    q = F.replace(F.replace(F.trim(F.coalesce(op, F.lit(""))), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    y = -F.log10(value * factor)
    known = q.isin("", "=", "==", "<", "<=", ">", ">=")
    checked = F.when(known & (value * factor > 0), y).otherwise(F.raise_error(F.lit("positive value and known qualifier required")).cast("double"))
    inf = float("inf")
    return F.when(q.isin(">", ">="), F.lit(-inf)).otherwise(checked), F.when(q.isin("<", "<="), F.lit(inf)).otherwise(checked)


def interval_fault(censored: Column, target: Column, low: Column, high: Column) -> Column:
    """Why an observation breaks the contract of points and intervals; NULL if it does not."""
    lo, hi = F.coalesce(low, F.lit(float("-inf"))), F.coalesce(high, F.lit(float("inf")))
    return (
        F.when(~censored & (target.isNull() | F.isnan(target) | (F.abs(target) == float("inf"))), "point_without_finite_target")
        .when(censored & target.isNotNull(), "censored_with_target")
        .when(censored & low.isNull() & high.isNull(), "censored_without_bound")
        .when(censored & (lo >= hi), "bounds_not_ordered")
    )
