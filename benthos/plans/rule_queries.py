"""Queries of the scalar rules, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from benthos.functions import curation, evidence_rules as E, features, habitat, text_rules as T
from benthos.plans import curation_inputs
from benthos.plans.inputs import OBSERVATIONS, RESULTS
from benthos.plans.registry import pick, query, values
from benthos.session import materialize

KEY = ["result_id"]
HOUR_ROWS = values([(u, float(h)) for u, h in T.HOURS.items()])
CONC_ROWS = values(T.CONCENTRATION_ROWS)
UNIT_SQL = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, 'micro', 'u'), 'µ', 'u'), 'μ', 'u'), ' per ', '/'), 'litre', 'liter'), '−', '-'), '–', '-'), '·', ' '), '\s+', ' ', 'g'))"
CLEAN = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN '' ELSE trim({0}) END"
UNIT1 = UNIT_SQL.format("lower(" + CLEAN.format("{0}") + ")")
NUM = r"TRY_CAST(nullif(regexp_extract(replace({0}, ',', ''), '[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?', 0), '') AS DOUBLE)"
CODE = r"regexp_replace(ltrim(regexp_replace(upper(coalesce({0}, '')), '\s+', '', 'g'), '~'), '[/*]+$', '')"
RAWU = r"CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'nr', 'nc', 'na', 'n/a', 'none', 'null', '--') THEN '' ELSE regexp_replace(replace(lower(trim({0})), 'μ', 'u'), '\s+', ' ', 'g') END"


def over_results(t):
    return t.sql(RESULTS)


@query("b01_registry_key", "SELECT p_partkey, regexp_replace(p_brand || '-' || p_partkey, '[^0-9]', '', 'g') AS registry_key FROM part")
def _(t):
    return t("part").select("p_partkey", T.registry_key(F.concat_ws("-", "p_brand", "p_partkey")).alias("registry_key"))


@query("b02_text_cleaning", f"WITH r AS ({RESULTS}) SELECT result_id, nullif(trim(number_text), '') AS text_null, {CLEAN.format('number_text')} AS text_empty FROM r")
def _(t):
    return over_results(t).select("result_id", T.text_or_null(F.col("number_text")).alias("text_null"), T.text_or_empty(F.col("number_text")).alias("text_empty"))


@query("b03_lenient_number", f"WITH r AS ({RESULTS}) SELECT result_id, {NUM.format('number_text')} AS number FROM r")
def _(t):
    return over_results(t).select("result_id", T.lenient_number(F.col("number_text")).alias("number"))


@query("b04_strict_number", rf"""WITH r AS ({RESULTS}), b AS (SELECT result_id, trim(number_text) AS v, regexp_replace(trim(number_text), '[*/\s]*[*/]\s*$', '') AS s FROM r)
SELECT result_id, CASE WHEN upper(v) NOT IN ('NR', 'NC', 'NA', 'N/A', 'NONE', 'NULL') AND regexp_full_match(s, '[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?') THEN TRY_CAST(s AS DOUBLE) END AS number FROM b""")
def _(t):
    return over_results(t).select("result_id", T.strict_number(F.col("number_text")).alias("number"))


@query("b05_unit_text", f"WITH r AS ({RESULTS}) SELECT result_id, {UNIT1.format('raw_unit')} AS unit_1, {RAWU.format('raw_unit')} AS unit_2 FROM r")
def _(t):
    return over_results(t).select("result_id", T.unit_text(F.col("raw_unit")).alias("unit_1"), T.raw_unit_text(F.col("raw_unit")).alias("unit_2"))


B06 = f"""WITH r AS ({RESULTS}), k AS (SELECT result_id, {NUM.format('number_text')} AS v, {UNIT1.format('duration_unit')} AS u FROM r)
SELECT result_id, round(v * h.f, 6) AS hours, CASE WHEN v IS NULL THEN 'missing' WHEN k.u = '' THEN 'missing_unit' WHEN h.f IS NULL THEN 'unrecognized_unit' ELSE 'standardized' END AS status
FROM k LEFT JOIN (VALUES {HOUR_ROWS}) h(u, f) ON h.u = k.u"""


@query("b06_duration_hours", B06)
def _(t):
    d = T.with_durations(over_results(t).select("result_id", "number_text", "duration_unit"), "number_text", "duration_unit")
    return d.select("result_id", "duration_h.hours", "duration_h.status")


@query("b07_short_duration", f"""WITH r AS ({RESULTS}), h AS (SELECT result_id, duration * CASE lower(trim(duration_unit)) WHEN 'h' THEN 1.0 WHEN 'd' THEN 24.0 WHEN 'min' THEN 1.0 / 60 END AS h FROM r) SELECT result_id, round(h, 9) AS hours, round(ln(1 + h), 9) AS log_hours FROM h""")
def _(t):
    return over_results(t).select("result_id", F.round(features.short_hours(F.col("duration"), F.col("duration_unit")), 9).alias("hours"), F.round(features.log_hours(F.col("duration"), F.col("duration_unit")), 9).alias("log_hours"))


B08 = f"""WITH r AS ({RESULTS}), k AS (SELECT result_id, {NUM.format('number_text')} AS v, {UNIT1.format('raw_unit')} AS u FROM r)
SELECT result_id, v * c.f AS value, CASE WHEN v IS NOT NULL THEN c.std END AS unit, CASE WHEN v IS NOT NULL AND c.f IS NOT NULL THEN c.fam ELSE 'other' END AS family,
 CASE WHEN v IS NULL THEN 'missing' WHEN k.u = '' THEN 'missing_unit' WHEN c.f IS NULL THEN 'unrecognized_unit' ELSE 'standardized' END AS status
FROM k LEFT JOIN (VALUES {CONC_ROWS}) c(u, std, fam, f) ON c.u = replace(k.u, ' ', '')"""


@query("b08_concentration", B08)
def _(t):
    d = T.with_concentration(over_results(t).select("result_id", "number_text", "raw_unit"), "number_text", "raw_unit", "c")
    return d.select("result_id", "c.value", "c.unit", "c.family", "c.status")


B09 = f"""WITH r AS ({RESULTS}), k AS (SELECT result_id, raw_mean, raw_min, raw_max, replace({UNIT1.format('raw_unit')}, ' ', '') AS u FROM r)
SELECT result_id, raw_mean * f AS mean_std, raw_min * f AS min_std, raw_max * f AS max_std, coalesce(fam, 'other') AS family, std AS unit,
 CASE WHEN k.u = '' THEN 'missing_unit' WHEN f IS NULL THEN 'unrecognized_unit' ELSE 'standardized' END AS status
FROM k LEFT JOIN (VALUES {CONC_ROWS}) c(u, std, fam, f) ON c.u = k.u"""


@query("b09_result_standardization", B09)
def _(t):
    names = ("mean", "min", "max")
    d = T.with_concentrations(over_results(t).select("result_id", "raw_unit", *[f"raw_{n}" for n in names]), {n: f"raw_{n}" for n in names}, "raw_unit")
    families = [F.col(f"{n}.family") for n in names]
    family = F.coalesce(*[F.when(f != "other", f) for f in families], F.lit("other"))
    ok = F.array(*[F.col(f"{n}.status") for n in names])
    status = F.when(F.array_contains(ok, "standardized"), "standardized").otherwise(F.array_min(F.filter(ok, lambda s: s != "missing")))
    return d.select("result_id", *[F.col(f"{n}.value").alias(f"{n}_std") for n in names], family.alias("family"), F.coalesce(*[F.col(f"{n}.unit") for n in names]).alias("unit"), status.alias("status"))


B10 = f"""WITH r AS ({RESULTS}), k AS (SELECT result_id, duration AS d, {UNIT1.format('duration_unit')} AS u FROM r)
SELECT result_id, round(d * f, 6) AS mean_h, round(d * 0.5 * f, 6) AS min_h, round(d * 2 * f, 6) AS max_h, CASE WHEN k.u = '' THEN 'missing_unit' WHEN f IS NULL THEN 'unrecognized_unit' ELSE 'standardized' END AS status
FROM k LEFT JOIN (VALUES {HOUR_ROWS}) h(u, f) ON h.u = k.u"""


@query("b10_test_durations", B10)
def _(t):
    scales = {"mean": 1.0, "min": 0.5, "max": 2.0}
    d = T.with_durations(over_results(t).select("result_id", "duration", "duration_unit"), "duration", "duration_unit", scales)
    return d.select("result_id", *[F.col(f"{n}.hours").alias(f"{n}_h") for n in scales], F.coalesce(*[F.nullif(F.col(f"{n}.status"), F.lit("missing")) for n in scales], F.lit("missing")).alias("status"))


MEDIUM = f"""m0 AS (SELECT *, replace(lower(trim(coalesce(habitat, ''))), '_', '-') AS h, regexp_replace(upper(trim(coalesce(media_type, ''))), '[/*]+$', '') AS m, regexp_replace(upper(trim(coalesce(exposure_type, ''))), '[/*]+$', '') AS e FROM r),
m1 AS (SELECT *, CASE WHEN m IN ('SED', 'SEDIMENT') THEN 'sediment' WHEN m IN ('FW', 'SW', 'AQU') THEN 'aquatic' WHEN m IN ('NAT', 'ART', 'UKS', 'MIN', 'HYP') THEN 'soil'
  WHEN m = 'CUL' THEN CASE WHEN h = 'water' OR e IN ('AQ', 'CM', 'MM', 'HP', 'NR') THEN 'aquatic' WHEN h = 'soil' OR e IN ('PR', 'SS') THEN 'soil' WHEN h IN ('non-soil', 'nonsoil') THEN 'terrestrial_nonsoil' END
  WHEN m IN ('NONE', 'FLT', 'AGR', 'LIT', 'FAB', 'POP') THEN 'terrestrial_nonsoil' END AS d1,
 CASE h WHEN 'water' THEN 'aquatic' WHEN 'soil' THEN 'soil' WHEN 'non-soil' THEN 'terrestrial_nonsoil' WHEN 'nonsoil' THEN 'terrestrial_nonsoil' END AS d2,
 CASE WHEN e IN ('AQ', 'CM', 'MM', 'HP', 'NR') THEN 'aquatic' WHEN e IN ('PR', 'SS') THEN 'soil' END AS d3 FROM m0),
m2 AS (SELECT *, coalesce(d1, d2, d3, 'unknown') AS medium_domain FROM m1)"""


@query("b17_exposure_medium", f"""WITH r AS ({RESULTS}), {MEDIUM} SELECT result_id, medium_domain,
 CASE WHEN coalesce(d1, d2, d3) IS NULL THEN 'unknown' ELSE concat_ws(',', CASE WHEN 'sediment' IN (d1, d2, d3) THEN 'sediment' END, CASE WHEN 'aquatic' IN (d1, d2, d3) THEN 'aquatic' END, CASE WHEN 'soil' IN (d1, d2, d3) THEN 'soil' END, CASE WHEN 'terrestrial_nonsoil' IN (d1, d2, d3) THEN 'terrestrial_nonsoil' END) END AS medium_domains,
 len(list_distinct(list_filter([d1, d2, d3], lambda x: x IS NOT NULL))) > 1 AS conflict FROM m2""")
def _(t):
    m = E.exposure_medium(F.col("habitat"), F.col("media_type"), F.col("exposure_type"))
    return over_results(t).select("result_id", m.alias("m")).select("result_id", "m.medium_domain", F.array_join("m.medium_domains", ",").alias("medium_domains"), F.col("m.medium_conflict_flag").alias("conflict"))


def unit_input(t):
    some = F.col("l_linenumber") == 5
    return E.with_exposure_medium(over_results(t)).join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("mw")), "l_partkey").withColumns({
        "std_mean": F.when(some, F.col("raw_mean") * 2), "std_min": F.lit(None).cast("double"), "std_max": F.lit(None).cast("double"),
        "std_family": F.when(some, "water_mg_l").otherwise("other"), "std_unit": F.when(some, "mg/L"),
    })


RULES = values(E.unit_rule_rows())
UNITS_V2 = f"""WITH r AS ({RESULTS}), {MEDIUM},
u0 AS (SELECT m2.*, p_retailprice AS mw, {RAWU.format('raw_unit')} AS ru FROM m2 JOIN part ON p_partkey = l_partkey),
u1 AS (SELECT *, CASE WHEN ru IN ('ppm', 'ppmw', 'ai ppm', 'ae ppm', 'ppb', 'ai ppb', 'ae ppb') THEN CASE WHEN medium_domain = 'aquatic' THEN 'water' WHEN medium_domain IN ('soil', 'sediment', 'terrestrial_nonsoil') THEN 'solid' ELSE 'none' END ELSE '*' END AS pl FROM u0),
u2 AS (SELECT u1.*, f.*, l_linenumber = 5 AND ru NOT IN ('ppm', 'ppmw', 'ai ppm', 'ae ppm', 'ppb', 'ai ppb', 'ae ppb') AS given, ru = 'mmol/kg soil' AND mw > 0 AS molar FROM u1 LEFT JOIN (VALUES {RULES}) f(unit, place, fam, std, factor, sure, note) ON f.unit = ru AND f.place = pl),
u3 AS (SELECT *, CASE WHEN given THEN 'water_mg_l' WHEN molar THEN 'soil_mg_kg' ELSE fam END AS family, CASE WHEN given THEN 'mg/L' WHEN molar THEN 'mg/kg' ELSE std END AS unit_v2,
 CASE WHEN given THEN raw_mean * 2 WHEN molar THEN raw_mean * mw WHEN factor IS NOT NULL THEN raw_mean * factor ELSE raw_mean END AS mean_v2,
 CASE WHEN given THEN 'source_standardized' WHEN molar OR factor IS NOT NULL THEN 'raw_unit_rule' ELSE 'unsupported' END AS src,
 CASE WHEN given THEN 'high' WHEN molar THEN 'medium' WHEN factor IS NOT NULL THEN sure ELSE 'none' END AS confidence,
 CASE WHEN given THEN NULL WHEN molar THEN 'mmol/kg_soil_to_mg/kg_using_molecular_weight' WHEN factor IS NOT NULL THEN note ELSE CASE WHEN ru = '' THEN 'missing_raw_unit' ELSE 'unsupported_raw_unit' END || ':' || coalesce(raw_unit, '') END AS why FROM u2)"""


@query("b11_unit_rules", UNITS_V2 + " SELECT result_id, family, unit_v2, mean_v2, src, confidence, why, ru LIKE 'ai %' OR ru LIKE 'ae %' AS active, ru LIKE 'ae %' AS acid FROM u3")
def _(t):
    u = E.normalize_units(unit_input(t))
    return u.select("result_id", F.col("unit_family_v2").alias("family"), F.col("standard_unit_v2").alias("unit_v2"), F.col("mean_value_v2").alias("mean_v2"), F.col("unit_conversion_source").alias("src"), F.col("unit_conversion_confidence").alias("confidence"), F.col("unit_conversion_note").alias("why"), F.col("active_ingredient_basis").alias("active"), F.col("acid_equivalent_basis").alias("acid"))


@query("b12_unsupported_units", UNITS_V2 + " SELECT split_part(why, ':', 1) AS reason, coalesce(raw_unit, '') AS raw_unit, count(*) AS n FROM u3 WHERE src = 'unsupported' GROUP BY 1, 2")
def _(t):
    u = E.normalize_units(unit_input(t)).where("unit_conversion_source = 'unsupported'")
    return u.groupBy(F.substring_index("unit_conversion_note", ":", 1).alias("reason"), F.coalesce("raw_unit", F.lit("")).alias("raw_unit")).agg(F.count("*").alias("n"))


@query("b13_standard_value_columns", UNITS_V2 + """ SELECT result_id, CASE WHEN family = 'water_mg_l' THEN mean_v2 END AS mg_l, CASE WHEN family = 'water_mg_l' THEN mean_v2 / 1000 / mw WHEN family = 'water_mol_l' THEN mean_v2 END AS mol_l,
 CASE WHEN family = 'soil_mg_kg' THEN mean_v2 END AS mg_kg, CASE WHEN family = 'soil_g_ha' THEN mean_v2 END AS g_ha, CASE WHEN family = 'diet_mg_kg' THEN mean_v2 END AS mg_kg_diet, CASE WHEN family = 'oral_mg_kg_d' THEN mean_v2 END AS mg_kg_bw_day FROM u3""")
def _(t):
    u = E.normalize_units(unit_input(t))
    c = E.standard_values(F.col("unit_family_v2"), F.col("standard_unit_v2"), F.col("mean_value_v2"), F.col("mw"))
    return u.select("result_id", *[v.alias(k.removeprefix("standard_value_")) for k, v in c.items()])


@query("b14_conversion_path", UNITS_V2 + """ SELECT result_id, CASE WHEN src = 'source_standardized' THEN 'source_standardized:mg/L' WHEN family = 'water_mg_l' THEN 'raw_to_mg_L_to_mol_L_to_pTox' WHEN family = 'water_mol_l' THEN 'raw_to_mol_L_to_pTox' WHEN family = 'soil_mg_kg' THEN 'raw_to_mg_kg_to_neglog'
 WHEN family = 'soil_g_ha' THEN 'raw_to_g_ha_to_neglog' WHEN family IN ('diet_mg_kg', 'oral_mg_kg_d') THEN 'raw_to_diet_or_oral_mg_kg_to_neglog' WHEN family IS NOT NULL THEN 'raw_to_' || family || '_to_neglog' END AS conversion_path FROM u3""")
def _(t):
    return E.normalize_units(unit_input(t)).select("result_id", "conversion_path")


TOX = """t0 AS (SELECT *, CASE WHEN l_linenumber = 2 THEN NULL ELSE raw_mean END AS tm, CASE WHEN l_linenumber = 3 THEN NULL ELSE raw_min END AS tl FROM r),
t1 AS (SELECT *, CASE WHEN tm IS NOT NULL THEN tm WHEN tl IS NOT NULL THEN (tl + raw_max) / 2 END AS tox,
 CASE WHEN tm IS NOT NULL THEN CASE WHEN mean_op = '<' THEN 'mean_censored' ELSE 'mean' END WHEN tl IS NOT NULL THEN CASE WHEN max_op = '>' THEN 'min_max_midpoint_censored' ELSE 'min_max_midpoint' END ELSE 'excluded' END AS source,
 CASE WHEN tm IS NOT NULL THEN CASE mean_op WHEN '<' THEN 'censored' WHEN '~' THEN 'approx' ELSE 'exact' END WHEN tl IS NOT NULL THEN CASE WHEN max_op = '>' THEN 'censored_midpoint' ELSE 'midpoint' END ELSE 'missing' END AS quality,
 CASE WHEN tm IS NOT NULL THEN CASE WHEN mean_op = '<' THEN 'censored_toxicity_value' END WHEN tl IS NOT NULL THEN CASE WHEN max_op = '>' THEN 'censored_min_or_max_toxicity_value' END ELSE 'missing_mean_and_invalid_min_max_midpoint' END AS tox_reason FROM t0)"""


def tox_parts():
    """Mean, low and high, and their operators."""
    numbers = [F.when(F.col("l_linenumber") != 2, F.col("raw_mean")), F.when(F.col("l_linenumber") != 3, F.col("raw_min")), F.col("raw_max")]
    return numbers, [F.col("mean_op"), F.lit(None).cast("string"), F.col("max_op")]


def tox_input(df):
    numbers, ops = tox_parts()
    return df.withColumn("tox", E.toxicity_value(*numbers, *ops))


@query("b15_toxicity_value", f"WITH r AS ({RESULTS}), {TOX} SELECT result_id, tox AS value, source, quality, tm IS NULL AND tl IS NOT NULL AS imputed, tox_reason AS reason FROM t1")
def _(t):
    return tox_input(over_results(t)).select("result_id", F.col("tox.value").alias("value"), "tox.source", "tox.quality", "tox.imputed", F.col("tox.excluded_reason").alias("reason"))


TARGET_ROWS = values([(i, *r) for i, r in enumerate(E.TARGETS)])
B16 = UNITS_V2.replace("WITH r AS", "WITH r AS", 1) + f""", {TOX.replace('FROM r)', 'FROM u3)')},
g AS (SELECT t1.*, k.*, coalesce(tox_reason, CASE WHEN tox <= 0 THEN 'non_positive_toxicity_value' WHEN k.i IS NULL THEN 'unsupported_unit_family:' || coalesce(family, unit_v2, 'missing') WHEN k.i = 1 AND (mw IS NULL OR mw <= 0) THEN 'missing_or_invalid_molecular_weight_for_mg_l_to_mol_l' END) AS reason
 FROM t1 LEFT JOIN (VALUES {TARGET_ROWS}) k(i, tfam, tunit, tname, tgroup, tbasis) ON k.tfam = family)
SELECT result_id, CASE WHEN reason IS NULL THEN round(-log10(CASE WHEN i = 1 THEN tox / 1000 / mw ELSE tox END), 9) END AS target_value, CASE WHEN reason IS NULL THEN tname END AS target_name, CASE WHEN reason IS NULL THEN tgroup END AS target_family,
 CASE WHEN reason IS NULL THEN CASE WHEN i = 2 THEN 'mg/kg:' || medium_domain ELSE tbasis END END AS target_basis, CASE WHEN reason IS NULL THEN 'included' ELSE 'excluded' END AS target_status, reason FROM g"""


def with_target(t):
    # written in between: one stage for all of these rules is more code than the virtual machine compiles
    rows = materialize(unit_input(t).select("result_id", "l_linenumber", *[f"{a}_{b}" for a in ("raw", "std") for b in ("mean", "min", "max", "unit")], "std_family", "mean_op", "max_op", "mw", "medium_domain"), "unit-rows")
    units = E.normalize_units(rows).select("result_id", "l_linenumber", "raw_mean", "raw_min", "raw_max", "mean_op", "max_op", "mw", "medium_domain", "unit_family_v2", "standard_unit_v2")
    return E.with_log_target(materialize(units, "unit-families"), *tox_parts(), F.col("unit_family_v2"), F.col("standard_unit_v2"), F.col("mw"), F.col("medium_domain"))


@query("b16_log_target", B16)
def _(t):
    return with_target(t).select("result_id", F.round("target.target_value", 9).alias("target_value"), "target.target_name", "target.target_family", "target.target_basis", "target.target_status", F.col("target.excluded_reason").alias("reason"))


@query("b18_effect_code", f"WITH r AS ({RESULTS}) SELECT result_id, {CODE.format('effect')} AS effect_code, {CODE.format('measurement')} AS measurement_code FROM r")
def _(t):
    return over_results(t).select("result_id", T.code(F.col("effect")).alias("effect_code"), T.code(F.col("measurement")).alias("measurement_code"))


ENDPOINT = f"""e0 AS (SELECT *, {CODE.format('endpoint')} AS ec FROM r),
e1 AS (SELECT *, nullif(regexp_extract(ec, '^(EC|LC|IC|AC|ED|LD|BMD|BMC)([0-9]+(\\.[0-9]+)?)$', 1), '') AS pre, TRY_CAST(nullif(regexp_extract(ec, '^(EC|LC|IC|AC|ED|LD|BMD|BMC)([0-9]+(\\.[0-9]+)?)$', 2), '') AS DOUBLE) AS lvl FROM e0),
e2 AS (SELECT *, CASE WHEN ec = '' THEN 'missing_endpoint' WHEN ec LIKE 'NR%' THEN 'excluded_endpoint:NR' WHEN ec = 'LT50' THEN 'excluded_endpoint:LT50' WHEN ec IN ('BAF', 'BCF', 'BCFD') THEN 'bioaccumulation_endpoint_requires_factor_target'
  WHEN pre IS NULL AND ec NOT IN ('NOEC', 'NOEL', 'LOEC', 'LOEL', 'MATC') THEN 'unsupported_endpoint:' || ec END AS ereason,
 CASE WHEN ec IN ('NOEC', 'NOEL') THEN 'NOEC' WHEN ec IN ('LOEC', 'LOEL') THEN 'LOEC' WHEN ec = 'MATC' THEN 'MATC' WHEN pre IN ('EC', 'LC') THEN 'ECx' WHEN pre IS NOT NULL THEN pre || 'x' END AS fam0 FROM e1),
e3 AS (SELECT *, CASE WHEN ereason IS NULL THEN fam0 END AS tf, CASE WHEN ereason IS NULL THEN CASE WHEN fam0 IN ('ECx', 'NOEC', 'LOEC') THEN 'main_toxicity' ELSE 'toxicity_aux' END END AS tg, CASE WHEN ereason IS NULL THEN lvl END AS tl0 FROM e2)"""
EFFECT_CASE = " ".join(f"WHEN ef IN ({', '.join(repr(c) for c in codes)}) OR me IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in E.EFFECTS.items())
EFFECT = f"""f0 AS (SELECT *, {CODE.format('effect')} AS ef, {CODE.format('measurement')} AS me FROM e3),
f1 AS (SELECT *, CASE {EFFECT_CASE} END AS effect_family FROM f0),
f2 AS (SELECT *, CASE WHEN ef = '' AND me = '' THEN 'missing_effect_and_measurement' WHEN effect_family IS NULL THEN 'unsupported_effect_family' END AS freason FROM f1)"""


@query("b19_endpoint_class", f"WITH r AS ({RESULTS}), {ENDPOINT} SELECT result_id, tf AS family, tg AS task_group, tl0 AS effect_level, ereason AS reason FROM e3")
def _(t):
    f, g, x, r = E.endpoint_class(F.col("ec"))
    return over_results(t).select("result_id", T.code(F.col("endpoint")).alias("ec")).select("result_id", f.alias("family"), g.alias("task_group"), x.alias("effect_level"), r.alias("reason"))


@query("b20_effect_family", f"WITH r AS ({RESULTS}), {ENDPOINT}, {EFFECT} SELECT result_id, effect_family, freason AS reason FROM f2")
def _(t):
    f, r = E.effect_family(F.col("e"), F.col("m"))
    return over_results(t).select("result_id", T.code(F.col("effect")).alias("e"), T.code(F.col("measurement")).alias("m")).select("result_id", f.alias("effect_family"), r.alias("reason"))


@query("b21_task_head", f"""WITH r AS ({RESULTS}), {ENDPOINT}, {EFFECT}, h AS (SELECT *, l_linenumber = 6 AS oral FROM f2)
SELECT result_id, CASE WHEN oral OR ereason IS NOT NULL OR freason IS NOT NULL THEN NULL ELSE tf || '_' || effect_family END AS task_head, CASE WHEN NOT oral THEN tg END AS task_group, CASE WHEN NOT oral THEN tf END AS task_family,
 CASE WHEN NOT oral THEN tl0 END AS effect_level_x, CASE WHEN oral OR ereason IS NOT NULL OR freason IS NOT NULL THEN 'excluded' ELSE 'included' END AS status, CASE WHEN oral THEN 'excluded_oral_target' ELSE coalesce(ereason, freason) END AS reason FROM h""")
def _(t):
    name = F.when(F.col("l_linenumber") == 6, "neg_log10_mg_kg_bw_day").otherwise("ptox_mol_l")
    h = E.with_task_head(over_results(t).withColumns({"target_name": name, "target_basis": F.lit(None).cast("string")}))
    return h.select("result_id", "task_head", "task_group", "task_family", "effect_level_x", F.col("task_status").alias("status"), F.col("task_excluded_reason").alias("reason"))


@query("b22_duration_bin", f"""WITH r AS ({RESULTS}), d AS (SELECT result_id, duration / (l_linenumber * l_linenumber * 2) AS h FROM r)
SELECT result_id, CASE WHEN h >= 24 THEN round_even(h * 2, 0) / 2 WHEN h >= 1 THEN CAST(format('{{:.1f}}', h) AS DOUBLE) ELSE CAST(format('{{:.2f}}', h) AS DOUBLE) END AS bin, CASE WHEN h >= 24 THEN 'round_0.5h_ge_24h' WHEN h >= 1 THEN 'round_0.1h_1_to_24h' ELSE 'round_0.01h_lt_1h' END AS rule FROM d""")
def _(t):
    df = over_results(t).select("result_id", (F.col("duration") / (F.col("l_linenumber") * F.col("l_linenumber") * 2)).alias("h"))
    b, r = T.duration_bin(F.col("h"))
    return df.select("result_id", b.alias("bin"), r.alias("rule"))


@query("b33_interval", f"""WITH r AS ({RESULTS}) SELECT result_id, round(CASE WHEN coalesce(mean_op, '') IN ('>', '>=') THEN NULL ELSE -log10(raw_mean) END, 9) AS bound_lower, round(CASE WHEN coalesce(mean_op, '') IN ('<', '<=') THEN NULL ELSE -log10(raw_mean) END, 9) AS bound_upper FROM r""")
def _(t):
    # the cohort's ~ marks an approximate value, no inequality; other qualifiers are errors (see the tests)
    lo, hi = E.concentration_interval(F.col("raw_mean"), F.nullif(F.col("mean_op"), F.lit("~")))
    return over_results(t).select("result_id", F.round(T.finite(lo), 9).alias("bound_lower"), F.round(T.finite(hi), 9).alias("bound_upper"))


@query("b36_interval_contract", f"""WITH r AS ({RESULTS}), c AS (SELECT result_id, mean_op IS NOT NULL AS cens, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE raw_mean END AS target, CASE WHEN l_linenumber % 2 = 0 THEN raw_min END AS lo, CASE WHEN l_linenumber % 5 > 1 THEN raw_mean END AS hi FROM r)
SELECT result_id, CASE WHEN NOT cens AND target IS NULL THEN 'point_without_finite_target' WHEN cens AND target IS NOT NULL THEN 'censored_with_target' WHEN cens AND lo IS NULL AND hi IS NULL THEN 'censored_without_bound' WHEN cens AND lo >= hi THEN 'bounds_not_ordered' END AS fault FROM c""")
def _(t):
    line = F.col("l_linenumber")
    fault = E.interval_fault(F.col("mean_op").isNotNull(), F.when(line % 3 != 0, F.col("raw_mean")), F.when(line % 2 == 0, F.col("raw_min")), F.when(line % 5 > 1, F.col("raw_mean")))
    return over_results(t).select("result_id", fault.alias("fault"))


@query("b39_stable_id", f"WITH r AS ({RESULTS}) SELECT result_id, 'agg:' || sha256(to_json([CAST(result_id AS VARCHAR), coalesce(media_type, ''), coalesce(endpoint, '')])) AS stable_record_id FROM r")
def _(t):
    return over_results(t).select("result_id", T.stable_id("agg:", F.col("result_id"), F.col("media_type"), F.col("endpoint")).alias("stable_record_id"))


@query("b40_source_ids", """SELECT o_orderkey, array_to_string(list_sort(list_distinct([CAST(o_custkey AS VARCHAR), CAST(o_orderkey % 7 AS VARCHAR), CAST(o_custkey AS VARCHAR)])), ',') AS ids FROM orders""")
def _(t):
    as_json = F.to_json(F.array(F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 7).cast("string"), F.col("o_custkey").cast("string")))
    return t("orders").select("o_orderkey", F.array_join(T.source_ids(as_json), ",").alias("ids"))


@query("b46_publication_year", f"""WITH y AS (SELECT o_orderkey, {pick('o_orderkey', ['1999', 'c. 2005b', '18', None, '17x1850', '120199', '3000', 'NR'])} AS t FROM orders),
z AS (SELECT o_orderkey, list_filter(list_transform(range(1, greatest(length(trim(t)) - 2, 1)), lambda i: substr(trim(t), i, 4)), lambda s: regexp_full_match(s, '[0-9]{{4}}') AND s BETWEEN '1800' AND '2100') AS w FROM y)
SELECT o_orderkey, CAST(w[1] AS INTEGER) AS year, round(CASE WHEN w[1] IS NULL THEN 0.3 ELSE greatest(0.3, least(1.0, pow(0.8, greatest(0, 2020 - CAST(w[1] AS INTEGER)) / 5.0))) END, 9) AS weight FROM z""")
def _(t):
    y = t.sql(f"SELECT o_orderkey, {pick('o_orderkey', ['1999', 'c. 2005b', '18', None, '17x1850', '120199', '3000', 'NR'])} AS t FROM orders")
    year = T.publication_year(F.col("t"))
    return y.select("o_orderkey", year.alias("year"), F.round(T.recency_weight(year, F.lit(2020)), 9).alias("weight"))


@query("b47_hash_bin", "SELECT c_custkey, CAST(('0x' || substr(md5(c_name), 1, 8)) AS UBIGINT)::BIGINT % 64 AS bin FROM customer")
def _(t):
    return t("customer").select("c_custkey", T.hash_bin(F.col("c_name"), 64).alias("bin"))


@query("b23_chemical_class", curation_inputs.CHEMICAL_SQL)
def _(t):
    return curation.chemical_classes(t.sql(curation_inputs.CHEMICAL_INPUT)).select("p_partkey", "class_l1", "class_l2", "class_l3", "confidence", F.array_join("flags", ";").alias("flags"))


@query("b26_species_class", curation_inputs.SPECIES_SQL)
def _(t):
    return curation.species_classes(t.sql(curation_inputs.SPECIES_INPUT)).select("c_custkey", "group_l1", "group_l2", "group_l3", "confidence", "is_standard", "base_group")


@query("b27_habitat_taxonomy", curation_inputs.HABITAT_SQL)
def _(t):
    return habitat.habitat_by_taxonomy(t.sql(curation_inputs.HABITAT_INPUT)).select("p_partkey", "habitat_rule", "habitat", "habitat_labels", "habitat_confidence", "habitat_status")
