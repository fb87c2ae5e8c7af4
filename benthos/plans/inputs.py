"""SQL, the same in Spark and DuckDB, that gives the driver tables the columns of evidence records."""

from __future__ import annotations

from benthos.plans.registry import pick

UNITS = ["mg/L", "ug/L", "AI mg/L", "ppm", "mg/kg", "mg/kg bdwt/d", "%", None, "mmol/kg soil", "ae ug/l", "ppb", "g/ha", "lb/acre", "µg/L", "nM", "XYZ", "ug/g dry soil", " MG/L ", "ml/kg sd", "mg/org", "gal/acre", "mmol/L", "ai kg/ha", "ppm diet"]
NUMBERS = ["1,234.5e2*", "NR", "<5", "12.5", "  7 ", "3/", "abc", "-2.5e-3", "", None, "1d", "infinity", "4*/", ".5", "n/a", "1_000"]
DURATIONS = ["h", "d", "Days", "wk", "min", "mo", "hrs ", "year", None, "fortnight", "NR", "s"]
MEDIA = ["FW/", "CUL", "NAT", "XYZ", "SED", None, "sw", "none", "ART*", "AGR"]
HABITATS = ["Water", "Soil", "Non-Soil", None, "water ", "non_soil"]
EXPOSURES = ["AQ", "PR", None, "ZZ", "ss/", "HP"]
ENDPOINTS = ["EC50", "LC10/", "~NOEL", "NR-ZERO", "LT50", "BCF", "IC25.5", "LOEC*", "MATC", None, "bmd10", "EC 50", "FOO", "NOEC"]
EFFECT_CODES = ["MOR", "GRO/", "~REP", "POP", "ITX", None, "ENZ", "XXX", "gen", "MLT", "ACC", "PHY"]
MEASURES = ["MORT", "WGHT", None, "ABND", "SWIM", "YYY", "GEXP", "RSDE"]

RESULTS = f"""
SELECT l_orderkey * 10 + l_linenumber AS result_id, l_orderkey AS test_id, l_partkey AS cas_number, l_suppkey AS reference_number,
  l_extendedprice / 1000 AS raw_mean, l_extendedprice / 2000 AS raw_min, l_extendedprice / 500 AS raw_max,
  CASE l_returnflag WHEN 'A' THEN '<' WHEN 'R' THEN '~' END AS mean_op, CASE WHEN l_linestatus = 'O' THEN '>' END AS max_op,
  {pick('l_orderkey * 7 + l_linenumber', UNITS)} AS raw_unit,
  {pick('l_orderkey + l_partkey', MEDIA)} AS media_type, {pick('l_orderkey', HABITATS)} AS habitat, {pick('l_partkey + l_linenumber', EXPOSURES)} AS exposure_type,
  {pick('l_orderkey + l_linenumber * 3', ENDPOINTS)} AS endpoint, {pick('l_partkey', EFFECT_CODES)} AS effect, {pick('l_suppkey + l_linenumber', MEASURES)} AS measurement,
  {pick('l_orderkey + 2 * l_linenumber', NUMBERS)} AS number_text, {pick('l_partkey + 5 * l_linenumber', DURATIONS)} AS duration_unit,
  l_quantity AS duration, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem"""

#: Observations on a log scale with merge keys, reference, test and year.
OBSERVATIONS = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS result_id, l.l_orderkey AS test_id, l.l_suppkey AS reference_number, l.l_partkey AS canonical_parent,
  -log10(l.l_extendedprice / 1000 / p.p_retailprice) AS x, p.p_type AS task_head, o.o_orderpriority AS medium_domain, l.l_returnflag AS life_stage,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE year(o.o_orderdate) END AS pub_year
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""

#: A cohort with the predictions of two models; cluster user_id, head event_type.
PREDICTIONS = """
SELECT event_id AS stable_record_id, event_type AS model_head, user_id AS canonical_parent, value AS target, event_id % 13 = 0 AS is_censored,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value + ((event_id * 7919) % 101 - 50) / 40.0 END AS pred_a,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value + ((event_id * 104729) % 89 - 44) / 50.0 END AS pred_b
FROM events"""
