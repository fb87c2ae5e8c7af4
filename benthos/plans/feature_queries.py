"""Queries of model features, bins, qualifiers, contracts and report labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from benthos.functions import features as X
from benthos.operators import audits as U
from benthos.plans.registry import query

_ID = ["l_orderkey", "l_linenumber"]
_RBF = ", ".join(f"round(exp(-0.35 * pow(ln(1 + l_quantity) - ln(1 + {c}.0), 2)), 9) AS duration_rbf_{c}h" for c in X.CENTERS)


@query("b29_duration_features", f"SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 9) AS duration_log1p_h, round(sqrt(l_quantity), 9) AS duration_sqrt_h, round(1 / (1 + ln(1 + l_quantity)), 9) AS duration_inv_log1p_h, {_RBF} FROM lineitem")
def _(t):
    return t("lineitem").select(*_ID, *[F.round(v, 9).alias(k) for k, v in X.duration_features(F.col("l_quantity")).items()])


@query("b30_effect_features", "SELECT l_orderkey, l_linenumber, x AS effect_level, CAST(0 AS DOUBLE) AS effect_share, round(ln(1 + x), 9) AS effect_log1p, CAST(l_linenumber % 2 AS DOUBLE) AS effect_present FROM (SELECT *, CAST(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END AS DOUBLE) AS x FROM lineitem)")
def _(t):
    return t("lineitem").select(*_ID, *[F.round(v, 9).alias(k) for k, v in X.effect_features(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")), frozenset(["effect_share"])).items()])


#: A scheme of bins by unit family, as a configuration would give it.
SCHEME = {
    "water_mg_l": {"bins": [("very_toxic", None, 1.0), ("toxic", 1.0, 10.0), ("harmful", 10.0, 60.0)]},
    "water_mol_l": {"bins": [("very_toxic", None, 100.0), ("low", 100.0, None)], "needs_weight": True},
    "soil_mg_kg": {"bins": [("any", None, None)], "enabled": False},
}


@query("b31_toxicity_bin", """WITH d AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'water_mg_l' WHEN 1 THEN 'water_mol_l' WHEN 2 THEN 'soil_mg_kg' WHEN 3 THEN 'oral_mg_kg_d' END AS f, CASE WHEN l_quantity > 2 THEN l_extendedprice / 1000 END AS v, CASE WHEN l_discount > 0.01 THEN l_discount END AS w FROM lineitem),
x AS (SELECT *, CASE f WHEN 'water_mg_l' THEN v WHEN 'water_mol_l' THEN v * w * 1000 END AS s FROM d),
y AS (SELECT *, CASE WHEN f = 'soil_mg_kg' THEN 'disabled_for_aux_loss' WHEN f IS NULL OR f = 'oral_mg_kg_d' THEN 'no_authoritative_threshold' WHEN v IS NULL THEN 'missing_standard_value' WHEN s IS NULL THEN 'missing_molecular_weight' WHEN s <= 0 THEN 'non_positive_or_invalid_standard_value' WHEN f = 'water_mg_l' AND s >= 60 THEN 'no_matching_bin' ELSE 'active' END AS status FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN status = 'active' THEN CASE WHEN f = 'water_mg_l' THEN CASE WHEN s < 1 THEN 'very_toxic' WHEN s < 10 THEN 'toxic' ELSE 'harmful' END WHEN s < 100 THEN 'very_toxic' ELSE 'low' END END AS label, status, round(s, 6) AS standard_value,
 status = 'active' AND CASE WHEN f = 'water_mg_l' THEN abs(s - 1) <= 0.05 OR abs(s - 10) <= 0.5 OR abs(s - 60) <= 3 ELSE abs(s - 100) <= 5 END AS boundary_flag FROM y""")
def _(t):
    line = F.col("l_linenumber") % 5
    family = F.when(line == 0, "water_mg_l").when(line == 1, "water_mol_l").when(line == 2, "soil_mg_kg").when(line == 3, "oral_mg_kg_d")
    d = t("lineitem").select(*_ID, family.alias("f"), F.when(F.col("l_quantity") > 2, F.col("l_extendedprice") / 1000).alias("v"), F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("w"))
    b = X.assign_toxicity_bin(F.col("f"), F.col("v"), F.col("w"), SCHEME, ("oral_mg_kg_d",), tolerance=0.05)
    return d.select(*_ID, b["label"].alias("label"), b["status"].alias("status"), F.round(b["standard_value"], 6).alias("standard_value"), b["boundary_flag"].alias("boundary_flag"))


@query("b32_censor_operator", "SELECT l_orderkey, l_linenumber, op, CASE WHEN op LIKE '<%' THEN 'left' WHEN op IS NOT NULL THEN 'right' END AS direction FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN '<' WHEN l_linestatus = 'O' THEN '>=' END AS op FROM lineitem)")
def _(t):
    d = t.sql("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN ' < ' WHEN 'R' THEN '~' END AS a, CASE WHEN l_linestatus = 'O' THEN '>=' END AS b FROM lineitem")
    d = d.select(*_ID, X.censor_operator(F.col("a"), F.col("b")).alias("op"))
    return d.withColumn("direction", X.censor_direction(F.col("op")))


@query("b37_exact_qualifier", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'missing_value' WHEN l_returnflag = 'A' THEN 'censored' WHEN l_returnflag = 'R' THEN 'approximate' WHEN l_linenumber = 2 THEN 'unknown_qualifier' END AS reason FROM lineitem")
def _(t):
    return t.sql("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '<' WHEN 'R' THEN '~' ELSE CASE WHEN l_linenumber = 2 THEN '??' END END AS op, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS v FROM lineitem").select(*_ID, X.exact_reason(F.col("op"), F.col("v")).alias("reason"))


@query("b41_condition_key", "SELECT l_orderkey, CASE WHEN s <> 'O' THEN 'NA' WHEN len(v) = 0 THEN 'UNKNOWN' WHEN len(v) = 1 THEN CAST(v[1] AS VARCHAR) ELSE CAST(to_json(list_transform(v, lambda x: CAST(x AS VARCHAR))) AS VARCHAR) END AS condition_key FROM (SELECT l_orderkey, max(l_linestatus) AS s, coalesce(list_sort(list(DISTINCT l_quantity / 8) FILTER (WHERE l_quantity > 10)), []) AS v FROM lineitem GROUP BY l_orderkey)")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") > 10, F.col("l_quantity") / 8)).alias("v"), F.max("l_linestatus").alias("s"))
    return g.select("l_orderkey", X.condition_key(F.col("v"), exact=True, applies=F.col("s") == "O").alias("condition_key"))


@query("b42_head_routing", "SELECT p_partkey, p_type AS plain, p_type || CASE WHEN p_size % 4 <> 0 THEN '__' || p_brand ELSE '' END AS routed FROM part")
def _(t):
    family = F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).otherwise(" ")
    return t("part").select("p_partkey", X.route_head(F.col("p_type"), family, "task_head").alias("plain"), X.route_head(F.col("p_type"), family, "task_head_target_family").alias("routed"))


@query("b43_stage_contract", "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN 'brand' END, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 5 = 0 THEN 'size' END) AS mismatches, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN 'mismatch' WHEN p_partkey % 5 = 0 THEN 'legacy' ELSE 'ok' END AS state FROM part")
def _(t):
    size = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    brand = F.when(F.col("p_partkey") % 7 == 0, "other").otherwise(F.col("p_brand"))
    text = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("brand="), brand, F.lit("|size="), size))
    c = X.stage_contract(text, {"brand": F.col("p_brand"), "size": F.col("p_size")}, legacy=("size",))
    return t("part").select("p_partkey", F.array_join(c["mismatches"], ",").alias("mismatches"), c["state"].alias("state"))


@query("b44_single_target_dimension", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS dimensions, count(DISTINCT l_returnflag) <= 1 AS single FROM lineitem GROUP BY l_orderkey")
def _(t):
    return U.single_dimension(t("lineitem"), "l_orderkey", "l_returnflag")


@query("b45_medium_transfer", "SELECT event_id, CASE WHEN event_id % 16 = 4 THEN 'test' ELSE CASE event_id % 8 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' WHEN 3 THEN 'test' WHEN 4 THEN 'valid' WHEN 5 THEN 'train' WHEN 6 THEN 'test' ELSE 'valid' END END AS split_part FROM events")
def _(t):
    d = t.sql("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Fresh Water' WHEN 1 THEN 'aquaculture' WHEN 2 THEN 'medium:Soil' WHEN 3 THEN 'topsoil_dry' WHEN 4 THEN NULL WHEN 5 THEN 'ponds' WHEN 6 THEN 'sea water/soil mix' ELSE 'air' END AS m, CASE event_id % 16 WHEN 4 THEN 'SEDIMENT' WHEN 9 THEN 'unknown' END AS c FROM events")
    text = X.medium_text(F.col("c"), F.col("c"), F.col("m"))
    return d.select("event_id", X.medium_part(text, ("aquatic", "pond"), ("soil", "sediment"), "valid").alias("split_part"))


@query("b48_molar_shift", "SELECT p_partkey, round(-log10(p_retailprice / 7) + 3 + log10(p_retailprice), 9) AS molar FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(X.molar_shift(-F.log10(F.col("p_retailprice") / 7), F.col("p_retailprice")), 9).alias("molar"))


@query("b49_back_transform", "WITH d AS (SELECT p_partkey, p_partkey % 5 AS f, log10(p_retailprice) AS p, CASE WHEN p_size % 6 <> 0 THEN CAST(p_size AS DOUBLE) END AS w FROM part) SELECT p_partkey, " + ", ".join(f"round(CASE f WHEN 0 THEN least(40, pow(10, -(p + {s}))) WHEN 1 THEN CASE WHEN w IS NOT NULL THEN least(40, pow(10, -(p + {s})) / (1000 * w)) END END, 9) AS mol_l{n}, round(CASE f WHEN 1 THEN least(40, pow(10, -(p + {s}))) WHEN 0 THEN CASE WHEN w IS NOT NULL THEN least(40, pow(10, -(p + {s})) * w * 1000) END END, 9) AS mg_l{n}, round(CASE f WHEN 3 THEN least(40, pow(10, -(p + {s}))) WHEN 2 THEN CASE WHEN w IS NOT NULL THEN least(40, pow(10, -(p + {s})) * w * 1000) END END, 9) AS mg_kg{n}" for n, s in (("", "0.0"), ("_low", "0.98"), ("_high", "(-0.98)"))) + " FROM d")
def _(t):
    family = F.element_at(F.array(*[F.lit(x) for x in ("water_mol_l", "water_mg_l", "soil_mol_kg", "soil_mg_kg", "other")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    b = X.back_transform(F.log10("p_retailprice"), family, F.when(F.col("p_size") % 6 != 0, F.col("p_size").cast("double")), 0.5, most=40.0)
    return t("part").select("p_partkey", *[F.round(v, 9).alias(k) for k, v in b.items()])


@query("b50_domain_label", "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_nationkey > 12 THEN 'in_domain' WHEN c_acctbal > 0 THEN 'species_out_of_domain' WHEN c_nationkey > 12 THEN 'chemical_out_of_domain' ELSE 'out_of_domain' END AS label FROM customer")
def _(t):
    return t("customer").select("c_custkey", X.domain_label(F.col("c_acctbal") > 0, F.col("c_nationkey") > 12).alias("label"))


@query("b51_level_label", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'none' WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS label FROM part")
def _(t):
    return t("part").select("p_partkey", X.level_label(F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 2)).alias("label"))


@query("b52_duration_tolerance", "WITH x AS (SELECT l_partkey, l_orderkey AS a, l_quantity * 7 + l_discount AS h FROM lineitem), y AS (SELECT l_partkey, l_orderkey AS b, l_quantity * 7 + l_tax AS g FROM lineitem WHERE l_linenumber = 1) SELECT l_partkey, a, b, round(h, 6) AS h, round(g, 6) AS g FROM x JOIN y USING (l_partkey) WHERE abs(h - g) <= greatest(0.05, 0.002 * greatest(abs(h), abs(g)))")
def _(t):
    x = t("lineitem").select("l_partkey", F.col("l_orderkey").alias("a"), (F.col("l_quantity") * 7 + F.col("l_discount")).alias("h"))
    y = t("lineitem").where("l_linenumber = 1").select("l_partkey", F.col("l_orderkey").alias("b"), (F.col("l_quantity") * 7 + F.col("l_tax")).alias("g"))
    return X.join_durations(x, y, ["l_partkey"], "h", "g").select("l_partkey", "a", "b", F.round("h", 6).alias("h"), F.round("g", 6).alias("g"))


@query("b54_confidence_label", "WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey / 25.0 END AS s, c_acctbal > 0 AS c, c_custkey % 2 = 0 AS p, c_custkey % 3 <> 0 AS k FROM customer) SELECT c_custkey, CASE WHEN s IS NULL THEN CASE WHEN c AND p AND k THEN 'high' WHEN c AND p THEN 'medium' ELSE 'low' END WHEN s >= 0.7 AND c AND p AND k THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS label, CASE WHEN c AND p THEN CASE WHEN k THEN 'in_domain' ELSE 'task_extrapolation' END WHEN NOT c AND NOT p THEN 'chemical_and_species_extrapolation' WHEN NOT c THEN 'chemical_extrapolation' ELSE 'species_extrapolation' END AS warning FROM d")
def _(t):
    s, chem, species, seen = F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey") / 25), F.col("c_acctbal") > 0, F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 != 0
    return t("customer").select("c_custkey", X.confidence_label(s, chem, species, seen).alias("label"), X.domain_warning(chem, species, seen).alias("warning"))
