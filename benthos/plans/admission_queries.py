"""Queries of admission, quotas, weights and feature matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from benthos.functions import evidence_rules as E
from benthos.functions import features as X
from benthos.operators import admission as M
from benthos.operators import fitting as B
from benthos.operators import splits as P
from benthos.operators.ranks import range_rank
from benthos.plans.inputs import OBSERVATIONS, RESULTS
from benthos.plans.registry import query
from benthos.plans.rule_queries import EFFECT, ENDPOINT, UNITS_V2, unit_input
from benthos.plans.split_queries import CUT, rank_sql


@query("b28_habitat_flags", """WITH f AS (SELECT c_custkey, c_custkey % 3 = 0 OR c_nationkey % 5 = 0 AS w, c_nationkey % 4 = 0 AS d FROM customer)
SELECT c_custkey, CASE WHEN w THEN 'aquatic' WHEN d THEN 'terrestrial' END AS medium, CASE WHEN w AND d THEN 'aquatic;amphibious' WHEN w THEN 'aquatic' WHEN d THEN 'terrestrial' END AS labels, CAST(CASE WHEN w AND d THEN 0.78 WHEN w THEN 0.88 WHEN d THEN 0.86 END AS DOUBLE) AS confidence, CASE WHEN w AND d THEN 'review_recommended' WHEN w OR d THEN 'accepted' END AS status FROM f""")
def _(t):
    h = M.habitat_from_flags(F.when(F.col("c_custkey") % 3 == 0, 1), F.lit(None).cast("int"), F.when(F.col("c_nationkey") % 5 == 0, 1).otherwise(0), F.when(F.col("c_nationkey") % 4 == 0, 1))
    return t("customer").select("c_custkey", h.alias("h")).select("c_custkey", "h.*")


LIMITS = UNITS_V2 + f""", {ENDPOINT.replace('FROM r)', 'FROM u3)', 1)}, {EFFECT},
l0 AS (SELECT *, CASE WHEN ru IN ('ul/l', 'nl/l', 'ai ul/l', 'ai nl/l') THEN 'volume_concentration_missing_density_or_mass_equivalence' WHEN coalesce(mean_op, '') NOT IN ('<', '>', '<=', '>=') THEN 'unsupported_mean_operator'
 WHEN mean_v2 IS NULL OR mean_v2 <= 0 THEN 'missing_nonpositive_or_nonfinite_mean_bound' WHEN family IS NULL OR family NOT IN ('water_mol_l', 'water_mg_l', 'soil_mg_kg') THEN 'unit_outside_W00_M00' WHEN family <> 'water_mol_l' AND (mw IS NULL OR mw <= 0) THEN 'missing_or_invalid_molecular_weight'
 WHEN coalesce(d1, '') <> CASE WHEN family = 'soil_mg_kg' THEN 'soil' ELSE 'aquatic' END AND coalesce(d2, '') <> CASE WHEN family = 'soil_mg_kg' THEN 'soil' ELSE 'aquatic' END AND coalesce(d3, '') <> CASE WHEN family = 'soil_mg_kg' THEN 'soil' ELSE 'aquatic' END THEN 'outside_legacy_route_medium_domains'
 WHEN ereason IS NOT NULL OR freason IS NOT NULL THEN 'task_mapping' END AS pending FROM f2)"""


def limits(t):
    u = E.normalize_units(unit_input(t)).withColumns({"target_name": F.lit("ptox_mol_l"), "target_basis": F.lit(None).cast("string")})
    return M.mean_limits(E.with_task_head(u))


@query("b34_mean_limits", LIMITS + " SELECT result_id, pending AS reason, round(CASE WHEN pending IS NULL AND mean_op LIKE '<%' THEN -log10(CASE WHEN family = 'water_mol_l' THEN mean_v2 ELSE mean_v2 / (1000 * mw) END) END, 9) AS bound_lower FROM l0")
def _(t):
    return limits(t).select("result_id", F.col("pending_reason").alias("reason"), F.round("bound_lower", 9).alias("bound_lower"))


@query("b35_skip_reasons", LIMITS + " SELECT coalesce(pending, 'admitted') AS reason, count(*) AS n FROM l0 GROUP BY 1")
def _(t):
    return limits(t).groupBy(F.coalesce("pending_reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


@query("b38_point_ledger", f"""WITH r AS ({RESULTS}), p AS (SELECT result_id, CASE WHEN l_linenumber = 1 THEN 'M00' ELSE 'W00' END AS route, l_suppkey AS model_head, CASE WHEN l_linenumber = 4 THEN 'metal' WHEN raw_unit = 'gal/acre' THEN 'volume_concentration_missing_density_or_mass_equivalence' END AS f FROM r),
n AS (SELECT route, model_head, count(*) AS n FROM p WHERE f IS NULL GROUP BY 1, 2) SELECT result_id, coalesce(f, CASE WHEN coalesce(n, 0) < CASE route WHEN 'W00' THEN 5 ELSE 150 END THEN 'below_route_head_minimum_after_structure_correction' END, 'retained') AS admission_reason FROM p LEFT JOIN n USING (route, model_head)""")
def _(t):
    line = F.col("l_linenumber")
    p = t.sql(RESULTS).select("result_id", F.when(line == 1, "M00").otherwise("W00").alias("route"), F.col("l_suppkey").alias("model_head"), F.when(line == 4, "metal").alias("structure_reason"), F.coalesce(F.col("raw_unit") == "gal/acre", F.lit(False)).alias("from_volume_unit"))
    return M.point_ledger(p, {"W00": 5, "M00": 150}).select("result_id", "admission_reason")


@query("d36_tabular_encoder", """WITH m AS (SELECT quantile_cont(p_size, 0.5) FILTER (WHERE p_size <= 40) AS md, count(*) AS n FROM part WHERE p_partkey % 4 <> 0), k AS (SELECT p_brand, count(*) AS k FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1),
l AS (SELECT p_brand, CASE WHEN k >= greatest(2, ceil(n * 0.01)) THEN p_brand ELSE '<rare>' END AS lv FROM k, m),
h AS (SELECT p_partkey, 'name#' || (CAST(('0x' || substr(md5('s' || p_size), 1, 8)) AS UBIGINT) % 16) AS hb FROM part)
SELECT p_partkey, round(CASE WHEN p_size > 40 THEN md ELSE p_size END, 6) AS filled, CASE WHEN lv IS NULL THEN '' ELSE 'p_brand=' || lv END AS level, CASE WHEN hb IN (SELECT hb FROM h WHERE p_partkey % 4 <> 0) THEN hb ELSE '' END AS bin FROM h JOIN part USING (p_partkey) LEFT JOIN l USING (p_brand), m""")
def _(t):
    # sizes above 40 stand for missing entries; brands are pooled below one in a hundred, sizes as names are hashed
    p = t("part").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("p_size"), F.lit(3).alias("same"), "p_brand", F.concat(F.lit("s"), F.col("p_size")).alias("name"))
    train = F.col("p_partkey") % 4 != 0
    a, names = B.tabular_encoding(p, train, ["p_size", "same"], "p_brand", "p_partkey")
    b, hashed = B.tabular_encoding(p, train, [], "name", "p_partkey", most_levels=30, bins=16)
    shown = lambda names: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.when(F.element_at("features", i) == 1.0, F.element_at(F.array(*map(F.lit, names)), i)).otherwise("")), "")
    left = a.select("p_partkey", F.round(F.element_at("features", 1), 6).alias("filled"), F.array_join(F.transform(F.sequence(F.lit(2), F.lit(len(names))), lambda i: F.when(F.element_at("features", i) == 1.0, F.element_at(F.array(*map(F.lit, names)), i)).otherwise("")), "").alias("level"))
    return left.join(b.select("p_partkey", shown(hashed).alias("bin")), "p_partkey")


@query("d39_similarity_weights", "SELECT l_orderkey, l_linenumber, round(greatest(0.8, least(1.2, (1 + 2 * l_discount) / avg(1 + 2 * l_discount) OVER ())), 6) AS weight, round(greatest(0.5, least(2, (1 + 0.5 * l_discount) * exp(-9 * l_tax) / avg((1 + 0.5 * l_discount) * exp(-9 * l_tax)) OVER ())), 6) AS both FROM lineitem")
def _(t):
    x = t("lineitem")
    a = B.similarity_weights(x, 0.8, 1.2, similarity="l_discount", alpha=2.0).withColumnRenamed("weight", "one")
    b = B.similarity_weights(a, 0.5, 2.0, similarity="l_discount", alpha=0.5, distance="l_tax", decay=9.0)
    return b.select("l_orderkey", "l_linenumber", F.round("one", 6).alias("weight"), F.round("weight", 6).alias("both"))


@query("e01_sequence_by_first_appearance", "SELECT p_name, p_type, row_number() OVER (ORDER BY min(p_partkey)) AS aggregate_id FROM part GROUP BY p_name, p_type")
def _(t):
    g = t("part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("first"))
    return range_rank(g, [F.col("first").asc()]).select("p_name", "p_type", (F.col("rank") + 1).alias("aggregate_id"))


@query("e04_stratified_anchor", "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('29|' || event_id)) AS i FROM events) SELECT event_id FROM r JOIN n USING (event_type) WHERE i <= greatest(1, CAST(floor(100 * n / (SELECT sum(n) FROM n)) AS BIGINT))")
def _(t):
    return B.stratified_anchor(t("events").select("event_id", "event_type"), "event_type", "event_id", 100, 29).select("event_id")


NAMED = [("chemical_split", "CAST(o_custkey AS VARCHAR)"), ("species_split", "o_orderpriority"), ("chemical_species_split", "CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority")]


@query("h05_named_splits", "WITH s AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS split_type, o_orderkey, {CUT} AS split_part FROM orders JOIN ({rank_sql('(SELECT DISTINCT ' + key + ' AS group_key FROM orders)', 'group_key', 13)}) ON group_key = {key}" for kind, key in NAMED) + f" UNION ALL SELECT 'random_split', o_orderkey, {CUT} FROM ({rank_sql('orders', 'o_orderkey', 13)}) UNION ALL SELECT 'medium_transfer_split', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'valid' END FROM orders) SELECT split_type, split_part, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM s GROUP BY 1, 2")
def _(t):
    parts = {"train": 0.7, "valid": 0.1, "test": 0.2}
    d = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("prio"), F.when(F.col("o_orderkey") % 3 == 0, "soil plot").when(F.col("o_orderkey") % 3 == 1, "pond water").alias("m"))
    medium = X.medium_part(F.col("m"), ("aquatic",), ("soil",), "valid")
    out = None
    for kind in ("random_split", "chemical_split", "species_split", "chemical_species_split", "medium_transfer_split"):
        s = P.named_split(d, kind, "o_orderkey", 13, parts, "o_custkey", "prio", medium).select(F.lit(kind).alias("split_type"), "o_orderkey", "split_part")
        out = s if out is None else out.unionByName(s)
    return out.groupBy("split_type", "split_part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


def matrix(t, masked):
    """Publication year, two life stages and a vector of two, which every fifth structure lacks; targets scaled per task."""
    d = t.sql(OBSERVATIONS).withColumn("vector", F.when(F.col("canonical_parent") % 5 != 0, F.array((F.col("canonical_parent") % 3).cast("double"), F.lit(2.0))))
    return B.feature_matrix(d, F.col("test_id") % 3 != 0, "result_id", ["pub_year"], {"life_stage": ["A", "N"]}, "vector", 2, "x", F.col("task_head"), "per_task", masked)


MATRIX = f"""WITH d AS ({OBSERVATIONS}), f AS (SELECT avg(pub_year) AS m, CASE WHEN stddev_pop(pub_year) > 1e-12 THEN stddev_pop(pub_year) ELSE 1 END AS sd FROM d WHERE test_id % 3 <> 0), g AS (SELECT task_head, avg(x) AS gm, stddev_pop(x) AS gs FROM d WHERE test_id % 3 <> 0 GROUP BY 1),
o AS (SELECT result_id, life_stage, greatest(-6, least(6, coalesce((pub_year - m) / sd, 0))) AS z, CASE WHEN canonical_parent % 5 <> 0 THEN CAST(canonical_parent % 3 AS DOUBLE) ELSE 0 END AS v0, CASE WHEN canonical_parent % 5 <> 0 THEN 2.0 ELSE 0 END AS v1, (x - gm) / gs AS y FROM d JOIN g USING (task_head), f)"""


@query("m05_feature_matrix", MATRIX + " SELECT result_id, round(z, 6) AS z_year, 0.0 AS stage_a, 0.0 AS stage_n, v0, v1, round(y, 6) AS scaled_target FROM o")
def _(t):
    m = matrix(t, frozenset(["life_stage"]))
    return m.select("result_id", *[F.round(F.element_at("features", i + 1), 6).alias(c) for i, c in enumerate(("z_year", "stage_a", "stage_n", "v0", "v1"))], F.round("scaled_target", 6).alias("scaled_target"))


SETS = {"numeric": ["pub_year"], "species": ["life_stage"], "fingerprint": ["vector"]}


@query("m07_ablation_masks", MATRIX + " SELECT name AS ablation, round(sum(CASE WHEN name IN ('full', 'no_fingerprint', 'no_species_lifestage') THEN z ELSE 0 END), 4) AS numeric_sum, sum(CASE WHEN name NOT IN ('no_species_lifestage', 'no_context') AND life_stage IN ('A', 'N') THEN 1.0 ELSE 0 END) AS stage_sum, sum(CASE WHEN name = 'no_fingerprint' THEN 0 ELSE v0 + v1 END) AS vector_sum FROM o, (SELECT unnest(['full', 'no_fingerprint', 'no_species_lifestage', 'no_context']) AS name) GROUP BY 1")
def _(t):
    out = None
    for name in ("full", "no_fingerprint", "no_species_lifestage", "no_context"):
        x = [F.sum(F.element_at("features", i)) for i in range(1, 6)]
        s = matrix(t, B.ablation_masks(SETS, name)).agg(F.round(x[0], 4).alias("numeric_sum"), (x[1] + x[2]).alias("stage_sum"), (x[3] + x[4]).alias("vector_sum")).withColumn("ablation", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out
