"""Queries of aggregation, quality control, metrics, statistics, windows and feature fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from benthos.functions import features as X
from benthos.functions import habitat as H
from benthos.operators import aggregates as A
from benthos.operators import audits as U
from benthos.operators import evaluation as V
from benthos.operators import fitting as B
from benthos.operators import resampling as RS
from benthos.operators.ranks import range_rank
from benthos.session import materialize
from benthos.plans.inputs import OBSERVATIONS, PREDICTIONS
from benthos.plans.join_queries import aligned_a
from benthos.plans.registry import Tables, query

KEYS = ["task_head", "medium_domain"]
OBS, PRED = f"WITH d AS ({OBSERVATIONS})", f"WITH p AS ({PREDICTIONS})"
R = lambda c, n=6: F.round(c, n)


@query("d01_quality_report", "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_l_orderkey, count(*) FILTER (WHERE l_discount = 0) AS n_no_discount, count(*) FILTER (WHERE l_returnflag = 'A') AS n_censored FROM lineitem")
def _(t):
    flags = {"no_discount": F.col("l_discount") == 0, "censored": F.col("l_returnflag") == "A"}
    return U.quality_report(t("lineitem"), ["l_orderkey"], flags)


@query("d02_best_row_per_key", "SELECT l_partkey, l_orderkey, l_linenumber, count(*) OVER w AS n_rows, (SELECT count(DISTINCT x.l_discount) FROM lineitem x WHERE x.l_partkey = lineitem.l_partkey AND x.l_discount > 0.05) AS n_values FROM lineitem WINDOW w AS (PARTITION BY l_partkey) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_discount > 0.05 THEN 0 ELSE 1 END, l_orderkey, l_linenumber) = 1")
def _(t):
    value = F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    return U.best_row_per_key(t("lineitem"), "l_partkey", value, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("d03_status_counters", "SELECT l_returnflag AS status, l_linestatus AS family, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return U.count_by(t("lineitem"), status="l_returnflag", family="l_linestatus")


@query("d04_strict_merge", OBS + " SELECT task_head, medium_domain, pub_year, round(quantile_cont(x, 0.5), 6) AS target_median, round(avg(x), 6) AS target_mean, round(coalesce(stddev_samp(x), 0), 6) AS target_std, count(x) AS target_count, round(min(x), 6) AS target_min, round(max(x), 6) AS target_max, count(*) AS n_ids FROM d GROUP BY 1, 2, 3")
def _(t):
    m = A.strict_merge(t.sql(OBSERVATIONS), [*KEYS, "pub_year"], "x", "result_id")
    return m.select(*KEYS, "pub_year", *[R(c).alias(c) for c in ("target_median", "target_mean", "target_std")], "target_count", R("target_min").alias("target_min"), R("target_max").alias("target_max"), F.size("result_ids").cast("bigint").alias("n_ids"))


Z = OBS + """, m AS (SELECT task_head, medium_domain, count(*) AS n, quantile_cont(x, 0.5) AS med, avg(x) AS mean, stddev_pop(x) AS sd FROM d GROUP BY 1, 2),
a AS (SELECT d.*, n, med, mean, sd FROM d JOIN m USING (task_head, medium_domain)), q AS (SELECT task_head, medium_domain, quantile_cont(abs(x - med), 0.5) AS mad FROM a GROUP BY 1, 2),
z AS (SELECT a.*, CASE WHEN mad > 1e-12 THEN 0.6745 * (x - med) / mad WHEN sd > 1e-12 THEN (x - mean) / sd ELSE 0 END AS z FROM a JOIN q USING (task_head, medium_domain)),
s AS (SELECT *, CASE WHEN n >= 50 AND abs(z) > 1.5 THEN 'excluded' ELSE 'included' END AS status FROM z)"""


def screened(t: Tables, *columns: str):
    return A.robust_screen(t.sql(OBSERVATIONS).select(*KEYS, "x", *columns), KEYS, "x", min_n=50, limit=1.5)


@query("d05_robust_z", Z + " SELECT result_id, round(z, 6) AS robust_z, status, CASE WHEN status = 'excluded' THEN 'robust_z_gt_1.5' WHEN n < 50 THEN 'small_group_manual_audit' END AS reason FROM s")
def _(t):
    return screened(t, "result_id").select("result_id", R("robust_z").alias("robust_z"), F.col("qc_status").alias("status"), F.col("qc_reason").alias("reason"))


W = ", w AS (SELECT *, max(pub_year) OVER (PARTITION BY task_head, medium_domain, life_stage) AS latest FROM s), v AS (SELECT *, CASE WHEN pub_year IS NULL THEN 0.3 ELSE greatest(0.3, least(1.0, pow(0.8, greatest(0, latest - pub_year) / 5.0))) END AS wt FROM w)"
MERGE = [*KEYS, "life_stage"]


def weighted(t: Tables, *columns: str):
    return A.recency_weights(screened(t, "life_stage", "pub_year", *columns), MERGE, "pub_year")


@query("d06_recency_weights", Z + W + " SELECT result_id, round(wt, 9) AS reference_weight FROM v")
def _(t):
    return weighted(t, "result_id").select("result_id", R("reference_weight", 9).alias("reference_weight"))


@query("d07_reference_merge", Z + W + """, i AS (SELECT * FROM v WHERE status = 'included'), raw AS (SELECT task_head, medium_domain, life_stage, count(*) AS n_rows, quantile_cont(x, 0.5) AS um, count(DISTINCT reference_number) AS nr FROM i GROUP BY 1, 2, 3),
u AS (SELECT task_head, medium_domain, life_stage, reference_number, test_id, quantile_cont(x, 0.5) AS u, avg(wt) AS w FROM i GROUP BY 1, 2, 3, 4, 5),
mm AS (SELECT task_head, medium_domain, life_stage, sum(w * u) / sum(w) AS wm, max(u) - min(u) AS rg, sum(w) AS ws, count(*) AS nu FROM u GROUP BY 1, 2, 3)
SELECT task_head, medium_domain, life_stage, round(wm, 6) AS weighted_mean, round(um, 6) AS unweighted_median, round(rg, 6) AS value_range, n_rows, nu AS n_units, CASE WHEN nr > 1 AND rg > 0.3 THEN 1 ELSE 0 END AS conflict_flag FROM mm JOIN raw USING (task_head, medium_domain, life_stage)""")
def _(t):
    m = A.reference_merge(weighted(t, "reference_number", "test_id").where("qc_status = 'included'"), MERGE, "x", "reference_number", "test_id")
    return m.select(*MERGE, R("weighted_mean").alias("weighted_mean"), R("unweighted_median").alias("unweighted_median"), R("value_range").alias("value_range"), "n_rows", "n_units", "conflict_flag")


@query("d08_train_only_qc", Z.replace("FROM d GROUP BY 1, 2)", "FROM d WHERE test_id % 5 <> 0 GROUP BY 1, 2)").replace("FROM a GROUP BY 1, 2)", "FROM a WHERE test_id % 5 <> 0 GROUP BY 1, 2)") + " SELECT CASE WHEN test_id % 5 <> 0 THEN 'train' ELSE 'eval' END AS part, count(*) AS n FROM s WHERE test_id % 5 = 0 OR status = 'included' GROUP BY 1")
def _(t):
    d = materialize(t.sql(OBSERVATIONS).select(*KEYS, "x", "test_id"), "observations")
    train, rest = d.where("test_id % 5 <> 0"), d.where("test_id % 5 = 0")
    kept = A.robust_screen(train, KEYS, "x", 50, 1.5, A.robust_stats(train, KEYS, "x", written=True)).where("qc_status = 'included'")
    return kept.select(F.lit("train").alias("part")).unionByName(rest.select(F.lit("eval").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


HABITATS = {"1": "Water", "2": "Soil", "3": "Non-Soil"}
VOTE = """WITH v AS (SELECT c_custkey, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS w, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS s, count(*) FILTER (WHERE o_orderpriority LIKE '3%') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
a AS (SELECT c_custkey, w + s + n AS total, CASE WHEN w >= s AND w >= n THEN 'aquatic' WHEN s >= n THEN 'soil' ELSE 'terrestrial' END AS top, greatest(w, s, n) / nullif(w + s + n, 0) AS share FROM v),
b AS (SELECT *, CASE WHEN total >= 5 AND share >= 0.7 THEN round(least(0.95, 0.74 + share * 0.2), 3) WHEN total >= 2 AND share >= 0.6 THEN round(least(0.82, 0.6 + share * 0.18), 3) END AS confidence, CASE WHEN total >= 5 AND share >= 0.7 THEN 'accepted' WHEN total >= 2 AND share >= 0.6 THEN 'review_recommended' END AS status,
 CASE WHEN total >= 2 AND share >= 0.6 THEN top END AS habitat FROM a)"""


@query("d09_habitat_vote", VOTE + " SELECT c_custkey, habitat, round(share, 9) AS share, confidence, status FROM b")
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.element_at(F.create_map(*[F.lit(x) for kv in HABITATS.items() for x in kv]), F.substring("o_orderpriority", 1, 1)).alias("habitat"))
    return H.habitat_vote(o, "c_custkey", "habitat").join(t("customer").select("c_custkey"), "c_custkey", "right").select("c_custkey", "habitat", R("share", 9).alias("share"), "confidence", "status")


@query("d10_habitat_decision", VOTE + """, x AS (SELECT c_custkey, CASE WHEN b.habitat IS NOT NULL THEN b.habitat WHEN c_nationkey < 10 THEN 'Water' WHEN c_nationkey < 20 THEN 'Soil' END AS h, CASE WHEN b.habitat IS NOT NULL THEN b.confidence WHEN c_nationkey < 20 THEN 0.5 + c_nationkey / 50 END AS cf,
 CASE WHEN b.habitat IS NOT NULL THEN 'vote' WHEN c_nationkey < 20 THEN 'taxonomy' END AS src, b.total, CASE WHEN c_custkey % 2 = 0 THEN 0.6 + (c_custkey % 7) / 20 END AS ext FROM customer JOIN b USING (c_custkey)),
y AS (SELECT *, ext IS NOT NULL AND (cf IS NULL OR cf < 0.75) AND ext >= coalesce(cf, 0) AS outside FROM x)
SELECT c_custkey, CASE WHEN outside THEN 'Non-Soil' ELSE h END AS habitat, round(CASE WHEN outside THEN ext ELSE cf END, 9) AS confidence, CASE WHEN outside THEN 'external' ELSE coalesce(src, 'unresolved') END AS source, total FROM y""")
def _(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.element_at(F.create_map(*[F.lit(x) for kv in HABITATS.items() for x in kv]), F.substring("o_orderpriority", 1, 1)).alias("habitat"))
    vote = H.habitat_vote(o, "c_custkey", "habitat")
    c = t("customer").select("c_custkey", "c_nationkey")
    taxonomy = c.where("c_nationkey < 20").select("c_custkey", F.when(F.col("c_nationkey") < 10, "Water").otherwise("Soil").alias("habitat"), (0.5 + F.col("c_nationkey") / 50).alias("confidence"))
    external = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("Non-Soil").alias("habitat"), (F.lit(0.6) + F.col("c_custkey") % 7 / 20).alias("confidence"))
    return H.habitat_decision(c, "c_custkey", vote, taxonomy, external, 0.75).select("c_custkey", "habitat", R("confidence", 9).alias("confidence"), "source", "total")


MET = "count(e) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(CASE WHEN count(e) >= 2 AND var_pop(y) > 0 THEN 1 - sum(e * e) / (var_pop(y) * count(y)) END, 6) AS r2"
SC = PRED + ", s AS (SELECT *, CASE WHEN NOT is_censored AND pred_a IS NOT NULL THEN target END AS y, CASE WHEN NOT is_censored THEN pred_a - target END AS e FROM p)"
rounded = lambda df, *keep: df.select(*keep, "n", *[R(c).alias(c) for c in ("mae", "rmse", "r2")])


@query("d11_regression_metrics", SC + f" SELECT {MET}, round(avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 6) AS huber FROM s")
def _(t):
    a = aligned_a(t).where("scored")
    return rounded(a.agg(*A.regression_metrics(), A.huber("target", "prediction").alias("huber")).withColumn("huber", R("huber")), "huber")


@query("d12_metrics_per_group", SC + f" SELECT model_head, {MET} FROM s GROUP BY 1")
def _(t):
    return rounded(aligned_a(t).where("scored").groupBy("model_head").agg(*A.regression_metrics()), "model_head")


@query("d13_within_task_r2", SC + ", h AS (SELECT model_head, sum(e * e) AS sse, var_pop(y) * count(y) AS sst FROM s GROUP BY 1) SELECT round(1 - sum(sse) / sum(sst), 6) AS within_r2 FROM h")
def _(t):
    return V.within_task_r2(aligned_a(t).where("scored"), "model_head", "target", "prediction").select(R("within_r2").alias("within_r2"))


@query("d14_cohort_evaluation", SC + """, h AS (SELECT model_head, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(y)) AS r2 FROM s GROUP BY 1),
q AS (SELECT count(e) AS pooled_n, avg(abs(e)) AS a, 1 - sum(e * e) / (var_pop(y) * count(y)) AS b FROM s) SELECT any_value(pooled_n) AS pooled_n, round(any_value(a), 6) AS pooled_mae, round(any_value(b), 6) AS pooled_r2, round(avg(mae), 6) AS macro_mae, round(quantile_cont(r2, 0.5), 6) AS median_r2, count(*) AS n_heads FROM h, q""")
def _(t):
    _, s = A.head_and_pooled(aligned_a(t))
    return s.select("pooled_n", R("pooled_mae").alias("pooled_mae"), R("pooled_r2").alias("pooled_r2"), R("macro_mae").alias("macro_mae"), R("median_r2").alias("median_r2"), "n_heads")


def members(t: Tables):
    p = t.sql(PREDICTIONS)
    return p.select("stable_record_id", F.explode(F.array(F.struct(F.lit(1).alias("seed"), F.col("pred_a").alias("prediction")), F.struct(F.lit(2).alias("seed"), F.col("pred_b").alias("prediction")), F.struct(F.lit(3).alias("seed"), (F.col("pred_a") + 0.5).alias("prediction")))).alias("m")).select("stable_record_id", "m.*")


ENS = PRED + ", m AS (SELECT stable_record_id, unnest([pred_a, pred_b, pred_a + 0.5]) AS v FROM p), g AS (SELECT stable_record_id, count(v) AS members, avg(v) AS mean, stddev_samp(v) AS sd FROM m GROUP BY 1)"


@query("d15_seed_ensemble", ENS + " SELECT stable_record_id, members, round(CASE WHEN members = 3 THEN mean END, 6) AS prediction, round(sd, 6) AS sd FROM g")
def _(t):
    return A.seed_ensemble(members(t), 3).select("stable_record_id", "members", R("prediction").alias("prediction"), R("sd").alias("sd"))


@query("d16_ensemble_replay", ENS + " SELECT stable_record_id, members, round(mean, 6) AS prediction, CASE WHEN stable_record_id % 9 = 0 THEN 'missing' WHEN mean IS NOT NULL AND stable_record_id % 7 = 0 THEN 'differs' ELSE 'same' END AS state FROM g")
def _(t):
    # the stored table has rounded means, one in seven of them off and one in nine left out
    stored = A.seed_ensemble(members(t), 3, require_all=False)
    i = F.col("stable_record_id")
    stored = stored.where(i % 9 != 0).select(i, (F.round("prediction", 4) + F.when(i % 7 == 0, 0.5).otherwise(0.0)).alias("prediction"))
    return V.replay_ensemble(members(t), stored, 3, 1e-3).select("stable_record_id", "members", R("prediction").alias("prediction"), "state")


CELLS = PRED + """, c AS (SELECT canonical_parent AS cluster, model_head AS head, count(*) AS n, sum(abs(pred_a - target) - abs(pred_b - target)) AS s FROM p WHERE NOT is_censored AND pred_a IS NOT NULL AND pred_b IS NOT NULL GROUP BY 1, 2)"""
BOOT = CELLS + """, k AS (SELECT cluster, row_number() OVER (ORDER BY sha256('7|' || cluster)) - 1 AS num, count(*) OVER () AS P FROM (SELECT DISTINCT cluster FROM c)),
d AS (SELECT r.r AS replicate, j.j, CAST(('0x' || substr(sha256('7|' || r.r || '|' || j.j), 1, 8)) AS UBIGINT)::BIGINT % (SELECT max(P) FROM k) AS num FROM range(200) r(r), (SELECT num AS j FROM k) j),
w AS (SELECT replicate, num, count(*) AS m FROM d GROUP BY 1, 2), x AS (SELECT replicate, head, sum(m * n) AS n, sum(m * s) AS s FROM w JOIN k USING (num) JOIN c USING (cluster) GROUP BY 1, 2)
, b AS (SELECT replicate, sum(s) / sum(n) AS delta_pooled, CASE WHEN count(*) = (SELECT count(DISTINCT head) FROM c) THEN avg(s / n) END AS delta_macro FROM x GROUP BY 1)"""


def cells(t: Tables):
    p = t.sql(PREDICTIONS).where("not is_censored and pred_a is not null and pred_b is not null")
    delta = F.abs(F.col("pred_a") - F.col("target")) - F.abs(F.col("pred_b") - F.col("target"))
    return p.groupBy(F.col("canonical_parent").alias("cluster"), F.col("model_head").alias("head")).agg(F.count("*").alias("n"), F.sum(delta).alias("s"))


@query("d17_cluster_bootstrap", BOOT + " SELECT replicate, round(delta_pooled, 6) AS delta_pooled, round(delta_macro, 6) AS delta_macro FROM b")
def _(t):
    return A.cluster_bootstrap(cells(t), 200, 7).select("replicate", R("delta_pooled").alias("delta_pooled"), R("delta_macro").alias("delta_macro"))


@query("e14_bootstrap_p", BOOT + ", z AS (SELECT count(delta_pooled) AS valid, quantile_cont(delta_pooled, 0.025) AS low, quantile_cont(delta_pooled, 0.975) AS high, least(1.0, 2 * (least(count(*) FILTER (WHERE delta_pooled <= 0), count(*) FILTER (WHERE delta_pooled >= 0)) + 1) / (count(delta_pooled) + 1)) AS p FROM b) SELECT valid, round(low, 6) AS low, round(high, 6) AS high, round(p, 9) AS p, CASE WHEN low > 0 OR high < 0 THEN 'EXCLUDES_ZERO' ELSE 'INCLUDES_ZERO' END AS status FROM z")
def _(t):
    b = V.bootstrap_test(cells(t), 200, 7, least_valid=100)
    return b.select("valid", *[R(c).alias(c) for c in ("low", "high")], R("p", 9).alias("p"), "status")


HEADS = PRED + ", h AS (SELECT model_head, avg(abs(pred_a - target)) AS a, avg(abs(pred_b - target)) AS b FROM p WHERE NOT is_censored GROUP BY 1)"


def head_errors(t: Tables):
    err = lambda m: F.avg(F.abs(F.col(m) - F.col("target")))
    return t.sql(PREDICTIONS).where("not is_censored").groupBy("model_head").agg(err("pred_a").alias("a"), err("pred_b").alias("b"))


@query("d18_direction_counts", HEADS + " SELECT count(*) FILTER (WHERE b < a) AS better, count(*) FILTER (WHERE b > a) AS worse, count(*) FILTER (WHERE b = a) AS equal FROM h")
def _(t):
    return V.direction_counts(head_errors(t), "a", "b")


@query("d22_similarity_summary", "WITH d AS (SELECT l_extendedprice / 120000 AS s FROM lineitem), r AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM d) SELECT count(*) AS n, round(avg(s), 6) AS mean, round(max(s) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)), 6) AS p50, round(max(s) FILTER (WHERE i = round_even(0.9 * (n - 1), 0)), 6) AS p90, round(max(s), 6) AS max, round(count(*) FILTER (WHERE s >= 0.65) / count(*), 6) AS share_ge_65, round(count(*) FILTER (WHERE s >= 0.80) / count(*), 6) AS share_ge_80 FROM r")
def _(t):
    return U.similarity_summary(t("lineitem").select((F.col("l_extendedprice") / 120000).alias("s")), "s").select("n", *[R(c).alias(c) for c in ("mean", "p50", "p90", "max", "share_ge_65", "share_ge_80")])


@query("d23_chemical_units", "SELECT p_brand, count(*) AS n_rows, arg_min(p_name, p_partkey) FILTER (WHERE p_size > 10) AS name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS heads FROM part GROUP BY p_brand")
def _(t):
    records = t("part").withColumn("p_name", F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" "))
    u = U.chemical_units(records, "p_brand", "p_partkey", ["p_name"], "p_type")
    return u.select("p_brand", "n_rows", F.col("p_name").alias("name"), F.array_join("heads", ",").alias("heads"))


@query("d24_group_summary", "SELECT p_type, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_members, count(DISTINCT p_size) AS n_scaffolds, array_to_string(list_sort(list(DISTINCT p_brand))[1:5], ',') AS top FROM part GROUP BY p_type")
def _(t):
    units = t("part").withColumn("rows", F.lit(1))
    g = U.group_summary(units, "p_type", "p_partkey", "rows", "p_size", "p_brand")
    return g.select("p_type", "n_rows", "n_members", "n_scaffolds", F.array_join("top_names", ",").alias("top"))


@query("d25_censoring_audit", "SELECT l_returnflag, l_linestatus, l_linenumber, l_discount > 0.05 AS high, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return U.count_by(t("lineitem"), l_returnflag="l_returnflag", l_linestatus="l_linestatus", l_linenumber="l_linenumber", high=F.col("l_discount") > 0.05)


@query("d26_bin_summary", "SELECT CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'mid' ELSE 'high' END AS bin, l_returnflag, count(*) AS n, count(*) FILTER (WHERE abs(l_extendedprice - 10000) <= 100 OR abs(l_extendedprice - 50000) <= 500) AS n_near_boundary FROM lineitem GROUP BY 1, 2")
def _(t):
    price = F.col("l_extendedprice")
    b = X.toxicity_bin(price, [("low", None, 10000.0), ("mid", 10000.0, 50000.0), ("high", 50000.0, None)])
    return U.boundary_audit(t("lineitem"), price, [10000.0, 50000.0], 0.01, bin=b, l_returnflag="l_returnflag")


@query("d27_perturbation", "SELECT l_orderkey, count(l_discount) AS n, round(avg(l_discount), 9) AS mean, round(stddev_pop(l_discount), 9) AS sd, round(avg(l_discount) - avg(l_tax), 9) + 0.0 AS error FROM lineitem GROUP BY 1")
def _(t):
    p = V.perturbation_summary(t("lineitem"), "l_orderkey", "l_discount", "l_tax")
    return p.select("l_orderkey", "n", *[(R(c, 9) + 0.0).alias(c) for c in ("mean", "sd", "error")])


@query("d28_species_performance", SC + f", f AS (SELECT *, bool_or(stable_record_id % 2 = 0) OVER (PARTITION BY canonical_parent) AS has_eval FROM s) SELECT canonical_parent, {MET} FROM f WHERE NOT has_eval OR stable_record_id % 2 = 0 GROUP BY 1")
def _(t):
    a = aligned_a(t).withColumn("prediction", F.when(F.col("scored"), F.col("prediction")))
    return rounded(V.preferred_metrics(a, ["canonical_parent"], F.col("stable_record_id") % 2 == 0), "canonical_parent")


@query("d29_observed_vs_predicted", """WITH q AS (SELECT quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events), b AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 28)) AS BIGINT) + 1, 28) AS bin, value FROM events, q WHERE value BETWEEN lo AND hi)
SELECT bin, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM b GROUP BY 1""")
def _(t):
    b = V.binned_profile(t("events").select("value"), "value", "value")
    return b.select("bin", "n", *[R(c).alias(c) for c in ("mean", "q25", "q75")])


@query("d30_support_counts", "WITH x AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, user_id, sum(n) OVER (PARTITION BY event_type)::BIGINT AS by_task, sum(n) OVER (PARTITION BY user_id)::BIGINT AS by_species, n AS by_species_task, max(n) OVER (PARTITION BY event_type) AS max_species_task FROM x")
def _(t):
    s = B.support_counts(t("events"), ["event_type"], "user_id")
    return s.select("event_type", "user_id", "by_task", "by_species", "by_species_task", "max_species_task")


SUPPORT = """WITH e AS (SELECT event_id, event_type AS task, user_id AS u, user_id % 40 AS g, hour(ts) % 5 AS stage, round(value) AS level, value FROM events), q AS (SELECT * FROM e WHERE event_id % 10 = 0), r AS (SELECT * FROM e WHERE event_id % 10 <> 0),
n AS (SELECT task, count(*) AS n, quantile_cont(level, 0.05) AS l5, quantile_cont(level, 0.95) AS l95, quantile_cont(value, 0.05) AS v5, quantile_cont(value, 0.95) AS v95 FROM r GROUP BY 1), m AS (SELECT max(n) AS most FROM n),
x AS (SELECT q.*, n.n, ln(1 + n.n) / ln(1 + most) AS task_support, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.task = q.task AND r.u = q.u) THEN 1.0 WHEN EXISTS (SELECT 1 FROM r WHERE r.task = q.task AND r.g = q.g) THEN 0.85 ELSE 0 END AS taxon_support,
 ln(1 + (SELECT count(*) FROM r WHERE r.task = q.task AND r.stage = q.stage)) / ln(1 + n.n) AS stage_support, (SELECT count(*) FROM r WHERE r.task = q.task AND r.u = q.u AND r.stage = q.stage AND r.level = q.level AND r.value = q.value) AS same,
 greatest(0, 1 - (SELECT min(abs(r.level - q.level)) FROM r WHERE r.task = q.task) / (l95 - l5)) AS e1,
 greatest(0, 1 - (SELECT min(abs(ln(1 + r.value) - ln(1 + q.value))) FROM r WHERE r.task = q.task) / (ln(1 + v95) - ln(1 + v5))) AS e2 FROM q JOIN n USING (task), m),
y AS (SELECT *, (e1 + e2) / 2 AS ex, ln(1 + same) / ln(1 + n) AS den FROM x)
SELECT event_id, round(task_support, 6) AS task_support, round(taxon_support, 6) AS taxon_support, round(stage_support, 6) AS stage_support, round(ex, 6) AS experiment_support, round(den, 6) AS density_support,
 round(exp((ln(greatest(task_support, 1e-9)) + ln(greatest(taxon_support, 1e-9)) + ln(greatest(stage_support, 1e-9)) + ln(greatest(ex, 1e-9)) + CASE WHEN den > 0 THEN ln(greatest(den, 1e-9)) ELSE 0 END) / CASE WHEN den > 0 THEN 5 ELSE 4 END), 6) AS overall FROM y"""


@query("d31_support_score", SUPPORT)
def _(t):
    e = t("events").withColumns({"genus": F.col("user_id") % 40, "stage": F.hour("ts") % 5, "level": F.round("value")})
    taxa = {"user_id": 1.0, "genus": 0.85}
    s = B.support_scores(e.where("event_id % 10 = 0"), e.where("event_id % 10 <> 0"), "event_id", ["event_type"], taxa, "stage", {"level": False, "value": True})
    return s.select("event_id", *[R(c).alias(c) for c in ("task_support", "taxon_support", "stage_support", "experiment_support", "density_support", "overall")])


@query("d32_reference_median", OBS + " SELECT task_head, life_stage, round(quantile_cont(x, 0.5), 6) AS median FROM d GROUP BY 1, 2")
def _(t):
    return B.reference_median(t.sql(OBSERVATIONS), ["task_head", "life_stage"], "x").select("task_head", "life_stage", R("median").alias("median"))


@query("d33_numeric_stats", "WITH t AS (SELECT avg(l_quantity) AS m, CASE WHEN stddev_pop(l_quantity) > 1e-12 THEN stddev_pop(l_quantity) ELSE 1 END AS s FROM lineitem WHERE l_linenumber <= 4) SELECT l_orderkey, l_linenumber, round(greatest(-1, least(1, (l_quantity - m) / s)), 6) AS z, abs((l_quantity - m) / s) > 1 AS clipped FROM lineitem, t")
def _(t):
    z = B.scale_numeric(t("lineitem"), F.col("l_linenumber") <= 4, ["l_quantity"], clip=1.0)
    return z.select("l_orderkey", "l_linenumber", R("z_l_quantity").alias("z"), F.col("clipped_l_quantity").alias("clipped"))


SCALES = [("per_task", "s1", "task_head"), ("per_target", "s2", "medium_domain"), ("per_task_target", "s3", "task_head, medium_domain"), ("per_adapter", "s4", "life_stage"), ("per_task_adapter", "s5", "task_head, life_stage")]


@query("d34_target_scaler", OBS + ", f AS (SELECT * FROM d WHERE test_id % 3 <> 0 AND (pub_year IS NOT NULL OR life_stage <> 'A')), g AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM f) SELECT d.result_id, round(d.x, 6) + 0.0 AS none, round(d.x, 6) + 0.0 AS identity, round((d.x - g.m) / g.sd, 6) + 0.0 AS global" + "".join(f", round((d.x - coalesce({a}.m, g.m)) / coalesce({a}.sd, g.sd), 6) + 0.0 AS {name}" for name, a, _ in SCALES) + ", round(d.x, 6) + 0.0 AS back FROM d CROSS JOIN g " + " ".join(f"LEFT JOIN (SELECT {k}, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END AS sd FROM f GROUP BY ALL) {a} USING ({k})" for _, a, k in SCALES))
def _(t):
    d = t.sql(OBSERVATIONS).withColumn("adapter", F.col("life_stage"))
    train, out = d.where("test_id % 3 <> 0"), d
    for mode in B.MODES:
        key = B.scale_key(mode, F.col("task_head"), F.col("medium_domain"), F.col("adapter"))
        stats = B.fit_target_scaler(train.where("pub_year is not null or life_stage <> 'A'"), "x", key)
        out = B.apply_target_scaler(out, stats, "x", key, mode, mode)
        if mode == "per_task":
            out = B.apply_target_scaler(out, stats, mode, key, mode, "back", inverse=True)
    return out.select("result_id", *[(R(m) + 0.0).alias(m) for m in B.MODES], (R("back") + 0.0).alias("back"))


@query("d35_category_maps", """WITH d AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_name || '/' || (p_size % 4) END AS v, CASE WHEN p_size % 9 <> 0 THEN p_name || '/' || (p_size % 4) ELSE '<missing>' END AS w FROM part),
n AS (SELECT v, count(*) AS n FROM d WHERE p_partkey % 4 <> 0 AND v IS NOT NULL GROUP BY 1), i AS (SELECT v, row_number() OVER (ORDER BY v) + 3 AS code FROM n WHERE n >= 5),
k AS (SELECT w, count(*) AS n FROM d WHERE p_partkey % 4 <> 0 GROUP BY 1), j AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS code FROM k WHERE n >= 5)
SELECT p_partkey, coalesce(i.code, CASE WHEN d.v IS NULL THEN 1 WHEN n.n IS NULL THEN 2 ELSE 3 END)::BIGINT AS reserved, coalesce(j.code, 0)::BIGINT AS by_frequency FROM d LEFT JOIN n ON n.v = d.v LEFT JOIN i ON i.v = d.v LEFT JOIN j ON j.w = d.w""")
def _(t):
    p = t("part").withColumn("v", F.when(F.col("p_size") % 9 != 0, F.concat("p_name", F.lit("/"), F.col("p_size") % 4)))
    train = F.col("p_partkey") % 4 != 0
    p = B.category_codes(p, train, "v", "reserved", 5)
    return B.category_codes(p, train, "v", "by_frequency", 5, "frequency").select("p_partkey", "reserved", "by_frequency")


@query("d37_task_weights", "WITH n AS (SELECT l_suppkey AS head, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT quantile_cont(n, 0.5) AS md FROM n) SELECT head, n, round(greatest(0.25, least(4, sqrt(md / n) * CASE WHEN head % 3 = 0 THEN 0.35 ELSE 1 END)), 9) AS weight FROM n, m")
def _(t):
    e = t("lineitem").select(F.col("l_suppkey").alias("head"), F.when(F.col("l_suppkey") % 3 == 0, "toxicity_aux").otherwise("main").alias("grp"))
    return B.task_weights(e, "head", "grp", {"toxicity_aux": 0.35}).select("head", "n", R("weight", 9).alias("weight"))


@query("d38_level_weights", "WITH n AS (SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_discount > 0.02 OR l_linenumber < 3 GROUP BY 1), w AS (SELECT *, pow(n, -0.5) AS w FROM n) SELECT l_linenumber, n, round(w * sum(n) OVER () / sum(w * n) OVER (), 6) AS weight FROM w")
def _(t):
    w = B.level_weights(t("lineitem").where("l_discount > 0.02 or l_linenumber < 3"), "l_linenumber", 0.5, 0.1, 10.0)
    return w.select("l_linenumber", "n", R("weight").alias("weight"))


@query("d40_bin_sampling_weights", "WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), b AS (SELECT event_id, event_type, least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS BIGINT) + 1, 10) AS bin FROM events JOIN r USING (event_type)), c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY 1, 2), k AS (SELECT event_type, count(*) AS occupied, sum(n) AS total FROM c GROUP BY 1) SELECT event_id, b.bin, round(total / (occupied * n), 6) AS weight FROM b JOIN c USING (event_type, bin) JOIN k USING (event_type)")
def _(t):
    w = B.bin_sampling_weights(t("events"), "event_id", "event_type", "value", 10, 1e-6, 1e6)  # bounds out of reach: SQL has no clipping
    return w.select("event_id", "bin", R("weight").alias("weight"))


@query("d41_shrinkage", "WITH n AS (SELECT event_type, count(*) AS n, event_type[1] AS family FROM events GROUP BY 1) SELECT event_type, n, family, sum(n) OVER (PARTITION BY family)::BIGINT AS n_family, round(n / (n + 50), 9) AS shrinkage FROM n")
def _(t):
    s = B.shrinkage(t("events").withColumn("family", F.substring("event_type", 1, 1)), "event_type", "family", 50.0)
    return s.withColumn("shrinkage", R("shrinkage", 9))


@query("d42_identity_hash", "SELECT l_partkey, sha256(to_json(list_sort(list(DISTINCT CAST(l_orderkey AS VARCHAR))))) AS identity_sha256 FROM lineitem GROUP BY 1")
def _(t):
    return U.listed_hash(t("lineitem"), "l_partkey", "l_orderkey")


@query("d43_unique_structures", "SELECT p_name AS structure, count(*) AS n, count(DISTINCT p_brand) AS n_sources FROM part WHERE p_size > 3 GROUP BY p_name")
def _(t):
    p = t("part").select(F.when(F.col("p_size") > 3, F.concat(F.lit(" "), "p_name", F.lit("  "))).otherwise(" ").alias("structure"), "p_brand")
    return U.unique_structures(p, "structure", "p_brand")


@query("d44_snapshot_validation", "SELECT CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT event_id) AS n_unique, count(DISTINCT event_type) AS n_heads, count(*) FILTER (WHERE event_id % 50 = 0 OR value IS NULL) AS n_not_finite, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1")
def _(t):
    e = t("events").withColumns({"part": F.when(F.col("event_id") % 4 == 0, "test").otherwise("train"), "value": F.when(F.col("event_id") % 50 != 0, F.col("value"))})
    return U.snapshot_validation(e, "event_id", "event_type", "value", "part").select("part", "n", "n_unique", "n_heads", "n_not_finite", "n_ids")


@query("d45_frame_contract", "WITH x AS (SELECT count(*) - count(DISTINCT event_id % 900) AS a, count(*) FILTER (WHERE event_id % 40 = 0 OR coalesce(event_type, '') = '') AS b, count(DISTINCT event_type) - 1 AS c FROM events) SELECT unnest(['missing_columns', 'repeated_ids', 'empty_head', 'several_scale', 'several_route']) AS rule, unnest([0, a, b, c, 0]) AS n_violations FROM x")
def _(t):
    e = t("events").withColumns({"head": F.when(F.col("event_id") % 40 == 0, " ").otherwise(F.col("event_type")), "record": F.col("event_id") % 900, "scale": F.col("event_type"), "route": F.lit("W00")})
    return U.frame_contract(e, ["record", "head", "scale", "route", "value"], "record", "head", "scale", ["route"])


@query("d46_row_exact_comparison", "SELECT 'left_only' AS side, count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem EXCEPT ALL (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.09 UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 45)) UNION ALL SELECT 'right_only', count(*) FROM ((SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.09 UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 45) EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem)")
def _(t):
    x = t("lineitem")
    other = x.where("l_discount < 0.09").unionByName(x.where("l_linenumber = 2 and l_quantity > 45"))
    return U.row_differences(x, other, ["l_orderkey", "l_partkey"])


@query("d47_validation_winner", HEADS + " SELECT CASE WHEN avg(a) <= avg(b) THEN 'pred_a' ELSE 'pred_b' END AS winner, round(least(avg(a), avg(b)), 6) AS macro_mae FROM h")
def _(t):
    return V.validation_winner(head_errors(t).select(F.col("a").alias("pred_a"), F.col("b").alias("pred_b")), ["pred_a", "pred_b"]).select("winner", R("macro_mae").alias("macro_mae"))


@query("d48_conflict_flags", "WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) > 1 AND max(l_discount) - min(l_discount) > 0.03 AS f, max(l_discount) > 0.05 AS was FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN f THEN 1 ELSE 0 END AS new_flag, f <> was AS changed FROM g")
def _(t):
    g = t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"), (F.max("l_discount") - F.min("l_discount")).alias("range"), (F.max("l_discount") > 0.05).cast("int").alias("flag"))
    return U.conflict_flags(g, "n", "range", 0.03, "flag").select("l_partkey", "new_flag", "changed")


@query("d49_task_filter", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber <= 5) AS n_train, count(*) FILTER (WHERE l_linenumber > 5) AS n_eval FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (WHERE l_linenumber <= 5) >= 15 AND count(*) FILTER (WHERE l_linenumber > 5) >= 3")
def _(t):
    return B.task_filter(t("lineitem"), "l_suppkey", F.col("l_linenumber") <= 5, (20, 15, 3))


# ---- windows ------------------------------------------------------------------------------


@query("e02_group_rank", "SELECT p_brand, 'structure_group_' || lpad(CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS VARCHAR), 5, '0') AS group_key FROM part GROUP BY p_brand")
def _(t):
    g = t("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return range_rank(g, [F.col("n").desc(), F.col("p_brand").asc()]).select("p_brand", F.format_string("structure_group_%05d", F.col("rank") + 1).alias("group_key"))


@query("e03_best_metric_row", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0 DESC, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, value DESC, event_id) = 1")
def _(t):
    rank = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return V.best_metric_row(t("events"), "user_id", "event_id", rank, F.col("value"), F.col("event_id") % 3 == 0)


@query("e05_internal_validation", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('11|' || event_id)) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, i <= greatest(1, least(n - 1, CAST(floor(n * 0.1) AS BIGINT))) AS is_valid FROM r")
def _(t):
    return B.internal_validation(t("events").select("event_id", "event_type"), "event_type", "event_id", 0.1, 11).select("event_id", "is_valid")


PV = "SELECT c_custkey AS contrast, c_mktsegment AS family, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_nationkey + 1) / 200.0 END AS p FROM customer"


@query("e06_holm", f"WITH p AS ({PV}), o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY family) AS m FROM p WINDOW w AS (PARTITION BY family ORDER BY coalesce(p, 1), contrast)) SELECT contrast, round(CASE WHEN p IS NOT NULL THEN max(least(1, (m - i + 1) * coalesce(p, 1))) OVER (PARTITION BY family ORDER BY i) END, 9) AS p_holm FROM o")
def _(t):
    return A.holm(t.sql(PV).withColumn("p", F.col("p").cast("double")), ["family"]).select("contrast", R("p_holm", 9).alias("p_holm"))


@query("e07_benjamini_hochberg", f"WITH p AS ({PV}), o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, contrast) AS i, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL) SELECT p.contrast, round(q, 9) AS q_bh FROM p LEFT JOIN (SELECT contrast, least(1, min(p * m / i) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM o) z ON z.contrast = p.contrast")
def _(t):
    return A.benjamini_hochberg(t.sql(PV).withColumn("p", F.col("p").cast("double")), ["family"]).select("contrast", R("q_bh", 9).alias("q_bh"))


@query("e08_risk_coverage", SC + ", c AS (SELECT unnest([0.0, 20.0, 40.0, 60.0, 80.0]) AS cutoff) SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(e) AS kept, round(avg(abs(e)), 6) AS mae FROM c LEFT JOIN s ON s.target >= cutoff GROUP BY 1")
def _(t):
    a = aligned_a(t).where("scored").select("target", F.abs(F.col("prediction") - F.col("target")).alias("e"))
    return V.risk_coverage(a, "target", "e", [0.0, 20.0, 40.0, 60.0, 80.0]).select("cutoff", "kept", R("mae").alias("mae"))


@query("e09_scope_effect", SC + " SELECT model_head, count(e) FILTER (WHERE canonical_parent % 2 = 0) AS n_low, count(e) FILTER (WHERE canonical_parent % 2 = 1) AS n_high, round(CASE WHEN least(count(e) FILTER (WHERE canonical_parent % 2 = 0), count(e) FILTER (WHERE canonical_parent % 2 = 1)) >= 20 THEN avg(abs(e)) FILTER (WHERE canonical_parent % 2 = 0) - avg(abs(e)) FILTER (WHERE canonical_parent % 2 = 1) END, 6) AS effect FROM s GROUP BY 1")
def _(t):
    a = aligned_a(t).where("scored").withColumn("e", F.abs(F.col("prediction") - F.col("target")))
    return V.scope_effect(a, "model_head", F.col("canonical_parent") % 2 == 0, "e").select("model_head", "n_low", "n_high", R("effect").alias("effect"))


@query("e10_stratified_metrics", SC + f""", k AS (SELECT *, count(*) OVER (PARTITION BY canonical_parent) AS ns FROM s WHERE e IS NOT NULL), q AS (SELECT quantile_cont(target, 0.25) AS a, quantile_cont(target, 0.5) AS b, quantile_cont(target, 0.75) AS c FROM k),
b AS (SELECT 'toxicity_quartile' AS stratum, CASE WHEN target <= a THEN 'q1' WHEN target <= b THEN 'q2' WHEN target <= c THEN 'q3' ELSE 'q4' END AS band, y, e FROM k, q UNION ALL SELECT 'similarity', CASE WHEN target / 100 < 0.3 THEN 'low' WHEN target / 100 < 0.65 THEN 'middle' ELSE 'high' END, y, e FROM k
UNION ALL SELECT 'species_support', CASE WHEN ns < 5 THEN 'few' WHEN ns < 12 THEN 'some' ELSE 'many' END, y, e FROM k) SELECT stratum, band, {MET} FROM b GROUP BY 1, 2""")
def _(t):
    a = aligned_a(t).where("scored")
    species = a.groupBy("canonical_parent").agg(F.count("*").alias("n_species"))
    d = materialize(a.join(species, "canonical_parent"), "strata")
    strata = {
        "toxicity_quartile": V.quartile_bands(d, "target"),
        "similarity": V.bands(F.col("target") / 100, [(0.3, "low"), (0.65, "middle")], "high"),
        "species_support": V.bands(F.col("n_species"), [(5, "few"), (12, "some")], "many"),
    }
    return rounded(V.stratified_metrics(d, strata), "stratum", "band")


@query("e11_within_task_spearman", SC + ", k AS (SELECT *, round(target) AS u FROM s WHERE e IS NOT NULL), r AS (SELECT model_head, rank() OVER (PARTITION BY model_head ORDER BY u) + (count(*) OVER (PARTITION BY model_head, u) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model_head ORDER BY abs(e)) + (count(*) OVER (PARTITION BY model_head, abs(e)) - 1) / 2.0 AS b FROM k) SELECT model_head, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def _(t):
    d = aligned_a(t).where("scored").select("model_head", F.round("target").alias("u"), F.abs(F.col("prediction") - F.col("target")).alias("v"))
    return V.spearman_by_task(d, "model_head", "u", "v").select("model_head", "n", R("rho").alias("rho"))


@query("e12_task_fraction", "WITH n AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS clusters FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_suppkey) AS i, count(*) OVER () AS k FROM n) SELECT count(*) AS n_tasks, sum(n)::BIGINT AS sum_n, sum(clusters)::BIGINT AS sum_clusters FROM r WHERE i <= ceil(k * 0.25)")
def _(t):
    n = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("clusters"))
    return V.task_fraction(n, "n", "l_suppkey", 0.25, ["n", "clusters"])


@query("e13_seed_mean_sd", PRED + ", m AS (SELECT model_head, unnest([1, 2]) AS seed, unnest([abs(pred_a - target), abs(pred_b - target)]) AS e FROM p WHERE NOT is_censored), s AS (SELECT model_head, seed, avg(e) AS mae FROM m GROUP BY 1, 2) SELECT model_head, count(mae) AS n, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS sd FROM s GROUP BY 1")
def _(t):
    p = t.sql(PREDICTIONS).where("not is_censored")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.abs(F.col(m) - F.col("target")).alias("e")) for i, m in ((1, "pred_a"), (2, "pred_b"))]))
    s = V.seed_mean_sd(p.select("model_head", each.alias("x")).select("model_head", "x.*"), ["model_head"], "seed", "e")
    return s.select("model_head", "n", R("mean").alias("mean"), R("sd").alias("sd"))


@query("e15_sign_flip", CELLS + """, o AS (SELECT head, sum(s) AS obs, count(*) AS k FROM c GROUP BY 1), f AS (SELECT r.r AS rep, head, sum(CASE WHEN CAST(('0x' || substr(sha256('5|' || r.r || '|' || cluster), 1, 8)) AS UBIGINT)::BIGINT % 2 = 0 THEN s ELSE -s END) AS v FROM c, range(50) r(r) GROUP BY 1, 2),
g AS (SELECT o.head, any_value(k) AS n_clusters, CASE WHEN any_value(k) > 1 THEN count(*) FILTER (WHERE abs(v) >= abs(obs) - 1e-9) END AS n_extreme FROM f JOIN o ON o.head = f.head GROUP BY o.head) SELECT *, round((n_extreme + 1) / 51, 9) AS p FROM g""")
def _(t):
    g = V.sign_flip_test(cells(t), 50, 5)
    return g.select("head", "n_clusters", "n_extreme", R("p", 9).alias("p"))


SIGN = "1 - 2 * ((CAST(('0x' || substr(sha256('5|' || (r.r // 256) || '|' || cluster), 1 + (r.r % 256) // 4, 1)) AS INTEGER) >> (3 - r.r % 4)) & 1)"


@query("e15_sign_flip_vectors", CELLS + f""", o AS (SELECT head, sum(s) AS obs, count(*) AS k FROM c GROUP BY 1), f AS (SELECT r.r AS rep, head, sum(s * ({SIGN})) AS v FROM c, range(300) r(r) GROUP BY 1, 2),
g AS (SELECT o.head, any_value(k) AS n_clusters, CASE WHEN any_value(k) > 1 THEN count(*) FILTER (WHERE abs(v) >= abs(obs) - 1e-9) END AS n_extreme FROM f JOIN o ON o.head = f.head GROUP BY o.head) SELECT *, round((n_extreme + 1) / 301, 9) AS p FROM g""")
def _(t):
    return RS.sign_flip_vectors(cells(t), 300, 5).withColumn("p", R("p", 9))


@query("d17_split_bootstrap")
def _(t):
    """Two thousand replicates, whose draws are made where the clusters are."""
    return RS.split_bootstrap(cells(t), 2000, 7)
