"""Queries of sources, joins, set operations and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from benthos.operators import audits as U
from benthos.operators import evaluation as V
from benthos.operators import joins as J
from benthos.operators import search as K
from benthos.plans.inputs import PREDICTIONS
from benthos.plans.registry import Tables, pick, query
from benthos.sources import tables as S


@query("a01_projected_ingest", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(t):
    return J.require_columns(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("a02_full_ingest", "SELECT * FROM customer")
def _(t):
    return S.read_table(t.spark, f"{t.sf_dir}/customer.parquet")


@query("a03_dictionary_ingest", "SELECT CAST(c_custkey AS VARCHAR) AS cas_key, c_name AS structure FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR) || '7', c_name FROM customer WHERE c_custkey % 3 = 0")
def _(t):
    third = F.col("c_custkey") % 3 == 0
    raw = t("customer").select(F.when(~third, F.col("c_custkey").cast("string")).otherwise("  ").alias("CAS"), F.lit(None).cast("string").alias("casrn"), F.concat(F.col("c_custkey").cast("string"), F.lit("-7")).alias("cas_number"), F.col("c_name").alias("structure"))
    return S.dictionary(S.round_trip_csv(raw, "dictionary"), ["CAS", "casrn", "cas_number"]).select("cas_key", "structure")


@query("a04_jsonl_cache", "SELECT user_id AS cache_key, max(value) AS response FROM events GROUP BY user_id")
def _(t):
    ranked = t("events").groupBy("user_id").agg(F.max("value").alias("top"))
    lines = t("events").join(ranked, "user_id").select(F.to_json(F.struct(F.col("user_id").alias("cache_key"), F.col("value").alias("response"), F.when(F.col("value") == F.col("top"), "2024-02-02").otherwise("2024-01-01").alias("retrieved"))).alias("value"))
    broken = t("events").limit(5).select(F.lit('{"cache_key": 1, "resp').alias("value"))
    return S.last_json_lines(S.round_trip_text(lines.unionByName(broken), "cache"), "cache_key bigint, response double, retrieved string", "cache_key", "retrieved").select("cache_key", "response")


@query("a05_feature_cache", "SELECT CASE WHEN vec_id % 10 = 0 THEN 'missing' WHEN label > 2 THEN 'wrong_width' ELSE 'ok' END AS state, count(*) AS n FROM embeddings GROUP BY 1")
def _(t):
    e = t("embeddings")
    # vectors of labels above 2 are cut short, and one id in ten is not in the cache
    cache = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("id"), F.when(F.col("label") > 2, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"))
    state = S.cache_coverage(e.select(F.col("vec_id").alias("id")), cache, "embedding", 64)
    return state.groupBy("state").agg(F.count("*").alias("n"))


@query("a06_prediction_read", f"WITH p AS ({PREDICTIONS}) SELECT stable_record_id, pred_a AS prediction FROM p")
def _(t):
    p = t.sql(PREDICTIONS).select("stable_record_id", F.coalesce(F.col("pred_a").cast("string"), F.lit("NA")).alias("prediction"))
    back = S.round_trip_csv(p, "predictions")
    return back.select(F.col("stable_record_id").cast("bigint"), F.col("prediction").try_cast("double").alias("prediction"))


@query("a07_partitioned_write", "SELECT l_returnflag AS route, l_linestatus AS assigned_split, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("route"), F.col("l_linestatus").alias("assigned_split"))
    return S.write_partitions(rows, ["route", "assigned_split"], "views").groupBy("route", "assigned_split").agg(F.count("*").alias("n"))


@query("a08_exact_and_censored_views", f"WITH p AS ({PREDICTIONS}) SELECT v AS view, count(*) AS n, round(sum(target), 4) AS total FROM (SELECT unnest(CASE WHEN is_censored THEN ['all', 'censored'] ELSE ['all', 'exact'] END) AS v, target FROM p) GROUP BY v")
def _(t):
    out = None
    for name, d in U.views(t.sql(PREDICTIONS), "is_censored").items():
        n = d.agg(F.count("*").alias("n"), F.round(F.sum("target"), 4).alias("total")).select(F.lit(name).alias("view"), "n", "total")
        out = n if out is None else out.unionByName(n)
    return out


@query("a09_manifest", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_final FROM orders")
def _(t):
    m = t("orders").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))
    return S.manifest(m, "manifest")


@query("a10_split_replace", "SELECT 'S' || CAST(o_orderkey % 3 AS VARCHAR) AS split_name, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0 GROUP BY 1")
def _(t):
    o = t("orders").select("o_orderkey", F.concat(F.lit("S"), (F.col("o_orderkey") % 3).cast("string")).alias("split_name"))
    return S.replace_splits(o, o.where("split_name = 'S1' and o_orderkey % 2 = 0"), "splits").groupBy("split_name").agg(F.count("*").alias("n"))


@query("a11_batch_input", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'EC' ELSE 'LC' END AS endpoint, 'Mortality' AS effect, 'aquatic' AS medium, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'smiles' END, CASE WHEN value IS NULL OR value <= 5 THEN 'value' END) AS reasons FROM events")
def _(t):
    raw = t("events").select("event_id", F.when(F.col("event_id") % 3 != 0, "LC").alias("endpoint"), F.lit(None).cast("string").alias("effect"), F.when(F.col("event_id") % 4 == 0, " ").alias("medium"), F.col("value").cast("string").alias("value"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("S"), "user_id")).alias("smiles"))
    good, bad = S.batch_rows(raw, {"endpoint": "EC", "effect": "Mortality", "medium": "aquatic"}, {"smiles": F.col("smiles").isNotNull(), "value": F.col("value").try_cast("double") > 5})
    return good.select("event_id", "endpoint", "effect", "medium", F.lit("").alias("reasons")).unionByName(bad.select("event_id", "endpoint", "effect", "medium", F.array_join("reasons", ",").alias("reasons")))


C1 = "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, p.p_type, c.c_name, n.n_name, r.r_name FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"


def star(t: Tables):
    dims = [("orders", "l_orderkey", "o_orderkey"), ("part", "l_partkey", "p_partkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")]
    return J.star_view(t("lineitem"), [(t(n), a, b) for n, a, b in dims])


@query("c01_star_view", C1)
def _(t):
    return star(t).select("l_orderkey", "l_linenumber", "o_custkey", "p_type", "c_name", "n_name", "r_name")


@query("c02_wide_query", "SELECT l_orderkey, l_linenumber, o_orderpriority, p_brand, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = CAST(l_suppkey AS VARCHAR)")
def _(t):
    fact = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("sk", F.col("l_suppkey").cast("string"))
    return J.star_view(fact, [(t("part"), "l_partkey", "p_partkey"), (t("supplier").withColumn("tk", F.col("s_suppkey").cast("string")), "sk", "tk")]).select("l_orderkey", "l_linenumber", "o_orderpriority", "p_brand", "s_name")


@query("c03_curated_view", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def _(t):
    return J.star_view(t("orders").withColumn("a", F.col("o_custkey").cast("string")), [(t("customer").withColumn("b", F.col("c_custkey").cast("string")), "a", "b")]).select("o_orderkey", "c_mktsegment")


@query("c04_dictionary_enrichment", "SELECT p_partkey, p_name, 'CC' || p_partkey AS smiles FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name, NULL FROM part WHERE p_partkey % 2 = 1")
def _(t):
    d = t("part").where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("CC"), "p_partkey").alias("smiles"))
    return J.enrich(t("part"), d, "p_partkey", "smiles").select("p_partkey", "p_name", "smiles")


@query("c05_orphans", "SELECT 'orders_customers' AS relation, count(*) AS n_orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) UNION ALL SELECT 'lineitem_parts', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def _(t):
    a = J.orphans(t("orders"), t("customer").where("c_custkey % 5 <> 0"), "o_custkey", "c_custkey", "orders_customers")
    return a.unionByName(J.orphans(t("lineitem"), t("part").where("p_partkey % 7 <> 0"), "l_partkey", "p_partkey", "lineitem_parts"))


@query("c06_strict_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    split = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.strict_join(split, t("customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("c07_fetch_by_ids", "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    return U.fetch_by_ids(t("part"), t("lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


def aligned_a(t: Tables, model: str = "pred_a"):
    p = t.sql(PREDICTIONS)
    return J.aligned(p.select("stable_record_id", "target", "model_head", F.col(model).alias("prediction")), p.select("stable_record_id", "target", "model_head", "canonical_parent", "is_censored"))


@query("c08_alignment", f"WITH p AS ({PREDICTIONS}) SELECT stable_record_id, pred_a AS prediction, NOT is_censored AND target IS NOT NULL AS exact_expected, NOT is_censored AND target IS NOT NULL AND pred_a IS NOT NULL AS scored, CAST(NULL AS VARCHAR) AS fault FROM p")
def _(t):
    return aligned_a(t).select("stable_record_id", "prediction", "exact_expected", "scored", "fault")


@query("c09_paired_errors", f"WITH p AS ({PREDICTIONS}) SELECT stable_record_id, abs(pred_a - target) - abs(pred_b - target) AS delta FROM p WHERE NOT is_censored AND pred_a IS NOT NULL AND pred_b IS NOT NULL")
def _(t):
    return V.paired_errors(aligned_a(t), aligned_a(t, "pred_b"), "stable_record_id")


@query("c10_censored_to_split", """WITH s AS (SELECT 'c' || o_custkey AS i, 'n' || (o_custkey % 400) AS j, o_orderkey % 3 AS k3, o_orderstatus AS p FROM orders), l AS (SELECT i, k3, p FROM s UNION ALL SELECT j, k3, p FROM s WHERE j LIKE 'n1%'),
m AS (SELECT c_custkey, min(p) AS a, max(p) AS b FROM customer JOIN l ON l.k3 = c_custkey % 3 AND l.i IN ('c' || c_custkey, 'n' || (c_custkey % 400)) GROUP BY 1)
SELECT c_custkey, CASE WHEN a = b THEN a WHEN a IS NULL AND c_nationkey % 2 = 0 THEN 'train' END AS split_part FROM customer LEFT JOIN m USING (c_custkey)""")
def _(t):
    seen = t("orders").select("o_custkey", F.col("o_orderstatus").alias("split_part"), (F.col("o_orderkey") % 3).alias("k3"))
    lookup = seen.select(F.concat(F.lit("c"), "o_custkey").alias("identifier"), "k3", "split_part").unionByName(seen.select(F.concat(F.lit("n"), F.col("o_custkey") % 400).alias("identifier"), "k3", "split_part").where("identifier like 'n1%'"))
    c = t("customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("own"), F.concat(F.lit("n"), F.col("c_custkey") % 400).alias("other"), (F.col("c_custkey") % 3).alias("k3"), "c_nationkey")
    return U.censored_to_split(c, "c_custkey", ["own", "other"], ["k3"], lookup, F.col("c_nationkey") % 2 == 0)


@query("c11_seen_in_train", "WITH s AS (SELECT *, c_custkey % 4 = 0 AS tr FROM customer) SELECT c_custkey, c_nationkey IN (SELECT c_nationkey FROM s WHERE tr) AS seen_c_nationkey, c_mktsegment IN (SELECT c_mktsegment FROM s WHERE tr) AS seen_c_mktsegment FROM s")
def _(t):
    return J.seen_in_train(t("customer"), F.col("c_custkey") % 4 == 0, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "seen_c_nationkey", "seen_c_mktsegment")


@query("c13_taxonomic_prefix", """WITH x AS (SELECT c_custkey, n_regionkey AS a, c_nationkey AS b, c_mktsegment AS c, c_custkey % 9 = 0 AS tr FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT q.c_custkey, max(CASE WHEN q.a = r.a THEN CASE WHEN q.b = r.b THEN CASE WHEN q.c = r.c THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END) / 3 AS max_prefix FROM x q, x r WHERE r.tr GROUP BY 1""")
def _(t):
    x = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return J.prefix_similarity(x, x.where("c_custkey % 9 = 0"), ["n_regionkey", "c_nationkey", "c_mktsegment"]).select("c_custkey", "max_prefix")


@query("c15_feature_alignment", """WITH l AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 7 = 0) SELECT 'features_only' AS fault, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT 'data_only', count(*) FROM l WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'features_repeated', count(*) FROM (SELECT vec_id FROM embeddings GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'data_repeated', count(*) FROM (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'not_finite', count(*) FROM embeddings WHERE len(list_filter(embedding, lambda x: x >= 0.3)) > 0""")
def _(t):
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: F.when(x < 0.3, x).cast("double")).alias("v"))
    return U.alignment_faults(e, t("labels").unionByName(t("labels").where("doc_id % 7 = 0")), "doc_id", "v")


@query("c16_side_comparison", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def _(t):
    return J.compare_sides(t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")), "k")


@query("c17_json_membership", "SELECT event_id, event_id % 5 <> 0 AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 = 2 AS member FROM events")
def _(t):
    d = t("events").select("event_id", F.when(F.col("event_id") % 5 == 0, "broken [").otherwise(F.concat(F.lit('["k'), F.get_json_object("props", "$.k").cast("bigint") % 4, F.lit('","x"]'))).alias("domains"))
    return d.select("event_id", U.json_list_contains(F.col("domains"), "k2").alias("member"))


@query("c18_list_overlap", "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM r) AS n_right, (SELECT count(*) FROM a JOIN r USING (l_partkey)) AS n_shared")
def _(t):
    rows = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_set("l_partkey").alias("ids"))
    return U.list_overlap(rows.where("l_returnflag <> 'N'"), "ids", F.col("l_returnflag") == "A")


@query("c20_all_sources_pass", "SELECT l_orderkey, bool_and(p_size < 40) AS passes, coalesce(string_agg(DISTINCT CASE WHEN p_size >= 40 THEN 'size' END, ','), '') AS reasons FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def _(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    ledger = t("part").select(F.col("p_partkey").alias("source_id"), (F.col("p_size") < 40).alias("ok"), F.lit("size").alias("reason"))
    return J.sources_pass(rows, "ids", "l_orderkey", ledger).select("l_orderkey", "passes", F.array_join("reasons", ",").alias("reasons"))


@query("c21_recovered_times", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT x)), ',') AS times, count(DISTINCT x) AS n_times, count(DISTINCT x) > 1 AS multi_time FROM (SELECT l_orderkey, CASE WHEN p_partkey IS NULL OR p_partkey % 6 = 0 THEN 'UNKNOWN_SOURCE' WHEN p_partkey % 5 = 0 THEN 'UNKNOWN_TIME' ELSE CAST(p_size AS VARCHAR) END AS x FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) GROUP BY 1")
def _(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    source = t("part").where("p_partkey % 6 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("time"))
    return U.recovered_times(rows, "l_orderkey", "ids", source, "p_partkey", "time").select("l_orderkey", F.array_join("times", ",").alias("times"), "n_times", "multi_time")


# ---- searches and rankings ----------------------------------------------------------------


@query("f01_species_search", """WITH m AS (SELECT p_name, min(p_size) / 100 AS r2, max(p_retailprice) AS mae FROM part WHERE p_size > 5 GROUP BY 1),
a AS (SELECT p_name, count(*) AS n, bool_or(lower(p_name) = 'hot bolt' OR lower(p_type) = 'hot bolt' OR lower(p_brand) = 'hot bolt') AS exact, 'plain' AS form FROM part WHERE lower(p_name) LIKE '%hot bolt%' OR lower(p_type) LIKE '%hot bolt%' OR lower(p_brand) LIKE '%hot bolt%' GROUP BY 1 ORDER BY exact DESC, n DESC, p_name LIMIT 20),
b AS (SELECT p_name, count(*) AS n, bool_or(lower(p_name) = 'steel' OR lower(p_type) = 'steel') AS exact, 'ranked' AS form FROM part LEFT JOIN m USING (p_name) WHERE lower(p_name) LIKE '%steel%' OR lower(p_type) LIKE '%steel%' GROUP BY p_name, r2, mae ORDER BY exact DESC, r2 DESC NULLS LAST, mae NULLS LAST, n DESC, p_name LIMIT 20),
c AS (SELECT p_name, count(*) AS n, bool_or(lower(p_name) = 'an' OR lower(p_type) = 'an') AS exact, 'metric' AS form FROM part LEFT JOIN m USING (p_name) WHERE lower(p_name) LIKE '%an%' OR lower(p_type) LIKE '%an%' GROUP BY p_name, r2, mae ORDER BY exact DESC, r2 DESC NULLS LAST, mae NULLS LAST, n DESC, p_name LIMIT 20)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def _(t):
    metrics = t("part").where("p_size > 5").groupBy("p_name").agg((F.min("p_size") / 100).alias("r2"), F.max("p_retailprice").alias("mae"))
    found = K.text_search(t("part"), ["p_name", "p_type", "p_brand"], " Hot Bolt", ["p_name"], 20).withColumn("form", F.lit("plain"))
    return found.unionByName(K.text_search(t("part"), ["p_name", "p_type"], "steel", ["p_name"], 20, metrics).drop("r2", "mae").withColumn("form", F.lit("ranked"))).unionByName(K.text_search(t("part"), ["p_name", "p_type"], "an", ["p_name"], 20, metrics).drop("r2", "mae").withColumn("form", F.lit("metric")))


@query("f02_species_options", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 15")
def _(t):
    return K.options(t("customer"), ["c_custkey", "c_name", "c_acctbal"], "c_acctbal", 15)


@query("f03_taxonomy_facets", "SELECT n_name AS facet, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND lower(c_mktsegment) = 'building' AND lower(n_name) LIKE '%n%' GROUP BY 1 ORDER BY n DESC, facet LIMIT 10")
def _(t):
    x = t("customer").where("c_acctbal > 0").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return K.facet(x, "n_name", 10, {"c_mktsegment": " building "}, "N")


HABITAT = pick("c_custkey", ["Fresh water", "SOIL", "non-soil", None])


@query("f04_medium_filter", f"SELECT c_custkey, h IS NULL OR lower(h) LIKE '%water%' AS aquatic, h IS NULL OR (lower(h) LIKE '%soil%' AND lower(h) NOT LIKE '%non-soil%') AS soil, h IS NULL AS sediment, TRUE AS any FROM (SELECT c_custkey, {HABITAT} AS h FROM customer)")
def _(t):
    d = t.sql(f"SELECT c_custkey, {HABITAT} AS h FROM customer")
    return d.select("c_custkey", *[K.medium_filter(F.col("h"), m).alias(m) for m in ("aquatic", "soil", "sediment", "any")])


@query("f05_effect_options", "SELECT event_type, n, round(a, 9) AS mean_value FROM (SELECT event_type, count(*) AS n, avg(CASE WHEN event_type <> 'view' THEN value END) AS a FROM events GROUP BY 1) ORDER BY a DESC NULLS LAST, event_type")
def _(t):
    return K.ranked_options(t("events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value"))), "event_type", "value").select("event_type", "n", F.round("mean", 9).alias("mean_value"))


IDS = pick("o_orderkey", ["x", "10", "9", "b2", "007"])


@query("f06_natural_sort", f"SELECT o_orderkey, row_number() OVER (ORDER BY TRY_CAST(i AS BIGINT) NULLS LAST, i, o_orderkey) AS pos FROM (SELECT o_orderkey, {IDS} AS i FROM orders)")
def _(t):
    return K.natural_order(t("orders").select("o_orderkey", F.expr(IDS).alias("i")), "i", "o_orderkey").select("o_orderkey", "pos")


@query("f06_natural_sort_all", f"SELECT o_orderkey, row_number() OVER (ORDER BY TRY_CAST(i AS BIGINT) NULLS LAST, i, o_orderkey) AS pos FROM (SELECT o_orderkey, {IDS} AS i FROM orders)")
def _(t):
    return K.natural_order(t("orders").select("o_orderkey", F.expr(IDS).alias("i")), "i", "o_orderkey").select("o_orderkey", "pos")


# ---- set operations -----------------------------------------------------------------------


@query("g01_union_of_frames", "SELECT o_orderkey AS id, o_orderstatus AS head, o_totalprice AS target, CAST(NULL AS DOUBLE) AS bound, o_orderkey % 10 = 0 AS duplicate FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, NULL, o_totalprice, o_orderkey % 10 = 0 FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 10 = 0")
def _(t):
    o = t("orders")
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("head"), F.col("o_totalprice").alias("target"))
    b = o.where("o_orderkey % 2 = 1 or o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("head"), F.col("o_totalprice").alias("bound"))
    return U.union_frames(a, b, "id").select("id", "head", "target", "bound", "duplicate")


@query("g02_distinct_with_conflicts", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_variants, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY l_partkey")
def _(t):
    return U.distinct_by_id(t("lineitem"), "l_partkey", ["l_suppkey"])


@query("g03_disjointness", "SELECT x || '_' || y AS pair, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = x INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = y)) AS n_common FROM (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')) v(x, y) UNION ALL SELECT 'F_O', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _(t):
    frames = {f: t("lineitem").where(F.col("l_returnflag") == f).select("l_suppkey") for f in "ANR"}
    return U.disjointness(frames, "l_suppkey").unionByName(U.disjointness({f: t("orders").where(F.col("o_orderstatus") == f) for f in "FO"}, "o_orderkey"))


@query("g04_set_equality", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 3 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)) AS only_left, (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 3)) AS only_right")
def _(t):
    return U.set_equality(t("lineitem").where("l_quantity > 3"), t("orders").where("o_orderkey % 9 <> 0"), "l_orderkey", "o_orderkey")


@query("g05_view_validation", f"""WITH p AS (SELECT *, stable_record_id AS i, stable_record_id % 2 = 0 AS less, stable_record_id % 11 = 0 AS wrong, stable_record_id % 3 = 0 AS two FROM ({PREDICTIONS}) WHERE target > 0), c AS (SELECT *, (less <> wrong) OR two AS has_low, ((NOT less) <> wrong) OR two AS has_high FROM p WHERE is_censored)
SELECT 'exact_rows' AS rule, 2 * count(*) AS n FROM p WHERE NOT is_censored AND i % 30 = 0 UNION ALL SELECT 'two_sided', count(*) FROM c WHERE has_low AND has_high UNION ALL SELECT 'direction', count(*) FROM c WHERE CASE WHEN less THEN NOT has_low ELSE NOT has_high END UNION ALL SELECT 'bound_value', count(*) FROM c WHERE i % 7 = 0""")
def _(t):
    # a tenth of the censored rows breaks each rule, and one exact row in thirty differs between the views
    i, less = F.col("stable_record_id"), F.col("stable_record_id") % 2 == 0
    p = t.sql(PREDICTIONS).where("target > 0").withColumns({"op": F.when(F.col("is_censored"), F.when(less, "<").otherwise(">")), "value": F.pow(F.lit(10.0), -F.col("target") / 50)})
    bound = F.col("target") / 50 + F.when(i % 7 == 0, 0.1).otherwise(0.0)
    wrong = i % 11 == 0
    p = p.withColumns({"bound_lower": F.when(F.col("is_censored") & ((less != wrong) | (i % 3 == 0)), bound), "bound_upper": F.when(F.col("is_censored") & ((~less != wrong) | (i % 3 == 0)), bound)})
    exact = p.where("not is_censored").select("stable_record_id", (F.col("target") + F.when(i % 30 == 0, 1.0).otherwise(0.0)).alias("target"))
    return U.view_violations(exact, p, "stable_record_id")