"""Queries of splits, closure groups, audits, similarity and kept modelling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from benthos.operators import audits as U
from benthos.operators import balance as B
from benthos.operators import domain as D
from benthos.operators import evaluation as V
from benthos.operators import models as M
from benthos.operators import nearest as N
from benthos.operators import similarity as Y
from benthos.operators import splits as P
from benthos.operators import trees as R
from benthos.plans.inputs import PREDICTIONS
from benthos.plans.registry import Tables, query
from benthos.session import materialize
from benthos.sources import tables as S

PARTS3 = ("train", "valid", "test")


def rank_sql(source: str, key: str, seed: int) -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY sha256('{seed}|' || {key})) - 1 AS r, count(*) OVER () AS n FROM {source}"


CUT = "CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.7) + floor(n * 0.1) THEN 'valid' ELSE 'test' END"


@query("h01_random_split", f"WITH k AS ({rank_sql('documents', 'doc_id', 13)}) SELECT doc_id, {CUT} AS split_part FROM k")
def _(t):
    return P.random_split(t("documents").select("doc_id"), "doc_id", 13, (0.7, 0.1, 0.2), PARTS3)


@query("h02_group_split", f"WITH k AS ({rank_sql('(SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS group_key FROM orders)', 'group_key', 17)}) SELECT o_orderkey, {CUT} AS split_part FROM orders JOIN k ON group_key = CAST(o_custkey AS VARCHAR)")
def _(t):
    return P.group_split(t("orders"), ["o_custkey"], 17, (0.7, 0.1, 0.2), PARTS3).select("o_orderkey", "split_part")


@query("h03_k_folds", f"WITH k AS ({rank_sql('(SELECT DISTINCT source AS group_key FROM documents)', 'group_key', 19)}) SELECT doc_id, CAST(r % 5 AS INTEGER) AS fold FROM documents JOIN k ON group_key = source")
def _(t):
    return P.k_folds(t("documents").select("doc_id", "source"), ["source"], 5, 19).select("doc_id", "fold")


def _named(name: str, table: str, r: str, parts: dict[str, float]) -> str:
    upto, cases = "0", ""
    for part, share in list(parts.items())[:-1]:
        upto += f" + floor(n * {share})"
        cases += f" WHEN r < {upto} THEN '{part}'"
    return f"SELECT '{name}' AS split_name, o_orderkey, CASE{cases} ELSE '{list(parts)[-1]}' END AS split_part FROM {r}"


RANKED = f"({rank_sql('orders', 'o_orderkey', 1)})"
GROUPED = f"(SELECT o_orderkey, r, n FROM orders JOIN ({rank_sql('(SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS group_key FROM orders)', 'group_key', 1)}) ON group_key = CAST(o_custkey AS VARCHAR))"
FOLDED = f"(SELECT o_orderkey, r FROM orders JOIN ({rank_sql('(SELECT CAST(o_orderkey AS VARCHAR) AS group_key FROM orders)', 'group_key', 1)}) ON group_key = CAST(o_orderkey AS VARCHAR))"
SUITE_SQL = " UNION ALL ".join(
    _named(name, "orders", RANKED if kind == "random" else GROUPED, parts) if isinstance(parts, dict)
    else f"SELECT '{name}_fold_' || (k + 1) AS split_name, o_orderkey, CASE WHEN r % {parts} = k THEN 'test' ELSE 'train' END AS split_part FROM {FOLDED if kind == 'random' else GROUPED}, range({parts}) f(k)"
    for name, kind, parts in P.SUITE.values()
)


@query("h04_split_suite", "SELECT split_name, split_part, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM (" + SUITE_SQL + ") GROUP BY 1, 2")
def _(t):
    suite = P.split_suite(t("orders"), "o_orderkey", "o_custkey", 1, min_rows=100)
    return suite.groupBy("split_name", "split_part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("c19_inherited_parts", "WITH k AS (SELECT c_custkey, 'test' AS part FROM customer WHERE c_nationkey = 3) SELECT o_orderkey, coalesce(part, CASE WHEN u < 0.64 THEN 'train' WHEN u < 0.8 THEN 'valid' ELSE 'test' END) AS split_part FROM (SELECT o_orderkey, o_custkey, CAST(('0x' || substr(sha256('23|' || o_custkey), 1, 8)) AS UBIGINT) / 4294967296.0 AS u FROM orders) LEFT JOIN k ON c_custkey = o_custkey")
def _(t):
    known = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.lit("test").alias("split_part"))
    return P.inherit_parts(t("orders").select("o_orderkey", "o_custkey"), known, "o_custkey", 23).select("o_orderkey", "split_part")


CLOSURE = """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a.l_orderkey AS a, b.l_orderkey AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_quantity = b.l_quantity AND a.l_orderkey <> b.l_orderkey),
r(a, b) AS (SELECT DISTINCT l_orderkey, l_orderkey FROM lineitem UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS l_orderkey, min(b) AS group_id FROM r GROUP BY a"""


def closure(t: Tables):
    rows = t("lineitem").select("l_orderkey", F.concat_ws("/", "l_partkey", "l_suppkey", "l_quantity").alias("id"))
    return P.closure_groups(rows, "l_orderkey", ["id"], [])


@query("h06_closure_groups", CLOSURE)
def _(t):
    return closure(t)


@query("h06_grown_groups", CLOSURE)
def _(t):
    """The closure groups of all rows, grown from those of four fifths of the orders by what the other rows touch."""
    rows = t("lineitem").select("l_orderkey", F.concat_ws("/", "l_partkey", "l_suppkey", "l_quantity").alias("id"))
    late = F.col("l_orderkey") % 5 == 0
    old = materialize(P.closure_groups(rows.where(~late), "l_orderkey", ["id"], []), "old-groups")
    fresh = P.shared_keys(rows.where(late), "l_orderkey", ["id"], [])
    # only keys that the other rows hold can be touched
    held = P.shared_keys(rows.where(~late), "l_orderkey", ["id"], []).join(fresh.select("x").distinct(), "x", "left_semi")
    keys = held.join(old.withColumnRenamed("l_orderkey", "r"), "r").select("x", "group_id").distinct()
    grown = P.grow_groups(keys, fresh, rows.where(late).select(F.col("l_orderkey").alias("r")))
    renamed = grown["renamed"].select(F.col("old_id").alias("group_id"), F.col("group_id").alias("now"))
    kept = old.join(renamed, "group_id", "left").select("l_orderkey", F.coalesce("now", "group_id").alias("group_id"))
    return kept.unionByName(grown["labels"].select(F.col("r").alias("l_orderkey"), "group_id"))


@query("h07_boundary_keys", "SELECT l_orderkey, l_linenumber, sha256(to_json([CAST(l_partkey AS VARCHAR)])) AS s3, sha256(to_json([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag])) AS s2, sha256(to_json([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END])) AS s1, sha256(to_json([CAST(l_partkey AS VARCHAR), CAST(to_json([CAST(l_orderkey AS VARCHAR)]) AS VARCHAR)])) AS source FROM lineitem")
def _(t):
    keys = {"s3": ["l_partkey"], "s2": ["l_partkey", "l_suppkey", "l_returnflag"], "s1": ["l_partkey", "l_suppkey", "l_returnflag", "time"], "source": ["l_partkey", "test_ids"]}
    d = t("lineitem").withColumns({"time": F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("string")), "test_ids": F.to_json(F.array(F.col("l_orderkey").cast("string")))})
    return P.boundary_keys(d, keys, single=("time",)).select("l_orderkey", "l_linenumber", *keys)


def balanced(t: Tables):
    rows = t("lineitem").select("l_returnflag", "l_suppkey", "l_linestatus").withColumnRenamed("l_returnflag", "route")
    groups = rows.groupBy("route", F.col("l_suppkey").alias("group_id"), F.col("l_linestatus").alias("head")).agg(F.count("*").cast("double").alias("n"))
    return P.balanced_assignment(groups, (0.64, 0.16, 0.20), 20260914)


@query("h08_balanced_assignment")
def _(t):
    return balanced(t)


@query("h08_balanced_attempts")
def _(t):
    """Suppliers' rows per line status, placed in sixteen jittered attempts; the best one."""
    rows = t("lineitem").withColumn("route", F.when(F.col("l_suppkey") % 3 == 0, "M00").otherwise("W00"))
    groups = rows.groupBy("route", F.concat(F.col("l_suppkey"), F.lit("/"), F.col("l_linenumber")).alias("group_id"), F.col("l_linestatus").alias("head")).agg(F.count("*").cast("double").alias("n"))
    return B.jittered_assignment(groups, (0.64, 0.16, 0.20), 20260914, attempts=16)


@query("h09_boundary_suite")
def _(t):
    """Groups under two boundaries, balanced parts per head, and their audit."""
    o = t("orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 2).alias("pair"), F.when(F.col("o_orderkey") % 3 == 0, "M00").otherwise("W00").alias("route"), F.col("o_orderpriority").alias("head"), F.array(F.concat(F.lit("t"), F.floor(F.col("o_orderkey") / 3))).alias("ids"))
    _, audit = P.boundary_suite(o, "o_orderkey", "head", "route", {"S3": (["pair"], []), "source": (["pair"], ["ids"])}, (0.64, 0.16, 0.20), 1, {"train": 10, "valid": 2, "test": 3}, attempts=16)
    return audit


@query("h10_holdout_greedy")
def _(t):
    groups = t("lineitem").groupBy(F.col("l_partkey").alias("group_id")).agg(F.count("*").cast("double").alias("n"))
    a = P.holdout_assignment(groups, 0.2, 3).withColumn("form", F.lit("holdout"))
    b = P.fold_assignment(groups, 5, 3).withColumn("form", F.lit("folds"))
    c = P.fraction_assignment(groups, {"train": 0.7, "valid": 0.1, "test": 0.2}, 3).withColumn("form", F.lit("fractions"))
    return a.unionByName(b).unionByName(c)


ASG = "SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split_part FROM orders"


@query("d20_leakage_audit", f"WITH a AS ({ASG}), x AS (SELECT 'o_custkey' AS kind, CAST(o_custkey AS VARCHAR) AS id, split_part FROM a UNION ALL SELECT 'tests', CAST(o_custkey % 700 AS VARCHAR), split_part FROM a UNION ALL SELECT 'tests', 't' || o_orderkey, split_part FROM a), g AS (SELECT kind, id, count(DISTINCT split_part) AS p FROM x GROUP BY 1, 2) SELECT kind, count(*) AS n_ids, count(*) FILTER (WHERE p > 1) AS n_crossing FROM g GROUP BY 1")
def _(t):
    a = t.sql(ASG).withColumn("tests", F.array((F.col("o_custkey") % 700).cast("string"), F.concat(F.lit("t"), "o_orderkey")))
    return U.leakage_audit(a, ["o_custkey"], ["tests"])


@query("d19_support_counts", f"WITH a AS ({ASG}), g AS (SELECT o_custkey % 50 AS head, count(*) FILTER (WHERE split_part = 'train') AS n_train, count(*) FILTER (WHERE split_part = 'test') AS n_test FROM a GROUP BY 1) SELECT head, n_train, n_test, concat_ws(';', CASE WHEN n_train < 100 THEN 'train_below_100' END, CASE WHEN n_test < 60 THEN 'test_below_60' END) AS reasons, n_train >= 100 AND n_test >= 60 AS eligible FROM g")
def _(t):
    return P.support(t.sql(ASG).withColumn("head", F.col("o_custkey") % 50), "head", {"train": 100, "test": 60})


@query("d21_structure_overlap", f"WITH a AS ({ASG}), d AS (SELECT DISTINCT o_custkey, split_part FROM a) SELECT x.split_part AS left_part, y.split_part AS right_part, count(*) AS n_common FROM d x JOIN d y ON x.o_custkey = y.o_custkey AND x.split_part < y.split_part GROUP BY 1, 2")
def _(t):
    return U.structure_overlap(t.sql(ASG), "o_custkey")


# ---- similarity ---------------------------------------------------------------------------

BITS = "list_filter(range(0, 64), lambda i: embedding[i + 1] > 0)"


BITS20 = "list_filter(range(0, 20), lambda i: embedding[i + 1] > 0)"


def sign_bits(t: Tables, width: int = 64):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.col("embedding")[i] > 0, i)), lambda x: x.isNotNull()).alias("bits"))


GRAM = "list_transform(range(1, length(s) - {0} + 2), lambda i: substr(s, i, {0}))"


@query("b53_gram_fingerprint", f"WITH n AS (SELECT p_partkey, lower(p_name) AS s FROM part), g AS (SELECT p_partkey, list_concat({GRAM.format(1)}, list_concat({GRAM.format(2)}, {GRAM.format(3)})) AS g FROM n), b AS (SELECT p_partkey, list_sort(list_distinct(list_transform(g, lambda x: CAST(CAST(('0x' || substr(md5(x), 1, 8)) AS UBIGINT) % 512 AS INTEGER)))) AS b FROM g) SELECT p_partkey, len(b) AS n_bits, array_to_string(b, ',') AS bits FROM b")
def _(t):
    b = Y.with_gram_bits(t("part").select("p_partkey", F.lower("p_name").alias("name")), "name", "b", 512).select("p_partkey", "b")
    return b.select("p_partkey", F.aggregate(Y.pack(F.col("b"), 512), F.lit(0), lambda a, w: a + F.bit_count(w)).cast("bigint").alias("n_bits"), F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("bits"))


@query("c12_best_tanimoto", f"WITH b AS (SELECT vec_id AS id, {BITS} AS x FROM embeddings) SELECT q.id AS query_id, round(max(len(list_intersect(q.x, r.x)) / len(list_distinct(list_concat(q.x, r.x)))), 9) AS max_similarity FROM b q, b r WHERE q.id % 20 = 0 AND r.id <> q.id GROUP BY 1")
def _(t):
    d = sign_bits(t).select("id", Y.pack(F.col("bits"), 64).alias("words"))
    q = d.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return Y.best_other_tanimoto(q, d).select("query_id", F.round("max_similarity", 9).alias("max_similarity"))


@query("c12_best_tanimoto_all", f"""WITH b AS (SELECT vec_id AS id, {BITS20} AS x FROM embeddings), p AS (SELECT q.id AS query_id, q.x AS own, r.x AS ref, coalesce(len(list_intersect(q.x, r.x)) / nullif(len(list_distinct(list_concat(q.x, r.x))), 0), 0) AS s FROM b q, b r WHERE q.id % 20 = 0 AND r.id <> q.id),
u AS (SELECT DISTINCT query_id, ref, s FROM p WHERE own <> ref), k AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS i FROM u), m AS (SELECT query_id, max(s) AS o, avg(s) FILTER (WHERE i <= 5) AS t FROM k GROUP BY 1)
SELECT p.query_id, round(max(s), 9) AS max_similarity, round(any_value(o), 9) AS other_similarity, round(any_value(t), 9) AS top_mean FROM p LEFT JOIN m USING (query_id) GROUP BY 1""")
def _(t):
    d = sign_bits(t, 20).select("id", Y.pack(F.col("bits"), 20).alias("words"))
    q = d.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return Y.best_other_tanimoto(q, d).select("query_id", *[F.round(c, 9).alias(c) for c in ("max_similarity", "other_similarity", "top_mean")])


@query("h11_similar_pairs", f"WITH b AS (SELECT vec_id AS id, {BITS20} AS x FROM embeddings), r AS (SELECT x, min(id) AS id FROM b WHERE len(x) > 0 GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS s FROM r a JOIN r b ON a.id < b.id) SELECT a, b, round(s, 9) AS similarity FROM p WHERE s >= 0.65 - 1e-12 UNION ALL SELECT r.id, b.id, 1 FROM b JOIN r ON r.x = b.x AND b.id <> r.id")
def _(t):
    return Y.similar_links(sign_bits(t, 20), 0.65).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("h12_similarity_clusters")
def _(t):
    """Scaffold-cluster job over part names as chemicals: groups with their holdout part and fold."""
    p = t("part").withColumn("id", F.concat_ws("/", "p_name", F.col("p_size") % 6))
    chemicals = p.groupBy("id").agg(F.min("p_name").alias("name"), F.min("p_size").alias("s")).select("id", Y.gram_bits(F.concat("name", F.lit("-"), F.col("s")), 256).alias("bits"), F.when(F.col("s") < 2, F.substring("name", -3, 3)).alias("scaffold"))
    job = Y.scaffold_cluster_job(chemicals, p.select("id", F.col("p_partkey").alias("row_id")), 0.65, 0.2, 5, 7)
    a = job["assignments"].groupBy("group_key", "split_part", "fold").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_members"))
    return a.crossJoin(job["overlap"].select("n_crossing"))  # one row


PART_SPLITS = "SELECT 'size' AS split_name, p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split_part FROM part UNION ALL SELECT 'key', p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'test' ELSE 'train' END FROM part"

NEAREST_SQL = f"""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS s FROM part), g AS (SELECT id, list_concat({GRAM.format(1)}, list_concat({GRAM.format(2)}, {GRAM.format(3)})) AS g FROM n), b AS (SELECT id, list_sort(list_distinct(list_transform(g, lambda x: CAST(CAST(('0x' || substr(md5(x), 1, 8)) AS UBIGINT) % 256 AS INTEGER)))) AS b FROM g),
a AS ({PART_SPLITS}), p AS (SELECT DISTINCT split_name, split_part, id, b FROM a JOIN b USING (id) WHERE len(b) > 0), u AS (SELECT DISTINCT split_name, split_part, b FROM p),
m AS (SELECT x.split_name, x.split_part, x.b, max(len(list_intersect(x.b, y.b)) / len(list_distinct(list_concat(x.b, y.b)))) AS s FROM u x JOIN u y ON x.split_name = y.split_name AND y.split_part = 'train' WHERE x.split_part <> 'train' GROUP BY ALL),
r AS (SELECT split_name, split_part AS test_part, id, coalesce(s, 0) AS s FROM p LEFT JOIN m USING (split_name, split_part, b) WHERE split_part <> 'train')"""


def _nearest(t: Tables):
    names = t("part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    parts = Y.with_gram_bits(names, "name", "bits", 256).select("id", "bits")
    return N.nearest_train(parts, t.sql(PART_SPLITS))


@query("h12_nearest_train", NEAREST_SQL + " SELECT split_name, test_part, id, round(s, 9) AS max_similarity FROM r")
def _(t):
    """Of every part that is not in train, in either split, the best similarity of its name to a training one."""
    return _nearest(t).withColumn("max_similarity", F.round("max_similarity", 9))


@query("h12_nearest_summary", NEAREST_SQL + ", i AS (SELECT *, row_number() OVER (PARTITION BY split_name, test_part ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY split_name, test_part) AS n FROM r) SELECT split_name, test_part, count(*) AS chemical_count, round(avg(s), 9) AS mean_max, round(max(s) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)), 9) AS median_max, round(max(s) FILTER (WHERE i = round_even(0.9 * (n - 1), 0)), 9) AS p90_max, round(max(s), 9) AS max, round(count(*) FILTER (WHERE s >= 0.65) / count(*), 9) AS share_ge_065, round(count(*) FILTER (WHERE s >= 0.80) / count(*), 9) AS share_ge_080 FROM i GROUP BY 1, 2")
def _(t):
    names = ("mean_max", "median_max", "p90_max", "max", "share_ge_065", "share_ge_080")
    return N.nearest_summary(_nearest(t)).withColumns({c: F.round(c, 9) for c in names})


@query("c14_standardized_distance", """WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part), z AS (SELECT p_partkey, (p_size - m1) / s1 AS u, (p_retailprice - m2) / s2 AS v FROM part, s)
SELECT a.p_partkey, round(min(sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v))), 6) AS distance FROM z a, z b WHERE a.p_partkey % 20 = 0 AND b.p_partkey <> a.p_partkey GROUP BY 1""")
def _(t):
    z = Y.standardized(t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("u"), F.col("p_retailprice").alias("v")), ["u", "v"])
    return N.nearest_points(z.where("id % 20 = 0"), z, ["u", "v"]).select(F.col("id").alias("p_partkey"), F.round("distance", 6).alias("distance"))


@query("c14_standardized_distance_all", """WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2, avg(length(p_name)) AS m3, stddev_pop(length(p_name)) AS s3 FROM part), z AS (SELECT p_partkey, (p_size - m1) / s1 AS u, (p_retailprice - m2) / s2 AS v, (length(p_name) - m3) / s3 AS w FROM part, s)
SELECT a.p_partkey, round(min(sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) + (a.w - b.w) * (a.w - b.w))), 6) AS distance FROM z a, z b WHERE a.p_partkey % 20 = 0 AND b.p_partkey <> a.p_partkey GROUP BY 1""")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("u"), F.col("p_retailprice").alias("v"), F.length("p_name").cast("double").alias("w"))
    z = Y.standardized(p, ["u", "v", "w"])
    return N.nearest_points(z.where("id % 20 = 0"), z, ["u", "v", "w"]).select(F.col("id").alias("p_partkey"), F.round("distance", 6).alias("distance"))


# ---- modelling operators that stay --------------------------------------------------------


@query("m01_head_baselines")
def _(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("head"), F.col("l_extendedprice").alias("target"), "l_quantity", "l_discount", "l_tax", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split_part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stable_record_id"))
    return M.linear_baselines(rows, ["l_quantity", "l_discount", "l_tax"])


@query("m01_learners")
def _(t):
    """A forest, boosted trees and an elastic net per return flag and line status, each with its skip reasons."""
    rows = t("lineitem").select(F.concat("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 49, "+").otherwise("")).alias("head"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record"), F.col("l_extendedprice").alias("target"), F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split_part"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    rows = rows.withColumn("features", F.array("l_quantity", "l_discount", "l_tax"))
    minima, out = {"total": 30, "train": 150, "eval": 5}, None
    learners = {"forest": R.TreeSpec(trees=8, depth=4, bins=16), "boosting": R.TreeSpec(trees=5, depth=3, bins=16, boosting=True, rate=0.3)}
    reports = {name: R.tree_baselines(rows, "features", spec, minima) for name, spec in learners.items()}
    reports["elastic_net"] = M.elastic_baselines(rows, ["l_quantity", "l_discount", "l_tax"], minima=minima)
    for name, report in reports.items():
        report = report.select(F.lit(name).alias("learner"), "head", "status", "n_train", "n_test", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")])
        out = report if out is None else out.unionByName(report)
    return out


@query("m03_leverage")
def _(t):
    d = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("d0"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)], (F.col("vec_id") % 4 != 0).alias("train"))
    return M.leverage(d, ["d0"], [f"x{i}" for i in range(64)], components=8)


@query("m02_baseline_ensemble", f"WITH p AS ({PREDICTIONS}), m AS (SELECT stable_record_id, unnest([pred_a, pred_b]) AS v, target FROM p) SELECT stable_record_id, count(v) AS members, round(avg(v), 6) AS prediction, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(avg(v) - any_value(target), 6) AS residual FROM m GROUP BY 1")
def _(t):
    p = t.sql(PREDICTIONS)
    each = F.explode(F.array("pred_a", "pred_b")).alias("prediction")
    m = V.member_ensemble(p.select("stable_record_id", each), "stable_record_id").join(p.select("stable_record_id", "target"), "stable_record_id")
    return m.select("stable_record_id", "members", F.round("prediction", 6).alias("prediction"), F.round("sd", 6).alias("sd"), F.round(F.col("prediction") - F.col("target"), 6).alias("residual"))


@query("m06_grouped_ensemble", f"WITH p AS ({PREDICTIONS}), m AS (SELECT stable_record_id, unnest(CASE WHEN stable_record_id % 4 <> 0 THEN [pred_a, pred_b, pred_a + 1] ELSE [pred_a, pred_b] END) AS v FROM p), g AS (SELECT stable_record_id, count(v) AS members, avg(v) AS a FROM m GROUP BY 1) SELECT stable_record_id, members, round(a, 6) AS loose, round(CASE WHEN members = 3 THEN a END, 6) AS strict FROM g")
def _(t):
    p = t.sql(PREDICTIONS)
    files = [S.write_table(p.select("stable_record_id", F.col(c).alias("prediction")), c) for c in ("pred_a", "pred_b")]
    files.append(S.write_table(p.where("stable_record_id % 4 <> 0").select("stable_record_id", (F.col("pred_a") + 1).alias("prediction")), "pred_c"))
    both = t.spark.read.parquet(*files)
    loose, strict = V.member_ensemble(both, "stable_record_id"), V.member_ensemble(both, "stable_record_id", require=3)
    return loose.select("stable_record_id", "members", F.round("prediction", 6).alias("loose")).join(strict.select("stable_record_id", F.round("prediction", 6).alias("strict")), "stable_record_id")


@query("m08_interval_likelihood")
def _(t):
    p = t.sql(PREDICTIONS).where("pred_a is not null")
    lo = F.when(F.col("is_censored"), F.lit(float("-inf"))).otherwise(F.col("target"))
    return M.interval_likelihood(p.select("model_head", F.col("pred_a").alias("mu"), F.lit(1.5).alias("sigma"), lo.alias("lo"), F.col("target").alias("hi")))


@query("m09_censored_hinge", f"WITH p AS ({PREDICTIONS}) SELECT model_head, count(*) AS n, round(avg(pow(greatest(0, CASE WHEN stable_record_id % 2 = 0 THEN target - pred_a ELSE pred_a - target END), 2)), 6) AS hinge FROM p WHERE is_censored AND pred_a IS NOT NULL GROUP BY 1")
def _(t):
    p = t.sql(PREDICTIONS).where("is_censored and pred_a is not null")
    h = V.censored_hinge(p, "model_head", "pred_a", "target", F.col("stable_record_id") % 2 == 0)
    return h.select("model_head", "n", F.round("hinge", 6).alias("hinge"))


@query("slice_robust_targets", """WITH d AS (SELECT p_type, o_orderpriority, -log10(CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice / 1000 WHEN 1 THEN l_extendedprice ELSE l_extendedprice * 1000 END / 1000 / p_retailprice) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
m AS (SELECT p_type, o_orderpriority, count(*) AS n, quantile_cont(x, 0.5) AS med, avg(x) AS mean FROM d GROUP BY 1, 2), q AS (SELECT p_type, o_orderpriority, quantile_cont(abs(x - med), 0.5) AS mad FROM d JOIN m USING (p_type, o_orderpriority) GROUP BY 1, 2)
SELECT p_type, o_orderpriority, n, round(med, 6) AS median_target, round(mean, 6) AS mean_target, round(mad, 6) AS mad FROM m JOIN q USING (p_type, o_orderpriority)""")
def slice_query(t):
    from benthos.functions.text_rules import with_concentration
    from benthos.operators.aggregates import robust_stats

    # what depends on a line alone is read before the joins
    unit = F.element_at(F.array(F.lit("ug/L"), F.lit("mg/L"), F.lit("g/L")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    lines = with_concentration(t("lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("raw"), unit.alias("unit")), "raw", "unit", "c")
    d = lines.select("l_orderkey", "l_partkey", "c").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    x = d.select("p_type", "o_orderpriority", (-F.log10(F.col("c.value") / 1000 / F.col("p_retailprice"))).alias("x"))
    return robust_stats(x, ["p_type", "o_orderpriority"], "x").select("p_type", "o_orderpriority", F.col("qc_n").alias("n"), F.round("qc_median", 6).alias("median_target"), F.round("qc_mean", 6).alias("mean_target"), F.round("qc_mad", 6).alias("mad"))


@query("m04_applicability_domain")
def _(t):
    """Leverage, seen flags, nearest training structure and taxonomic prefix of every twentieth customer, with a four-state label."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumns({"id": F.col("c_custkey"), "train": F.col("c_custkey") % 4 != 0, "size": F.col("c_custkey") % 17 * 1.0, "bits": Y.gram_bits(F.concat_ws("/", "c_mktsegment", F.col("c_custkey") % 97), 256)})
    return D.applicability_report(c, F.col("id") % 20 == 0, ["c_acctbal", "size"], "bits", 256, ["c_nationkey", "c_mktsegment"], ["n_regionkey", "c_nationkey", "c_mktsegment"], 0.5, 0.6)