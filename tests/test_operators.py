"""Invariants of splits, components, similarity, metrics and statistics."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from benthos.operators import aggregates as A
from benthos.operators import joins as J
from benthos.operators import models as M
from benthos.operators import nearest as N
from benthos.operators import similarity as Y
from benthos.operators import splits as P
from benthos.operators import audits as U
from benthos.operators import fitting as B
from benthos.operators import ranks as R
from benthos.operators.graph import connected_components


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == union_find(nodes, [p for p in pairs if p[0] != p[1]])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0


def test_closure_is_transitive_and_split_is_closed(spark):
    rows = [("W", str(i), f"p{i // 4}", ["x"] if i in (0, 8) else ["y"] if i == 20 else [f"i{i}"]) for i in range(40)]
    rows[8] = ("W", "8", "p2", ["x", "y"])
    df = spark.createDataFrame(rows, "route string, id string, parent string, ids array<string>")
    groups = P.closure_groups(df, "id", ["parent"], ["ids"], scope="route")
    g = {r.id: r.group_id for r in groups.collect()}
    assert g["0"] == g["8"] == g["20"] == g["23"] and g["4"] != g["0"]
    again = {r.id: r.group_id for r in P.closure_groups(df.orderBy(F.rand(3)), "id", ["parent"], ["ids"], scope="route").collect()}
    assert g == again
    counted = df.join(groups, "id").withColumn("head", F.lit("h")).groupBy("route", "group_id", "head").agg(F.count("*").cast("double").alias("n"))
    parts = P.balanced_assignment(counted, (0.64, 0.16, 0.20), 7)
    assert parts.groupBy("group_id").agg(F.countDistinct("split_part").alias("k")).where("k > 1").count() == 0
    assert parts.count() == len(set(g.values()))


def test_random_split_has_exact_sizes(spark):
    got = P.random_split(spark.range(101).withColumnRenamed("id", "k"), "k", 5, (0.7, 0.1, 0.2), ("train", "valid", "test")).groupBy("split_part").count().collect()
    assert {r.split_part: r["count"] for r in got} == {"train": 70, "valid": 10, "test": 21}


def test_range_rank_numbers_all_rows(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise((F.col("id") * 7919 % 500).cast("string")).alias("i"))
    order = [F.asc_nulls_last(F.col("i").try_cast("bigint")), F.col("i").asc(), F.col("id").asc()]
    got = {r.id: r["rank"] for r in P.range_rank(d, order).collect()}
    key = lambda k: (1, 0, "x", k) if k % 3 == 0 else (0, k * 7919 % 500, "", k)
    assert [got[k] for k in sorted(range(5000), key=key)] == list(range(5000))
    assert P.range_rank(d.where("false"), order).count() == 0


def test_natural_sort_keeps_every_order(spark):
    from benthos.plans import catalog

    sf = "/root/testdata/sf0.001"
    pos = sorted(r.pos for r in catalog.queries()["f06_natural_sort_all"](spark, sf).collect())
    assert pos == list(range(1, spark.read.parquet(f"{sf}/orders.parquet").count() + 1)) and len(pos) > 200


def test_missing_group_is_one_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"g{i}") for i in range(40)], "k int, g string")
    got = P.group_split(df, ["g"], 3, (0.5, 0.5), ("a", "b"))
    assert got.where("g is null").select("split_part").distinct().count() == 1 and got.count() == 40


def test_similar_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    base = [frozenset(rnd.sample(range(60), 20)) for _ in range(6)]
    sets = [set(b) ^ set(rnd.sample(range(60), rnd.randrange(4))) for b in base for _ in range(12)] + [set()]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, bits array<int>")
    got = {(r.a, r.b) for r in Y.similar_pairs(df, 0.65).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.65}
    assert got == want


def test_search_against_all_other_rows(spark):
    d = spark.createDataFrame([(20, [7]), (40, [7]), (60, [1]), (3, [3]), (80, [0]), (81, [0])], "id long, words array<long>")
    q = d.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {r.query_id: r.max_similarity for r in Y.best_other_tanimoto(q, d).collect()}
    assert got == {20: 1.0, 40: 1.0, 60: 0.5, 80: 0.0}  # equal rows with ids divisible by 20 are found
    assert Y.best_other_tanimoto(q.where("query_id = 20"), d.where("id = 20")).count() == 0
    p = spark.createDataFrame([(20, 0.0, 0.0), (40, 0.0, 0.0), (60, 3.0, 4.0), (1, 9.0, 4.0)], "id long, u double, v double")
    assert {r.id: r.distance for r in N.nearest_points(p.where("id % 20 = 0"), p, ["u", "v"]).collect()} == {20: 0.0, 40: 0.0, 60: 5.0}


def test_butina_against_sequential(spark):
    rnd = random.Random(9)
    pairs = sorted({tuple(sorted(rnd.sample(range(30), 2))) for _ in range(45)})
    got = {r.id: r.centroid for r in Y.butina_clusters(spark.range(30), spark.createDataFrame(pairs, "a long, b long")).collect()}
    free, want, near = set(range(30)), {}, {i: set() for i in range(30)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    while free:
        c = max(free, key=lambda i: (len(near[i] & free), i))
        for x in (near[c] & free) | {c}:
            want[x] = c
        free -= {x for x, k in want.items() if k == c}
    assert got == want


def test_alignment_faults(spark):
    p = spark.createDataFrame([(1, 1.0, "h", 1.5), (2, 2.0, "h", None), (3, 9.0, "h", 1.0), (5, 1.0, "h", 1.0)], "stable_record_id int, target double, model_head string, prediction double")
    c = spark.createDataFrame([(1, 1.0, "h", False), (2, 2.0, "h", False), (3, 3.0, "h", False), (4, 1.0, "h", False)], "stable_record_id int, target double, model_head string, is_censored boolean")
    got = {r.stable_record_id: (r.fault, r.scored) for r in J.aligned(p, c).collect()}
    assert got[1] == (None, True) and got[2] == (None, False)
    assert [got[i][0] for i in (3, 4, 5)] == ["target_differs", "cohort_without_prediction", "prediction_without_cohort"]


def test_r2_of_a_constant_target_is_null(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "target double, prediction double")
    r = df.agg(*A.regression_metrics()).first()
    assert (r.n, r.mae, r.rmse, r.r2) == (2, 1.0, 1.0, None)


def test_holm_and_bh(spark):
    p = [0.01, 0.04, 0.03, None]
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(p)], "contrast int, family string, p double")
    h = {r.contrast: r.p_holm for r in A.holm(df, ["family"]).collect()}
    assert h[0] == pytest.approx(0.04) and h[2] == pytest.approx(0.09) and h[1] == pytest.approx(0.09) and h[3] is None
    q = {r.contrast: r.q_bh for r in A.benjamini_hochberg(df, ["family"]).collect()}
    assert q[0] == pytest.approx(0.03) and q[1] == q[2] == pytest.approx(0.04) and q[3] is None


def test_strict_join_refuses_gaps(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no single source row"):
        J.strict_join(a, b, "k").collect()


def test_gaussian_tails():
    one = np.ones(1)
    far = M.gaussian_nll(0 * one, one, -np.inf * one, -40 * one)[0]
    assert far == pytest.approx(804.608442, abs=1e-4)
    mid = M.gaussian_nll(0 * one, one, 10 * one, 11 * one)[0]
    assert mid == pytest.approx(-math.log(0.5 * (math.erfc(10 / 2**0.5) - math.erfc(11 / 2**0.5))), rel=1e-9)


# ---- ranks and quantiles ------------------------------------------------------------------


def test_quantiles_by_counts_are_exact(spark):
    rnd = random.Random(3)
    rows = [(g, v) for g, k in (("a", 500), ("b", 7), (None, 40), ("same", 30)) for v in ([rnd.choice([rnd.gauss(0, 1), float(round(rnd.gauss(0, 1)))]) for _ in range(k)] if g != "same" else [2.5] * k)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    p = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    for cells in (1, 3, 1024):
        got = {r.g: [r[c] for c in p] for r in R.counted_quantiles(df, ["g"], "v", p, F.count("*").alias("n"), cells=cells).collect()}
        for g in {g for g, _ in rows}:
            v = [x for h, x in rows if h == g and x is not None]
            want = np.quantile(v, list(p.values())).tolist() if v else [None] * len(p)
            assert got[g] == (pytest.approx(want) if v else want), (cells, g)
    assert R.counted_quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert R.quantiles(df.where("false"), [], "v", {"m": 0.5}).first().m is None


def test_counted_quantiles_cut_cells_again(spark):
    rnd = random.Random(5)
    odd = [float("inf"), float("-inf"), float("nan"), 1e308, -1e308]
    rows = [("tight", 1 + rnd.random() * 1e-9) for _ in range(900)] + [("tight", 1e9)] + [("ties", 7.0)] * 900 + [("ties", float(i)) for i in range(20)] + [("odd", rnd.gauss(0, 1)) for _ in range(200)] + [("odd", x) for x in odd]
    df = spark.createDataFrame(rows, "g string, v double")
    p = {"q1": 0.25, "q2": 0.5, "q9": 0.9}
    got = {r.g: [r[c] for c in p] for r in R.counted_quantiles(df, ["g"], "v", p, cells=8, few=10).collect()}
    exact = {r.g: [r[c] for c in p] for r in df.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in p.items()]).collect()}
    assert got == {g: pytest.approx(v, rel=1e-15) for g, v in exact.items()}


def test_ranks_within_groups_and_mean_ranks(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_ROWS", 5)
    d = spark.range(300).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("g")).withColumn("k", P.hash_key(1, "id"))
    got = R.global_rank(d, "k", ["g"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.k):
        by.setdefault(r.g, []).append(r["rank"])
    assert len(got) == 300 and all(v == list(range(len(v))) for v in by.values()) and len(by) == 3
    assert R.global_rank(d.where("false"), "k").count() == 0
    m = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 9.0), (None, 1.0)], "g string, v double")
    assert sorted(((r.g, r.v, r.m) for r in R.average_rank(m, "g", "v", "m").collect()), key=str) == sorted([("a", 3.0, 2.5), ("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", None, None), ("b", 9.0, 1.0), (None, 1.0, 1.0)], key=str)


# ---- splits -------------------------------------------------------------------------------


def profile_of(heads):
    import hashlib
    import json

    return hashlib.sha256(json.dumps([{"head": h, "n": n} for h, n in heads], separators=(",", ":")).encode()).hexdigest()


def test_balanced_assignment_is_the_sequential_rule(spark):
    """One group at a time, in plain Python, gives every profile the same number of groups per part."""
    rnd, fractions, rows = random.Random(6), (0.64, 0.16, 0.20), []
    for g in range(260):
        for h in rnd.sample(["h1", "h2", "h3"] if g % 2 else ["x1", "x2"], rnd.choice([1, 1, 2])):
            rows.append(("W" if g % 5 else "M", g, h, float(rnd.choice([1, 1, 1, 2, 7]))))
    got = {r.group_id: r.split_part for r in P.balanced_assignment(spark.createDataFrame(rows, "route string, group_id long, head string, n double"), fractions, 11).collect()}
    for route in "WM":
        own = {}
        for r, g, h, n in rows:
            if r == route:
                own.setdefault(g, []).append((h, n))
        own = {g: sorted(h) for g, h in own.items()}
        totals = Counter()
        for heads in own.values():
            totals.update(dict(heads))
        have, want = {h: [0.0] * 3 for h in totals}, Counter()
        name = {g: profile_of(heads) for g, heads in own.items()}
        for g in sorted(own, key=lambda g: (-sum(n for _, n in own[g]), P._sha(11, name[g]), g)):
            def growth(p):
                d = sum(n * (2 * (have[h][p] - totals[h] * fractions[p]) + n) / max(totals[h] * fractions[p], 1.0) for h, n in own[g])
                return round(d, 9), P._sha(11, name[g], p)

            best = min(range(3), key=growth)
            for h, n in own[g]:
                have[h][best] += n
            want[name[g], P.PARTS[best]] += 1
        assert Counter((name[g], got[g]) for g in own) == want
    assert len(got) == 260


def test_greedy_holdouts_and_folds(spark):
    rnd = random.Random(2)
    groups = [(f"g{i}", float(rnd.choice([1, 1, 2, 3, 9, 40]))) for i in range(150)]
    df, total = spark.createDataFrame(groups, "group_id string, n double"), sum(n for _, n in groups)
    sizes = sorted((n for _, n in groups), reverse=True)
    test, want = 0.0, Counter()
    for n in sizes:
        if abs(test + n - 0.2 * total) <= abs(test - 0.2 * total):
            test += n
            want[n] += 1
    got = P.holdout_assignment(df, 0.2, 5).collect()
    assert Counter(r.n for r in got if r.split_part == "test") == want and len(got) == 150
    folds, loads = Counter(), [0.0] * 4
    for n in sizes:
        i = min(range(4), key=lambda i: loads[i])
        loads[i] += n
    for r in P.fold_assignment(df, 4, 5).collect():
        folds[r.split_part] += r.n
    assert sorted(folds.values()) == sorted(loads)
    fractions, have = {"train": 0.7, "valid": 0.1, "test": 0.2}, dict.fromkeys(["train", "valid", "test"], 0.0)
    for n in sizes:
        best = min(fractions, key=lambda p: (abs(have[p] + n - total * fractions[p]) / max(total * fractions[p], 1.0), have[p] / max(total * fractions[p], 1.0), p))
        have[best] += n
    made = Counter()
    for r in P.fraction_assignment(df, fractions, 5).collect():
        made[r.split_part] += r.n
    assert dict(made) == have
    assert P.holdout_assignment(spark.createDataFrame([("only", 5.0)], "group_id string, n double"), 0.2, 1).first().split_part == "test"
    with pytest.raises(ValueError, match="sum to 1"):
        P.fraction_assignment(df, {"a": 0.5, "b": 0.2}, 1)


def test_equal_steps_are_the_greedy_choice():
    rnd = random.Random(1)
    for _ in range(200):
        first, step, k = [rnd.uniform(-5, 5) for _ in range(3)], [rnd.uniform(0.1, 2) for _ in range(3)], rnd.randrange(60)
        now, want = list(first), [0, 0, 0]
        for _ in range(k):
            p = min(range(3), key=lambda p: now[p])
            want[p] += 1
            now[p] += step[p]
        assert P.deal_equal_steps(first, step, k, [0, 1, 2]) == want
    assert sum(P.deal_equal_steps([0.0, 0.0, 0.0], [1.0, 1.0, 1.0], 10**9, [0, 1, 2])) == 10**9


def test_boundary_keys_and_suite(spark):
    rows = [("W00", str(i), f"p{i // 4}", "sp", "h", "50", str(i % 4), [f"i{i}"], [f"t{i // 8}"]) for i in range(40)]
    for i, s in ((0, ["a", "b"]), (8, ["b", "c"]), (20, ["c"])):
        rows[i] = (*rows[i][:7], s, rows[i][8])
    df = spark.createDataFrame(rows, "route string, stable_record_id string, canonical_parent string, latin_name string, model_head string, effect string, time string, source_ids array<string>, test_ids array<string>")
    keys = {"S3": ["canonical_parent"], "S1": ["canonical_parent", "latin_name", "model_head", "effect", "time"]}
    k = P.boundary_keys(df, keys, single=("time",))
    assert k.select("S3").distinct().count() == 10 and k.select("S1").distinct().count() == 40
    several = df.withColumn("time", F.when(F.col("stable_record_id") == "0", '["0","1"]').otherwise(F.col("time")))
    with pytest.raises(Exception, match="several values"):
        P.boundary_keys(several, keys, single=("time",)).collect()
    assert P.boundary_keys(several, {"S3": keys["S3"]}, single=("time",)).count() == 40
    with pytest.raises(ValueError, match="label"):
        P.boundary_keys(df, {"bad": ["target"]})
    placed, audit = P.boundary_suite(k, "stable_record_id", "model_head", "route", {"S3": (["S3"], ["source_ids"]), "source": (["S3"], ["source_ids", "test_ids"])}, (0.64, 0.16, 0.20), 7, {"train": 1})
    part = {(r.boundary, r.stable_record_id): (r.group_id, r.split_part) for r in placed.collect()}
    assert part["S3", "0"] == part["S3", "8"] == part["S3", "20"] == part["S3", "23"] and len(part) == 80
    assert part["source", "0"][0] == part["source", "4"][0] and {r.n_crossing for r in audit.collect()} == {0}
    crossing = U.leakage_audit(df.withColumn("split_part", F.col("time")), ["canonical_parent"], ["test_ids"])
    assert {r.kind: r.n_crossing for r in crossing.collect()} == {"canonical_parent": 10, "test_ids": 5}


def test_suite_refuses_too_few_rows(spark):
    d = spark.range(20).select("id", F.col("id").alias("g"))
    with pytest.raises(ValueError, match="below the minimum"):
        P.split_suite(d, "id", "g", 1, min_rows=21)
    with pytest.raises(ValueError, match="unknown split"):
        P.named_split(d, "nope", "id", 1, {"a": 1.0})
    got = P.split_suite(d, "id", "g", 1, "D")
    assert got.where("split_part = 'test'").groupBy("id").count().where("count <> 1").count() == 0 and got.count() == 100


def test_scaffold_cluster_job(spark):
    rnd = random.Random(3)
    base = [set(rnd.sample(range(100), 30)) for _ in range(6)]
    rows = [(f"c{i}", sorted(base[i % 6] ^ set(rnd.sample(range(100), i % 3))), "ring" if i in (0, 7) else None) for i in range(30)] + [("none", [], None)]
    chemicals = spark.createDataFrame(rows, "id string, bits array<int>, scaffold string")
    uses = spark.createDataFrame([(f"c{i % 30}", i) for i in range(90)] + [("none", 90)], "id string, row_id int")
    job = Y.scaffold_cluster_job(chemicals, uses, 0.65, 0.2, 3, 5)
    group = {r.id: r.group_key for r in job["assignments"].collect()}
    assert group["c0"] == group["c7"] == group["c1"] == group["c6"] and len(set(group.values())) == 6
    sizes = [r.n_rows for r in job["groups"].orderBy("group_key").collect()]
    assert sizes == sorted(sizes, reverse=True) and job["overlap"].first().n_crossing == 0
    assert job["assignments"].count() == 91
    part, bits = {r.id: r.split_part for r in job["assignments"].collect()}, {i: set(b) for i, b, _ in rows}
    best = lambda i: max(len(bits[i] & bits[j]) / len(bits[i] | bits[j]) for j, p in part.items() if p == "train" and bits[j])
    # every test chemical with a fingerprint has a row, copies and low similarities too
    assert {r.id: r.best for r in job["similarity"].collect()} == {i: pytest.approx(best(i)) for i, p in part.items() if p == "test" and bits[i]}


# ---- fitting ------------------------------------------------------------------------------


def test_weights_keep_their_mean(spark):
    rows = spark.createDataFrame([(i, "t" if i % 3 else "u", float(min(i % 37, 5)), 10.0 if i % 10 else 50.0) for i in range(300)], "id int, head string, v double, level double")
    w = B.bin_sampling_weights(rows, "id", "head", "v", 6, 0.25, 3.0).collect()
    for h in "tu":
        own = [r.weight for r in w if r.head == h]
        assert sum(own) == pytest.approx(len(own), abs=1e-6) and 0.25 <= min(own) and max(own) <= 3.0
    levels = B.level_weights(rows, "level", 0.9, 0.5, 1.5).collect()
    assert sum(r.n * r.weight for r in levels) == pytest.approx(300) and max(r.weight for r in levels) <= 1.5
    assert B.clipped_to_mean([1.0, 9.0], [1, 1], 2.0, 3.0) == [2.0, 3.0]  # a mean of 1 is out of reach: clipped only


def test_scaler_inverse_and_modes(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("new", 7.0)], "task string, x double")
    for mode in B.MODES:
        key = B.scale_key(mode, F.col("task"), F.col("task"), F.col("task"))
        stats = B.fit_target_scaler(d.where("task <> 'new'"), "x", key)
        z = B.apply_target_scaler(d, stats, "x", key, mode, "z")
        back = B.apply_target_scaler(z, stats, "z", key, mode, "back", inverse=True)
        assert all(r.back == pytest.approx(r.x) for r in back.collect())
    with pytest.raises(ValueError, match="unknown mode"):
        B.scale_key("per_moon", F.col("a"), F.col("a"), F.col("a"))


def test_encoder_drops_constants_and_hashes_many_levels(spark):
    d = spark.createDataFrame([(i, float(i % 5), 1.0, f"n{i % 40}") for i in range(400)], "id int, a double, same double, c string")
    x, names = B.tabular_encoding(d, F.lit(True), ["a", "same"], "c", "id", bins=8)
    assert names[0] == "a" and "same" not in names and all(n.startswith("c#") for n in names[1:])
    assert all(sum(r.features[1:]) <= 1 for r in x.collect())
    masked, _ = B.tabular_encoding(d, F.lit(True), ["a", "same"], "c", "id", frozenset(["c"]))
    assert all(len(r.features) == 1 for r in masked.collect())
    assert B.ablation_masks({"numeric": ["a"], "fingerprint": ["v"]}, "no_fingerprint", ("b",)) == {"v", "b"}


def test_encoder_hashes_a_level_once(spark):
    d = spark.createDataFrame([(i, f"n{i % 40}") for i in range(400)], "id int, c string")
    x, names = B.tabular_encoding(d, F.lit(True), [], "c", "id", bins=8)
    shown = x.select("id", F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.element_at("features", i)).alias("f"))
    assert "md5" not in shown._jdf.queryExecution().optimizedPlan().toString()  # entries are read, not computed for each reader
    assert all(sum(r.f) <= 1 for r in shown.collect())


def test_leverage_with_components_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7)) @ rng.normal(size=(7, 7))
    train = np.arange(60) % 4 != 0
    df = spark.createDataFrame([(i, bool(train[i]), *map(float, x[i])) for i in range(60)], "id int, train boolean, " + ", ".join(f"x{i} double" for i in range(7)))
    got = {r.id: r.h for r in M.leverage(df, ["x0", "x1"], [f"x{i}" for i in range(2, 7)], components=3).collect()}
    z = (x - x[train].mean(0)) / x[train].std(0)
    _, _, v = np.linalg.svd(z[train][:, 2:], full_matrices=False)
    d = np.column_stack([z[:, :2], z[:, 2:] @ v[:3].T])
    core = np.linalg.pinv(d[train].T @ d[train])
    want = np.einsum("ij,jk,ik->i", d, core, d)
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i in range(60))


def test_leverage_of_wide_fingerprints(spark):
    rng = np.random.default_rng(11)
    bits = (rng.uniform(size=(120, 2048)) < 0.2).astype(float)
    bits[:, 5] = 0  # constant
    train = np.arange(120) % 4 > 0
    df = spark.createDataFrame([(i, float(i % 7), bool(train[i]), bits[i].tolist()) for i in range(120)], "id int, d double, train boolean, bits array<double>")
    got = {r.id: r.h for r in M.leverage(df, ["d"], "bits", components=5, width=2048).collect()}
    x = np.column_stack([np.arange(120) % 7, bits])
    sd = x[train].std(0)
    z = (x - x[train].mean(0)) / np.where(sd > 1e-6, sd, 1.0)
    _, _, v = np.linalg.svd(z[train][:, 1:], full_matrices=False)
    d = np.column_stack([z[:, :1], z[:, 1:] @ v[:5].T])
    want = np.einsum("ij,jk,ik->i", d, np.linalg.pinv(d[train].T @ d[train]), d)
    assert all(got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-8) for i in range(120))


def test_elastic_net_per_head(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.1]
    y = 2 + x @ [1.5, 0.0, -3.0] + rng.normal(size=300) * 0.1
    rows = [(["a", "b"][i % 2], "test" if i % 3 == 0 else "train", *map(float, x[i]), float(y[i])) for i in range(300)] + [("few", "train", 1.0, 1.0, 1.0, 1.0), ("a", "train", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "head string, split_part string, u double, v double, w double, target double")
    got = {r["head"]: r for r in M.elastic_baselines(df, ["u", "v", "w"], alpha=0.01, minima={"train": 5}).collect()}
    assert got["few"].status == "train_samples_lt_5" and got["few"].n_train == 1 and got["few"].mae is None
    assert got["a"].r2 > 0.98 and got["b"].rmse < 0.3 and got["a"].n_test + got["b"].n_test == 100
    own = np.array([r[2:] for r in rows if r[0] == "a" and r[1] == "train" and r[2] is not None])
    m = np.column_stack([np.ones(len(own)), own])
    w = M.elastic_net(m.T @ m, 0.01, 0.5)
    scale = own[:, :3].std(axis=0)

    def loss(w):  # the stated objective, which no small step lowers
        e = own[:, 3] - w[0] - own[:, :3] @ w[1:]
        z = w[1:] * scale
        return (e @ e) / (2 * len(own)) + 0.01 * (0.5 * np.abs(z).sum() + 0.25 * (z @ z))

    assert all(loss(w) <= loss(w + d) + 1e-12 for d in rng.normal(size=(300, 4)) * 1e-3)


def test_support_of_the_nearest_value(spark):
    ref = spark.createDataFrame([("t", float(v)) for v in range(0, 101)] + [("u", 5.0)], "task string, v double")
    req = spark.createDataFrame([(1, "t", 7.4), (2, "t", 190.0), (3, "u", 5.0), (4, "none", 1.0), (5, "t", None)], "id int, task string, v double")
    got = {r.id: r.support for r in B.nearest_support(req, ref, "id", ["task"], "v").collect()}
    logs = {r.id: r.support for r in B.nearest_support(req, ref, "id", ["task"], "v", True).collect()}
    assert logs[2] == pytest.approx(1 - (math.log(191) - math.log(101)) / (math.log(96) - math.log(6)))
    assert got[1] == pytest.approx(1 - 0.4 / 90) and got[2] == pytest.approx(0.0) and got[3] is None and got[4] is None and got[5] is None


# ---- sources ------------------------------------------------------------------------------


def test_dictionaries_of_any_encoding(spark, tmp_path):
    from benthos.sources import tables as S

    for name, raw in (("bom", "\ufeffCAS,名\n12-3,x\n".encode()), ("utf", "CAS,名\n12-3,é\n".encode()), ("gbk", "CAS,名称\n12-3,水\n".encode("gbk"))):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(raw)
        assert S.probe_encoding(spark, f"file://{path}") == ("gbk" if name == "gbk" else "utf-8")
        assert S.read_dictionary(spark, f"file://{path}", ["CAS"]).columns[0] == "CAS"
    got = S.read_dictionary(spark, f"file://{tmp_path}/gbk.csv", ["CAS"]).first()
    assert got.cas_key == "123" and got[1] == "水"


def test_the_last_json_line_wins(spark, tmp_path):
    from benthos.sources import tables as S

    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "old"}\n{"k": 1, "v": \n{"k": 2, "v": "b"}\n{"k": 1, "v": "new"}\n')
    got = {r.k: r.v for r in S.read_json_cache(spark, f"file://{tmp_path}", "k long, v string", "k").collect()}
    assert got == {1: "new", 2: "b"}
    states = S.cache_coverage(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<double>"), "x", 2)
    with pytest.raises(Exception, match="feature cache: 2 missing"):
        S.require_coverage(states).collect()


def test_components_settle_on_long_chains(spark):
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(chain).select("component").distinct().collect()[0][0] == 0


def test_intermediate_tables_are_dropped_by_call(spark):
    import os

    from benthos.session import drop_scratch, materialize

    drop_scratch(spark)
    kept = [materialize(spark.range(5), "drop-me") for _ in range(2)]
    paths = [d.inputFiles()[0].removeprefix("file://") for d in kept]
    assert all(map(os.path.exists, paths)) and drop_scratch(spark) == 2 and not any(map(os.path.exists, paths)) and drop_scratch(spark) == 0
