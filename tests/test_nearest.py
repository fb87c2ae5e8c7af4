"""Nearest fingerprints and the nearest-train audit against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from benthos.operators import nearest as N
from benthos.operators import similarity as Y


def tanimoto(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_nearest_train_has_a_row_for_each_chemical(spark):
    rnd = random.Random(4)
    base = [set(rnd.sample(range(200), 40)) for _ in range(8)]
    bits = {i: base[i % 8] ^ set(rnd.sample(range(200), rnd.choice([0, 1, 6, 25]))) for i in range(150)}
    bits |= {200: bits[3], 201: bits[3], 202: set(), 203: {250}, 204: set(range(200)), 205: {7}}
    parts = [("a", i, rnd.choice(["train", "train", "test", "valid"])) for i in bits] + [("b", i, "test") for i in list(bits)[:20]] + [("a", 0, "test"), ("a", 0, "test")]
    chemicals = spark.createDataFrame([(i, sorted(b), 1) for i, b in bits.items()], "id int, bits array<int>, best int")
    assigned = spark.createDataFrame(parts, "split_name string, id int, split_part string")
    report = []
    got = {(r.split_name, r.test_part, r.id): r.max_similarity for r in N.nearest_train(chemicals, assigned, report).collect()}
    train = {s: [bits[i] for t, i, p in parts if t == s and p == "train" and bits[i]] for s in "ab"}
    want = {(s, p, i): pytest.approx(max((tanimoto(bits[i], x) for x in train[s]), default=0.0)) for s, i, p in parts if p != "train" and bits[i]}
    assert got == want and got["a", "test", 0] is not None and set(v for (s, _, _), v in got.items() if s == "b") == {0.0}
    assert len({t for t, _, _ in report}) > 2 and report[0][1] > report[-1][1]
    summary = {(r.split_name, r.test_part): r for r in N.nearest_summary(N.nearest_train(chemicals, assigned)).collect()}
    own = sorted(v for (s, p, _), v in got.items() if (s, p) == ("a", "test"))
    r = summary["a", "test"]
    assert (r.chemical_count, r.median_max, r.p90_max, r.max) == (len(own), own[round((len(own) - 1) * 0.5)], own[round((len(own) - 1) * 0.9)], own[-1])
    assert r.share_ge_065 == pytest.approx(sum(v >= 0.65 for v in own) / len(own))


def test_search_looks_at_few_pairs_of_clustered_prints(spark):
    rnd = random.Random(6)
    base = [rnd.sample(range(512), 60) for _ in range(60)]
    bits = {i: sorted(set(base[i % 60]) ^ set(rnd.sample(range(512), 4))) for i in range(1800)}
    df = spark.createDataFrame(list(bits.items()), "id int, bits array<int>")
    packed = df.select("id", Y.pack(F.col("bits"), 512).alias("words"))
    report = []
    got = {r.query_id: (r.max_similarity, r.top_mean) for r in Y.best_other_tanimoto(packed.where("id % 20 = 0").withColumnRenamed("id", "query_id"), packed, 5, report).collect()}
    sets = {i: set(b) for i, b in bits.items()}
    for q in list(got)[:30]:
        best = sorted((tanimoto(sets[q], x) for i, x in sets.items() if i != q), reverse=True)
        assert got[q] == (pytest.approx(best[0]), pytest.approx(sum(best[:5]) / 5))
    assert sum(pairs for _, _, pairs in report) < 0.1 * len(got) * len(bits)


def test_empty_and_equal_fingerprints(spark):
    rows = [(0, []), (20, [1, 2]), (1, [1, 2]), (40, []), (60, [5])]
    d = spark.createDataFrame(rows, "id int, bits array<int>").select("id", Y.pack(F.col("bits"), 64).alias("words"))
    got = {r.query_id: tuple(r)[1:] for r in Y.best_other_tanimoto(d.where("id % 20 = 0").withColumnRenamed("id", "query_id"), d).collect()}
    assert got == {0: (0.0, 0.0, 0.0), 40: (0.0, 0.0, 0.0), 20: (1.0, 0.0, 0.0), 60: (0.0, 0.0, 0.0)}
    assert Y.best_other_tanimoto(d.where("false").withColumnRenamed("id", "query_id"), d).count() == 0


def test_nearest_points_by_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_POINTS", 20)
    rnd = random.Random(8)
    points = [(i, rnd.gauss(0, 1), rnd.choice([0.0, 1.0, 5.0]), rnd.random() ** 4) for i in range(900)]
    points += [(900, 0.5, 1.0, 0.5), (920, 0.5, 1.0, 0.5), (940, 99.0, 99.0, 99.0), (960, None, 1.0, 1.0), (980, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(points, "id int, a double, b double, c double")
    report = []
    got = {r.id: r.distance for r in N.nearest_points(df.where("id % 20 = 0"), df, ["a", "b", "c"], report).collect()}
    whole = [p for p in points if p[1] is not None and p[1] == p[1]]
    want = {p[0]: min(sum((x - y) ** 2 for x, y in zip(p[1:], q[1:])) ** 0.5 for q in whole if q[0] != p[0]) for p in whole if p[0] % 20 == 0}
    assert got == {i: pytest.approx(d) for i, d in want.items()} and got[900] == 0.0 and 960 not in got
    assert sum(report) < 0.25 * len(want) * len(whole)
    lone = df.where("id = 20")
    assert N.nearest_points(lone, lone, ["a", "b"]).count() == 0 and N.nearest_points(lone, df.where("false"), ["a"]).count() == 0
    same = spark.createDataFrame([(i, 1.0) for i in range(300)], "id int, a double")
    assert {r.distance for r in N.nearest_points(same, same, ["a"]).collect()} == {0.0}


def dense_prints(n, width):
    rnd = random.Random(11)
    return {i: sorted(x for x in range(width) if rnd.random() < 0.5) for i in range(n)}


def test_dense_prints_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SETS", 100)
    monkeypatch.setattr(N, "FREE_MEETINGS", 0)
    bits = dense_prints(600, 70) | {600: [], 620: [1], 640: [1]}
    packed = spark.createDataFrame(list(bits.items()), "id int, bits array<int>").select("id", Y.pack(F.col("bits"), 70).alias("words"))
    report = []
    got = {r.query_id: (r.max_similarity, r.top_mean) for r in Y.best_other_tanimoto(packed.where("id % 20 = 0").withColumnRenamed("id", "query_id"), packed, 5, report).collect()}
    assert report[0][0] is None and len(report) == 1  # no round that meets on bits
    sets = {i: set(b) for i, b in bits.items()}
    for q in range(0, 600, 20):
        best = sorted((tanimoto(sets[q], x) for i, x in sets.items() if i != q), reverse=True)
        assert got[q] == (pytest.approx(best[0]), pytest.approx(sum(best[:5]) / 5))
    assert got[600] == (0.0, 0.0) and got[620][0] == got[640][0] == 1.0


def test_links_of_dense_prints_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SETS", 100)
    monkeypatch.setattr(N, "FREE_MEETINGS", 0)
    bits = dense_prints(300, 20) | {301: [], 302: [3], 303: [3]}
    df = spark.createDataFrame(list(bits.items()), "id long, bits array<int>")
    got = {(r.a, r.b): r.similarity for r in Y.similar_links(df, 0.65).collect()}
    first = {}
    for i, b in sorted(bits.items()):
        if b:
            first.setdefault(tuple(b), i)
    reps = [(i, set(b)) for b, i in first.items()]
    want = {(i, j): tanimoto(x, y) for i, x in reps for j, y in reps if i < j and tanimoto(x, y) >= 0.65 - 1e-12}
    assert got == want | {(first[tuple(b)], i): 1.0 for i, b in bits.items() if b and first[tuple(b)] != i}
