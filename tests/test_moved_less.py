"""What steps move and hold: inputs evaluated once, short keys, one file's rows a task."""

import random

from pyspark.sql import functions as F

from benthos.functions import evidence_rules as E
from benthos.functions.distinct import by_distinct
from benthos.operators import aggregates as A
from benthos.operators import similarity as Y
from benthos.operators import splits as P
from benthos.sources.versioned import spread_by_bytes


def test_a_task_holds_the_rows_of_one_file(spark):
    df = spark.createDataFrame([(k, "x" * 80) for k in "abc" for _ in range(4000)], "k string, t string")
    dealt = spread_by_bytes(df, ["k"], file_bytes=40_000)
    held = [(r.n, r.k) for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("k").alias("k")).collect()]
    files = dealt.rdd.getNumPartitions()
    assert len(held) == files >= 24 and all(k == 1 for _, k in held)
    assert sum(n for n, _ in held) == 12_000 and max(n for n, _ in held) < 2 * 12_000 / files
    assert sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    assert spread_by_bytes(df.where("false"), ["k"]).count() == 0


def test_screened_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rnd = random.Random(3)
    data = [("ab"[i % 2] if i % 9 else None, float(rnd.gauss(0, 1)), rnd.choice([None, 1990, 2001]), i) for i in range(400)]
    schema = "k string, x double, y int, id int"
    source = spark.createDataFrame(data, schema)
    plain = A.robust_screen(source, ["k"], "x", 50, 1.5, A.robust_stats(source, ["k"], "x"))
    want = A.recency_weights(plain, ["k"], "y").collect()
    got = A.recency_weights(A.robust_screen(source.mapInPandas(count, schema), ["k"], "x", 50, 1.5), ["k"], "y").collect()
    assert made.value == 400
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.qc_status for r in got} == {"excluded", "included"}


def test_shared_keys_are_short(spark):
    rows = spark.createDataFrame([(1, "a", ["t"]), (2, "a", ["u"]), (3, "b", ["t", "t"]), (4, None, [])], "r int, k string, l array<string>")
    x = P.shared_keys(rows, "r", ["k"], ["l"])
    assert x.select(F.octet_length("x")).distinct().collect()[0][0] == 16 and x.select("x").distinct().count() == 4 and x.count() == 7


def test_counts_that_are_not_asked_for_are_not_made(spark):
    rnd = random.Random(4)
    data = [(rnd.choice("ab"), rnd.gauss(0, 1), rnd.choice([None, 1, 2, 3]), rnd.randrange(9), rnd.uniform(0.3, 1)) for _ in range(200)]
    m = A.reference_merge(spark.createDataFrame(data, "k string, x double, ref int, test int, reference_weight double"), ["k"], "x", "ref", "test")
    assert {(r.k, r.n_references, r.n_tests, r.n_rows) for r in m.collect()} == {(k, 3, len({d[3] for d in data if d[0] == k}), sum(d[0] == k for d in data)) for k in "ab"}
    # two distinct counts would send every row twice
    assert "Expand" not in m.select("k", "n_references", "conflict_flag")._jdf.queryExecution().optimizedPlan().toString()


def test_grams_are_dealt_by_texts_not_bytes(spark, monkeypatch):
    monkeypatch.setattr(Y, "GRAM_TEXTS", 10)
    names = ["", None, "a", "lead", "Lead", "x y"] + [f"name {i % 60}" for i in range(200)]
    d = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    want = d.select("id", "name", Y.gram_bits(F.col("name"), 64).alias("bits"))
    seen = []
    monkeypatch.setattr(Y, "by_distinct", lambda df, columns, rule: by_distinct(df, columns, lambda texts: seen.append(rule(texts)) or seen[-1]))
    got = Y.with_gram_bits(d, "name", "bits", 64)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert seen[0].count() == 66 and seen[0].rdd.getNumPartitions() == 7


def test_targets_by_distinct_texts_are_the_plain_ones(spark):
    rnd = random.Random(6)
    number = lambda: rnd.choice([None, float("nan"), 0.0, -1.5, 2.5, 1e-30, 7e9, float("inf")])
    op = lambda: rnd.choice([None, "", "<", " >= ", "~", "x"])
    data = [(i, number(), number(), number(), op(), op(), op(), rnd.choice([None, "", "water_mg_l", "soil_mg_kg", "odd"]), rnd.choice([None, "mg/L", "g/ha", "?"]), number(), rnd.choice([None, " ", "soil"])) for i in range(3000)]
    d = spark.createDataFrame(data, "id int, a double, b double, c double, p string, q string, r string, f string, u string, w double, m string")
    col = [F.col(x) for x in "abcpqrfuwm"]
    want = d.select("id", E.log_target(E.toxicity_value(*col[:6]), *col[6:]).alias("target"))
    got = E.with_log_target(d, col[:3], col[3:6], *col[6:])
    assert got.columns == [*d.columns, "target"]
    assert sorted(map(str, got.select("id", "target").collect())) == sorted(map(str, want.collect()))
