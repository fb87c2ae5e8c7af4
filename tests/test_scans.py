"""Running values over ranges, with one group spread over many."""

import random

import pytest
from pyspark.sql import functions as F

from benthos.operators import aggregates, fitting, ranks


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 40)


def test_range_scan(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.8 else rnd.choice(["a", None]), i, rnd.choice([None, rnd.randint(-50, 50)])) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    order = [F.col("i")]
    dealt = ranks.deal_ranges(df, ["g"], order)
    assert dealt.where("g = 'hot'").select("__range").distinct().count() > 8
    scans = {"up": ("max", F.col("v"), "before"), "down": ("min", F.col("v"), "after"), "n": ("sum", F.lit(1), "before"), "all_n": ("sum", F.lit(1), "all"), "most": ("max", F.col("v"), "all")}
    got = {(r.g, r.i): (r.up, r.down, r.n, r.all_n, r.most) for r in ranks.range_scan(dealt, ["g"], order, **scans).collect()}
    assert len(got) == len(rows)
    for g in ("hot", "a", None):
        own = sorted((i, v) for h, i, v in rows if h == g)
        known = lambda x: [v for _, v in x if v is not None]
        for k, (i, _) in enumerate(own):
            want = (max(known(own[: k + 1]), default=None), min(known(own[k:]), default=None), k + 1, len(own), max(known(own), default=None))
            assert got[g, i] == want


def test_adjusted_p_values_of_one_large_family(spark):
    rnd = random.Random(2)
    rows = [("big" if i % 9 else "small", f"c{i:04}", rnd.choice([None, round(rnd.random() ** 3, 4)])) for i in range(900)]
    df = spark.createDataFrame(rows, "route string, contrast string, p double")
    got = {r.contrast: r.p_holm for r in aggregates.holm(df, ["route"]).collect()}
    q = {r.contrast: r.q_bh for r in aggregates.benjamini_hochberg(df, ["route"]).collect()}
    for route in ("big", "small"):
        own, top = sorted(((1.0 if p is None else p), c, p) for r, c, p in rows if r == route), 0.0
        for k, (x, c, p) in enumerate(own):
            top = max(top, min(1.0, (len(own) - k) * x))
            assert got[c] == (None if p is None else pytest.approx(top))
        known, least = [(x, c) for x, c, p in own if p is not None], 1.0
        for k in range(len(known), 0, -1):
            least = min(least, known[k - 1][0] * len(known) / k)
            assert q[known[k - 1][1]] == pytest.approx(least)
        assert all(q[c] is None for _, c, p in own if p is None)


def test_nearest_support_of_one_large_task(spark):
    rnd = random.Random(3)
    reference = [("t" if i % 10 else "u", rnd.uniform(0, 100)) for i in range(600)]
    requests = [(i, rnd.choice(["t", "u", "none"]), rnd.choice([None, rnd.uniform(-20, 120)])) for i in range(200)]
    got = {r.id: r.support for r in fitting.nearest_support(spark.createDataFrame(requests, "id int, task string, v double"), spark.createDataFrame(reference, "task string, v double"), "id", ["task"], "v").collect()}
    import numpy as np

    for i, task, v in requests:
        own = [x for t, x in reference if t == task]
        if v is None or not own:
            assert got[i] is None
        else:
            lo, hi = np.percentile(own, [5, 95])
            assert got[i] == pytest.approx(min(1.0, max(0.0, 1 - min(abs(v - x) for x in own) / (hi - lo))))


def test_nearest_support_of_a_task_whose_quantiles_go_by_counts(spark, monkeypatch):
    rnd = random.Random(4)
    reference = [("t" if i % 10 else "u", float(rnd.randint(0, 300))) for i in range(600)]
    requests = [(i, rnd.choice(["t", "u"]), rnd.uniform(-20, 320)) for i in range(100)]
    frames = spark.createDataFrame(requests, "id int, task string, v double"), spark.createDataFrame(reference, "task string, v double")
    want = {r.id: r.support for r in fitting.nearest_support(*frames, "id", ["task"], "v").collect()}
    monkeypatch.setattr(ranks, "GROUP_ROWS", 100)
    got = {r.id: r.support for r in fitting.nearest_support(*frames, "id", ["task"], "v").collect()}
    assert got == {i: pytest.approx(x) for i, x in want.items()} and len(got) == 100


@pytest.mark.parametrize("keys", [["g"], []])
def test_counted_quantiles_may_have_any_name(spark, keys):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)], "g string, v double")
    got = ranks.counted_quantiles(df, keys, "v", {"__a": 0.05, "__b": 0.95, "__n": 0.5, "__lo": 0.1, "__hi": 0.9}, few=10).first()
    assert [got["__a"], got["__b"], got["__n"], got["__lo"], got["__hi"]] == pytest.approx([5, 95, 50, 10, 90])


def test_scan_from_the_end_takes_no_frame_that_ends_with_the_partition(spark):
    rows = [("a" if i % 3 else None, (i * 37) % 101, i) for i in range(300)]
    dealt = ranks.deal_ranges(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], [F.col("v"), F.col("i")], parts=5)
    got = ranks.range_scan(dealt, ["g"], [F.col("v"), F.col("i")], low=("min", F.col("i"), "after"), n=("sum", F.lit(1), "before"))
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan  # quadratic in the rows of a range
    for r in got.collect():
        own = sorted((v, i) for g, v, i in rows if g == r.g)
        assert r.low == min(i for v, i in own if (v, i) >= (r.v, r.i)) and r.n == sum(x <= (r.v, r.i) for x in own)
