"""Literal fixtures of the scalar rules."""

import math

import pytest
from pyspark.sql import functions as F

from benthos.functions import evidence_rules as E
from benthos.functions import features, text_rules as T


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_lenient_number(spark):
    df = column(spark, ["1,234.5e2*", "NR", "<5", "  7 ", "-2.5e-3", "", None, "1d", ".5"])
    assert run(df, T.lenient_number(F.col("v"))) == [123450.0, None, 5.0, 7.0, -0.0025, None, None, 1.0, 0.5]


def test_strict_number(spark):
    df = column(spark, ["12.5", "3/", "4*/ ", "NR", "n/a", "1d", "infinity", "1_000", "<5", None])
    assert run(df, T.strict_number(F.col("v"))) == [12.5, 3.0, 4.0, None, None, None, None, None, None, None]


def test_unit_texts(spark):
    df = column(spark, ["µg/L", "μg/L", " MG  per  Litre", "NR", None, "AI mg/L"])
    assert run(df, T.unit_text(F.col("v"))) == ["ug/l", "ug/l", "mg / liter", "nr", "", "ai mg/l"]
    assert run(df, T.raw_unit_text(F.col("v"))) == ["µg/l", "ug/l", "mg per litre", "", "", "ai mg/l"]


def test_durations(spark):
    df = spark.createDataFrame([(0, "2", "wk"), (1, "30", "min"), (2, "1", "yr"), (3, "1", None), (4, "x", "h"), (5, "1", "eon")], "i int, v string, u string")
    hours, status = T.duration_hours(F.col("v"), F.col("u"))
    assert run(df, hours) == [336.0, 0.5, 8760.0, None, None, None]
    assert run(df, status) == ["standardized"] * 3 + ["missing_unit", "missing", "unrecognized_unit"]


def test_duration_bins(spark):
    df = column(spark, [24.25, 24.75, 1.25, 0.333, None, 100.1], "double")
    b, _ = T.duration_bin(F.col("v"))
    assert run(df, b) == [24.0, 25.0, 1.2, 0.33, None, 100.0]


@pytest.mark.parametrize(("code", "family", "level", "reason"), [("EC50", "ECx", 50.0, None), ("LC10/", "ECx", 10.0, None), ("~NOEL", "NOEC", None, None), ("NR-ZERO", None, None, "excluded_endpoint:NR"), ("LT50", None, None, "excluded_endpoint:LT50"), ("IC25.5", "ICx", 25.5, None), ("FOO", None, None, "unsupported_endpoint:FOO"), (None, None, None, "missing_endpoint")])
def test_endpoints(spark, code, family, level, reason):
    df = column(spark, [code]).withColumn("c", T.code(F.col("v")))
    f, _, x, why = E.endpoint_class(F.col("c"))
    assert df.select(f, x, why).first() == (family, level, reason)


def test_media(spark):
    rows = [("Water", "CUL", None), ("Water", "NAT", None), (None, "XYZ", None), (None, "FW/", "PR"), ("non_soil", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, m string, e string")
    got = run(df, E.exposure_medium(F.col("h"), F.col("m"), F.col("e")))
    assert [(g.medium_domain, g.medium_conflict_flag) for g in got] == [("aquatic", False), ("soil", True), ("unknown", False), ("aquatic", True), ("terrestrial_nonsoil", False)]


def test_interval_contract(spark):
    rows = [(False, 3.0, None, None), (True, None, None, 3.0), (True, None, 3.0, None), (True, None, 2.0, 3.0), (True, 3.0, None, 3.0), (True, None, None, None), (True, None, 3.0, 2.0), (True, None, 3.0, 3.0), (False, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c boolean, t double, lo double, hi double")
    faults = run(df, E.interval_fault(F.col("c"), F.col("t"), F.col("lo"), F.col("hi")))
    assert [x is None for x in faults] == [True] * 4 + [False] * 5


def test_inequalities_turn_around(spark):
    df = spark.createDataFrame([(0, 0.01, "<"), (1, 0.01, ">="), (2, 0.01, None)], "i int, v double, q string")
    lo, hi = E.concentration_interval(F.col("v"), F.col("q"))
    assert [tuple(r) for r in df.orderBy("i").select(lo, hi).collect()] == [(2.0, math.inf), (-math.inf, 2.0), (2.0, 2.0)]
    with pytest.raises(Exception, match="known qualifier"):
        spark.createDataFrame([(1.0, "~")], "v double, q string").select(*E.concentration_interval(F.col("v"), F.col("q"))).collect()


def test_years_and_weights(spark):
    df = column(spark, ["1999", "c. 2005b", "18", None, "120199", "3000"])
    assert run(df, T.publication_year(F.col("v"))) == [1999, 2005, None, None, 2019, None]


def test_ppm_follows_the_medium(spark):
    rows = [("ppm", "aquatic"), ("ppm", "soil"), ("ppm", "unknown"), ("mmol/kg soil", "soil"), (None, "soil")]
    df = spark.createDataFrame([(i, 2.0, None, None, u, m, 10.0, None, None, None, "other", None) for i, (u, m) in enumerate(rows)], "i int, raw_mean double, raw_min double, raw_max double, raw_unit string, medium_domain string, mw double, std_mean double, std_min double, std_max double, std_family string, std_unit string")
    got = [(r.unit_family_v2, r.mean_value_v2) for r in E.normalize_units(df).orderBy("i").collect()]
    assert got == [("water_mg_l", 2.0), ("soil_mg_kg", 2.0), (None, 2.0), ("soil_mg_kg", 20.0), (None, 2.0)]


def test_condition_key(spark):
    df = spark.createDataFrame([(0, [2, 1, 2]), (1, [5]), (2, [])], "i int, v array<int>")
    assert run(df, features.condition_key(F.col("v"))) == ["[1,2]", "5", "UNKNOWN"]


def test_binary_rounding_is_pythons(spark):
    import random

    rnd = random.Random(1)
    values = [x / 20 for x in range(20, 480)] + [x / 200 for x in range(0, 200)] + [rnd.uniform(0, 30) for _ in range(500)] + [1.25, 2.675, 0.125, 0.375, 1.005, 0.045, 24.25]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.round_binary(F.col("v"), 1).alias("a"), T.round_binary(F.col("v"), 2).alias("b")).collect()
    assert all((r.a, r.b) == (round(r.v, 1), round(r.v, 2)) for r in got)


def test_unknown_qualifier_is_an_error(spark):
    lo, hi = E.concentration_interval(F.col("v"), F.col("op"))
    with pytest.raises(Exception):
        spark.createDataFrame([(1.0, "~")], "v double, op string").select(lo, hi).collect()


def test_medium_rules(spark):
    from benthos.functions import features as X

    rows = ["soil:plot", "fresh_water", "x/aquatic", "sedimentary", "", None, "brackwater", "air"]
    part = X.medium_part(F.col("m"), ("aquatic",), ("soil", "sediment"), "valid")
    got = [r[0] for r in spark.createDataFrame([(m,) for m in rows], "m string").select(part).collect()]
    assert got == ["test", "train", "train", "test", "valid", "valid", "train", "valid"]
    with pytest.raises(ValueError):
        X.medium_part(F.col("m"), (), (), "nowhere")
