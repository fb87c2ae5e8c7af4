"""Rules that read units once per distinct text, against the plain ones."""

from pyspark.sql import functions as F

from benthos.functions import text_rules as T

UNITS = ["mg/L", " ug / L", None, "", "XYZ", "µg/L", "h", "Days", "wk"]
NUMBERS = ["1,234.5e2*", "NR", None, "<5", "-2.5e-3"]


def test_units_are_read_once_per_distinct_text(spark):
    texts = spark.createDataFrame([(u, n) for u in UNITS for n in NUMBERS], "u string, n string")
    doubles = spark.createDataFrame([(u, n) for u in UNITS for n in (1.5, None, float("nan"), float("inf"), -2.5e-30, 1e22)], "u string, n double")
    for d in (texts, doubles):
        plain = T.concentration(F.col("n").cast("string"), F.col("u"))
        hours = T.duration_hours(F.col("n").cast("string"), F.col("u"))
        want = d.select("u", "n", *[c.alias(f"c{i}") for i, c in enumerate(plain)], F.round(hours[0], 6).alias("h"), hours[1].alias("s"))
        both = T.with_durations(T.with_concentrations(d, {"c": "n", "c2": "n"}, "u"), "n", "u", {"h": 1.0} if d is doubles else {"h": None})
        assert both.where("not (c <=> c2)").count() == 0
        got = both.select("u", "n", "c.value", "c.unit", "c.family", "c.status", "h.hours", F.col("h.status").alias("s"))
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.collect())
