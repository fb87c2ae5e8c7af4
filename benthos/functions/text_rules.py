"""Text, number, unit-text and code rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.functions.distinct import by_distinct

# Words that stand for a missing entry.
MISSING_WORDS = ("", "nan", "none", "null", "na", "n/a")
MISSING_NUMBERS = ("NR", "NC", "NA", "N/A", "NONE", "NULL")
MISSING_UNITS = ("", "nr", "nc", "na", "n/a", "none", "null", "--")

NUMBER = r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?"


def one_of(c: Column, values) -> Column:
    return c.isin(*values)


def registry_key(c: Column) -> Column:
    """Digits of a registry number."""
    return F.regexp_replace(c, r"[^0-9]", "")


def text_or_null(c: Column) -> Column:
    """Trimmed text; NULL when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def text_or_empty(c: Column) -> Column:
    """Trimmed text; empty for NULL and for words that mean missing."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(one_of(F.lower(t), MISSING_WORDS), "").otherwise(t)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def lenient_number(c: Column) -> Column:
    """First number in the text, commas dropped; NULL if none or not finite."""
    found = F.regexp_extract(F.regexp_replace(c, ",", ""), NUMBER, 0)
    return finite(F.nullif(found, F.lit("")).try_cast("double"))


def strict_number(c: Column) -> Column:
    """The whole text as a number after trailing ``*`` and ``/``; NULL for words that mean missing."""
    t = F.trim(c)
    bare = F.regexp_replace(t, r"[*/\s]*[*/]\s*$", "")
    return F.when(one_of(F.upper(t), MISSING_NUMBERS), None).when(bare.rlike(f"^{NUMBER}$"), bare.try_cast("double"))


def unit_text(c: Column) -> Column:
    """First dialect: lower case, micro signs as u, ``per`` as a slash, plain dashes, single spaces."""
    t = F.lower(text_or_empty(c))
    # Fixed values, in the order in which they are replaced.
    for old, new in (("micro", "u"), ("µ", "u"), ("μ", "u"), (" per ", "/"), ("litre", "liter"), ("−", "-"), ("–", "-"), ("·", " ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def raw_unit_text(c: Column) -> Column:
    """Second dialect: lower case, U+03BC as u, single spaces; empty for words that mean missing."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(one_of(t, MISSING_UNITS), "").otherwise(F.regexp_replace(F.replace(t, F.lit("μ"), F.lit("u")), r"\s+", " "))


def code(c: Column) -> Column:
    """Endpoint, effect and measurement codes: upper case, no white space, no leading ``~``, no trailing ``/`` or ``*``."""
    t = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(t, "^~+", ""), "[/*]+$", "")


def media_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[/*]+$", "")


def lookup(c: Column, table: dict, kind: str = "double") -> Column:
    """Value of a small fixed table; NULL where the key is missing."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c].cast(kind)


# Hours in each unit of duration (a month has 30 days, a year 365).
HOURS = {u: h for h, names in ((1 / 3600, ("s", "sec", "second", "seconds")), (1 / 60, ("min", "minute", "minutes")), (1.0, ("h", "hr", "hrs", "hour", "hours")), (24.0, ("d", "day", "days")), (168.0, ("wk", "wks", "week", "weeks")), (720.0, ("mo", "month", "months")), (8760.0, ("yr", "year", "years"))) for u in names}


def duration_hours(value: Column, unit: Column) -> tuple[Column, Column]:
    """(hours, status) of a duration given as texts."""
    number, key = lenient_number(value), unit_text(unit)
    factor = lookup(key, HOURS)
    status = F.when(number.isNull(), "missing").when(key == "", "missing_unit").when(factor.isNull(), "unrecognized_unit").otherwise("standardized")
    return number * factor, status


# Factor to the standard unit, by compacted unit text.
CONCENTRATIONS = {
    "mg/L": ("water_mg_l", {"mg/l": 1.0, "mg/liter": 1.0, "mgl-1": 1.0, "mg/l-1": 1.0, "ug/l": 1e-3, "ugl-1": 1e-3, "ug/l-1": 1e-3, "ng/l": 1e-6, "ngl-1": 1e-6, "g/l": 1e3, "gl-1": 1e3}),
    "mol/L": ("water_mol_l", {"mol/l": 1.0, "m/l": 1.0, "moll-1": 1.0, "mmol/l": 1e-3, "umol/l": 1e-6, "umoll-1": 1e-6, "nmol/l": 1e-9}),
    "mg/kg": ("soil_mg_kg", {"mg/kg": 1.0, "mgkg-1": 1.0, "ug/kg": 1e-3, "ugkg-1": 1e-3, "ng/kg": 1e-6, "ngkg-1": 1e-6, "g/kg": 1e3, "gkg-1": 1e3}),
    "mg/kg/d": ("oral_mg_kg_d", {"mg/kg/d": 1.0, "mg/kg/day": 1.0, "mgkg-1d-1": 1.0, "mgkg-1day-1": 1.0, "ug/kg/d": 1e-3, "ug/kg/day": 1e-3, "ugkg-1d-1": 1e-3, "ugkg-1day-1": 1e-3}),
}
CONCENTRATION_ROWS = [(u, std, family, f) for std, (family, units) in CONCENTRATIONS.items() for u, f in units.items()]


def concentration(value: Column, unit: Column) -> tuple[Column, Column, Column, Column]:
    """(value, standard unit, family, status) of a concentration given as texts."""
    number, key = lenient_number(value), unit_text(unit)
    compact = F.replace(key, F.lit(" "), F.lit(""))
    factor, std, family = (lookup(compact, {r[0]: r[i] for r in CONCENTRATION_ROWS}, kind) for i, kind in ((3, "double"), (1, "string"), (2, "string")))
    known = number.isNotNull() & factor.isNotNull()
    status = F.when(number.isNull(), "missing").when(key == "", "missing_unit").when(factor.isNull(), "unrecognized_unit").otherwise("standardized")
    return F.when(known, number * factor), F.when(known, std), F.when(known, family).otherwise("other"), status


def as_number(df: DataFrame, value: str) -> Column:
    """``lenient_number`` of a column; a double is what its own text says, and is not written out for that."""
    return finite(F.col(value)) if dict(df.dtypes)[value] == "double" else lenient_number(F.col(value))


def with_concentrations(df: DataFrame, values: dict[str, str], unit: str) -> DataFrame:
    """Adds a struct (value, unit, family, status) per name -> column of values, as ``concentration`` gives them; units are read once per distinct text."""
    def rule(codes: DataFrame) -> DataFrame:
        c = codes.withColumn("__key", unit_text(F.col(unit)))
        compact = F.replace("__key", F.lit(" "), F.lit(""))
        return c.withColumns({f"__{n}": lookup(compact, {r[0]: r[i] for r in CONCENTRATION_ROWS}, kind) for n, i, kind in (("factor", 3, "double"), ("std", 1, "string"), ("family", 2, "string"))})

    d = by_distinct(df, [unit], rule).withColumns({f"__number_{name}": as_number(df, value) for name, value in values.items()})
    factor, out = F.col("__factor"), {}
    for name in values:
        number = F.col(f"__number_{name}")
        known = number.isNotNull() & factor.isNotNull()
        status = F.when(number.isNull(), "missing").when(F.col("__key") == "", "missing_unit").when(factor.isNull(), "unrecognized_unit").otherwise("standardized")
        out[name] = F.struct((number * factor).alias("value"), F.when(known, F.col("__std")).alias("unit"), F.when(known, F.col("__family")).otherwise("other").alias("family"), status.alias("status"))
    return d.withColumns(out).drop("__key", "__factor", "__std", "__family", *[f"__number_{name}" for name in values])


def with_concentration(df: DataFrame, value: str, unit: str, name: str) -> DataFrame:
    return with_concentrations(df, {name: value}, unit)


def with_durations(df: DataFrame, value: str, unit: str, scales: dict[str, float] | None = None, digits: int = 6) -> DataFrame:
    """Adds a struct (hours, status) per name -> factor of the value, hours rounded; worked out once per distinct value and unit."""
    def rule(codes: DataFrame) -> DataFrame:
        out = {}
        for name, scale in (scales or {"duration_h": None}).items():
            hours, status = duration_hours(F.col(value) if scale is None else (F.col(value) * scale).cast("string"), F.col(unit))
            out[name] = F.struct(F.round(hours, digits).alias("hours"), status.alias("status"))
        return codes.withColumns(out)

    return by_distinct(df, [value, unit], rule)


def publication_year(c: Column) -> Column:
    """First run of four digits between 1800 and 2100, also inside longer numbers."""
    t = F.trim(c)
    windows = F.when(F.length(t) >= 4, F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.substring(t, i, F.lit(4))))
    years = F.transform(F.filter(windows, lambda w: w.rlike("^[0-9]{4}$")), lambda w: w.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(1800, 2100)), F.lit(0))


def recency_weight(year: Column, latest: Column, decay: float = 0.8, least: float = 0.3) -> Column:
    """``decay`` for each five years before the latest, ``least`` at least and for unknown years."""
    older = F.greatest(F.lit(0), latest - year)
    return F.when(year.isNull() | latest.isNull(), least).otherwise(F.greatest(F.lit(least), F.least(F.lit(1.0), F.pow(F.lit(decay), older / 5.0))))


def round_binary(x: Column, digits: int) -> Column:
    """A non-negative double rounded to decimals by its exact binary value; a tie goes to the even digit.

    Which side of the half a value lies on is decided without rounding: the double is split in
    two halves of 26 bits, whose products with the power of ten are exact.
    """
    scale = float(10**digits)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    k = F.floor(x * scale).cast("double")
    side = (high * scale - (k + 0.5)) + (x - high) * scale
    return F.when(side > 0, k + 1).when(side < 0, k).otherwise(k + k % 2) / scale


def duration_bin(hours: Column) -> tuple[Column, Column]:
    """(bin, rule): half hours from 24 h, tenths from 1 h, hundredths below; exact ties go to the even digit."""
    size = F.abs(hours)
    rule = F.when(hours.isNull(), "missing_duration").when(size >= 24, "round_0.5h_ge_24h").when(size >= 1, "round_0.1h_1_to_24h").otherwise("round_0.01h_lt_1h")
    sign = F.when(hours < 0, -1.0).otherwise(1.0)
    return F.when(size >= 24, F.bround(hours * 2, 0) / 2).when(size >= 1, sign * round_binary(size, 1)).otherwise(sign * round_binary(size, 2)), rule


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and SHA-256 of the compact JSON array of the parts as texts."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256))


def source_ids(json_list: Column) -> Column:
    """Distinct, sorted texts of a JSON list of ids."""
    return F.array_sort(F.array_distinct(F.transform(F.from_json(json_list, "array<string>"), lambda x: F.trim(x))))


def hash_bin(c: Column, bins: int) -> Column:
    """Bin of a text by the leading 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % bins


def hash_share(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone (leading 32 bits of SHA-256)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
