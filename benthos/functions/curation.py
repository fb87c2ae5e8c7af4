"""Chemical and species classes by ordered rules over names, groups, structures and taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class patterns in the order tried (word borders bind the first and last word only).
CHEMICALS = [
    (r"\bmetal|metalloid|arsenic|cadmium|lead|mercury|chromium|copper|nickel|zinc|selenium|silver|aluminum|cobalt|manganese|iron|uranium|boron\b", None, "inorganic", "metal_metalloid", "metal", 0.90),
    (r"pfas|perfluoro|polyfluoro", "highly_fluorinated", "organic", "fluorinated_organic", "PFAS", 0.86),
    (r"\bpesticide|herbicide|insecticide|fungicide|biocide|atrazine|simazine|carbaryl|permethrin|imidacloprid|ddt|endosulfan|glyphosate\b", None, "organic", "pesticide", "pesticide", 0.84),
    (r"\bpharmaceutical|personal care|ppcp|drug|antibiotic|ibuprofen|diclofenac|carbamazepine|acetaminophen|caffeine|triclosan\b", None, "organic", "pharmaceutical_pcp", "pharma", 0.84),
    (r"\bpah|polycyclic aromatic|naphthalene|anthracene|phenanthrene|fluoranthene|pyrene|chrysene\b", "pah_like", "organic", "hydrocarbon", "PAH", 0.82),
    (r"\bpetroleum|diesel|gasoline|fuel oil|crude oil|mineral oil|tph\b", None, "organic_mixture", "hydrocarbon", "petroleum_hydrocarbon", 0.82),
    (r"\bsurfactant|detergent|alkylbenzene sulfonate|quaternary ammonium|benzalkonium\b", None, "organic", "surfactant", "surfactant", 0.80),
    (r"\bphenol|phenolic|cresol|bisphenol|chlorophenol|nitrophenol|nonylphenol\b", "phenol_like", "organic", "phenolic", "phenol_derivative", 0.78),
    (r"\bchlorinated|organochlorine|pcb|polychlorinated|chloroform|chlorobenzene|trichloroethylene\b", "halogenated", "organic", "halogenated_organic", "chlorinated_organic", 0.76),
    (r"\bsolvent|voc|benzene|toluene|xylene|styrene|acetone|methanol|ethanol|hexane\b", None, "organic", "solvent_voc", "volatile_organic", 0.74),
    (r"\bdye|azo dye|methylene blue|crystal violet|malachite green|rhodamine\b", None, "organic", "dye", "industrial_dye", 0.74),
]
METALS = ("arsenic", "cadmium", "lead", "mercury", "chromium", "copper", "nickel", "zinc", "selenium")


def structure_flags(smiles: Column, text: Column) -> Column:
    """Sorted flags read off a structure's letters and the name."""
    s = F.replace(smiles, F.lit(" "), F.lit(""))
    digits = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit("([0-9])"))))
    flags = {
        "halogenated": s.contains("Cl") | s.contains("Br") | text.contains("chlor"),
        "highly_fluorinated": (F.regexp_count(s, F.lit("F")) >= 4) | text.contains("perfluoro") | text.contains("polyfluoro"),
        "phosphorus_containing": s.contains("P") | text.contains("phosph"),
        "pah_like": (F.regexp_count(s, F.lit("c")) >= 10) & (digits >= 2),
        "phenol_like": s.rlike("Oc1|c1.*O"),
        "ionic_or_metal_token": s.rlike(r"\[[A-Z][a-z]?[+-]?\]"),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()])))


def metal_label(text: Column, name: Column) -> Column:
    out = F.when(name != "", F.lower(F.substring_index(name, " ", 1))).otherwise("metal_metalloid")
    for m in reversed(METALS):
        out = F.when(text.contains(m), m).otherwise(out)
    return out


def pesticide_label(text: Column, flags: Column) -> Column:
    has = text.contains
    return (
        F.when(has("organophosphate") | F.array_contains(flags, "phosphorus_containing"), "organophosphate_pesticide").when(has("organochlorine") | has("ddt") | F.array_contains(flags, "halogenated"), "organochlorine_pesticide")
        .when(has("pyreth") | has("permethrin"), "pyrethroid_pesticide").when(has("triazine") | has("atrazine") | has("simazine"), "triazine_herbicide").otherwise("pesticide_other")
    )


def pharma_label(text: Column) -> Column:
    any_of = lambda *w: text.rlike("|".join(w))
    return F.when(any_of("antibiotic", "tetracycline", "sulfamethoxazole"), "antibiotic").when(any_of("steroid", "pregn"), "steroid").when(any_of("ibuprofen", "diclofenac", "naproxen"), "anti_inflammatory").otherwise("pharmaceutical_other")


def chemical_classes(df: DataFrame) -> DataFrame:
    """Adds class_l1..class_l3, confidence and flags from chemical_name, ecotox_group and smiles."""
    name, group, smiles = (F.trim(F.coalesce(c, F.lit(""))) for c in ("chemical_name", "ecotox_group", "smiles"))
    d = df.withColumns({"text": F.lower(F.concat_ws(" ", name, group)), "__name": name, "__smiles": smiles})
    d = d.withColumn("flags", structure_flags(F.col("__smiles"), F.col("text")))
    which = F.lit(None).cast("int")
    for i, (pattern, flag, *_) in reversed(list(enumerate(CHEMICALS))):
        hit = F.col("text").rlike(pattern)
        which = F.when(hit | F.array_contains("flags", flag) if flag else hit, i).otherwise(which)
    d = d.withColumn("__w", which)
    of = lambda j: F.get(F.array(*[F.lit(r[j]) for r in CHEMICALS]), F.col("__w"))
    l3 = F.when(F.col("__w") == 0, metal_label(F.col("text"), F.col("__name"))).when(F.col("__w") == 2, pesticide_label(F.col("text"), F.col("flags"))).when(F.col("__w") == 3, pharma_label(F.col("text"))).otherwise(of(4))
    carbon = F.when(F.lower("__smiles").contains("c"), "organic").otherwise("unknown")
    out = d.withColumns({"class_l1": F.coalesce(of(2), carbon), "class_l2": F.coalesce(of(3), F.lit("unclassified")), "class_l3": F.coalesce(l3, F.lit("unclassified")), "confidence": F.coalesce(of(5), F.lit(0.35))})
    return out.drop("text", "__name", "__smiles", "__w")


# Classes and groups of taxa, in the order tried: (classes, group, l1, l2, level-3 column, confidence).
TAXA = [
    (("actinopterygii", "chondrichthyes"), "fish", "vertebrate", "fish", "class", 0.95),
    (("amphibia",), "amphibians", "vertebrate", "amphibian", "order", 0.95),
    (("aves",), "birds", "vertebrate", "bird", "order", 0.95),
    (("mammalia",), "mammals", "vertebrate", "mammal", "order", 0.95),
    (("reptilia",), "reptiles", "vertebrate", "reptile", "order", 0.95),
    (("branchiopoda", "malacostraca", "maxillopoda", "ostracoda", "copepoda"), "crustaceans", "invertebrate", "crustacean", "class", 0.95),
    (("bivalvia", "gastropoda", "cephalopoda", "polyplacophora"), "molluscs", "invertebrate", "mollusk", "class", 0.95),
    (("insecta",), "insects/spiders", "invertebrate", "insect", "order", 0.92),
    (("arachnida",), "-", "invertebrate", "arachnid", "order", 0.92),
    (("clitellata", "polychaeta", "secernentea", "chromadorea"), "worms", "invertebrate", "worm", "class", 0.92),
    (("chlorophyceae", "bacillariophyceae", "cyanophyceae", "trebouxiophyceae", "ulvophyceae"), "algae", "algae_cyanobacteria", "algae", "class", 0.92),
]
TAGS = ("standard test species", "u.s. invasive species", "u.s. threatened and endangered species")


def base_group(group: Column) -> Column:
    """First entry of a ``;`` list that is no tag, else the first entry."""
    parts = F.filter(F.transform(F.split(group, ";"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.filter(parts, lambda x: ~F.lower(x).isin(*TAGS))
    return F.coalesce(F.get(plain, F.lit(0)), F.get(parts, F.lit(0)), F.lit(""))


def species_classes(df: DataFrame) -> DataFrame:
    """Adds group_l1..group_l3, confidence, is_standard and base_group from the taxonomy columns."""
    low = {c: F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("kingdom", "class", "tax_order", "family")}
    group = base_group(F.trim(F.coalesce("ecotox_group", F.lit(""))))
    g = F.lower(group)
    which = F.lit(None).cast("int")
    plant = (low["kingdom"] == "plantae") | low["class"].isin("magnoliopsida", "liliopsida") | g.contains("flowers")
    which = F.when(plant, 100).when((low["kingdom"] == "fungi") | (g == "fungi"), 101).otherwise(which)
    for i, (classes, name, *_) in reversed(list(enumerate(TAXA))):
        which = F.when(low["class"].isin(*classes) | (g == name), i).otherwise(which)
    d = df.withColumns({"__w": which, "base_group": group})
    of = lambda j: F.get(F.array(*[F.lit(r[j]) for r in TAXA]), F.when(F.col("__w") < 100, F.col("__w")))
    water_plant = low["tax_order"].contains("alismatales") | low["family"].contains("lemnaceae")
    l1 = F.when(F.col("__w") == 100, "plant").when(F.col("__w") == 101, "fungi").otherwise(F.coalesce(of(2), F.lit("unknown")))
    l2 = F.when(F.col("__w") == 100, F.when(water_plant, "aquatic_plant").otherwise("vascular_plant")).when(F.col("__w") == 101, "fungi").when(low["class"] == "cyanophyceae", "cyanobacteria").otherwise(F.coalesce(of(3), F.lit("unclassified")))
    by_class, by_order = F.nullif(low["class"], F.lit("")), F.nullif(low["tax_order"], F.lit(""))
    l3 = F.when(F.col("__w").isNull(), F.coalesce(by_class, F.nullif(g, F.lit("")), F.lit("unknown"))).when(of(4) == "order", F.coalesce(by_order, low["class"])).otherwise(F.coalesce(by_class, l2))
    conf = F.when(F.col("__w") >= 100, 0.88).otherwise(F.coalesce(of(5), F.lit(0.25)))
    return d.withColumns({"group_l1": l1, "group_l2": l2, "group_l3": l3, "confidence": conf, "is_standard": F.lower(F.coalesce("ecotox_group", F.lit(""))).contains(TAGS[0])}).drop("__w")
