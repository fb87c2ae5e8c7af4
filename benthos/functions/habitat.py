"""Habitat of a species from its taxonomy: an ordered rule table and its appliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, in the order tried: rule, medium, labels, confidence, accepted,
# then what it looks for: words in the group; phyla; classes; families; orders; word anywhere.
# An order narrows the rule; all others widen it.
RULES = [
    ("amphibian_as_aquatic", "aquatic", "aquatic;amphibious", 0.82, True, "amphibian", "", "amphibia", "", "", ""),
    ("fish_as_aquatic", "aquatic", "aquatic", 0.92, True, "fish", "", "actinopterygii chondrichthyes cephalaspidomorphi myxini", "", "", ""),
    ("algae_as_aquatic", "aquatic", "aquatic", 0.86, True, "algae", "chlorophyta bacillariophyta cyanophycota rhodophycota rhodophyta phaeophyta pyrrophycophyta charophyta chrysophyta euglenophycota haptophyta xanthophyta cryptophycophyta prasinophyta ochrophyta", "", "", "", ""),
    ("bivalvia_as_sediment", "sediment", "sediment;aquatic", 0.80, True, "", "", "bivalvia", "", "", ""),
    ("polychaete_as_sediment", "sediment", "sediment;aquatic", 0.78, True, "", "", "errantia sedentaria", "", "", "polychaet"),
    ("benthic_family_as_sediment", "sediment", "sediment;aquatic", 0.74, False, "", "", "", "chironomidae tubificidae", "", ""),
    ("aquatic_invertebrate_phylum", "aquatic", "aquatic", 0.86, True, "", "cnidaria echinodermata porifera ctenophora bryozoa", "", "", "", ""),
    ("small_aquatic_invertebrate_phylum", "aquatic", "aquatic;sediment", 0.70, False, "", "rotifera brachiopoda hemichordata chaetognatha cephalorhyncha kinorhyncha nemertea sipuncula foraminifera kamptozoa ectoprocta", "", "", "", ""),
    ("aquatic_invertebrate_class", "aquatic", "aquatic", 0.82, True, "", "", "branchiopoda maxillopoda ostracoda monogononta hydrozoa scyphozoa anthozoa ascidiacea cephalopoda", "", "", ""),
    ("marine_mollusc_class_as_aquatic", "aquatic", "aquatic;sediment", 0.72, False, "", "", "polyplacophora aplacophora scaphopoda monoplacophora", "", "", ""),
    ("crustacean_as_aquatic", "aquatic", "aquatic", 0.76, False, "crustacean", "", "malacostraca", "", "", ""),
    ("earthworm_clitellate_as_soil", "soil", "soil", 0.84, True, "", "", "clitellata oligochaeta", "lumbricidae enchytraeidae", "", ""),
    ("nematoda_broad_soil", "soil", "soil", 0.68, False, "", "nematoda", "", "", "", ""),
    ("fungi_broad_soil_low_confidence", "soil", "soil", 0.58, False, "fungi", "ascomycota basidiomycota glomeromycota chytridiomycota zygomycota myxomycota oomycota deuteromycotina", "", "", "", ""),
    ("plant_as_terrestrial", "terrestrial", "terrestrial", 0.74, False, "flowers, trees, shrubs, ferns", "magnoliophyta coniferophyta polypodiophyta bryophyta marchantiophyta lycopodiophyta", "", "", "", ""),
    ("bird_as_terrestrial", "terrestrial", "terrestrial", 0.82, True, "bird", "", "aves", "", "", ""),
    ("mammal_as_terrestrial", "terrestrial", "terrestrial", 0.82, True, "mammal", "", "mammalia", "", "", ""),
    ("reptile_broad_terrestrial", "terrestrial", "terrestrial", 0.74, False, "reptile", "", "reptilia", "", "", ""),
    ("aquatic_insect_order", "aquatic", "aquatic;amphibious", 0.70, False, "insects/spiders", "", "insecta arachnida entognatha diplopoda chilopoda", "", "ephemeroptera plecoptera trichoptera odonata", ""),
    ("arthropod_broad_terrestrial", "terrestrial", "terrestrial", 0.64, False, "insects/spiders", "", "insecta arachnida entognatha diplopoda chilopoda", "", "", ""),
]
# Voted habitats and their media, in the order of ties; of a vote (tests at least,
# share at least, confidence: base, slope by share, most; status).
VOTED = {"Water": "aquatic", "Soil": "soil", "Non-Soil": "terrestrial"}
VOTE_BANDS = ((5, 0.70, 0.74, 0.20, 0.95, "accepted"), (2, 0.60, 0.60, 0.18, 0.82, "review_recommended"))
COLUMNS = ("ecotox_group", "phylum_division", "class", "family", "tax_order")


def habitat_by_taxonomy(df: DataFrame) -> DataFrame:
    """Adds habitat_rule, habitat, habitat_labels, habitat_confidence and habitat_status.

    Reads ecotox_group, phylum_division, class, family and tax_order; a missing text is empty.
    """
    low = df.withColumns({f"__{c}": F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in COLUMNS})
    low = low.withColumn("__all", F.concat_ws(" ", *[f"__{c}" for c in COLUMNS]))
    which = F.lit(None).cast("int")
    for i, (*_, group, phyla, classes, families, orders, word) in reversed(list(enumerate(RULES))):
        hit = F.lit(False)
        for column, members in (("phylum_division", phyla), ("class", classes), ("family", families)):
            hit = hit | F.col(f"__{column}").isin(*members.split()) if members else hit
        hit = hit | F.col("__ecotox_group").contains(group) if group else hit
        hit = hit | F.col("__all").contains(word) if word else hit
        hit = hit & F.col("__tax_order").isin(*orders.split()) if orders else hit
        which = F.when(hit, i).otherwise(which)
    low = low.withColumn("__w", which)
    of = lambda j, none: F.coalesce(F.get(F.array(*[F.lit(r[j]) for r in RULES]), F.col("__w")), F.lit(none))
    ok = F.get(F.array(*[F.lit(r[4]) for r in RULES]), F.col("__w"))
    status = F.when(ok.isNull(), "needs_external_review").when(ok, "accepted").otherwise("review_recommended")
    out = low.withColumns({"habitat_rule": of(0, "unknown_no_reliable_evidence"), "habitat": of(1, "unknown"), "habitat_labels": of(2, "unknown"), "habitat_confidence": of(3, 0.0), "habitat_status": status})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def habitat_vote(tests: DataFrame, species: str, habitat: str) -> DataFrame:
    """(species, habitat, share, total, confidence, status): the medium of most tests, ties in the order Water, Soil, Non-Soil.

    Five tests with a share of 0.70 are accepted, two with 0.60 are for review; less is no
    evidence: habitat, confidence and status are null. Tests without one of the three habitats
    do not vote; a species without votes has no row.
    """
    votes = tests.groupBy(species).agg(*[F.count_if(F.col(habitat) == h).alias(f"__{i}") for i, h in enumerate(VOTED)])
    total, top = sum((F.col(f"__{i}") for i in range(1, len(VOTED))), F.col("__0")), F.greatest(*[f"__{i}" for i in range(len(VOTED))])
    medium = F.coalesce(*[F.when(F.col(f"__{i}") == top, m) for i, m in enumerate(VOTED.values())])
    d = votes.select(species, medium.alias("__m"), total.alias("total"), top.alias("__top")).where("total > 0").withColumn("share", F.col("__top") / F.col("total"))
    confidence, status = F.lit(None).cast("double"), F.lit(None).cast("string")
    for least, share, base, slope, most, name in reversed(VOTE_BANDS):
        hit = (F.col("total") >= least) & (F.col("share") >= share)
        confidence = F.when(hit, F.round(F.least(F.lit(most), base + F.col("share") * slope), 3)).otherwise(confidence)
        status = F.when(hit, name).otherwise(status)
    return d.select(species, F.when(confidence.isNotNull(), F.col("__m")).alias("habitat"), "share", "total", confidence.alias("confidence"), status.alias("status"))


def habitat_decision(all_species: DataFrame, species: str, vote: DataFrame, taxonomy: DataFrame, external: DataFrame, threshold: float) -> DataFrame:
    """(species, habitat, confidence, source, total): the vote, else taxonomy, else nothing known (unresolved).

    External evidence replaces what is less sure than ``threshold``, if it is at least as sure.
    Each source has (species, habitat, confidence), one row per species at most; the vote also
    has total. total is the number of votes, 0 without any.
    """
    d = all_species.select(species)
    for name, source in (("v", vote), ("t", taxonomy), ("e", external)):
        d = d.join(source.select(species, F.col("habitat").alias(f"__{name}"), F.col("confidence").alias(f"__{name}c"), *(["total"] if name == "v" else [])), species, "left")
    first, sure = F.coalesce("__v", "__t"), F.when(F.col("__v").isNotNull(), F.col("__vc")).otherwise(F.col("__tc"))
    source = F.when(F.col("__v").isNotNull(), "vote").when(F.col("__t").isNotNull(), "taxonomy").otherwise("unresolved")
    known = F.coalesce(sure, F.lit(0.0))
    outside = F.col("__e").isNotNull() & (known < threshold) & (F.col("__ec") >= known)
    return d.select(species, F.when(outside, F.col("__e")).otherwise(first).alias("habitat"), F.when(outside, F.col("__ec")).otherwise(sure).alias("confidence"), F.when(outside, "external").otherwise(source).alias("source"), F.coalesce("total", F.lit(0)).alias("total"))


def decision_report(decided: DataFrame) -> DataFrame:
    """(source, habitat, n, mean_confidence) of decisions."""
    return decided.groupBy("source", "habitat").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
