"""Inputs and SQL of the curation queries: texts that the class rules meet, and the same rules in SQL."""

from __future__ import annotations

from benthos.functions import curation, habitat
from benthos.plans.registry import pick

_NAMES = ["Lead acetate", "Environment blend", "Perfluorooctane", "Atrazine technical", "Ibuprofen sodium", "Naphthalene", "Diesel no 2", "Benzalkonium salt", "Nonylphenol", "PCB 126", "Toluene", "Rhodamine B", "Plain thing", "DDT mix", "Antibiotic X", None]
_SMILES = ["CC", "c1ccc2ccccc2c1cc", "FC(F)(F)CF", "OP(=O)O", "Oc1ccccc1", "[Na+]", "ClCCl", None, "N"]
CHEMICAL_INPUT = f"SELECT p_partkey, {pick('p_partkey', _NAMES)} AS chemical_name, CASE WHEN p_partkey % 5 = 0 THEN 'Group ' || p_brand END AS ecotox_group, {pick('p_partkey * 5 + p_size', _SMILES)} AS smiles FROM part"
_R = lambda i: curation.CHEMICALS[i][0].replace("'", "''")
_FLAG = {None: "FALSE", "highly_fluorinated": "f2", "pah_like": "f4", "phenol_like": "f5", "halogenated": "f1"}
_WHICH = "CASE " + " ".join(f"WHEN regexp_matches(text, '{_R(i)}') OR {_FLAG[r[1]]} THEN {i}" for i, r in enumerate(curation.CHEMICALS)) + " END"
_OF = lambda j, other: "CASE w " + " ".join(f"WHEN {i} THEN {r[j]!r}" for i, r in enumerate(curation.CHEMICALS)) + f" ELSE {other} END"
_METAL = "CASE " + " ".join(f"WHEN text LIKE '%{m}%' THEN '{m}'" for m in curation.METALS) + " WHEN name <> '' THEN lower(split_part(name, ' ', 1)) ELSE 'metal_metalloid' END"
CHEMICAL_SQL = rf"""WITH i AS ({CHEMICAL_INPUT}), a AS (SELECT p_partkey, coalesce(chemical_name, '') AS name, lower(trim(coalesce(chemical_name, '')) || ' ' || trim(coalesce(ecotox_group, ''))) AS text, coalesce(smiles, '') AS s FROM i),
b AS (SELECT *, s LIKE '%Cl%' OR s LIKE '%Br%' OR text LIKE '%chlor%' AS f1, length(s) - length(replace(s, 'F', '')) >= 4 OR text LIKE '%perfluoro%' OR text LIKE '%polyfluoro%' AS f2, s LIKE '%P%' OR text LIKE '%phosph%' AS f3,
 length(s) - length(replace(s, 'c', '')) >= 10 AND len(list_distinct(regexp_extract_all(s, '[0-9]'))) >= 2 AS f4, regexp_matches(s, 'Oc1|c1.*O') AS f5, regexp_matches(s, '\[[A-Z][a-z]?[+-]?\]') AS f6 FROM a),
c AS (SELECT *, {_WHICH} AS w FROM b)
SELECT p_partkey, {_OF(2, "CASE WHEN lower(s) LIKE '%c%' THEN 'organic' ELSE 'unknown' END")} AS class_l1, {_OF(3, "'unclassified'")} AS class_l2,
 CASE w WHEN 0 THEN {_METAL}
  WHEN 2 THEN CASE WHEN text LIKE '%organophosphate%' OR f3 THEN 'organophosphate_pesticide' WHEN text LIKE '%organochlorine%' OR text LIKE '%ddt%' OR f1 THEN 'organochlorine_pesticide' WHEN text LIKE '%pyreth%' OR text LIKE '%permethrin%' THEN 'pyrethroid_pesticide' WHEN text LIKE '%triazine%' OR text LIKE '%atrazine%' OR text LIKE '%simazine%' THEN 'triazine_herbicide' ELSE 'pesticide_other' END
  WHEN 3 THEN CASE WHEN regexp_matches(text, 'antibiotic|tetracycline|sulfamethoxazole') THEN 'antibiotic' WHEN regexp_matches(text, 'steroid|pregn') THEN 'steroid' WHEN regexp_matches(text, 'ibuprofen|diclofenac|naproxen') THEN 'anti_inflammatory' ELSE 'pharmaceutical_other' END
  ELSE {_OF(4, "'unclassified'")} END AS class_l3, CAST({_OF(5, "0.35")} AS DOUBLE) AS confidence,
 concat_ws(';', CASE WHEN f1 THEN 'halogenated' END, CASE WHEN f2 THEN 'highly_fluorinated' END, CASE WHEN f6 THEN 'ionic_or_metal_token' END, CASE WHEN f4 THEN 'pah_like' END, CASE WHEN f5 THEN 'phenol_like' END, CASE WHEN f3 THEN 'phosphorus_containing' END) AS flags FROM c"""

_CLASSES = ["Actinopterygii", "Amphibia", None, "Insecta", "Bivalvia", "Cyanophyceae", "Magnoliopsida", "Mammalia", "Clitellata", "Odd class", "Branchiopoda", "Arachnida"]
_GROUPS = ["Fish;Standard Test Species", "Flowers, Trees", "U.S. Invasive Species", None, "Fungi", "Worms; x", "Algae", "Birds"]
_ORDERS = ["Alismatales", None, "Passeriformes"]
SPECIES_INPUT = f"SELECT c_custkey, {pick('c_custkey', ['Animalia', 'Plantae', None, 'Fungi', 'Animalia'])} AS kingdom, {pick('c_custkey', _CLASSES)} AS class, {pick('c_custkey', _ORDERS)} AS tax_order, CASE WHEN c_custkey % 4 = 0 THEN 'Lemnaceae' END AS family, {pick('c_custkey * 3 + c_nationkey', _GROUPS)} AS ecotox_group FROM customer"
_TW = "CASE " + " ".join(f"WHEN cl IN ({', '.join(repr(x) for x in r[0])}) OR g = '{r[1]}' THEN {i}" for i, r in enumerate(curation.TAXA)) + " WHEN k = 'plantae' OR cl IN ('magnoliopsida', 'liliopsida') OR g LIKE '%flowers%' THEN 100 WHEN k = 'fungi' OR g = 'fungi' THEN 101 END"
_TO = lambda j, other: "CASE w " + " ".join(f"WHEN {i} THEN {r[j]!r}" for i, r in enumerate(curation.TAXA)) + f" {other} END"
SPECIES_SQL = f"""WITH i AS ({SPECIES_INPUT}),
a AS (SELECT c_custkey, lower(coalesce(kingdom, '')) AS k, lower(coalesce(class, '')) AS cl, lower(coalesce(tax_order, '')) AS od, lower(coalesce(family, '')) AS fm, coalesce(ecotox_group, '') AS eg, list_filter(list_transform(string_split(coalesce(ecotox_group, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM i),
b AS (SELECT *, coalesce(list_filter(ps, lambda x: lower(x) NOT IN ('standard test species', 'u.s. invasive species', 'u.s. threatened and endangered species'))[1], ps[1], '') AS base_group FROM a),
c AS (SELECT *, lower(base_group) AS g FROM b), d AS (SELECT *, {_TW} AS w FROM c)
, e AS (SELECT *, CASE WHEN w = 100 THEN CASE WHEN od LIKE '%alismatales%' OR fm LIKE '%lemnaceae%' THEN 'aquatic_plant' ELSE 'vascular_plant' END WHEN w = 101 THEN 'fungi' WHEN cl = 'cyanophyceae' THEN 'cyanobacteria' ELSE {_TO(3, "ELSE 'unclassified'")} END AS group_l2 FROM d)
SELECT c_custkey, {_TO(2, "WHEN 100 THEN 'plant' WHEN 101 THEN 'fungi' ELSE 'unknown'")} AS group_l1, group_l2,
 CASE WHEN w IS NULL THEN coalesce(nullif(cl, ''), nullif(g, ''), 'unknown') WHEN {_TO(4, "ELSE 'class'")} = 'order' THEN coalesce(nullif(od, ''), cl) ELSE coalesce(nullif(cl, ''), group_l2) END AS group_l3,
 CAST({_TO(5, "WHEN 100 THEN 0.88 WHEN 101 THEN 0.88 ELSE 0.25")} AS DOUBLE) AS confidence, lower(eg) LIKE '%standard test species%' AS is_standard, base_group FROM e"""


_HAB_GROUPS = ["Fish", "Algae, moss", None, "Crustaceans", "Flowers, Trees, Shrubs, Ferns", "Birds", "Insects/Spiders", "Worms", "Mammals", "", "Amphibians", "Reptiles", "Fungi"]
_PHYLA = ["Cnidaria", None, "Rotifera", "Nematoda", "Arthropoda", "Mollusca", "Annelida", "Chordata", "Ascomycota"]
_HAB_CLASSES = ["Bivalvia", "Errantia", None, "Insecta", "Clitellata", "Cephalopoda", "Scaphopoda", "Aves", "Polychaeta", "Odd", "Arachnida"]
_FAMILIES = ["Chironomidae", None, "Lumbricidae", "Other", "Tubificidae"]
_HAB_ORDERS = ["Odonata", None, "Diptera"]
HABITAT_INPUT = f"SELECT p_partkey, {pick('p_partkey', _HAB_GROUPS)} AS ecotox_group, {pick('p_partkey * 5 + p_size', _PHYLA)} AS phylum_division, {pick('p_partkey * 3 + p_size', _HAB_CLASSES)} AS class, CASE WHEN p_size % 6 = 0 THEN {pick('p_partkey', _FAMILIES)} END AS family, {pick('p_size', _HAB_ORDERS)} AS tax_order FROM part"


def _case() -> str:
    inside = lambda c, members: f"{c} IN ({', '.join(repr(m) for m in members.split())})"
    out = []
    for i, (*_, group, phyla, classes, families, orders, word) in enumerate(habitat.RULES):
        any_of = [inside(c, m) for c, m in (("ph", phyla), ("cl", classes), ("fm", families)) if m] + ([f"contains(gr, '{group}')"] if group else []) + ([f"contains(al, '{word}')"] if word else [])
        out.append(f"WHEN ({' OR '.join(any_of)})" + (f" AND {inside('od', orders)}" if orders else "") + f" THEN {i}")
    return "CASE " + " ".join(out) + " END"


_LIST = lambda j: "[" + ", ".join(repr(r[j]) for r in habitat.RULES) + "]"
HABITAT_SQL = f"""WITH i AS ({HABITAT_INPUT}), l AS (SELECT p_partkey, lower(coalesce(ecotox_group, '')) AS gr, lower(coalesce(phylum_division, '')) AS ph, lower(coalesce(class, '')) AS cl, lower(coalesce(family, '')) AS fm, lower(coalesce(tax_order, '')) AS od FROM i),
a AS (SELECT *, gr || ' ' || ph || ' ' || cl || ' ' || fm || ' ' || od AS al FROM l), w AS (SELECT p_partkey, {_case()} AS w FROM a)
SELECT p_partkey, coalesce({_LIST(0)}[w + 1], 'unknown_no_reliable_evidence') AS habitat_rule, coalesce({_LIST(1)}[w + 1], 'unknown') AS habitat, coalesce({_LIST(2)}[w + 1], 'unknown') AS habitat_labels, CAST(coalesce({_LIST(3)}[w + 1], 0) AS DOUBLE) AS habitat_confidence,
 CASE WHEN w IS NULL THEN 'needs_external_review' WHEN {_LIST(4)}[w + 1] THEN 'accepted' ELSE 'review_recommended' END AS habitat_status FROM w"""
