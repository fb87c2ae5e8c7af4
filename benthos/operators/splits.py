"""Splits by hash order, closure groups, balanced assignment and leakage audits."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benthos.functions.text_rules import hash_share
from benthos.operators.balance import jittered_assignment
from benthos.operators.graph import connected_components
from benthos.operators.ranks import global_rank, range_rank  # noqa: F401
from benthos.session import materialize

PARTS = ("train", "valid", "test")


def hash_key(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("<missing>")) for k in keys]), 256)


def random_split(df: DataFrame, key: str, seed: int, fractions: tuple[float, ...], names: tuple[str, ...]) -> DataFrame:
    """Adds split_part: parts of exactly floor(n f) rows in hash order, the remainder in the last."""
    total = df.agg(F.count("*").alias("__total"))
    ranked = global_rank(df.withColumn("__k", hash_key(seed, key)), "__k").crossJoin(F.broadcast(total))
    part, upto = F.lit(names[-1]), F.lit(0)
    bounds = []
    for f in fractions[:-1]:
        upto = upto + F.floor(F.col("__total") * f)
        bounds.append(upto)
    for name, bound in reversed(list(zip(names, bounds))):
        part = F.when(F.col("rank") < bound, name).otherwise(part)
    return ranked.withColumn("split_part", part).drop("__k", "__total", "rank")


def group_split(df: DataFrame, columns: list[str], seed: int, fractions: tuple[float, ...], names: tuple[str, ...]) -> DataFrame:
    """All rows of a group in one part; a missing key is the group ``<missing>``."""
    keyed = df.withColumn("group_key", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for c in columns]))
    parts = random_split(keyed.select("group_key").distinct(), "group_key", seed, fractions, names)
    return keyed.join(parts, "group_key")


def k_folds(df: DataFrame, columns: list[str], k: int, seed: int) -> DataFrame:
    """Adds fold: rank of the group in hash order, modulo k."""
    keyed = df.withColumn("group_key", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for c in columns]))
    groups = global_rank(keyed.select("group_key").distinct().withColumn("__k", hash_key(seed, "group_key")), "__k")
    return keyed.join(groups.select("group_key", (F.col("rank") % k).cast("int").alias("fold")), "group_key")


def inherit_parts(rows: DataFrame, known: DataFrame, group: str, seed: int) -> DataFrame:
    """Part of a known group, else by its hash: below 0.64 train, below 0.80 valid, else test."""
    u = hash_share(F.lit(str(seed)), F.col(group))
    rule = F.when(u < 0.64, "train").when(u < 0.80, "valid").otherwise("test")
    return rows.join(known.select(group, F.col("split_part").alias("__known")), group, "left").withColumn("split_part", F.coalesce("__known", rule)).drop("__known")


def shared_keys(rows: DataFrame, record: str, keys: list[str], lists: list[str], scope: str | None = None) -> DataFrame:
    """(r, x): each record with a hash of every key and listed id that may join it to others, its scope in it.

    x is the first half of a SHA-256, 16 bytes, as it is shuffled and written several times.
    """
    digest = lambda *c: F.unhex(F.substring(F.sha2(F.to_json(F.array(*c)), 256), 1, 32))
    scoped = [F.col(scope).cast("string")] if scope else []
    shared = [rows.select(F.col(record).alias("r"), digest(F.lit(f"k{i}"), *scoped, F.col(k).cast("string")).alias("x")).where(F.col(k).isNotNull()) for i, k in enumerate(keys)]
    shared += [rows.select(F.col(record).alias("r"), *[x.alias("__s") for x in scoped], F.explode(c).alias("v")).where("v is not null").select("r", digest(F.lit(f"l{i}"), *([F.col("__s")] if scoped else []), F.col("v").cast("string")).alias("x")) for i, c in enumerate(lists)]
    out = shared[0]
    for x in shared[1:]:
        out = out.unionByName(x)
    return out.where("r is not null")


def grow_groups(known_keys: DataFrame, new_keys: DataFrame, records: DataFrame, parts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Closure groups after rows were added, from what the new rows touch.

    ``known_keys`` (x, group_id): the shared keys of earlier rows with their groups; ``new_keys``
    (r, x) from ``shared_keys``, ``records`` (r): the new rows; ``parts`` (group_id, part): where
    groups were put. Groups are named by their smallest record, so a group is a record as well,
    and the new rows, the groups they touch and nothing else make up the graph. Results:
    labels (r, group_id) of the new rows; renamed (old_id, group_id): touched groups that get
    another name, all others stay as they are and need not be written; keys (x, group_id): what is
    to be added to ``known_keys`` after renaming; joined (group_id, old_ids, parts): new groups
    made of several known ones that lie in different parts, which rules out keeping both.
    """
    new_keys = materialize(new_keys.select("r", "x").distinct(), "grow-keys")
    touched = materialize(new_keys.join(known_keys.select("x", "group_id").distinct(), "x").select("r", "group_id").distinct(), "grow-touched")
    least = new_keys.groupBy("x").agg(F.min("r").alias("first"), F.max("r").alias("last")).where("first != last")
    stars = new_keys.join(least, "x").where("r != first").select(F.col("r").alias("src"), F.col("first").alias("dst"))
    edges = touched.select(F.col("r").alias("src"), F.col("group_id").alias("dst")).unionByName(stars)
    label = materialize(connected_components(edges), "grow-labels")
    labels = materialize(records.select("r").distinct().join(label.withColumnRenamed("node", "r"), "r", "left").select("r", F.coalesce("component", "r").alias("group_id")), "grow-records")
    old = touched.select(F.col("group_id").alias("old_id")).distinct().join(label.withColumnRenamed("node", "old_id"), "old_id").select("old_id", F.col("component").alias("group_id"))
    old = materialize(old, "grow-old")
    out = {"labels": labels, "renamed": old.where("old_id <> group_id"), "keys": new_keys.join(labels, "r").select("x", "group_id").distinct()}
    if parts is not None:
        placed = old.join(parts.select(F.col("group_id").alias("old_id"), "part"), "old_id")
        met = placed.groupBy("group_id").agg(F.array_sort(F.collect_set("old_id")).alias("old_ids"), F.array_sort(F.collect_set("part")).alias("parts"))
        out["joined"] = met.where(F.size("parts") > 1)
    return out


def closure_groups(rows: DataFrame, record: str, keys: list[str], lists: list[str], scope: str | None = None) -> DataFrame:
    """(record, group_id): rows that share a key or a listed id, directly or through others, are one group.

    Each key or id links the records that hold it to the smallest of them; the components of
    these links are the groups, named by their smallest record. With a ``scope`` column, such as
    the route, rows of different scopes are never joined; records are unique over all scopes.
    """
    all_shared = materialize(shared_keys(rows, record, keys, lists, scope), "closure")
    # an id that many records share is a star around its smallest record: no pairs, no nodes for ids
    least = all_shared.groupBy("x").agg(F.min("r").alias("first"), F.max("r").alias("last")).where("first != last")
    edges = all_shared.join(least, "x").where("r != first").select(F.col("r").alias("src"), F.col("first").alias("dst"))
    label = connected_components(edges)
    return rows.select(record).distinct().join(label.withColumnRenamed("node", record), record, "left").select(record, F.coalesce("component", record).alias("group_id"))


def _sha(*x: object) -> str:
    return hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()


def deal_equal_steps(first: list[float], step: list[float], k: int, order: list) -> list[int]:
    """How often each part is chosen when k times the part with the least value is, and its value then grows by its step.

    The k least numbers of the progressions first[p], first[p] + step[p], ... (ties by
    ``order``), found by halving a threshold and choosing the last few one by one.
    """
    taken = lambda x: [max(0, math.floor((x - a) / d) + 1) if x >= a else 0 for a, d in zip(first, step)]
    low, high = min(first) - 1.0, min(first) + min(step) * (k + 1)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(taken(middle)) <= k else (low, middle)
    counts = taken(low)
    for _ in range(k - sum(counts)):
        best = min(range(len(first)), key=lambda p: (first[p] + counts[p] * step[p], order[p]))
        counts[best] += 1
    return counts


def _deal(groups: DataFrame, keys: list[str], counts: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Groups of one kind (``keys``) to parts in hash order: the first counts[0] to the first part, and so on."""
    ranked = global_rank(groups.withColumn("__k", hash_key(seed, "group_id")), "__k", keys).join(counts, keys)
    part, upto = F.lit(None).cast("string"), F.lit(0)
    bounds = []
    for i in range(len(names)):
        upto = upto + F.col("counts")[i]
        bounds.append(upto)
    for name, bound in reversed(list(zip(names, bounds))):
        part = F.when(F.col("rank") < bound, name).otherwise(part)
    return ranked.withColumn("split_part", part).drop("__k", "rank", "counts")


def group_profiles(groups: DataFrame, scope: str) -> DataFrame:
    """(scope, group_id, profile, size): each group's rows per head, heads in order."""
    per = groups.groupBy(scope, "group_id").agg(F.array_sort(F.collect_list(F.struct("head", "n"))).alias("heads"), F.sum("n").alias("size"))
    return per.withColumn("profile", F.sha2(F.to_json("heads"), 256))


def balanced_assignment(groups: DataFrame, fractions: tuple[float, ...], seed: int, scope: str = "route", names: tuple[str, ...] = PARTS) -> DataFrame:
    """(scope, group_id, split_part): largest group first, to the part whose squared deviation per head grows least.

    ``groups`` has one row per (scope, group_id, head) with n. Groups of one profile (the same
    rows per head) are alike to this rule, so Spark counts them, and the sequential choice runs
    over the distinct profiles: sizes fall, ties go by the profile's hash, and all groups of a
    profile are placed at once, since the k choices are the k least numbers of one arithmetic
    progression per part. Heads that no group links have nothing to do with one another: each
    connected set of heads is a task of its own. Within a profile, groups are dealt to the parts
    by hash rank. A task holds the distinct profiles of its heads, never groups or rows.
    """
    kind = dict(groups.dtypes)
    fractions = tuple(fractions)
    per = materialize(group_profiles(groups, scope), "profiles")
    kinds = materialize(per.groupBy(scope, "profile").agg(F.first("heads").alias("heads"), F.first("size").alias("size"), F.count("*").alias("k")), "profile-kinds")
    links = kinds.select(scope, F.col("heads")[0]["head"].cast("string").alias("a"), F.explode(F.transform("heads", lambda h: h["head"].cast("string"))).alias("b")).distinct()

    def join_heads(pdf: pd.DataFrame) -> pd.DataFrame:
        up = {h: h for h in [*pdf["a"], *pdf["b"]]}

        def find(x: str) -> str:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for x, y in zip(pdf["a"], pdf["b"]):
            x, y = sorted((find(x), find(y)))
            up[y] = x
        return pd.DataFrame([(pdf[scope].iloc[0], h, find(h)) for h in up], columns=[scope, "head", "heads_of"])

    # a row per pair of heads that meet in a profile: a table of heads
    sets = links.groupBy(scope).applyInPandas(join_heads, f"{scope} {kind[scope]}, head string, heads_of string")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        profiles = [(r["profile"], [(h["head"], h["n"]) for h in r["heads"]], r["size"], int(r["k"])) for r in pdf.to_dict("records")]
        totals: dict = {}
        for _, heads, _, k in profiles:
            for h, n in heads:
                totals[h] = totals.get(h, 0.0) + n * k
        have = {h: [0.0] * len(fractions) for h in totals}
        out = []
        for name, heads, _, k in sorted(profiles, key=lambda x: (-x[2], _sha(seed, x[0]))):
            first, step = [0.0] * len(fractions), [0.0] * len(fractions)
            for p, f in enumerate(fractions):
                for h, n in heads:
                    goal = totals[h] * f
                    first[p] += n * (2 * (have[h][p] - goal) + n) / max(goal, 1.0)
                    step[p] += 2 * n * n / max(goal, 1.0)
            counts = deal_equal_steps(first, step, k, [_sha(seed, name, p) for p in range(len(fractions))])
            for h, n in heads:
                for p, c in enumerate(counts):
                    have[h][p] += n * c
            out.append((pdf[scope].iloc[0], name, counts))
        return pd.DataFrame(out, columns=[scope, "profile", "counts"])

    placed = kinds.join(sets, (kinds[scope] == sets[scope]) & (F.col("heads")[0]["head"].cast("string") == F.col("head"))).select(kinds[scope], "profile", "heads", "size", "k", "heads_of")
    counts = placed.groupBy(scope, "heads_of").applyInPandas(assign, f"{scope} {kind[scope]}, profile string, counts array<long>")
    return _deal(per.select(scope, "group_id", "profile"), [scope, "profile"], materialize(counts, "profile-parts"), list(names), seed).select(scope, "group_id", "split_part")


def _by_size(groups: DataFrame, choose, names: list[str], seed: int) -> DataFrame:
    """(group_id, n, split_part): ``choose`` gets the distinct sizes, largest first, with their counts, and gives counts per part."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ascending=False)
        return pd.DataFrame({"n": pdf["n"], "counts": choose(pdf["n"].tolist(), pdf["k"].astype(int).tolist())})

    # distinct sizes: fewer than the square root of twice the rows
    sizes = groups.groupBy("n").agg(F.count("*").alias("k"))
    counts = sizes.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(assign, f"n {dict(groups.dtypes)['n']}, counts array<long>")
    return _deal(groups.select("group_id", "n"), ["n"], materialize(counts, "sizes"), names, seed)


def holdout_assignment(groups: DataFrame, test_fraction: float, seed: int) -> DataFrame:
    """(group_id, n, split_part): largest group first, to test where that brings its rows no further from their target.

    Groups of one size are taken in hash order. If none fits, the largest one is the test part.
    """

    def choose(sizes: list[float], counts: list[int]) -> list[list[int]]:
        target, test, out = sum(n * k for n, k in zip(sizes, counts)) * test_fraction, 0.0, []
        for n, k in zip(sizes, counts):
            m = min(k, max(0, math.floor((target - test) / n + 0.5))) if test <= target else 0
            test += m * n
            out.append([m, k - m])
        if out and not test:
            out[0] = [1, counts[0] - 1]
        return out

    return _by_size(groups, choose, ["test", "train"], seed)


def fold_assignment(groups: DataFrame, folds: int, seed: int) -> DataFrame:
    """(group_id, n, split_part): largest group first, to the lightest fold (its number as text); ties by hash."""

    def choose(sizes: list[float], counts: list[int]) -> list[list[int]]:
        have, out = [0.0] * folds, []
        for n, k in zip(sizes, counts):
            dealt = deal_equal_steps(have, [n] * folds, k, [_sha(seed, n, p) for p in range(folds)])
            have = [a + n * c for a, c in zip(have, dealt)]
            out.append(dealt)
        return out

    return _by_size(groups, choose, [str(i) for i in range(folds)], seed)


def fraction_assignment(groups: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    """(group_id, n, split_part): largest group first, to the part that it brings closest to its target, relative to that.

    Then the emptier part, then the name. Runs of groups of one size that one part keeps
    winning are placed at once.
    """
    if len(fractions) < 2 or min(fractions.values()) <= 0 or abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must be positive, two at least, and sum to 1")
    if set(fractions) == {"train", "test"}:
        return holdout_assignment(groups, fractions["test"], seed)
    names = list(fractions)

    def choose(sizes: list[float], counts: list[int]) -> list[list[int]]:
        total = sum(n * k for n, k in zip(sizes, counts))
        goal, have, out = {p: total * f for p, f in fractions.items()}, dict.fromkeys(names, 0.0), []
        for n, k in zip(sizes, counts):
            dealt = dict.fromkeys(names, 0)
            while k:
                best = min(names, key=lambda p: (abs(have[p] + n - goal[p]) / max(goal[p], 1.0), have[p] / max(goal[p], 1.0), p))
                run = min(k, max(1, int((goal[best] - have[best]) // n)))  # short of its target it only gets closer
                dealt[best] += run
                have[best] += run * n
                k -= run
            out.append([dealt[p] for p in names])
        return out

    return _by_size(groups, choose, names, seed)


def boundary_keys(rows: DataFrame, boundaries: dict[str, list[str]], single: tuple[str, ...] = (), labels: tuple[str, ...] = ("target", "split_part")) -> DataFrame:
    """Adds a key per boundary: the hash of its columns as a JSON list of texts, missing ones as empty texts.

    Label columns may not be part of a key. A boundary with a column of ``single`` is refused
    (an error when it runs) for rows whose column holds a JSON list, so more than one value.
    """
    out = rows
    for name, columns in boundaries.items():
        if taken := sorted(set(columns) & set(labels)):
            raise ValueError(f"boundary {name} uses label columns: {', '.join(taken)}")
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
        key = F.sha2(F.to_json(F.array(*texts)), 256)
        for c in set(columns) & set(single):
            key = F.when(F.col(c).cast("string").startswith("["), F.raise_error(F.lit(f"boundary {name}: several values in {c}"))).otherwise(key)
        out = out.withColumn(name, key)
    return out


def set_digest(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, n, digest): a hash of the set of rows that needs no sort: the sum of the rows' hashes, and their number."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*"), F.sum(h)), 256).alias("digest"))


def boundary_suite(rows: DataFrame, record: str, head: str, scope: str, boundaries: dict[str, tuple[list[str], list[str]]], fractions: tuple[float, ...], seed: int, minima: dict[str, int], attempts: int = 0) -> tuple[DataFrame, DataFrame]:
    """Parts under several boundaries, and their audit.

    With ``attempts``, the best of so many jittered placements per boundary (its number is in
    the audit as ``attempt``); without, one placement by size, and a null attempt.

    ``boundaries`` names for each the key columns and the id list columns that may not cross
    parts. First frame: (boundary, scope, record, group_id, head, split_part). Second, per boundary and
    part: rows, groups, ids that cross parts (an error when it runs, if any does), heads with
    support in all parts, and a digest of the records.
    """
    done, audits = None, None
    for name, (keys, lists) in boundaries.items():
        groups = closure_groups(rows, record, keys, lists, scope=scope)
        g = rows.join(groups, record).withColumnRenamed(head, "head")
        counted = g.groupBy(scope, "group_id", "head").agg(F.count("*").cast("double").alias("n"))
        if attempts:
            parts = jittered_assignment(counted, fractions, seed, scope, attempts=attempts)
        else:
            parts = balanced_assignment(counted, fractions, seed, scope).withColumn("attempt", F.lit(None).cast("int"))
        placed = materialize(g.join(parts, [scope, "group_id"]), "boundary")
        ids = [placed.select(scope, "split_part", F.concat(F.lit(f"{c}:"), F.col(c).cast("string")).alias("id")) for c in keys]
        ids += [placed.select(scope, "split_part", F.explode(c).alias("id")).withColumn("id", F.concat(F.lit(f"{c}:"), F.col("id").cast("string"))) for c in lists]
        every = ids[0]
        for x in ids[1:]:
            every = every.unionByName(x)
        across = every.withColumn("id", F.concat_ws("|", scope, "id"))
        n_cross = crossing(across, "id").select(F.when(F.col("n_crossing") > 0, F.raise_error(F.lit(f"{name}: ids cross parts"))).otherwise(F.col("n_crossing")).cast("long").alias("n_crossing"))
        supported = support(placed.withColumn("__h", F.concat_ws("|", scope, "head")), "__h", minima).agg(F.count_if("eligible").alias("n_heads_supported"))
        audit = placed.groupBy("split_part").agg(F.first("attempt").alias("attempt"), F.count("*").alias("n"), F.countDistinct(scope, "group_id").alias("n_groups"), F.countDistinct(scope, "head").alias("n_heads"))
        audit = audit.join(set_digest(placed, [scope, record], ["split_part"]).select("split_part", "digest"), "split_part").crossJoin(n_cross).crossJoin(supported)  # one row each
        placed, audit = (x.withColumn("boundary", F.lit(name)) for x in (placed.select(scope, record, "group_id", "head", "split_part"), audit))
        done, audits = (placed, audit) if done is None else (done.unionByName(placed), audits.unionByName(audit))
    return done, audits


# The experiment suite, code -> (name, kind, fractions or folds).
SUITE = {
    "A": ("A_random_adapt_7_2_1", "random", {"train": 0.7, "finetune": 0.2, "test": 0.1}),
    "B": ("B_random_8_2", "random", {"train": 0.8, "test": 0.2}),
    "C": ("C_chemical_holdout_8_2", "group", {"train": 0.8, "test": 0.2}),
    "D": ("D_chemical_group_5fold", "group", 5),
    "E": ("E_random_5fold", "random", 5),
    "F": ("F_chemical_group_7_2_1", "group", {"train": 0.7, "finetune": 0.2, "test": 0.1}),
}


def split_suite(rows: DataFrame, record: str, group: str, seed: int, codes: str = "ABCDEF", min_rows: int = 0) -> DataFrame:
    """(record, split_name, split_part) of the named experiment splits; a fold k gives a split of its own, ``_fold_k``.

    Fewer rows than ``min_rows`` are an error. In a fold's split, its rows are test and all others train.
    """
    if unknown := sorted(set(codes) - set(SUITE)):
        raise ValueError(f"unknown split codes: {', '.join(unknown)}")
    if min_rows and (n := rows.count()) < min_rows:
        raise ValueError(f"{n} rows, below the minimum of {min_rows}")
    rows, out = rows.select(record, group), None
    for code in codes:
        name, kind, parts = SUITE[code]
        if isinstance(parts, dict):
            names, fractions = tuple(parts), tuple(parts.values())
            got = random_split(rows, record, seed, fractions, names) if kind == "random" else group_split(rows, [group], seed, fractions, names)
            got = got.select(record, F.lit(name).alias("split_name"), "split_part")
        else:
            folds = materialize(k_folds(rows, [record if kind == "random" else group], parts, seed).select(record, "fold"), "folds")
            each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k")
            got = folds.select(record, "fold", each).select(record, F.format_string(f"{name}_fold_%d", F.col("k") + 1).alias("split_name"), F.when(F.col("k") == F.col("fold"), "test").otherwise("train").alias("split_part"))
        out = got if out is None else out.unionByName(got)
    return out


def named_split(rows: DataFrame, split_type: str, record: str, seed: int, fractions: dict[str, float], chemical: str = "", species: str = "", medium: Column | None = None) -> DataFrame:
    """(record, split_part, group_key) of one of five split types.

    random_split, chemical_split, species_split, chemical_species_split (both as one group) and
    medium_transfer_split, whose ``medium`` column holds the part already (see medium_part).
    """
    names, shares = tuple(fractions), tuple(fractions.values())
    columns = {"chemical_split": [chemical], "species_split": [species], "chemical_species_split": [chemical, species]}
    if split_type == "random_split":
        return random_split(rows.select(record), record, seed, shares, names).select(record, "split_part", F.lit(None).cast("string").alias("group_key"))
    if split_type in columns:
        return group_split(rows.select(record, *columns[split_type]), columns[split_type], seed, shares, names).select(record, "split_part", "group_key")
    if split_type == "medium_transfer_split" and medium is not None:
        return rows.select(record, medium.alias("split_part"), F.lit(None).cast("string").alias("group_key"))
    raise ValueError(f"unknown split type {split_type}")


def crossing(assignments: DataFrame, ids: str, part: str = "split_part") -> DataFrame:
    """(n_ids, n_crossing): distinct ids, and those found in more than one part."""
    per = assignments.groupBy(ids).agg(F.countDistinct(part).alias("p"))
    return per.agg(F.count("*").alias("n_ids"), F.coalesce(F.sum((F.col("p") > 1).cast("bigint")), F.lit(0)).alias("n_crossing"))


def support(assignments: DataFrame, head: str, minima: dict[str, int]) -> DataFrame:
    """Rows per head and part, and the reasons why a head is not eligible."""
    g = assignments.groupBy(head).agg(*[F.count_if(F.col("split_part") == p).alias(f"n_{p}") for p in minima])
    reasons = F.array_compact(F.array(*[F.when(F.col(f"n_{p}") < m, f"{p}_below_{m}") for p, m in minima.items()]))
    return g.withColumn("reasons", F.array_join(reasons, ";")).withColumn("eligible", F.col("reasons") == "")
