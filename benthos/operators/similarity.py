"""Packed fingerprints, Tanimoto search and similarity clusters.

A fingerprint is a list of distinct bit positions (``bits``); ``words`` packs it into 64-bit
words, on which set sizes are bit counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benthos.functions.distinct import by_distinct
from benthos.operators import splits as P
from benthos.operators.graph import connected_components
from benthos.operators.nearest import costly, links_in_blocks, nearest_sets, nearest_train
from benthos.operators.ranks import range_rank
from benthos.session import materialize


def pack(bits: Column, width: int) -> Column:
    one = F.lit(1).cast("bigint")
    word = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", one, (b % 64).cast("int"))))
    return F.array(*[word(w) for w in range(-(-width // 64))])


def gram_bits(text: Column, width: int, longest: int = 3) -> Column:
    """Bit positions of a text's distinct character n-grams (n = 1..longest), placed by MD5."""
    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*[of_length(n) for n in range(1, longest + 1)]))
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(grams), lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % width).cast("int"))))


#: Texts that a task of ``with_gram_bits`` is sized for.
GRAM_TEXTS = 2000


def with_gram_bits(df: DataFrame, text: str, name: str, width: int, longest: int = 3) -> DataFrame:
    """Adds ``name``: the gram_bits of column ``text``, once per distinct text; as many tasks as there are texts for.

    Short texts make small files, so tasks that follow their bytes would be few and long.
    """
    def rule(texts: DataFrame) -> DataFrame:
        texts = materialize(texts, "gram-texts")
        dealt = texts.repartition(max(1, math.ceil(texts.count() / GRAM_TEXTS)))
        return dealt.withColumn(name, gram_bits(F.col(text), width, longest))

    return by_distinct(df, [text], rule)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def shared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def unpack(words: Column) -> Column:
    """The bit positions that are set in packed words."""
    place = F.sequence(F.lit(0), 64 * F.size(words) - 1)
    return F.when(F.size(words) > 0, F.filter(place, lambda i: F.getbit(F.get(words, F.floor(i / 64).cast("int")), i % 64) == 1)).otherwise(F.array().cast("array<int>"))


def best_other_tanimoto(queries: DataFrame, references: DataFrame, top: int = 5, report: list | None = None) -> DataFrame:
    """(query_id, max_similarity, other_similarity, top_mean): a stated query set against all rows with other ids.

    queries (query_id, words), references (id, words); 0/0 counts as 0, and a query without any
    other row is left out. max_similarity is over all other rows; other_similarity leaves out
    rows whose fingerprint is the query's own (the exact parent), and top_mean is the mean over
    the ``top`` most similar distinct fingerprints of these; both are null if there are none.
    References are reduced to distinct words with their smallest and largest id, which tell
    whether a row equal to the query has another id; ``nearest_sets`` finds the best of them by
    falling thresholds, and says in ``report`` how many pairs it looked at.
    """
    r = references.groupBy("words").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    r = materialize(r.select("words", "lo", "hi", unpack(F.col("words")).alias("bits")), "tanimoto")
    q = materialize(queries.select("query_id", "words", unpack(F.col("words")).alias("bits")), "tanimoto")
    n_refs = r.count()
    sets = lambda df: df.where(F.size("bits") > 0).select(F.lit("").alias("scope"), "bits")
    best = nearest_sets(sets(q), sets(r), top, scan=True, report=report).select("bits", "best")
    own = q.join(r.select("words", "lo", "hi"), "words", "left").join(best, "bits", "left").withColumn("best", F.coalesce("best", F.array().cast("array<double>")))
    n_other = F.lit(n_refs) - F.when(F.col("lo").isNotNull(), 1).otherwise(0)
    other = F.when(n_other > 0, F.coalesce(F.get("best", F.lit(0)), F.lit(0.0)))
    mean = F.when(n_other > 0, F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.least(n_other, F.lit(top)))
    equal = F.when((F.col("lo") != F.col("query_id")) | (F.col("hi") != F.col("query_id")), F.when(F.size("bits") > 0, 1.0).otherwise(0.0))
    return own.select("query_id", F.greatest(equal, other).alias("max_similarity"), other.alias("other_similarity"), mean.alias("top_mean")).where("max_similarity is not null")


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over all rows, by their population deviation (1 where that vanishes)."""
    sd = lambda c: F.when(F.stddev_pop(c) > 1e-12, F.stddev_pop(c)).otherwise(1.0)
    s = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), sd(c).alias(f"__s_{c}"))])
    return rows.crossJoin(F.broadcast(s)).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in columns}).drop(*s.columns)  # one row


def similar_links(fps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: pairs of (id, bits) with Tanimoto at the threshold or above.

    Ids with one fingerprint are reduced to the smallest, which is paired with each of them.
    Bits are put in the order of their frequency, rarest first (a list as long as a fingerprint
    is wide). Exact prefix filter: with t the threshold, a set of n bits shares one of its first
    n - ceil(t n) + 1 bits with any partner, and so does the partner. Pairs meet on such a bit
    and a band of sizes only, must have enough bits from there on for the overlap that the
    threshold asks for, and are confirmed on all bits. Where bits are so common that such
    meetings cost more than comparing blocks of packed sets does, all pairs are compared so.
    """
    fps = fps.select("id", F.array_sort("bits").alias("bits")).where(F.size("bits") > 0)
    classes = materialize(fps.groupBy("bits").agg(F.min("id").alias("id"), F.count("*").alias("k")), "fingerprints")
    copies = fps.join(classes.where("k > 1").select("bits", F.col("id").alias("a")), "bits").where("id != a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    often = {r[0]: r[1] for r in classes.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*")).collect()}  # a row per bit position
    order = sorted(often, key=lambda x: (often[x], x))
    place = [0] * (max(order, default=0) + 1)
    for i, x in enumerate(order):
        place[x] = i
    rank = F.array(*[F.lit(x) for x in place])
    sized = classes.select("id", "bits", F.size("bits").alias("n"), F.array_sort(F.transform("bits", lambda x: F.get(rank, x))).alias("ranked"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)) if threshold < 1 else F.col("n")
    prefix = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    keys = sized.select("id", "n", band.cast("int").alias("band"), F.posexplode(F.slice("ranked", F.lit(1), prefix)).alias("at", "bit"))
    left = keys.select("bit", "band", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    right = keys.select("bit", near.alias("band"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    per = ["bit", "band"]
    meetings = left.groupBy(*per).agg(F.count("*").alias("x")).join(right.groupBy(*per).agg(F.count("*").alias("y")), per).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    if costly(meetings, classes.count() ** 2):
        return links_in_blocks(classes.select("id", "bits"), threshold).unionByName(copies)
    need = (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
    met = left.join(right, ["bit", "band"]).where(fits).select("a", "b").distinct()
    full = met.join(sized.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(sized.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
    s = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    found = materialize(full.select("a", "b", s.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12), "similar-classes")
    # links of classes, and of each class with its copies: every link between different fingerprints is there once
    return found.unionByName(copies)


def similar_pairs(fps: DataFrame, threshold: float) -> DataFrame:
    """The links of ``similar_links`` with copies expanded: every (a, b, similarity), a < b. As many rows as there are such pairs."""
    classes = fps.where(F.size("bits") > 0).groupBy(F.array_sort("bits").alias("bits")).agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids"))
    members = classes.select("rep", F.explode("ids").alias("id"))
    side = lambda x, y: members.select(F.col("rep").alias(x), F.col("id").alias(y))
    across = similar_links(fps, threshold).where("similarity < 1").join(side("a", "x"), "a").join(side("b", "y"), "b")
    within = side("rep", "x").join(side("rep", "y"), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return across.select("x", "y", "similarity").unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def butina_clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, centroid): repeatedly the node with most free neighbours takes them; ties go to the larger id.

    Neighbour counts are renewed after each pick. A node that is the largest (count, id)
    within two steps can be picked at once with all others that are, so a round picks many; a
    round always picks the largest of all, so the rounds end.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    edges = materialize(pairs.select(both).select("e.a", "e.b"), "butina")
    linked = materialize(edges.select(F.col("a").alias("id")).distinct(), "butina")
    # a node without neighbours is its own cluster, whatever happens around it
    done = nodes.select("id").join(linked, "id", "left_anti").select("id", F.col("id").alias("centroid"))
    free = linked
    while not free.isEmpty():
        deg = free.join(edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.struct(F.coalesce("d", F.lit(0)).alias("d"), "id").alias("k"))
        near = lambda m: edges.join(m.select(F.col("id").alias("b"), "k"), "b").select(F.col("a").alias("id"), "k").unionByName(m).groupBy("id").agg(F.max("k").alias("k"))
        top = near(near(deg))
        picked = materialize(top.where("k.id = id").select(F.col("id").alias("centroid")), "butina")
        taken = picked.select(F.col("centroid").alias("id"), "centroid").unionByName(edges.join(picked, F.col("a") == F.col("centroid")).select(F.col("b").alias("id"), "centroid"))
        taken = materialize(taken, "butina")
        done = done.unionByName(taken)
        free = materialize(free.join(taken, "id", "left_anti"), "butina")
        edges = materialize(edges.join(free.select(F.col("id").alias("a")), "a", "left_semi").join(free.select(F.col("id").alias("b")), "b", "left_semi"), "butina")
    return done


def structure_groups(chemicals: DataFrame, threshold: float) -> DataFrame:
    """(id, group_id): similarity clusters and scaffolds, joined wherever they share a chemical.

    ``chemicals`` has (id, bits, scaffold); equal fingerprints are one cluster through their
    smallest id. A missing scaffold or an empty fingerprint joins nothing.
    """
    fps = chemicals.select("id", F.array_sort("bits").alias("bits"))
    reps = materialize(fps.where(F.size("bits") > 0).groupBy("bits").agg(F.min("id").alias("id")), "structures")
    clusters = butina_clusters(reps, similar_links(reps, threshold))
    own = fps.join(reps.withColumnRenamed("id", "rep"), "bits").select("id", "rep")
    stars = chemicals.where("scaffold is not null and scaffold <> ''").select("id", "scaffold")
    first = stars.groupBy("scaffold").agg(F.min("id").alias("dst"))
    edges = clusters.select(F.col("id").alias("src"), F.col("centroid").alias("dst")).unionByName(own.select(F.col("id").alias("src"), F.col("rep").alias("dst"))).unionByName(stars.join(first, "scaffold").select(F.col("id").alias("src"), "dst"))
    label = connected_components(edges).withColumnRenamed("node", "id")
    return chemicals.select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))


def scaffold_cluster_job(chemicals: DataFrame, rows: DataFrame, threshold: float, test_fraction: float, folds: int, seed: int) -> dict[str, DataFrame]:
    """Groups, a holdout split, folds and their audits, for (id, bits, scaffold) and rows (id, row_id).

    groups: (group_id, group_key, n_rows, n_members), keys numbered from the largest group on;
    assignments: (row_id, id, group_key, split_part, fold); overlap: groups found in more than one
    part or fold (0 expected); parts: rows, members and groups per part; similarity: the best
    similarity to a training chemical of each test chemical that has a fingerprint (id, test_part, best).
    """
    label = materialize(structure_groups(chemicals, threshold), "groups")
    per = rows.groupBy("id").agg(F.count("*").alias("rows")).join(label, "id", "right")
    sizes = per.groupBy("group_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_members"))
    ranked = range_rank(sizes, [F.col("n_rows").desc(), F.col("group_id").asc()])
    groups = materialize(ranked.select("group_id", F.format_string("structure_group_%05d", F.col("rank") + 1).alias("group_key"), "n_rows", "n_members"), "groups")
    counted = groups.where("n_rows > 0").select(F.col("group_key").alias("group_id"), F.col("n_rows").cast("double").alias("n"))
    holdout = P.holdout_assignment(counted, test_fraction, seed).select(F.col("group_id").alias("group_key"), "split_part")
    fold = P.fold_assignment(counted, folds, seed).select(F.col("group_id").alias("group_key"), F.col("split_part").cast("int").alias("fold"))
    placed = groups.join(holdout, "group_key").join(fold, "group_key")
    assignments = materialize(rows.join(label, "id").join(placed, "group_id").select("row_id", "id", "group_key", "split_part", "fold"), "assignments")
    crossing = assignments.groupBy("group_key").agg(F.countDistinct("split_part").alias("p"), F.countDistinct("fold").alias("f")).agg(F.count("*").alias("n_groups"), F.count_if((F.col("p") > 1) | (F.col("f") > 1)).alias("n_crossing"))
    parts = assignments.groupBy("split_part").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_members"), F.countDistinct("group_key").alias("n_groups"))
    nearest = nearest_train(chemicals, assignments.select(F.lit("holdout").alias("split_name"), "id", "split_part")).select("id", "test_part", F.col("max_similarity").alias("best"))
    return {"groups": groups, "assignments": assignments, "overlap": crossing, "parts": parts, "similarity": nearest}
