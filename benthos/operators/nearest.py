"""Exact nearest fingerprints by falling thresholds, and nearest points by cells of a k-d partition."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benthos.session import materialize

#: A meeting on a bit is a shuffled row, a pair of packed sets in a block some nanoseconds: from so many meetings a
#: pair on, all pairs are compared in blocks. So many meetings in all are cheap in any case.
MEETINGS_PER_PAIR, FREE_MEETINGS = 1 / 32, 1_000_000
#: Sets of a block at least, blocks that it takes to make them larger, and sets of a block that meet another block at once.
BLOCK_SETS, MANY_BLOCKS, TILE_SETS = 4096, 256, 64
#: Similarities at which queries may be settled, one round each; then whatever shares a bit.
THRESHOLDS = (0.9, 0.75, 0.6, 0.45, 0.3, 0.15)


#: Bits that two similar sets must share among their rarest ones to be compared.
COMMON = 6


def _meets(side: DataFrame, threshold: float, name: str, near: bool) -> DataFrame:
    """(scope, bit, band, name, n): the bits by which a set meets any partner of that similarity, rarest first.

    Two sets of similarity t share t n bits of a set of n, all but COMMON - 1 of which may lie
    beyond its first n - ceil(t n) + COMMON bits; the first COMMON that they share lie in both
    prefixes. Sizes differ by a factor of t at most, so by one band of sizes.
    """
    n = F.size("ranked")
    if threshold > 0:
        band = F.floor(F.log(n.cast("double")) / math.log(1 / threshold)).cast("int")
        bits = F.slice("ranked", F.lit(1), F.least(n, n - F.ceil(n * threshold - 1e-9) + COMMON).cast("int"))
    else:
        band, bits = F.lit(0), F.col("ranked")
    bands = F.explode(F.array(band - 1, band, band + 1)) if near and threshold > 0 else band
    return side.select("scope", F.col("key").alias(name), n.alias(f"n{name}"), bands.alias("band"), F.explode(bits).alias("bit"))


def costly(meetings: int, pairs: int) -> bool:
    """Whether pairs are better compared in blocks than by the bits on which they meet."""
    return meetings > FREE_MEETINGS and meetings >= MEETINGS_PER_PAIR * pairs


def set_blocks(sets: DataFrame, label: str, width: int, n: int) -> DataFrame:
    """(scope, block, label, words): distinct sets (scope, ``label``, bits) as blocks of packed bits, dealt by hash, ``n`` in all."""
    blocks = max(1, math.ceil(n / max(BLOCK_SETS, n // MANY_BLOCKS)))
    wide = -(-width // 64) * 64
    kinds = dict(sets.dtypes)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(pdf), wide), np.uint8)
        dense[np.repeat(np.arange(len(pdf)), [len(b) for b in pdf["bits"]]), np.concatenate(pdf["bits"].to_list())] = 1
        return pd.DataFrame({"scope": pdf["scope"].iloc[:1], "block": pdf["block"].iloc[:1], label: [pdf[label].to_list()], "words": [np.packbits(dense, axis=1, bitorder="little").tobytes()]})

    dealt = sets.select("scope", label, "bits", F.pmod(F.xxhash64("scope", "bits"), F.lit(blocks)).cast("int").alias("block"))
    return materialize(dealt.groupBy("scope", "block").applyInPandas(packed, f"scope {kinds['scope']}, block int, {label} array<{kinds[label]}>, words binary"), "set-blocks")


def unpacked(words: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed sets of a block, a row each, and their sizes."""
    x = np.frombuffer(words, np.uint64).reshape(n, -1)
    return x, np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def shared_counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits each set of x shares with each set of y."""
    out = np.bitwise_count(x[:, None, 0] & y[None, :, 0])
    if x.shape[1] > 3:
        out = out.astype(np.int32)
    for w in range(1, x.shape[1]):
        out += np.bitwise_count(x[:, None, w] & y[None, :, w])
    return out


def best_in_blocks(queries: DataFrame, references: DataFrame, top: int) -> DataFrame:
    """(scope, a, s): of each query set (scope, a, bits) the ``top`` best similarities to other sets of each block of references.

    Each row of the joined blocks is one task's piece of work: a block of queries and one of
    references, packed, some 100 KB; all pairs are compared, and none is a row.
    """
    width = queries.select("bits").unionByName(references.select("bits")).agg(F.max(F.array_max("bits"))).first()[0]
    if width is None:
        return queries.select("scope", "a", F.lit(0.0).alias("s")).limit(0)
    left = set_blocks(queries, "a", width + 1, queries.count())
    right = set_blocks(references.select("scope", F.lit(0).cast("tinyint").alias("b"), "bits"), "b", width + 1, references.count())
    work = left.join(right.select("scope", "b", F.col("words").alias("others")), "scope")
    work = work.repartition(max(1, left.count() * right.count()))
    kinds = dict(queries.dtypes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, nx = unpacked(r["words"], len(r["a"]))
                y, ny = unpacked(r["others"], len(r["b"]))
                best = np.zeros((len(x), min(top, len(y))))
                for at in range(0, len(x), TILE_SETS):
                    both = shared_counts(x[at : at + TILE_SETS], y).astype(np.int32)
                    s = both / (nx[at : at + TILE_SETS, None] + ny[None, :] - both)
                    s[s == 1.0] = 0.0  # the set itself
                    best[at : at + TILE_SETS] = np.partition(s, s.shape[1] - best.shape[1], axis=1)[:, s.shape[1] - best.shape[1] :]
                row, col = np.nonzero(best)
                keys = pa.array(r["a"], batch.schema.field("a").type.value_type).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array([r["scope"]] * len(row), batch.schema.field("scope").type), keys, pa.array(best[row, col])], ["scope", "a", "s"])

    return work.select("scope", "a", "words", "b", "others").mapInArrow(compare, f"scope {kinds['scope']}, a {kinds['a']}, s double")


def links_in_blocks(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of distinct sets (id, bits) of that similarity, every block compared with every other."""
    width = sets.agg(F.max(F.array_max("bits"))).first()[0]
    n = sets.count()
    blocks = set_blocks(sets.select(F.lit("").alias("scope"), "id", "bits"), "id", width + 1, n).drop("scope")
    other = blocks.select(F.col("block").alias("block2"), F.col("id").alias("id2"), F.col("words").alias("words2"))
    k = blocks.count()
    work = blocks.join(other, F.col("block") <= F.col("block2")).repartition(max(1, k * (k + 1) // 2))
    kind = dict(sets.dtypes)["id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_id = batch.schema.field("id").type.value_type
            for r in batch.to_pylist():
                x, nx = unpacked(r["words"], len(r["id"]))
                y, ny = unpacked(r["words2"], len(r["id2"]))
                ids, others = np.array(r["id"]), np.array(r["id2"])
                same = r["block"] == r["block2"]
                need = np.ceil((np.arange(nx.max() + ny.max() + 1)) * (threshold / (1 + threshold)) - 1e-9)
                need = need.astype(np.uint8 if x.shape[1] <= 3 else np.int32)
                out, held = [], 0
                for at in range(0, len(x), TILE_SETS):
                    own = nx[at : at + TILE_SETS]
                    both = shared_counts(x[at : at + TILE_SETS], y)
                    level, place = np.unique(own, return_inverse=True)
                    row, col = np.nonzero(both >= need[level[:, None] + ny[None, :]][place])
                    met = both[row, col].astype(np.int32)
                    s = met / (own[row] + ny[col] - met)
                    a, b = ids[at + row], others[col]
                    keep = (s >= threshold - 1e-12) & ((a < b) if same else (a != b))
                    out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep]))
                    held += int(keep.sum())
                    if held >= 50_000 or at + TILE_SETS >= len(x):
                        a, b, s = (np.concatenate(c) for c in zip(*out))
                        yield pa.RecordBatch.from_arrays([pa.array(a, of_id), pa.array(b, of_id), pa.array(s, pa.float64())], ["a", "b", "similarity"])
                        out, held = [], 0

    return work.select("block", "id", "words", "block2", "id2", "words2").mapInArrow(compare, f"a {kind}, b {kind}, similarity double")


def nearest_sets(queries: DataFrame, references: DataFrame, top: int = 1, scan: bool = False, report: list | None = None) -> DataFrame:
    """(scope, bits, best): for each distinct query set its ``top`` most similar other reference sets, as similarities.

    queries and references (scope, bits), bits sorted and not empty; sets meet within their
    scope, a set does not meet its equal. ``best`` holds the similarities of the distinct
    reference sets, largest first, without those that share no bit. Nothing is approximate: a
    round at threshold t finds every reference of similarity t or more, so queries that have
    ``top`` of them are settled; only the others go on to a lower one, and at last all that
    shares a bit is looked at. ``scan`` allows what is left of a stated query set to be
    compared with all references, block by block, where meetings on bits would cost more.
    ``report`` receives (threshold, queries open, pairs compared) per round; a threshold of
    None is such a scan.
    """
    refs = materialize(references.select("scope", "bits").distinct(), "nearest-references")
    open_ = queries.select("scope", "bits").distinct()
    often = refs.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))  # a row per bit position
    order = [r["bit"] for r in often.orderBy("n", "bit").collect()]
    place = {x: i for i, x in enumerate(order)}
    rank = F.array(*[F.lit(place.get(i, len(order))) for i in range(max(order, default=-1) + 1)]).cast("array<int>")
    ranked = F.array_sort(F.transform("bits", lambda b: F.coalesce(F.get(rank, b), F.lit(len(order)) + b)))
    keyed = lambda df: df.select("scope", "bits", F.to_json("bits").alias("key"), ranked.alias("ranked"))
    refs = materialize(keyed(refs), "nearest-references")
    open_ = materialize(keyed(open_), "nearest-open")
    per_scope = refs.groupBy("scope").agg(F.count("*").alias("n_refs"))
    best = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, top)
    settled = None
    for threshold in (*THRESHOLDS, 0.0):
        n_open = open_.count()
        if not n_open:
            break
        left, right = _meets(open_, threshold, "a", False), _meets(refs, threshold, "b", True)
        whole = threshold
        if scan:
            per = ["scope", "bit", "band"]
            meetings = left.groupBy(*per).agg(F.count("*").alias("x")).join(right.groupBy(*per).agg(F.count("*").alias("y")), per).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
            pairs = open_.groupBy("scope").agg(F.count("*").alias("x")).join(per_scope, "scope").agg(F.sum(F.col("x") * F.col("n_refs"))).first()[0] or 0
            whole = None if costly(meetings, pairs) else threshold
        sides = [df.select("scope", F.col("key").alias(k), F.col("bits").alias(f"bits_{k}")) for df, k in ((open_, "a"), (refs, "b"))]
        if whole is None:
            found = materialize(best_in_blocks(sides[0].withColumnRenamed("bits_a", "bits"), sides[1].withColumnRenamed("bits_b", "bits"), top), "nearest-blocks")
        else:
            larger = F.greatest("na", "nb")
            met = left.join(right, ["scope", "bit", "band"]).where("a <> b").where(F.least("na", "nb") >= larger * threshold - 1e-9)
            met = met.groupBy("scope", "a", "b").agg(F.count("*").alias("k"), F.first(larger).alias("larger"))
            met = met.where(F.col("k") >= F.least(F.lit(COMMON), F.ceil(F.col("larger") * threshold - 1e-9))).select("scope", "a", "b")
            met = materialize(met, "nearest-met")
            compared = met.join(sides[0], ["scope", "a"]).join(sides[1], ["scope", "b"])
            both = F.size(F.array_intersect("bits_a", "bits_b"))
            s = both / (F.size("bits_a") + F.size("bits_b") - both)
            found = compared.select("scope", "a", s.alias("s")).where((F.col("s") >= threshold - 1e-12) & (F.col("s") > 0))
        found = found.groupBy("scope", F.col("a").alias("key")).agg(best.alias("best"))
        now = materialize(open_.join(found, ["scope", "key"], "left").withColumn("best", F.coalesce("best", F.array().cast("array<double>"))), "nearest-found")
        if report is not None:
            report.append((whole, n_open, pairs if whole is None else met.count()))
        done = F.lit(True) if whole is None or threshold == 0 else F.size("best") >= top
        part = now.where(done).select("scope", "bits", "best")
        settled = part if settled is None else settled.unionByName(part)
        open_ = now.where(~done).drop("best")
    return settled if settled is not None else queries.select("scope", "bits", F.array().cast("array<double>").alias("best")).limit(0)


def nearest_train(chemicals: DataFrame, assignments: DataFrame, report: list | None = None) -> DataFrame:
    """(split_name, test_part, id, max_similarity): for each chemical of each part but train its best Tanimoto to training ones.

    ``chemicals`` (id, bits), ``assignments`` (split_name, id, split_part), repeated as rows
    are. Every chemical with a fingerprint has a row for each part it is in: 1.0 if a training
    chemical has the same fingerprint (it may be itself), 0.0 if none shares a bit or nothing
    is in train. Chemicals without a bit have none.
    """
    fps = chemicals.where(F.size("bits") > 0).select("id", F.array_sort("bits").alias("bits"))
    placed = assignments.select(F.col("split_name").alias("scope"), "id", "split_part").distinct().join(fps, "id")
    placed = materialize(placed, "nearest-train")
    train = placed.where("split_part = 'train'").select("scope", "bits").distinct()
    others = placed.where("split_part <> 'train'")
    equal = train.withColumn("equal", F.lit(1.0))
    apart = others.select("scope", "bits").distinct().join(train, ["scope", "bits"], "left_anti")
    best = nearest_sets(apart, train, report=report)
    out = others.join(equal, ["scope", "bits"], "left").join(best, ["scope", "bits"], "left")
    return out.select(F.col("scope").alias("split_name"), F.col("split_part").alias("test_part"), "id", F.coalesce("equal", F.get("best", F.lit(0)), F.lit(0.0)).alias("max_similarity"))


def nearest_summary(nearest: DataFrame) -> DataFrame:
    """Per split and part: chemicals, mean, median and 90 % by nearest rank (half to even), maximum, shares from 0.65 and 0.8 up.

    Ranks are taken on counts per distinct similarity, so a part of any size is no one task's list.
    """
    keys = ["split_name", "test_part"]
    counts = nearest.groupBy(*keys, F.col("max_similarity").alias("s")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumns({"upto": F.sum("k").over(w.orderBy("s")), "n": F.sum("k").over(w)})
    at = lambda q: F.bround((F.col("n") - 1) * F.lit(q).cast("double"))
    pick = lambda q: F.min(F.when(F.col("upto") > at(q), F.col("s")))
    share = lambda t: F.sum(F.when(F.col("s") >= t, F.col("k")).otherwise(0)) / F.sum("k")
    return ranked.groupBy(*keys).agg(F.sum("k").alias("chemical_count"), (F.sum(F.col("s") * F.col("k")) / F.sum("k")).alias("mean_max"), pick(0.5).alias("median_max"), pick(0.9).alias("p90_max"), F.max("s").alias("max"), share(0.65).alias("share_ge_065"), share(0.80).alias("share_ge_080"))


#: Points that a cell of the k-d partition is sized for, points that its borders are drawn from, and cells at most.
CELL_POINTS, SAMPLE_POINTS, MOST_CELLS = 2000, 50_000, 1 << 14


def _kd_cells(sample: np.ndarray, cells: int) -> tuple[list, int]:
    """(nested splits, number of cells): halved at the median of the widest side until there are so many cells."""
    numbers = iter(range(cells))

    def cut(points: np.ndarray, want: int):
        if want > 1 and len(points) > 1:
            side = int(np.argmax(np.ptp(points, axis=0)))
            at = float(np.median(points[:, side]))
            low = points[:, side] <= at
            if low.any() and not low.all():
                return side, at, cut(points[low], want - want // 2), cut(points[~low], want // 2)
        return next(numbers)

    return cut(sample, cells), next(numbers, cells)


def _cell_of(points: np.ndarray, tree) -> np.ndarray:
    out, waiting = np.zeros(len(points), np.int64), [(tree, np.arange(len(points)))]
    while waiting:
        node, own = waiting.pop()
        if isinstance(node, int):
            out[own] = node
        else:
            side, at, below, above = node
            low = points[own, side] <= at
            waiting += [(below, own[low]), (above, own[~low])]
    return out


def nearest_points(queries: DataFrame, references: DataFrame, columns: list[str], report: list | None = None) -> DataFrame:
    """(id, distance): Euclidean distance over ``columns`` to the nearest row with another id, exactly.

    A query (id and columns) without any other row, or with a missing value, is left out, and so
    are references with one. References are reduced to distinct points with their smallest and
    largest id, and dealt to the cells of a k-d partition, whose borders come from a bounded
    sample; only the cells' sizes depend on it. A query looks into its own cell first, and
    then into those other cells whose box (exact, of the points in them) is closer than the
    best found. ``report`` receives the pairs looked at in both rounds.
    """
    use = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    xs = [f"x{i}" for i in range(len(columns))]
    usable = F.lit(True)
    for c in xs:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(c)
    kind = dict(references.dtypes)["id"]
    refs = references.select("id", *use).where(usable).groupBy(*xs).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    refs = materialize(refs, "nearest-points")
    n = refs.count()
    sample = refs.orderBy(F.xxhash64(*xs)).select(*xs).limit(SAMPLE_POINTS).toPandas().to_numpy(float)  # bounded
    tree, _ = _kd_cells(sample, max(1, min(MOST_CELLS, n // CELL_POINTS, max(1, len(sample) // 4)))) if n else (0, 1)

    @F.pandas_udf("long")
    def cell(points: pd.DataFrame) -> pd.Series:
        return pd.Series(_cell_of(points.to_numpy(float), tree))

    refs = materialize(refs.withColumn("cell", cell(F.struct(*xs))), "nearest-cells")
    asked = materialize(queries.select("id", *use).where(usable).withColumn("own", cell(F.struct(*xs))), "nearest-asked")
    boxes = refs.groupBy("cell").agg(*[f(x).alias(f"{f.__name__}_{x}") for x in xs for f in (F.min, F.max)]).orderBy("cell").toPandas()  # a row per cell
    low, high = (boxes[[f"{f}_{x}" for x in xs]].to_numpy(float) for f in ("min", "max"))
    names = boxes["cell"].to_numpy(np.int64)

    def found(pairs: DataFrame) -> DataFrame:
        d = F.lit(0.0)
        for x in xs:
            d = d + (F.col(x) - F.col(f"r{x}")) ** 2
        return pairs.where((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id"))).groupBy("id", *xs).agg(F.min(d).alias("best"))

    points = refs.select(F.col("cell").alias("own"), *[F.col(x).alias(f"r{x}") for x in xs], "lo", "hi")
    first = asked.join(points, "own")
    begun = materialize(asked.join(found(first), ["id", *xs], "left"), "nearest-begun")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                q, best = part[xs].to_numpy(float), part["best"].fillna(np.inf).to_numpy(float)
                away = np.zeros((len(part), len(names)))
                for i in range(len(xs)):
                    away += np.maximum(0, np.maximum(low[:, i] - q[:, i : i + 1], q[:, i : i + 1] - high[:, i])) ** 2
                r, c = np.nonzero((away < best[:, None]) & (names != part["own"].to_numpy()[:, None]))
                yield part.iloc[r][["id", *xs]].assign(own=names[c])

    more = begun.mapInPandas(visits, ", ".join([f"id {kind}", *[f"{x} double" for x in xs], "own long"])) if len(names) else begun.select("id", *xs, "own").limit(0)
    second = more.join(points, "own")
    if report is not None:
        report += [first.count(), second.count()]
    both = begun.select("id", "best").unionByName(found(second).select("id", "best"))
    return both.groupBy("id").agg(F.sqrt(F.min("best")).alias("distance")).where("distance is not null")
