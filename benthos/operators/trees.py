"""Forests and boosted trees for all heads at once: histograms per node, one aggregate per level."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benthos.operators.ranks import quantiles
from benthos.session import materialize


@dataclass(frozen=True)
class TreeSpec:
    """trees of a forest (each on Poisson(1) weights) or rounds of boosting; rows that a task takes of a head."""

    trees: int = 50
    depth: int = 8
    bins: int = 32
    min_leaf: int = 2
    rate: float = 0.1
    boosting: bool = False
    seed: int = 7
    chunk_rows: int = 50_000


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap_weights(rid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree, by hash of its number: Poisson with mean 1."""
    key = _mix(np.array([tree * 1_000_003 + seed], np.uint64))
    u = (_mix(rid.astype(np.int64).view(np.uint64) ^ key) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(_POISSON, u, "right").astype(float)


def walk(bins: np.ndarray, splits: pd.DataFrame, base: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, value) of each row in one tree: node n has children 2 n and 2 n + 1; unsplit ones keep their value."""
    size = 1 << (depth + 1)
    feature, at = np.full(size, -1), np.zeros(size, int)
    value = np.zeros((size, 2))
    own = splits["node"].to_numpy(int)
    feature[own], at[own] = splits["feature"].to_numpy(int), splits["bin"].to_numpy(int)
    value[own] = splits[["low", "high"]].to_numpy(float)
    node, out, rows = np.ones(len(bins), int), np.full(len(bins), base), np.arange(len(bins))
    for _ in range(depth):
        go = feature[node] >= 0
        here = node[go]
        right = (bins[rows[go], feature[here]] > at[here]).astype(int)
        out[go] = value[here, right]
        node[go] = 2 * here + right
    return node, out


def _binned(rows: DataFrame, spec: TreeSpec) -> DataFrame:
    """(head, rid, y, split_part, bins, base, chunk): features as bins between the head's training quantiles."""
    train = rows.where("split_part = 'train'")
    long = train.select("head", F.posexplode("features").alias("f", "x")).where("x is not null")
    probabilities = {f"q{k:03}": k / spec.bins for k in range(1, spec.bins)}
    edges = quantiles(long, ["head", "f"], "x", probabilities)
    edges = edges.select("head", "f", F.array_sort(F.array_distinct(F.array(*probabilities))).alias("e"))
    edges = edges.groupBy("head").agg(F.map_from_entries(F.collect_list(F.struct("f", "e"))).alias("edges"))
    sizes = rows.groupBy("head").agg(F.avg(F.when(F.col("split_part") == "train", F.col("y"))).alias("base"), F.count("*").alias("__n"))
    heads = materialize(sizes.join(edges, "head", "left"), "tree-edges")  # a row per head
    met = rows.join(heads, "head")
    # a missing value goes to the lowest bin
    bin_of = F.transform("features", lambda x, i: F.coalesce(F.size(F.filter(F.element_at("edges", i), lambda e: e < x)), F.lit(0)))
    chunk = F.pmod(F.xxhash64("rid"), F.ceil(F.col("__n") / spec.chunk_rows)).cast("int")
    return met.select("head", "rid", "y", "split_part", F.transform(bin_of, lambda b: F.greatest(b, F.lit(0))).alias("bins"), "base", chunk.alias("chunk"))


#: Rows that a task adds up at once.
PACK_ROWS = 200_000


def _alike(train: DataFrame, spec: TreeSpec) -> DataFrame:
    """(head, bins, base, n, y, w, wy): a head's training rows with the same bins as one.

    n counts them and y is the sum of theirs, which is all that least squares asks for; w and wy
    are the same under each tree's weights (empty for boosting).
    """
    kind = dict(train.dtypes)["head"]
    trees = range(0 if spec.boosting else spec.trees)

    def added(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        lists = rows["bins"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        bins = np.full((len(rows), int(lengths.max())), -1)  # heads may differ in width
        bins[np.arange(bins.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
        head = rows["head"].combine_chunks().dictionary_encode().indices.to_numpy()
        cell = pd.DataFrame(bins).assign(head=head).groupby([*range(bins.shape[1]), "head"], sort=False).ngroup().to_numpy()
        first = np.unique(cell, return_index=True)[1]
        y, rid = rows["y"].to_numpy(), rows["rid"].to_numpy()
        total = lambda x: np.bincount(cell, x, len(first))
        w, wy = np.zeros((len(first), len(trees))), np.zeros((len(first), len(trees)))
        for m in trees:
            drawn = bootstrap_weights(rid, m, spec.seed)
            w[:, m], wy[:, m] = total(drawn), total(drawn * y)
        own = rows.select(["head", "bins", "base"]).take(pa.array(first)).combine_chunks()
        columns = [*[c.combine_chunks() for c in own.columns], pa.array(total(None).astype(float)), pa.array(total(y)), pa.array(list(w), pa.list_(pa.float64())), pa.array(list(wy), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["head", "bins", "base", "n", "y", "w", "wy"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= PACK_ROWS:
                yield added(held)
                held, n = [], 0
        if n:
            yield added(held)

    parts = train.select("head", "rid", "y", "bins", "base").mapInArrow(packed, f"head {kind}, bins array<int>, base double, n double, y double, w array<double>, wy array<double>")
    sums = lambda c: F.array(*[F.sum(F.get(c, F.lit(m))) for m in trees]).cast("array<double>").alias(c)
    return parts.groupBy("head", "bins").agg(F.min("base").alias("base"), F.sum("n").alias("n"), F.sum("y").alias("y"), sums("w"), sums("wy"))


def _chunked(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    """Distinct bins of each head, dealt into chunks of ``chunk_rows``."""
    cells = materialize(cells, "tree-cells")
    sizes = materialize(cells.groupBy("head").agg(F.count("*").alias("__n")), "tree-sizes")
    return cells.join(sizes, "head").withColumn("chunk", F.pmod(F.xxhash64("bins"), F.ceil(F.col("__n") / spec.chunk_rows)).cast("int")).drop("__n")


SPLITS = "tree int, node int, feature int, bin int, low double, high double"


def _split(cells: DataFrame, spec: TreeSpec) -> DataFrame:
    """The best split of each node from its (head, tree, node, feature, bin, w, wy): least squares, ties to the first feature and bin."""
    node = ["head", "tree", "node"]
    added = cells.groupBy(*node, "feature", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    upto = Window.partitionBy(*node, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*node, "feature")
    sums = added.select(*node, "feature", "bin", *[F.sum(c).over(w).alias(n) for c, w, n in (("w", upto, "lw"), ("wy", upto, "ly"), ("w", whole, "tw"), ("wy", whole, "ty"))])
    square = lambda y, w: y * y / w
    rest_w, rest_y = F.col("tw") - F.col("lw"), F.col("ty") - F.col("ly")
    sums = sums.where((F.col("lw") >= spec.min_leaf) & (rest_w >= spec.min_leaf))
    gain = F.round(square(F.col("ly"), F.col("lw")) + square(rest_y, rest_w) - square(F.col("ty"), F.col("tw")), 9)
    found = F.struct("feature", "bin", (F.col("ly") / F.col("lw")).alias("low"), (rest_y / rest_w).alias("high"))
    best = sums.withColumn("gain", gain).where("gain > 0").groupBy(*node).agg(F.max_by(found, F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("s"))
    return best.select(*node, F.col("s.feature").alias("feature"), F.col("s.bin").alias("bin"), F.col("s.low").alias("low"), F.col("s.high").alias("high"))


def _with_models(binned: DataFrame, chunks: DataFrame, splits: DataFrame | None, function, schema: str) -> DataFrame:
    """``function(key, rows, splits)`` per head and chunk, the head's splits sent to each of its chunks."""
    kind = dict(binned.dtypes)["head"]
    if splits is None:
        splits = binned.sparkSession.createDataFrame([], f"head {kind}, {SPLITS}")
    sent = splits.join(chunks, "head")
    return binned.groupBy("head", "chunk").cogroup(sent.groupBy("head", "chunk")).applyInPandas(function, schema)


def _predicted(rows: pd.DataFrame, bins: np.ndarray, splits: pd.DataFrame, spec: TreeSpec, upto: int) -> np.ndarray:
    """Mean over the trees of a forest; for boosting, the base and the first ``upto`` rounds' steps."""
    base = float(rows["base"].iloc[0])
    by = dict(list(splits.groupby("tree")))
    if spec.boosting:
        out = np.full(len(rows), base)
        for m in range(upto):
            if m in by:
                out += spec.rate * walk(bins, by[m], 0.0, spec.depth)[1]
        return out
    none = splits.iloc[:0]
    return np.mean([walk(bins, by.get(m, none), base, spec.depth)[1] for m in range(spec.trees)], axis=0)


def grow(binned: DataFrame, spec: TreeSpec) -> DataFrame | None:
    """(head, tree, node, feature, bin, low, high): the splits of all heads' trees.

    A forest grows all trees of all heads together, a level at a time; boosting a tree of each
    head at a time. A task sees a chunk of a head's training rows and that head's splits, walks
    the trees, and sends sums per node, feature and bin; these are added up and the best splits
    chosen in one aggregate. The number of Spark jobs depends on depth and rounds only. Rows with
    the same bins go as one wherever their sums, of each tree, are no more than the rows.
    """
    train = binned.where("split_part = 'train'")
    packed = spec.boosting or train.select("head", "bins").distinct().count() * spec.trees <= train.count()
    train = materialize(_chunked(_alike(train, spec), spec) if packed else train, "tree-rows")
    chunks = materialize(train.select("head", "chunk").distinct(), "tree-chunks")
    kind, splits = dict(binned.dtypes)["head"], None
    rounds = [[m] for m in range(spec.trees)] if spec.boosting else [list(range(spec.trees))]
    for trees in rounds:
        for level in range(spec.depth):

            def cells(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
                out = []
                if len(rows):
                    bins, y = np.stack(rows["bins"].to_numpy()).astype(int), rows["y"].to_numpy(float)
                    by = dict(list(own.groupby("tree")))
                    for m in trees:  # noqa: B023
                        node = walk(bins, by.get(m, own.iloc[:0]), 0.0, spec.depth)[0]
                        if spec.boosting:
                            w = rows["n"].to_numpy(float)
                            wy = y - w * _predicted(rows, bins, own, spec, trees[0])  # noqa: B023
                        elif packed:
                            w, wy = (np.array([x[m] for x in rows[c]], float) for c in ("w", "wy"))
                        else:
                            w = bootstrap_weights(rows["rid"].to_numpy(), m, spec.seed)
                            wy = w * y
                        at = np.flatnonzero((node >> level == 1) & (w > 0))  # noqa: B023
                        for f in range(bins.shape[1]):
                            cell, back = np.unique(node[at] * spec.bins + bins[at, f], return_inverse=True)
                            sums = [np.bincount(back, x, len(cell)) for x in (w[at], wy[at])]
                            out.append(np.stack([np.full(len(cell), m), cell // spec.bins, np.full(len(cell), f), cell % spec.bins, *sums], axis=1))
                found = pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 6)), columns=["tree", "node", "feature", "bin", "w", "wy"])
                found = found.astype({c: np.int32 for c in ("tree", "node", "feature", "bin")})
                found.insert(0, "head", key[0])
                return found

            made = _with_models(train, chunks, splits, cells, f"head {kind}, tree int, node int, feature int, bin int, w double, wy double")
            more = materialize(_split(made, spec), "tree-splits")
            splits = more if splits is None else splits.unionByName(more)
        splits = materialize(splits, "tree-splits") if splits is not None else None
    return splits


def tree_baselines(rows: DataFrame, features: str, spec: TreeSpec, minima: dict[str, int] | None = None) -> DataFrame:
    """(head, status, n_train, n_test, mae, rmse, r2): a forest or boosted trees per head, or why it was skipped.

    ``rows`` (head, record, target, split_part, ``features`` array): a head is skipped with the
    first reason of ``minima`` (total, train, eval; at least one row each) that it misses.
    Rows without a target or a record are left out before that; a missing feature value is
    the lowest. r2 is null on a constant target.
    """
    minima = {"total": 0, "train": 1, "eval": 1} | (minima or {})
    kind = dict(rows.dtypes)["head"]
    used = rows.where("target is not null and record is not null").select("head", F.xxhash64("record").alias("rid"), F.col("target").cast("double").alias("y"), "split_part", F.col(features).cast("array<double>").alias("features"))
    used = materialize(used, "tree-input")
    is_train, is_eval = F.col("split_part") == "train", F.col("split_part") == "test"
    counts = used.groupBy("head").agg(F.count("*").alias("total"), F.count_if(is_train).alias("train"), F.count_if(is_eval).alias("eval"))
    reason: Column = F.lit("fitted")
    for what, least in reversed(minima.items()):
        reason = F.when(F.col(what) < least, F.lit(f"{what}_samples_lt_{least}")).otherwise(reason)
    counts = materialize(counts.withColumn("status", reason), "tree-heads")
    binned = materialize(_binned(used.join(counts.where("status = 'fitted'").select("head"), "head", "left_semi"), spec), "tree-binned")
    splits = grow(binned, spec)

    def score(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"head": [], "bins": [], "p": []})
        bins = np.stack(rows["bins"].to_numpy()).astype(int)
        return pd.DataFrame({"head": key[0], "bins": rows["bins"], "p": _predicted(rows, bins, own, spec, spec.trees)})

    # equal bins have equal predictions
    test = binned.where("split_part = 'test'").select("head", "bins", "y", "base")
    asked = materialize(_chunked(test.groupBy("head", "bins").agg(F.min("base").alias("base")), spec), "tree-asked")
    chunks = materialize(asked.select("head", "chunk").distinct(), "tree-chunks")
    known = _with_models(asked, chunks, splits, score, f"head {kind}, bins array<int>, p double")
    scored = test.join(materialize(known, "tree-predictions"), ["head", "bins"])
    e, spread = F.col("p") - F.col("y"), F.var_pop("y") * F.count("y")
    per = scored.groupBy("head").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(spread > 1e-12, 1 - F.sum(e * e) / spread).alias("r2"))
    return counts.join(per, "head", "left").select("head", "status", F.col("train").alias("n_train"), F.col("eval").alias("n_test"), "mae", "rmse", "r2")
