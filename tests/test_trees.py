"""Trees grown over chunks of all heads against the same rule on whole heads in numpy."""

import random

import numpy as np
import pytest

from benthos.operators import trees as T


def grown(bins, left, w, spec, node=1, level=0):
    """{node: (feature, bin, low, high)} by trying all splits."""
    if level == spec.depth:
        return {}
    best = None
    for f in range(bins.shape[1]):
        for b in range(spec.bins - 1):
            low = bins[:, f] <= b
            lw, hw = w[low].sum(), w[~low].sum()
            if lw >= spec.min_leaf and hw >= spec.min_leaf and (bins[low & (w > 0), f] == b).any():
                ly, hy = (w * left)[low].sum(), (w * left)[~low].sum()
                gain = round(ly**2 / lw + hy**2 / hw - (ly + hy) ** 2 / (lw + hw), 9)
                if gain > 0 and (best is None or (gain, -f, -b) > best[0]):
                    best = (gain, -f, -b), (f, b, ly / lw, hy / hw), low
    if best is None:
        return {}
    low = best[2]
    return {node: best[1]} | grown(bins[low], left[low], w[low], spec, 2 * node, level + 1) | grown(bins[~low], left[~low], w[~low], spec, 2 * node + 1, level + 1)


def value(x, tree, base):
    node, v = 1, base
    while node in tree:
        f, b, low, high = tree[node]
        v, node = (low, 2 * node) if x[f] <= b else (high, 2 * node + 1)
    return v


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    out = []
    for i in range(600):
        x = [rnd.choice([None, rnd.uniform(0, 10)]) if k == 2 else rnd.uniform(0, 10) for k in range(3)]
        head = "a" if i % 2 else rnd.choice(["b", "c"])
        out.append((head, i, round(3 * (x[0] > 5) + x[1] * (head == "b") + rnd.gauss(0, 0.1), 6), "test" if i % 5 == 0 else "train", x))
    out += [("few", 1000 + i, 1.0, "train", [1.0, 2.0, 3.0]) for i in range(5)] + [("flat", 2000 + i, 7.0, "test" if i % 4 == 0 else "train", [float(i), 0.0, 0.0]) for i in range(60)]
    return spark.createDataFrame(out + [("a", None, 1.0, "train", [0.0] * 3), ("a", 5000, None, "train", [0.0] * 3)], "head string, record long, target double, split_part string, features array<double>")


@pytest.mark.parametrize("boosting", [False, True])
def test_trees_are_those_of_whole_heads(spark, rows, boosting):
    spec = T.TreeSpec(trees=3, depth=3, bins=8, boosting=boosting, rate=0.5, chunk_rows=70)
    used = rows.where("target is not null and record is not null and head in ('a', 'b', 'c')").selectExpr("head", "xxhash64(record) AS rid", "target AS y", "split_part", "features")
    binned = T._binned(used, spec)
    data = binned.toPandas()
    assert data.groupby("head")["chunk"].nunique()["a"] >= 4
    splits = T.grow(binned, spec).toPandas()
    for head, own in data.groupby("head"):
        train = own[own["split_part"] == "train"]
        bins, y = np.stack(train["bins"].to_numpy()), train["y"].to_numpy()
        base, left, made = y.mean(), y - y.mean(), []
        for m in range(spec.trees):
            w = np.ones(len(y)) if boosting else T.bootstrap_weights(train["rid"].to_numpy(), m, spec.seed)
            tree = grown(bins, left if boosting else y, w, spec)
            made.append(tree)
            got = splits[(splits["head"] == head) & (splits["tree"] == m)]
            assert {r.node: (r.feature, r.bin) for r in got.itertuples()} == {n: t[:2] for n, t in tree.items()}
            for r in got.itertuples():
                assert (r.low, r.high) == pytest.approx(tree[r.node][2:])
            if boosting:
                left = left - spec.rate * np.array([value(x, tree, 0.0) for x in bins])
        x = np.stack(own["bins"].to_numpy())
        slow = [base + spec.rate * sum(value(v, t, 0.0) for t in made) if boosting else np.mean([value(v, t, base) for t in made]) for v in x]
        assert T._predicted(own, x, splits[splits["head"] == head], spec, spec.trees).tolist() == pytest.approx(slow)


def test_report_and_skip_reasons(spark, rows):
    spec = T.TreeSpec(trees=10, depth=4, bins=16)
    got = {r["head"]: r for r in T.tree_baselines(rows, "features", spec, {"train": 10}).collect()}
    assert got["few"].status == "train_samples_lt_10" and got["few"].mae is None and got["few"].n_train == 5
    assert all(got[h].status == "fitted" and got[h].r2 > 0.85 for h in "abc")
    assert got["flat"].mae == pytest.approx(0) and got["flat"].r2 is None
    jobs = spark.sparkContext.statusTracker()
    assert T.tree_baselines(rows.where("false"), "features", spec).count() == 0 and jobs is not None


@pytest.mark.parametrize("boosting", [False, True])
def test_rows_with_equal_bins_go_as_one(spark, boosting):
    rnd = random.Random(9)
    data = [("ab"[i % 2], i, round(rnd.uniform(0, 5) + i % 3, 3), "test" if i % 5 == 0 else "train", [float(i % 3), float(rnd.randrange(2))]) for i in range(900)]
    rows = spark.createDataFrame(data + [("c", 1000 + i, float(i % 2), "train", [float(i % 2)]) for i in range(40)], "head string, rid long, y double, split_part string, features array<double>")
    spec = T.TreeSpec(trees=2, depth=2, bins=4, boosting=boosting, rate=0.5)
    binned = T._binned(rows, spec)
    train = binned.where("split_part = 'train'")
    cells = T._alike(train, spec).toPandas()
    assert len(cells) == train.select("head", "bins").distinct().count() <= 14 and cells["n"].sum() == train.count()
    splits = T.grow(binned, spec).toPandas()
    for head, own in train.toPandas().groupby("head"):
        bins, y = np.stack(own["bins"].to_numpy()), own["y"].to_numpy()
        left = y - y.mean() if boosting else y
        for m in range(spec.trees):
            tree = grown(bins, left, np.ones(len(y)) if boosting else T.bootstrap_weights(own["rid"].to_numpy(), m, spec.seed), spec)
            got = splits[(splits["head"] == head) & (splits["tree"] == m)]
            assert {r.node: (r.feature, r.bin) for r in got.itertuples()} == {n: t[:2] for n, t in tree.items()}
            for r in got.itertuples():
                assert (r.low, r.high) == pytest.approx(tree[r.node][2:], abs=1e-9)
            left = left - spec.rate * np.array([value(x, tree, 0.0) for x in bins]) if boosting else left
