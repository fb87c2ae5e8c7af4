"""Bootstrap multiplicities and sign flips that are made where the clusters are."""

import numpy as np
import pytest

from benthos.operators import aggregates as A
from benthos.operators import resampling as RS


def test_multiplicities_add_up_and_have_the_moments_of_draws():
    clusters, replicates, size = 53, 4000, 8
    m = np.concatenate([RS.multiplicities(clusters, replicates, 3, b, size) for b in range(-(-clusters // size))], axis=1)
    assert m.shape == (replicates, clusters) and (m.sum(axis=1) == clusters).all()
    assert np.abs(m.mean(axis=0) - 1).max() < 0.08 and np.abs(m.var(axis=0) - (1 - 1 / clusters)).max() < 0.15
    cov = np.cov(m.T)[np.triu_indices(clusters, 1)]
    assert abs(cov.mean() + 1 / clusters) < 0.003
    again = RS.multiplicities(clusters, replicates, 3, 2, size)
    assert (again == m[:, 16:24]).all() and (RS.multiplicities(clusters, 100, 4, 2, size) != again[:100]).any()
    assert (RS.multiplicities(5, 20, 1, 0).sum(axis=1) == 5).all()


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{c}", f"h{h}", 1 + c % 3, float(rng.normal() + 0.2)) for c in range(300) for h in range(3) if (c + h) % 4 or c < 2] + [("c1", "alone", 2, 0.5), ("x", None, 1, 0.1), ("y", None, 1, -0.2)]
    return spark.createDataFrame(rows, "cluster string, head string, n int, s double")


def test_split_bootstrap_agrees_with_drawing(spark, cells, monkeypatch):
    monkeypatch.setattr(RS, "BLOCK", 64)
    # functions that travel read the constant where they are defined
    own = cells.where("head like 'h%'")
    a = RS.split_bootstrap(own, 400, 1).toPandas()
    b = A.cluster_bootstrap(own, 400, 1).toPandas()
    assert len(a) == 400 and a["delta_macro"].notna().all()
    for c in ("delta_pooled", "delta_macro"):
        assert a[c].mean() == pytest.approx(b[c].mean(), abs=0.02) and a[c].std() == pytest.approx(b[c].std(), rel=0.25)
    # a head that one cluster in three hundred has is missing in about a third of the replicates
    rare = RS.split_bootstrap(cells.where("head is not null"), 400, 1).toPandas()
    assert 0.25 < rare["delta_macro"].isna().mean() < 0.5
    assert RS.split_bootstrap(cells.where("false"), 10, 1).count() == 0


def test_sign_flips(spark, cells):
    got = {r["head"]: r for r in RS.sign_flip_vectors(cells.repartition(5), 600, 9).collect()}
    rows = cells.collect()
    for head, r in got.items():
        own = [(x.cluster, x.s) for x in rows if x["head"] == head]
        v = sum(s * RS.signs(c, 600, 9) for c, s in own)
        x = int((np.abs(v) >= abs(sum(s for _, s in own)) - 1e-9).sum())
        assert r.n_clusters == len(own) and r.n_extreme == (x if len(own) > 1 else None)
        assert r.p == (pytest.approx((x + 1) / 601) if len(own) > 1 else None)
    assert len(got) == 5 and RS.sign_flip_vectors(cells.where("false"), 10, 1).count() == 0
    assert abs(np.mean([RS.signs(c, 1000, 1) for c in range(200)])) < 0.02
