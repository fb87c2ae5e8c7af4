"""Bootstrap and sign-flip replicates as vectors: no draw is ever a row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.operators.ranks import global_rank
from benthos.operators.splits import hash_key

#: Clusters whose multiplicities a task makes at a time, for all replicates.
BLOCK = 1024


def multiplicities(clusters: int, replicates: int, seed: int, block: int, size: int = BLOCK) -> np.ndarray:
    """How often each cluster of a block is drawn, per replicate, of as many draws as there are clusters.

    The draws are split down a binary tree over the blocks: of c draws in a range of clusters,
    the left half gets Binomial(c, its share). A node's splits depend on seed and node alone, so
    all tasks agree on them; a block's own draws are multinomial. All blocks of a replicate
    together hold exactly as many draws as there are clusters.
    """
    last = -(-clusters // size)
    a, z, c = 0, last, np.full(replicates, clusters)
    of = lambda a, z: min(z * size, clusters) - a * size
    while z - a > 1:
        mid = (a + z) // 2
        left = np.random.default_rng([seed, a, z]).binomial(c, of(a, mid) / of(a, z))
        a, z, c = (a, mid, left) if block < mid else (mid, z, c - left)
    n = of(a, z)
    return np.random.default_rng([seed, a, z, 1]).multinomial(c, np.full(n, 1 / n))


def split_bootstrap(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, delta_pooled, delta_macro) from cells (cluster, head, n, s), clusters drawn with replacement.

    As ``cluster_bootstrap``, but clusters are numbered, dealt in blocks, and each block's task
    makes their multiplicities for all replicates itself. What is shuffled is a vector of sums
    per block and head. The macro value is null where a head has no drawn row.
    """
    clusters = cells.select("cluster").distinct()
    numbered = global_rank(clusters.withColumn("__k", hash_key(seed, "cluster")), "__k").select("cluster", F.col("rank").alias("number"))
    p = clusters.count()

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["number"].iloc[0] // BLOCK)
        m = multiplicities(p, replicates, seed, block)
        out = []
        for head, own in pdf.groupby("head", dropna=False):
            w = m[:, own["number"].to_numpy() % BLOCK].astype(float)
            out.append((head, (w @ own["n"].to_numpy(float)).tolist(), (w @ own["s"].to_numpy(float)).tolist()))
        return pd.DataFrame(out, columns=["head", "n", "s"])

    placed = cells.join(numbered, "cluster").select("number", "head", F.col("n").cast("double").alias("n"), F.col("s").cast("double").alias("s"))
    vectors = placed.groupBy(F.floor(F.col("number") / BLOCK)).applyInPandas(sums, f"head {dict(cells.dtypes)['head']}, n array<double>, s array<double>")
    per = vectors.select("head", F.posexplode(F.arrays_zip("n", "s")).alias("replicate", "x")).groupBy("replicate", "head").agg(F.sum("x.n").alias("n"), F.sum("x.s").alias("s")).where("n > 0")
    heads = cells.agg(F.count_distinct(F.coalesce(F.col("head").cast("string"), F.lit(""))).alias("h"))
    out = per.groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("delta_pooled"), F.avg(F.col("s") / F.col("n")).alias("macro"), F.count("*").alias("k"))
    return out.crossJoin(F.broadcast(heads)).select(F.col("replicate").cast("long").alias("replicate"), "delta_pooled", F.when(F.col("k") == F.col("h"), F.col("macro")).alias("delta_macro"))  # one row


def signs(cluster: object, replicates: int, seed: int) -> np.ndarray:
    """1 or -1 per replicate: 256 bits of each SHA-256 of seed, number of the word and cluster; a set bit is -1."""
    words = b"".join(hashlib.sha256(f"{seed}|{k}|{cluster}".encode()).digest() for k in range(-(-replicates // 256)))
    return 1.0 - 2.0 * np.unpackbits(np.frombuffer(words, np.uint8))[:replicates]


def sign_flip_vectors(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(head, n_clusters, n_extreme, p) from cells (cluster, head, s); null for a head with one cluster.

    A task adds up a vector of replicates per head over its cells; rows into the shuffle are
    heads times tasks.
    """
    kind = dict(cells.dtypes)["head"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict = {}
        for pdf in batches:
            for head, own in pdf.groupby("head", dropna=False):
                flips = np.stack([signs(c, replicates, seed) for c in own["cluster"]])
                got = have.setdefault(head, [0, 0.0, np.zeros(replicates)])
                got[0] += len(own)
                got[1] += float(own["s"].sum())
                got[2] += own["s"].to_numpy(float) @ flips
        yield pd.DataFrame([(h, n, s, v.tolist()) for h, (n, s, v) in have.items()], columns=["head", "k", "obs", "v"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        v, obs, k = np.sum(np.stack(pdf["v"].to_numpy()), axis=0), pdf["obs"].sum(), int(pdf["k"].sum())
        x = int((np.abs(v) >= abs(obs) - 1e-9).sum())
        return pd.DataFrame([(pdf["head"].iloc[0], k, x if k > 1 else None, (x + 1) / (replicates + 1) if k > 1 else None)], columns=["head", "n_clusters", "n_extreme", "p"])

    rows = cells.select("head", F.col("cluster").cast("string").alias("cluster"), F.col("s").cast("double").alias("s"))
    return rows.mapInPandas(partial, f"head {kind}, k long, obs double, v array<double>").groupBy("head").applyInPandas(whole, f"head {kind}, n_clusters long, n_extreme long, p double")
