"""Quality classifier on supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words and the n-grams of its
characters (code points, across words), hashed into one table of learned vectors. Their average
goes through a softmax layer. Vectors and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. Scoring uses that the logit is linear
in the average: each table row is reduced to its own logit once, so a text's score is the
average of one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.llm.text import Words, chunks, combine, mix, release_memory, releasing, utf8
from benthos.session import materialize


@dataclass(frozen=True)
class QualitySpec:
    """sample: labelled rows used per class at most (picked by hash of doc_id); they are what reaches the driver."""

    buckets: int = 1 << 18
    dim: int = 8
    words: int = 2
    grams: tuple[int, ...] = (3, 4)
    sample: int = 1500
    epochs: int = 8
    rate: float = 4.0
    seed: int = 7


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray  # buckets x dim
    weights: np.ndarray  # dim x 2
    bias: np.ndarray  # 2
    spec: QualitySpec

    def logit_table(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def features(data: np.ndarray, off: np.ndarray, spec: QualitySpec) -> Iterator[tuple[list, list, int]]:
    """Per chunk of rows: feature buckets of each kind, row of each (ascending within a kind), rows."""
    shift = np.uint64(64 - spec.buckets.bit_length() + 1)
    for lo, hi in chunks(off):
        w = Words(data, off[lo : hi + 1], lower=False)
        chars = np.frombuffer(w.bytes.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.concatenate(([0], np.cumsum((w.bytes & 0xC0) != 0x80)))[w.off]
        row_of = np.repeat(np.arange(w.rows), np.diff(ends))
        ids, rows = [], []
        for longest, units, row in ((spec.words, w.hash, w.row), (max(spec.grams, default=0), mix(chars + np.uint64(1)), row_of)):
            wanted = range(1, longest + 1) if units is w.hash else spec.grams
            h = units
            for n in range(1, longest + 1):
                if n > 1:
                    h = combine(h[: max(0, len(units) - n + 1)], units[n - 1 :])
                if n in wanted:
                    inside = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
                    ids.append((mix(h + np.uint64(n)) >> shift).astype(np.int64)[inside])
                    rows.append(row[: len(h)][inside])
        yield ids, rows, w.rows


def _counted(batch: pa.Array, spec: QualitySpec) -> tuple[list[bytes], list[bytes]]:
    """Distinct buckets (32-bit) and counts (32-bit floats) of each text, as bytes."""
    keys, counts = [], []
    for ids, rows, n in features(*utf8(batch), spec):
        for i in range(n):
            own = np.concatenate([x[np.searchsorted(r, i) : np.searchsorted(r, i + 1)] for x, r in zip(ids, rows)])
            k, c = np.unique(own, return_counts=True)
            keys.append(k.astype(np.int32).tobytes())
            counts.append(c.astype(np.float32).tobytes())
    return keys, counts


def train(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec(), label: str = "quality") -> QualityModel:
    """Fit on at most ``spec.sample`` labelled documents of each class.

    Labels other than 0 and 1, rows with null ids and labels without a document are left out
    before shares and samples are taken; a doc_id with several
    labels counts with the lowest, one that several rows share with the least of their texts.
    Without any labelled document all scores are 0.5. Class
    weights bring the sample back to the labels' own proportions.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = materialize(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "quality-labels")
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(spec.seed))
    picked = known.where("y = 0").orderBy(order).limit(spec.sample).unionByName(known.where("y = 1").orderBy(order).limit(spec.sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one row per id, so the bound holds where ids repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = _counted(batch.column("text"), spec)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "y", "keys", "counts"])

    rows = texts.mapInArrow(releasing(run), "doc_id long, y int, keys binary, counts binary").toPandas().sort_values("doc_id", kind="stable")
    return fit([np.frombuffer(k, np.int32) for k in rows["keys"]], [np.frombuffer(c, np.float32) for c in rows["counts"]], rows["y"].to_numpy(), share, spec)


def fit(keys: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, share: dict[int, int], spec: QualitySpec) -> QualityModel:
    """Gradient descent, a document a step, with a rate that falls to zero."""
    rng = np.random.default_rng(spec.seed)
    vectors = rng.uniform(-1, 1, (spec.buckets, spec.dim)) / spec.dim
    weights = np.zeros((spec.dim, 2))
    # the layer's bias is the labels' own log odds: what a text without features gets
    bias = np.log(np.array([share.get(c, 0) + 1.0 for c in (0, 1)]) / (sum(share.values()) + 2.0))
    have = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    total = sum(share.values()) or 1
    of_class = {c: share.get(c, 0) / total * len(y) / have[c] for c in (0, 1)}
    steps, step = max(1, spec.epochs * len(y)), 0
    for _ in range(spec.epochs):
        for i in rng.permutation(len(y)):
            rate = spec.rate * (1 - step / steps) * min(2.0, of_class[int(y[i])])
            step += 1
            k, c = keys[i], counts[i]
            n = c.sum()
            mean = (c @ vectors[k]) / n if n else np.zeros(spec.dim)
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            if n:
                vectors[k] -= rate * np.outer(c / n, weights @ p)
            weights -= rate * np.outer(mean, p)
    return QualityModel(vectors.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), spec)


def _scores(texts: pa.Array, logit: np.ndarray, bias: float, spec: QualitySpec) -> np.ndarray:
    """Softmax chance of label 1 of each text: the average of its features' logits, and the bias."""
    out = []
    for ids, rows, n in features(*utf8(texts), spec):
        total, count = np.zeros(n), np.zeros(n)
        for x, r in zip(ids, rows):
            total += np.bincount(r, logit[x], n)
            count += np.bincount(r, minlength=n)
        out.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias))))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: QualityModel, keep: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) per row: the chance of label 1, and whether it reaches ``keep``.

    Null and empty texts have no features and get the labels' share of label 1. Repeated rows are
    scored alike; other columns are not read. Empty in, empty out.
    """
    spec, table, bias = model.spec, model.logit_table(), float(model.bias[1] - model.bias[0])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(table)  # spec.buckets floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = shipped.value
        for batch in batches:
            s = _scores(batch.column(1), logit, bias, spec)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= keep).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.mapInArrow(releasing(run), "doc_id long, score double, predicted int")


def select_kept(docs: DataFrame, model: QualityModel, keep: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``keep`` or more.

    The decision is made row by row where the row is, so repeated and null doc_ids are no matter.
    """
    spec, table, bias = model.spec, model.logit_table(), float(model.bias[1] - model.bias[0])
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        kept = pd.Series(_scores(pa.array(texts, pa.string(), from_pandas=True), shipped.value, bias, spec) >= keep)
        release_memory()
        return kept

    return docs.where(passes(F.coalesce(F.col("text").cast("string"), F.lit(""))))
