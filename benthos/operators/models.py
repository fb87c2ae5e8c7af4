"""Per-head baselines, leverage and interval likelihood on Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a moment matrix that travel together.
GRAM_ROWS = 64


def _gram(rows: DataFrame, x: str, width: int) -> np.ndarray:
    """Sums of products of (1, x...) over all rows whose array ``x`` has no missing value.

    Each task sends its matrix as blocks of GRAM_ROWS rows of doubles, which are added up block
    by block; the driver holds the whole one, 8 bytes a cell (34 MB for 2,048 columns).
    """
    width += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())]) if len(pdf) else np.zeros((0, width))
            total += x.T @ x
        yield pd.DataFrame([(i, total[i : i + GRAM_ROWS].tobytes()) for i in range(0, width, GRAM_ROWS)], columns=["i", "block"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(pdf["i"].iloc[0]), sum(np.frombuffer(b) for b in pdf["block"]).tobytes())], columns=["i", "block"])

    usable = rows.select(F.col(x).alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    cells = usable.mapInPandas(run, "i int, block binary").groupBy("i").applyInPandas(add, "i int, block binary")
    out = np.zeros((width, width))
    for r in cells.toPandas().itertuples():
        block = np.frombuffer(r.block).reshape(-1, width)
        out[r.i : r.i + len(block)] = block
    return out


def linear_baselines(rows: DataFrame, features: list[str], min_train: int = 50, ridge: float = 1e-6) -> DataFrame:
    """(head, status, n_test, mae, rmse): ridge regression per head, fitted on sums of products.

    Rows never leave their tasks: sums of products are one row per head, and each head is solved
    where its sums are. Heads with fewer training rows are skipped with a reason.
    """
    p = len(features) + 1
    terms = [F.lit(1.0), *[F.col(c) for c in [*features, "target"]]]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = rows.where("split_part = 'train'").groupBy("head").agg(F.array(*[F.sum(terms[i] * terms[j]) for i, j in pairs]).alias("sums"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for head, s in zip(pdf["head"], pdf["sums"]):
                m = np.zeros((p + 1, p + 1))
                for (i, j), v in zip(pairs, s):
                    m[i, j] = m[j, i] = v
                few = m[0, 0] < min_train
                w = None if few else np.linalg.solve(m[:p, :p] + ridge * np.eye(p), m[:p, p]).tolist()
                out.append((head, f"train_samples_lt_{min_train}" if few else "fitted", w))
            yield pd.DataFrame(out, columns=["head", "status", "w"])

    weights = sums.mapInPandas(solve, f"head {dict(rows.dtypes)['head']}, status string, w array<double>")
    test = rows.where("split_part = 'test'").join(weights, "head", "right")
    pred = F.col("w")[0]
    for i, c in enumerate(features):
        pred = pred + F.col("w")[i + 1] * F.col(c)
    e = pred - F.col("target")
    return test.groupBy("head", "status").agg(F.count(e).alias("n_test"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


def elastic_net(moments: np.ndarray, alpha: float, l1_ratio: float, sweeps: int = 1000) -> np.ndarray:
    """Intercept and coefficients from the moments of (1, x..., y): coordinate descent on scaled features.

    Least squares over 2 n, plus alpha times the mixed penalty of the coefficients of features
    that are scaled by their deviation (not centred), as for centred data with an intercept.
    """
    n, p = moments[0, 0], len(moments) - 2
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
    live = sd > 1e-9 * np.maximum(1.0, np.abs(mean[:p]))
    scale = np.where(live, sd, 1.0)
    c, r = cov[:p, :p] / np.outer(scale, scale), cov[:p, p] / scale
    w = np.zeros(p)
    for _ in range(sweeps):
        before = w.copy()
        for j in np.flatnonzero(live):
            rho = r[j] - c[j] @ w + c[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / (c[j, j] + alpha * (1 - l1_ratio))
        if np.abs(w - before).max(initial=0) < 1e-10:
            break
    w = w / scale
    return np.concatenate([[mean[p] - mean[:p] @ w], w])


def elastic_baselines(rows: DataFrame, features: list[str], alpha: float = 0.001, l1_ratio: float = 0.5, minima: dict[str, int] | None = None) -> DataFrame:
    """(head, status, n_train, n_test, mae, rmse, r2): an elastic net per head, or why it was skipped.

    Heads are fitted on sums of products, one row per head, where these sums are; rows with a
    missing value are left out. ``minima`` (total, train, eval) as for the trees.
    """
    minima = {"total": 0, "train": 1, "eval": 1} | (minima or {})
    used = rows.select("head", "split_part", *[F.col(c).cast("double").alias(c) for c in [*features, "target"]]).na.drop(subset=[*features, "target"])
    terms = [F.lit(1.0), *[F.col(c) for c in [*features, "target"]]]
    width = len(terms)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    is_train, is_eval = F.col("split_part") == "train", F.col("split_part") == "test"
    sums = used.groupBy("head").agg(F.count("*").alias("total"), F.count_if(is_train).alias("train"), F.count_if(is_eval).alias("eval"), F.array(*[F.coalesce(F.sum(F.when(is_train, terms[i] * terms[j])), F.lit(0.0)) for i, j in pairs]).alias("sums"))
    reason = F.lit("fitted")
    for what, least in reversed(minima.items()):
        reason = F.when(F.col(what) < least, F.lit(f"{what}_samples_lt_{least}")).otherwise(reason)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for status, s in zip(pdf["status"], pdf["sums"]):
                m = np.zeros((width, width))
                for (i, j), v in zip(pairs, s):
                    m[i, j] = m[j, i] = v
                out.append(elastic_net(m, alpha, l1_ratio).tolist() if status == "fitted" else None)
            yield pdf.drop(columns="sums").assign(__w=out)

    kind = dict(rows.dtypes)["head"]
    fitted = sums.withColumn("status", reason).mapInPandas(solve, f"head {kind}, total long, train long, eval long, status string, __w array<double>")
    pred = F.col("__w")[0]
    for i, c in enumerate(features):
        pred = pred + F.col("__w")[i + 1] * F.col(c)
    scored = used.where(is_eval).join(fitted.where("status = 'fitted'").select("head", "__w"), "head").select("head", F.col("target").alias("__y"), (pred - F.col("target")).alias("__e"))
    spread = F.var_pop("__y") * F.count("__y")
    per = scored.groupBy("head").agg(F.avg(F.abs("__e")).alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.when(spread > 1e-12, 1 - F.sum(F.col("__e") * F.col("__e")) / spread).alias("r2"))
    return fitted.select("head", "status", F.col("train").alias("n_train"), F.col("eval").alias("n_test")).join(per, "head", "left")


def leverage(rows: DataFrame, columns: list[str], fingerprint: list[str] | str | None = None, components: int = 8, width: int = 0) -> DataFrame:
    """(id, h, cutoff, outside): x' (X'X)^+ x on standardized columns, X from the training rows, cutoff 3p/n.

    ``fingerprint``, a list of columns or the name of an array column of ``width`` numbers, is
    standardized and replaced by its first principal components over the training rows. Moments
    are summed over tasks; the driver solves matrices as wide as the columns (some 200 MB in all
    for 2,048), and rows are scored where they are against a matrix of width times components.
    A row with a missing value has no leverage (null).
    """
    bits = F.col(fingerprint).cast("array<double>") if isinstance(fingerprint, str) else F.array(*[F.col(c).cast("double") for c in fingerprint or []]).cast("array<double>")
    width, k = width if isinstance(fingerprint, str) else len(fingerprint or []), len(columns)
    own = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    data = rows.select("id", "train", F.concat(own, bits).alias("x"))
    used = k + width
    m = _gram(data.where("train"), "x", used)
    n = m[0, 0]
    mean = m[0, 1:] / max(n, 1)
    cov = m[1:, 1:] / max(n, 1) - np.outer(mean, mean)
    sd = np.where(np.diag(cov) > 1e-12, np.sqrt(np.maximum(np.diag(cov), 0)), 1.0)
    corr = cov / np.outer(sd, sd)
    turn = np.zeros((used, k + min(components, width)))
    turn[:k, :k] = np.eye(k)
    if width:
        _, vectors = np.linalg.eigh(corr[k:, k:])
        turn[k:, k:] = vectors[:, ::-1][:, : turn.shape[1] - k]
    p = turn.shape[1]
    values, axes = np.linalg.eigh(np.linalg.pinv(turn.T @ corr @ turn * max(n, 1), hermitian=True, rcond=1e-10))
    half, cutoff = (turn @ axes) * np.sqrt(np.maximum(values, 0)), 3.0 * p / max(n, 1)  # h = |z half|^2

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([[np.nan] * used if v is None else v for v in pdf["x"]], float).reshape(len(pdf), used)
            h = (((x - mean) / sd @ half) ** 2).sum(axis=1)
            yield pd.DataFrame({"id": pdf["id"], "h": np.round(h, 9), "cutoff": round(cutoff, 9), "outside": h > cutoff})

    out = data.select("id", "x").mapInPandas(score, f"id {dict(rows.dtypes)['id']}, h double, cutoff double, outside boolean")
    return out.withColumn("h", F.when(~F.isnan("h"), F.col("h")))


def _log_ndtr(x: np.ndarray) -> np.ndarray:
    """log of the normal distribution function, by an asymptotic series far in the lower tail."""
    x = np.asarray(x, float)
    near = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v > -30 else 0.0 for v in x])
    with np.errstate(divide="ignore", invalid="ignore"):
        far = -0.5 * x * x - np.log(-x) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / (x * x) + 3 / x**4)
    return np.where(x > -30, near, far)


def gaussian_nll(mu: np.ndarray, sigma: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Negative log likelihood of points (lo = hi) and of intervals open on either side."""
    out = np.empty(len(mu))
    a, b = (lo - mu) / sigma, (hi - mu) / sigma
    point, left, right = lo == hi, np.isneginf(lo), np.isposinf(hi)
    mid = ~(point | left | right)
    out[point] = 0.5 * a[point] ** 2 + np.log(sigma[point]) + 0.5 * math.log(2 * math.pi)
    out[left], out[right] = -_log_ndtr(b[left]), -_log_ndtr(-a[right])
    flip = a[mid] > 0  # in the upper tail the mirrored interval keeps the digits
    u, v = np.where(flip, -a[mid], b[mid]), np.where(flip, -b[mid], a[mid])
    out[mid] = -(_log_ndtr(u) + np.log(-np.expm1(_log_ndtr(v) - _log_ndtr(u))))
    return out


def interval_likelihood(rows: DataFrame) -> DataFrame:
    """(model_head, n, nll) and the task-balanced mean as head ``<all>``."""

    @F.pandas_udf("double")
    def nll(mu: pd.Series, sigma: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series(gaussian_nll(*(x.to_numpy(float) for x in (mu, sigma, lo, hi))))

    per = rows.withColumn("nll", nll("mu", "sigma", "lo", "hi")).groupBy("model_head").agg(F.count("*").alias("n"), F.avg("nll").alias("nll"))
    whole = per.agg(F.sum("n").alias("n"), F.avg("nll").alias("nll")).select(F.lit("<all>").alias("model_head"), "n", "nll")
    return per.unionByName(whole).select("model_head", "n", F.round("nll", 6).alias("nll"))
