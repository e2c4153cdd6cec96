"""One-class models of normal behavior, fitted per group, kept in a registry table and scored in Arrow batches.

Mahalanobis models and mixtures are fitted on all rows: the former from sums, the latter with one start per task where a
group fits a task (``max_rows``), else in passes over an ordered table. Forests, which draw SUBSAMPLE rows a tree, draw
them from a bounded sample of each group (``max_rows``, by a hash order), one group per task. The registry (a row per group with
arrays) stays small and is sent to the scoring tasks whole. Scoring reads all rows, without a shuffle. No pickles: a model is its numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..session import checkpoint

# Fixed values of the model configuration.
COMPONENTS = (1, 2, 3, 4, 5, 6, 8, 10, 12)
REG, ITERATIONS, STARTS, SEED = 1e-6, 200, 3, 1337
KNEE_NATS = 0.5
FAR_TARGETS = (0.01, 0.05, 0.1)
TREES, SUBSAMPLE = 200, 256
BLOCK = 1024
SPREAD = 32
CELLS, SENT, PART = 1 << 21, 32 << 20, 64 << 20
MIN_ROWS = 50
MAX_MODELS = 50_000
REGISTRY = "family string, n_train long, model string"
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


# --- fitting, in numpy ----------------------------------------------------------------------------------------------


def scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation; a constant column is divided by 1."""
    std = x.std(axis=0)
    return x.mean(axis=0), np.where(std > 0, std, 1.0)


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk toward a multiple of the identity, and the shrinkage (Ledoit and Wolf, 2004)."""
    n = len(x)
    x = x - x.mean(axis=0)
    return shrunk(x.T @ x / n, ((x**2).sum(axis=1) ** 2).sum(), n)


def shrunk(s: np.ndarray, fourth: float, n: int) -> tuple[np.ndarray, float]:
    """The same from the covariance s of n rows and the sum of the fourth powers of their lengths."""
    d = len(s)
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = min(max((fourth / n - (s**2).sum()) / n / d, 0.0), delta)
    a = beta / delta if delta > 0 else 0.0
    return (1 - a) * s + a * mu * np.eye(d), float(a)


def _log_gauss(x: np.ndarray, means: np.ndarray, chol: np.ndarray) -> np.ndarray:
    """Log densities, rows by components; chol: lower factors of the covariances. In blocks of rows that stay in a cache."""
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, chol, strict=True)):
        turn, rest = np.linalg.inv(c).T, len(m) * np.log(2 * np.pi) / 2 + np.log(np.diag(c)).sum()
        for i in range(0, len(x), BLOCK):
            z = (x[i : i + BLOCK] - m) @ turn
            out[i : i + BLOCK, k] = -0.5 * np.einsum("ij,ij->i", z, z) - rest
    return out


def log_sum_exp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def _scatter(x: np.ndarray, share: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sum of outer products of the rows' deviations from a mean, by shares."""
    out, root = np.zeros((x.shape[1], x.shape[1])), np.sqrt(share)[:, None]
    for i in range(0, len(x), BLOCK):
        z = (x[i : i + BLOCK] - mean) * root[i : i + BLOCK]
        out += z.T @ z
    return out


def begin_mixture(x: np.ndarray, k: int, start: int, seed: int = SEED) -> np.ndarray:
    """The nearest of the k-means++ centres of a start, for each row. The starts draw from one sequence, one after another."""
    rng = np.random.default_rng(seed)
    for _ in range(start + 1):
        gap = nearest = None
        for j in range(k):
            c = x[rng.choice(len(x), p=gap / gap.sum()) if j and gap.sum() > 0 else rng.integers(len(x))]
            away = ((x - c) ** 2).sum(axis=1)
            nearest = np.zeros(len(x), int) if gap is None else np.where(away < gap, j, nearest)
            gap = away if gap is None else np.minimum(gap, away)
    return nearest


def run_mixture(x: np.ndarray, k: int, start: int, seed: int = SEED) -> dict:
    """Full-covariance Gaussian mixture by EM from one start."""
    resp, last = np.eye(k)[begin_mixture(x, k, start, seed)], -np.inf
    for _ in range(ITERATIONS):
        weight = resp.sum(axis=0) + 10 * np.finfo(float).eps
        means = resp.T @ x / weight[:, None]
        cov = np.stack([_scatter(x, resp[:, j], means[j]) / weight[j] + REG * np.eye(x.shape[1]) for j in range(k)])
        chol = np.linalg.cholesky(cov)
        joint = _log_gauss(x, means, chol) + np.log(weight / weight.sum())
        total = log_sum_exp(joint)
        resp = np.exp(joint - total[:, None])
        now = total.mean()
        if abs(now - last) < 1e-3:
            break
        last = now
    return {"ll": float(now), "weights": (weight / weight.sum()).tolist(), "means": means.tolist(), "chol": chol.tolist()}


def starts_of(k: int, starts: int = STARTS) -> range:
    """One component is the same from every start."""
    return range(starts if k > 1 else 1)


def fit_mixture(x: np.ndarray, k: int, seed: int = SEED, starts: int = STARTS) -> dict:
    """The best of several starts."""
    return max((run_mixture(x, k, s, seed) for s in starts_of(k, starts)), key=lambda m: m["ll"])


def select_mixture(train: np.ndarray, val: np.ndarray, sweep: Sequence[int] = COMPONENTS, tol: float = KNEE_NATS) -> dict:
    """The smallest number of components whose held-out log-likelihood is within tol of the best."""
    fits = []
    for k in sweep:
        if k <= len(train):
            m = fit_mixture(train, k)
            fits.append((k, held_out(train, val, m), m))
    k, ll = knee([(k, ll) for k, ll, _ in fits], tol)
    return next(m for j, _, m in fits if j == k) | {"k": k, "val_ll": ll}


def held_out(train: np.ndarray, val: np.ndarray, m: dict) -> float:
    return float(-mixture_score(val if len(val) else train, m).mean())


def knee(fits: Sequence[tuple[int, float]], tol: float = KNEE_NATS) -> tuple[int, float]:
    """The first (k, log-likelihood) within tol of the best."""
    top = max(ll for _, ll in fits)
    return next(f for f in fits if f[1] >= top - tol)


def mixture_score(x: np.ndarray, m: dict) -> np.ndarray:
    """Negative log density."""
    return -log_sum_exp(_log_gauss(x, np.array(m["means"]), np.array(m["chol"])) + np.log(np.array(m["weights"])))


def _path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def fit_forest(x: np.ndarray, trees: int = TREES, seed: int = SEED) -> dict:
    """Isolation forest: random splits of subsamples, kept as flat arrays."""
    rng, size = np.random.default_rng(seed), min(SUBSAMPLE, len(x))
    limit, out = int(np.ceil(np.log2(max(size, 2)))), []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + float(_path(len(rows)))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(rows) > 1 and len(open_):
                j = int(rng.choice(open_))
                cut = rng.uniform(low[j], high[j])
                left = rows[:, j] <= cut
                nodes[at][:2] = [j, float(cut)]
                nodes[at][2] = grow(rows[left], depth + 1)
                nodes[at][3] = grow(rows[~left], depth + 1)
            return at

        grow(x[rng.choice(len(x), size, replace=False)], 0)
        out.append(nodes)
    return {"trees": out, "size": size}


def forest_score(x: np.ndarray, m: dict) -> np.ndarray:
    """2 to the power of minus mean depth over expected depth: near 1 for what is isolated at once."""
    total = np.zeros(len(x))
    for nodes in m["trees"]:
        a = np.array(nodes)
        at = np.zeros(len(x), int)
        while True:
            f = a[at, 0].astype(int)
            inner = f >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= a[at, 1]
            at = np.where(inner, np.where(go, a[at, 2], a[at, 3]).astype(int), at)
        total += a[at, 4]
    return 2 ** (-total / len(m["trees"]) / max(float(_path(m["size"])), 1e-12))


def fit_family(family: str, train: np.ndarray, val: np.ndarray) -> dict:
    """A model of one family on standardised features."""
    mean, std = scaler(train)
    a, b = (train - mean) / std, (val - mean) / std
    if family == "mixture":
        m = select_mixture(a, b)
    elif family == "mahalanobis":
        cov, shrinkage = ledoit_wolf(a)
        m = {"centre": a.mean(axis=0).tolist(), "precision": np.linalg.pinv(cov).tolist(), "shrinkage": shrinkage}
    elif family == "forest":
        m = fit_forest(a)
    else:
        raise ValueError(f"unknown family {family}")
    return m | {"family": family, "mean": mean.tolist(), "std": std.tolist()}


def score_family(x: np.ndarray, m: dict) -> np.ndarray:
    """Higher is less normal. Mahalanobis distances are squared."""
    x = (x - np.array(m["mean"])) / np.array(m["std"])
    if m["family"] == "mixture":
        return mixture_score(x, m)
    if m["family"] == "forest":
        return forest_score(x, m)
    d = x - np.array(m["centre"])
    return np.einsum("ij,jk,ik->i", d, np.array(m["precision"]), d)


# --- tables ---------------------------------------------------------------------------------------------------------


def fit_models(rows: DataFrame, by: Sequence[str], features: Sequence[str], families: Sequence[str], split: str = "split", order: str = "row_id", min_rows: int = MIN_ROWS, max_rows: int = 20_000) -> DataFrame:
    """Registry: one row per group and family with at least min_rows training rows without missing features.

    Mahalanobis models come from sums over all rows. Mixtures are fitted on all rows too: a group with at most max_rows rows
    per split in tasks that hold it, a larger one in passes, with the same numbers. Of forests about max_rows rows per
    group and split (those with the smallest hash of ``order``) reach the fitting task.
    """
    # one array: a filter over many columns makes the optimizer infer constraints for minutes
    rows = rows.where(F.col(split).isin("train", "val")).select(*by, split, order, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    rows = rows.where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    exact = gaussians(rows.where(F.col(split) == "train"), by, len(features), min_rows) if "mahalanobis" in families else None
    families = [f for f in families if f != "mahalanobis"]
    if not families and exact is not None:
        return exact
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    d, keys, made = len(features), list(by), [] if exact is None else [exact]
    if "mixture" in families:
        made += mixtures_of_all(rows, by, split, order, d, min_rows, max_rows)
    chosen = [f for f in families if f != "mixture"]
    if not chosen:
        return reduce(DataFrame.unionByName, made)
    counts = rows.groupBy(*by, split).count()
    unit = (F.pmod(F.xxhash64(order), F.lit(1 << 30)) + 0.5) / (1 << 30)
    rows = rows.join(tables.small(counts), [*by, split]).where(unit < F.lit(float(max_rows)) / F.col("count"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, val = _sides(pdf, split, order, d)
        out = []
        if len(train) >= min_rows:
            for f in chosen:
                out.append([*pdf.iloc[0][keys], f, len(train), json.dumps(fit_family(f, train, val))])
        return pd.DataFrame(out, columns=[*keys, "family", "n_train", "model"])

    return reduce(DataFrame.unionByName, [*made, rows.groupBy(*by).applyInPandas(run, f"{kinds}, {REGISTRY}")])


def _sides(pdf: pd.DataFrame, split: str, order: str, d: int) -> list[np.ndarray]:
    """Training and validation rows of a group, in order."""
    pdf = pdf.sort_values(order, kind="stable")
    return [np.array(pdf.loc[pdf[split] == s, "_x"].tolist(), float).reshape(-1, d) for s in ("train", "val")]


def mixture_fits(rows: DataFrame, by: Sequence[str], split: str, order: str, d: int, min_rows: int) -> DataFrame:
    """(by, k, start, n_train, ll, val_ll, model): the mixtures that ``fit_family`` chooses from, each in a task of its own.
    A task gets the rows of its group; groups are dealt over SPREAD tasks per start, and those of most components begin first."""
    jobs, keys = [(k, s) for k in sorted(COMPONENTS, reverse=True) for s in starts_of(k)], list(by)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (k, start), (train, val), out = jobs[pdf["_job"].iloc[0]], _sides(pdf, split, order, d), []
        if len(train) >= max(min_rows, k):
            mean, std = scaler(train)
            a, b = (train - mean) / std, (val - mean) / std
            m = run_mixture(a, k, start)
            m |= {"k": k, "val_ll": held_out(a, b, m), "family": "mixture", "mean": mean.tolist(), "std": std.tolist()}
            out.append([*pdf.iloc[0][keys], k, start, len(train), m["ll"], m["val_ll"], json.dumps(m)])
        return pd.DataFrame(out, columns=[*keys, "k", "start", "n_train", "ll", "val_ll", "model"])

    each = rows.select(*by, split, order, "_x", F.explode(F.array(*[F.lit(j) for j in range(len(jobs))])).alias("_job"))
    each = each.withColumn("_task", (F.col("_job") * SPREAD + F.pmod(F.xxhash64(*by), F.lit(SPREAD))).cast("int"))
    each = each.repartitionById(SPREAD * len(jobs), F.col("_task"))
    return each.groupBy(*by, "_job", "_task").applyInPandas(run, f"{kinds}, k int, start int, n_train long, ll double, val_ll double, model string")


def mixtures(rows: DataFrame, by: Sequence[str], split: str, order: str, d: int, min_rows: int) -> DataFrame:
    """Registry of mixtures: the best start of each number of components, then ``knee``."""
    keys, kinds = list(by), ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "start"], ignore_index=True)
        best = pdf.loc[pdf.groupby("k")["ll"].idxmax()]
        k, _ = knee(list(zip(best["k"], best["val_ll"], strict=True)))
        return best[best["k"] == k].assign(family="mixture")[[*keys, "family", "n_train", "model"]]

    return mixture_fits(rows, by, split, order, d, min_rows).groupBy(*by).applyInPandas(choose, f"{kinds}, {REGISTRY}")


def mixtures_of_all(rows: DataFrame, by: Sequence[str], split: str, order: str, d: int, min_rows: int, max_rows: int) -> list[DataFrame]:
    """Registries of mixtures fitted on all rows: of the groups that fit a task, and of those with more than max_rows rows in a split."""
    counts = rows.groupBy(*by).agg(F.count_if(F.col(split) == "train").alias("_t"), F.count_if(F.col(split) == "val").alias("_u"))
    found = counts.where(F.greatest("_t", "_u") > max_rows).select(*by).limit(MAX_MODELS + 1).collect()
    if len(found) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    if not found:
        return [mixtures(rows, by, split, order, d, min_rows)]
    large = F.broadcast(rows.sparkSession.createDataFrame(found, counts.select(*by).schema))
    same = reduce(and_, [rows[c].eqNullSafe(large[c]) for c in by])
    return [mixtures(rows.join(large, same, "left_anti"), by, split, order, d, min_rows), mixtures_in_passes(rows.join(large, same, "left_semi"), by, split, order, d, min_rows)]


@dataclass
class Fit:
    """A start of a mixture that is fitted in passes."""

    group: int
    k: int
    start: int
    rng: np.random.Generator
    centres: list[np.ndarray] = field(default_factory=list)
    ll: float = -np.inf
    val_ll: float = -np.inf
    model: tuple = ()


def products(x: np.ndarray) -> np.ndarray:
    """Per row the products of its features (each pair once), the features and a 1: a Gaussian log density is linear in them,
    and their sums by shares are all that a step of EM needs."""
    n, d = x.shape
    out, at = np.empty((n, d * (d + 1) // 2 + d + 1)), 0
    for i in range(d):
        np.multiply(x[:, i : i + 1], x[:, i:], out=out[:, at : at + d - i])
        at += d - i
    out[:, at:-1], out[:, -1] = x, 1.0
    return out


def mixture_of_sums(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and lower factors from the sums of ``products`` by shares, a row per component: as in ``run_mixture``."""
    i, j = np.triu_indices(d)
    square, first, share = np.empty((len(sums), d, d)), sums[:, -d - 1 : -1], sums[:, -1]
    square[:, i, j] = square[:, j, i] = sums[:, : len(i)]
    weight = share + 10 * np.finfo(float).eps
    means = first / weight[:, None]
    cross = means[:, :, None] * first[:, None, :]
    square += share[:, None, None] * means[:, :, None] * means[:, None, :] - cross - cross.transpose(0, 2, 1)
    return weight / weight.sum(), means, np.linalg.cholesky(square / weight[:, None, None] + REG * np.eye(d))


def coefficients(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What ``products`` times gives the log of weight times density, a column per component."""
    out = []
    for w, m, c in zip(*model, strict=True):
        turn = np.linalg.inv(c)
        p = turn.T @ turn
        i, j = np.triu_indices(len(m))
        rest = np.log(w) - m @ p @ m / 2 - len(m) * np.log(2 * np.pi) / 2 - np.log(np.diag(c)).sum()
        out.append(np.concatenate([np.where(i == j, -0.5, -1.0) * p[i, j], p @ m, [rest]]))
    return np.array(out).T


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres; what rounding leaves of a zero is a zero."""
    size = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)
    away = size - 2 * x @ centres.T
    return np.where(away > 1e-13 * size, away, 0.0)


def _blocks(batches: Iterator[pa.RecordBatch], d: int, mean: np.ndarray, std: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, part, standardised rows) from (_k, _p, _x), in order, in blocks whose ``products`` have about CELLS cells."""
    step = max(1, CELLS // (d * (d + 3) // 2 + 1))
    for b in batches:
        group, part = b.column(0).to_numpy(), b.column(1).to_numpy()
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            for i in range(0, len(at), step):
                rows = at[i : i + step]
                yield int(g), int(part[rows[0]]), (x[rows] - mean[g]) / std[g]


def mixtures_in_passes(rows: DataFrame, by: Sequence[str], split: str, order: str, d: int, min_rows: int) -> DataFrame:
    """Registry of mixtures of groups that fit no task: what ``fit_family`` gives on all rows. Every centre and every step of EM
    is a pass over the rows, which stay in a table in order, for as many starts at once as have SENT bytes of coefficients;
    tasks return sums, and only these reach the driver."""
    spark, keys = rows.sparkSession, list(by)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    found, mean, std, number = moments(rows.where(F.col(split) == "train"), by, d, min_rows)
    if not found:
        return spark.createDataFrame([], f"{kinds}, {REGISTRY}")
    same = reduce(and_, [rows[c].eqNullSafe(number[c]) for c in by])
    table = rows.join(F.broadcast(number), same).select("_k", (rows[split] == "val").alias("_v"), rows[order].alias("_o"), "_x")
    n_val = {r._k: r["count"] for r in table.where("_v").groupBy("_k").count().collect()}
    n = [r.n_train for r in found]
    parts = max(2 * spark.sparkContext.defaultParallelism, (sum(n) + sum(n_val.values())) * d * 8 // PART)
    table = table.repartitionByRange(parts, "_k", "_v", "_o").sortWithinPartitions("_k", "_v", "_o")
    table = checkpoint(table.select("_k", "_v", F.spark_partition_id().alias("_p"), "_x"))
    train, val = (table.where(c).select("_k", "_p", "_x") for c in ("not _v", "_v"))

    def over(source: DataFrame, task: Callable, sent: dict, schema: str, total: Callable | None = None) -> list:
        """Rows of ``task(blocks, sent)``, added up by their first column if there is a total. Only the groups, or groups
        and parts, that are keys of sent are read."""
        b = spark.sparkContext.broadcast((sent, mean, std))
        shape = pa.schema([(c, ARROW[k]) for c, k in map(str.split, schema.split(", "))])

        def run(batches):
            what, m, s = b.value
            for row in task(_blocks(batches, d, m, s), what):
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, row, strict=True))], shape)

        groups, places = {k if isinstance(k, int) else k[0] for k in sent}, [k[1] for k in sent if not isinstance(k, int)]
        source = source.where(F.col("_k").isin(groups) & (F.col("_p").isin(places) if places else F.lit(True)))
        out = source.mapInArrow(run, schema)
        got = (out if total is None else out.groupBy(shape.names[0]).applyInPandas(total, schema)).collect()
        b.unpersist()
        return got

    jobs = [(g, k, s) for g in range(len(found)) for k in sorted(COMPONENTS, reverse=True) for s in starts_of(k) if k <= n[g]]
    held, best, out, most = [], {}, [], SENT // 8 // (d * (d + 3) // 2 + 1)
    for at, (g, k, s) in enumerate(jobs):
        rng = np.random.default_rng(SEED)
        for _ in range(s):  # the draws of the starts before
            rng.integers(n[g]), rng.random(k - 1)
        held.append(Fit(g, k, s, rng))
        if at + 1 < len(jobs) and sum(f.k for f in held) + jobs[at + 1][1] <= most:
            continue
        _seed(held, n, lambda *a: over(train, *a))
        _expect(held, n, n_val, d, lambda *a: over(train, *a), lambda *a: over(val, *a))
        for f in held:
            if (f.group, f.k) not in best or (f.ll, -f.start) > (best[f.group, f.k].ll, -best[f.group, f.k].start):
                best[f.group, f.k] = f
        held = []
        done = jobs[at + 1][0] if at + 1 < len(jobs) else len(found)
        for i in sorted({i for i, _ in best if i < done}):
            fits = [best.pop((i, c)) for c in COMPONENTS if (i, c) in best]
            c, _ = knee([(f.k, f.val_ll) for f in fits])
            f = next(f for f in fits if f.k == c)
            m = {"ll": f.ll, **{a: v.tolist() for a, v in zip(("weights", "means", "chol"), f.model, strict=True)}}
            m |= {"k": c, "val_ll": f.val_ll, "family": "mixture", "mean": mean[i].tolist(), "std": std[i].tolist()}
            out.append((*[found[i][a] for a in keys], "mixture", n[i], json.dumps(m)))
    return spark.createDataFrame(out, f"{kinds}, {REGISTRY}")


def _seed(fits: list[Fit], n: Sequence[int], over: Callable) -> None:
    """k-means++ centres as ``begin_mixture`` draws them: a pass adds up what each part of the table weighs, a second one
    takes the row at the drawn place of its part."""

    def weigh(blocks, sent):
        held: dict = {}
        for g, p, x in blocks:
            c, q = held.get((g, p), (0, 0.0))
            held[g, p] = c + len(x), q + np.array([_gap(x, sent[g][i]).sum() for i in sent[g]])
        yield from ((g, p, c, q.tobytes()) for (g, p), (c, q) in held.items())

    def take(blocks, sent):
        passed, last = {}, {}
        for g, p, x in blocks:
            for i, (centres, place) in sent.get((g, p), {}).items():
                run = passed.get(i, 0.0) + np.cumsum(gap := _gap(x, centres))
                if passed.get(i, 0.0) <= place and gap.any():
                    j = np.searchsorted(run, place, side="right")
                    last[i] = x[j if j < len(x) else np.flatnonzero(gap)[-1]].copy()
                passed[i] = run[-1]
        yield from ((i, x.tobytes()) for i, x in last.items())

    while todo := [i for i, f in enumerate(fits) if len(f.centres) < f.k]:
        sent: dict = {}
        for i in todo:
            sent.setdefault(fits[i].group, {})[i] = np.array(fits[i].centres)
        parts = sorted(over(weigh, sent, "g int, p int, n long, q binary"), key=lambda r: (r.g, r.p))
        wanted: dict = {}
        for g, of in sent.items():
            here = [r for r in parts if r.g == g]
            for col, (i, centres) in enumerate(of.items()):
                weight = np.array([np.frombuffer(r.q)[col] for r in here])
                if len(centres) and weight.sum() > 0:
                    place = fits[i].rng.random() * weight.sum()
                else:
                    place, weight, centres = fits[i].rng.integers(n[g]), np.array([float(r.n) for r in here]), centres[:0]
                ends = np.cumsum(weight)
                j = min(int(np.searchsorted(ends, place, side="right")), int(np.flatnonzero(weight)[-1]))
                wanted.setdefault((g, here[j].p), {})[i] = centres, place - (ends[j] - weight[j])
        for r in over(take, wanted, "i int, x binary"):
            fits[r.i].centres.append(np.frombuffer(r.x))


def _gap(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre; 1 without any."""
    return squares(x, centres).min(axis=1) if len(centres) else np.ones(len(x))


def _expect(fits: list[Fit], n: Sequence[int], n_val: Mapping[int, int], d: int, over: Callable, over_val: Callable) -> None:
    """EM from the centres, as ``run_mixture``, then the held-out log-likelihoods."""

    def begin(blocks, sent):
        held: dict = {}
        for g, _, x in blocks:
            p = products(x)
            for i, centres in sent[g].items():
                held[i] = held.get(i, 0.0) + np.eye(len(centres))[squares(x, centres).argmin(axis=1)].T @ p
        yield from ((i, 0.0, q.tobytes()) for i, q in held.items())

    def step(blocks, sent):
        held: dict = {}
        for g, _, x in blocks:
            _, at, size, log = sent[g]
            p = products(x)
            joint = p @ log
            top = np.maximum.reduceat(joint, at, axis=1)
            joint = np.exp(joint - np.repeat(top, size, axis=1))
            total = np.add.reduceat(joint, at, axis=1)
            joint /= np.repeat(total, size, axis=1)
            ll, q = held.get(g, (0.0, 0.0))
            held[g] = ll + (top + np.log(total)).sum(axis=0), q + joint.T @ p
        for g, (ll, q) in held.items():
            ids, at, size, _ = sent[g]
            yield from ((i, float(v), q[a : a + k].tobytes()) for i, v, a, k in zip(ids, ll, at, size, strict=True))

    def judge(blocks, sent):
        held: dict = {}
        for g, _, x in blocks:
            _, at, size, log = sent[g]
            joint = products(x) @ log
            top = np.maximum.reduceat(joint, at, axis=1)
            total = np.add.reduceat(np.exp(joint - np.repeat(top, size, axis=1)), at, axis=1)
            held[g] = held.get(g, 0.0) + (top + np.log(total)).sum(axis=0)
        for g, ll in held.items():
            yield from ((i, float(v), np.zeros(1).tobytes()) for i, v in zip(sent[g][0], ll, strict=True))

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        q = sum(np.frombuffer(b) for b in pdf["q"])
        return pd.DataFrame([(pdf["i"].iloc[0], pdf["ll"].sum(), q.tobytes())], columns=["i", "ll", "q"])

    def sent_of(of: list[int]) -> dict:
        out = {}
        for g in sorted({fits[i].group for i in of}):
            ids = [i for i in of if fits[i].group == g]
            size = [fits[i].k for i in ids]
            out[g] = ids, np.cumsum([0, *size[:-1]]), size, np.concatenate([coefficients(fits[i].model) for i in ids], axis=1)
        return out

    schema, live = "i int, ll double, q binary", list(range(len(fits)))
    begun: dict = {}
    for i in live:
        begun.setdefault(fits[i].group, {})[i] = np.array(fits[i].centres)
    got = over(begin, begun, schema, added)
    for _ in range(ITERATIONS):
        for r in got:
            fits[r.i].model = mixture_of_sums(np.frombuffer(r.q).reshape(fits[r.i].k, -1), d)
        got, live = over(step, sent_of(live), schema, added), []
        for r in got:
            f = fits[r.i]
            last, f.ll = f.ll, r.ll / n[f.group]
            if not abs(f.ll - last) < 1e-3:
                live.append(r.i)
        got = [r for r in got if r.i in live]
        if not live:
            break
    for f in fits:
        f.val_ll = f.ll
    if judged := [i for i, f in enumerate(fits) if n_val.get(f.group)]:
        for r in over_val(judge, sent_of(judged), schema, added):
            fits[r.i].val_ll = r.ll / n_val[fits[r.i].group]


def moments(rows: DataFrame, by: Sequence[str], d: int, min_rows: int) -> tuple[list, np.ndarray, np.ndarray, DataFrame]:
    """The groups of (by, _x) with min_rows rows, their means and deviations (1 if constant), and a table that numbers them."""
    stats = [f(F.get("_x", F.lit(i))).alias(f"_{p}{i}") for i in range(d) for p, f in (("m", F.avg), ("s", F.stddev_pop))]
    groups = rows.groupBy(*by).agg(F.count("*").alias("n_train"), *stats).where(F.col("n_train") >= min_rows)
    found = groups.limit(MAX_MODELS + 1).collect()
    if len(found) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    mean = np.array([[r[f"_m{i}"] for i in range(d)] for r in found], float).reshape(-1, d)
    std = np.array([[r[f"_s{i}"] for i in range(d)] for r in found], float).reshape(-1, d)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    number = rows.sparkSession.createDataFrame([(*[r[c] for c in by], k, r.n_train) for k, r in enumerate(found)], f"{kinds}, _k int, n_train long")
    return found, mean, np.where(std > 0, std, 1.0), number


def gaussians(rows: DataFrame, by: Sequence[str], d: int, min_rows: int) -> DataFrame:
    """Registry of Mahalanobis models from (by, _x), what ``fit_family`` gives on all rows: means and deviations in one
    pass, products and fourth powers of the standardised features, summed by partition and then by group, in a second."""
    found, mean, std, number = moments(rows, by, d, min_rows)
    same = [rows[c].eqNullSafe(number[c]) for c in by]

    def sums(batches):
        held: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("_k"):
                z = (np.array(part["_x"].tolist(), float) - mean[k]) / std[k]
                g, q = held.get(k, (0.0, 0.0))
                held[k] = g + z.T @ z, q + ((z**2).sum(axis=1) ** 2).sum()
        yield pd.DataFrame([(k, g.ravel(), q) for k, (g, q) in held.items()], columns=["_k", "g", "q"])

    counts = [r.n_train for r in found]

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["_k"].iloc[0])
        cov, shrinkage = shrunk(np.sum(np.stack(pdf["g"].to_list()), axis=0).reshape(d, d) / counts[k], pdf["q"].sum(), counts[k])
        m = {"centre": [0.0] * d, "precision": np.linalg.pinv(cov).tolist(), "shrinkage": shrinkage, "family": "mahalanobis", "mean": mean[k].tolist(), "std": std[k].tolist()}
        return pd.DataFrame([(k, json.dumps(m))], columns=["_k", "model"])

    parts = rows.join(F.broadcast(number), reduce(and_, same)).select("_k", "_x").mapInPandas(sums, "_k int, g array<double>, q double")
    made = parts.groupBy("_k").applyInPandas(model, "_k int, model string")
    return number.join(made, "_k").select(*by, F.lit("mahalanobis").alias("family"), "n_train", "model")


def with_pools(rows: DataFrame, column: str, pools: Mapping[str, Sequence[str]]) -> DataFrame:
    """rows, and each once more for every pool that holds its group, under the pool's name: what is fitted or calibrated on
    the result has an envelope per group and one per pool. A group is bounded by its rows, a pool by those of its members."""
    tags = F.array(F.col(column), *[F.when(F.col(column).isin(list(members)), F.lit(name)) for name, members in pools.items()])
    return rows.withColumn(column, F.explode(F.array_distinct(F.when(F.col(column).isNull(), F.array(F.col(column))).otherwise(F.array_compact(tags)))))


def registry_digest(registry: DataFrame) -> str:
    """A digest over all rows of a registry (at most MAX_MODELS), whatever their order."""
    one = F.sha2(F.to_json(F.struct(*sorted(registry.columns))), 256)
    rows = registry.select(one.alias("d")).limit(MAX_MODELS + 1).collect()
    if len(rows) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    return hashlib.sha256("\n".join(sorted(r.d for r in rows)).encode()).hexdigest()


def save_registry(registry: DataFrame, path: str, note: str = "") -> str:
    """Write a registry (or a threshold table) and a manifest with its digest below path; the digest is returned. Numbers in
    Parquet and JSON, no pickles."""
    registry.coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    saved = registry.sparkSession.read.parquet(f"{path}/models")
    digest = registry_digest(saved)
    manifest = registry.sparkSession.createDataFrame([(digest, saved.count(), note)], "digest string, n_models long, note string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return digest


def load_registry(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """A saved registry; an error if it is not what its manifest (and the given digest) say."""
    saved, found = spark.read.parquet(f"{path}/models"), spark.read.schema("digest string, n_models long, note string").json(f"{path}/manifest").collect()
    now = registry_digest(saved)
    if len(found) != 1 or found[0].digest != now or digest not in (None, now):
        raise ValueError(f"registry at {path} does not have the digest it was frozen with")
    return saved


def attach_registry(registry: DataFrame, extra: DataFrame, by: Sequence[str]) -> DataFrame:
    """A registry with the envelopes of another one; an envelope that both have is an error."""
    twice = registry.select(*by, "family").join(extra.select(*by, "family"), [*by, "family"]).limit(1).collect()
    if twice:
        raise ValueError(f"both registries hold {tuple(twice[0])}")
    return registry.unionByName(extra, allowMissingColumns=True)


def score_rows(rows: DataFrame, registry: DataFrame, by: Sequence[str], features: Sequence[str], family: str) -> DataFrame:
    """rows with ``score``; NULL where a feature is missing or the group has no model. No shuffle. Models are
    configuration and are sent to all tasks: more than MAX_MODELS of them are an error."""
    found = registry.where(F.col("family") == family).limit(MAX_MODELS + 1).collect()
    if len(found) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    models = {tuple(str(r[c]) for c in by): json.loads(r.model) for r in found}
    sent = rows.sparkSession.sparkContext.broadcast(models)
    n = len(by)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols[n:]])
        out = np.full(len(x), np.nan)
        known = np.isfinite(x).all(axis=1)
        keys = pd.MultiIndex.from_arrays([c.astype(str) for c in cols[:n]])
        for key in keys[known].unique():
            m = sent.value.get(tuple(key) if n > 1 else (key[0],))
            if m is not None:
                at = known & (keys == key)
                out[at] = score_family(x[at], m)
        return pd.Series(out)

    s = score(*[F.col(c).cast("string") for c in by], *[F.col(c).cast("double") for c in features])
    return rows.withColumn("score", s).withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def standardized(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Features minus mean over population deviation (1 if constant), one aggregate and one join with a row per group."""
    aggs = [f(c).alias(f"_{p}_{c}") for c in features for p, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs).withColumn("_one", F.lit(1))
    rows = rows.join(tables.small(stats), list(by)) if by else rows.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one").drop("_one")
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in features}
    return rows.withColumns(z).drop(*[f"_{p}_{c}" for c in features for p in "ms"])


def thresholds(rows: DataFrame, by: Sequence[str], targets: Sequence[float] = FAR_TARGETS, split: str = "split") -> DataFrame:
    """Per group and false-alarm target: the percentile 100 (1 - target) of validation scores, of training scores where
    the group has no validation score. Exact, linearly interpolated."""
    kind = F.when(F.col(split) == "val", 0).when(F.col(split) == "train", 1)
    rows = rows.withColumn("_s", kind).where("_s is not null")
    cuts = tables.exact_quantiles(rows, [*by, "_s"], "score", [1 - t for t in targets])
    best = cuts.groupBy(*by).agg(F.min_by("cuts", "_s").alias("cuts"))
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in targets]).alias("far_target"), F.col("cuts").alias("threshold")))
    return best.select(*by, pairs.alias("_p")).select(*by, "_p.far_target", "_p.threshold")


def subspace(course: Sequence[str], available: Column | None = None) -> Column:
    """'core_course' where all course features are known (and that model exists), else 'core'."""
    known = F.lit(True)
    for c in course:
        known = known & F.col(c).isNotNull()
    if available is not None:
        known = known & available
    return F.when(known, "core_course").otherwise("core")
