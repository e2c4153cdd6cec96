"""Quality by positive-unlabelled learning.

Trusted positives (labelled 1) and unlabelled web text train a small network under the non-negative unbiased risk:
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), with logistic loss; when the bracket turns
negative the step goes back along it. The class prior is estimated first, from a discriminator of positives against
unlabelled text: the least ratio of their shares above any of its thresholds (with a margin for the smaller counts).
Negative labels are not used at all. Inputs are dense counts of the whole text, made in tasks: the driver gets 18 numbers for
each of at most POSITIVES and UNLABELLED sampled texts.

Defined results: null and empty texts are scored on all-zero counts and get score 0 (there is nothing to keep);
without labelled positives or unlabelled texts the score is 0; equal texts get equal scores; labels, lang, source and
ids are never inputs of a score; of rows that share an id the first by text is learned from; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled
from .language_id import held_out
from .quality_rules import LEVEL, base_counts

POSITIVES, UNLABELLED = 4_000, 6_000
HIDDEN = 16
FEATURES = 18
KEEP = 0.7
SCHEMA = "score double, predicted int"


def features(texts: list[bytes]) -> np.ndarray:
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    hashes, at = common.batch_words(texts)
    rows = []
    for i, t in enumerate(texts):
        words = hashes[at[i] : at[i + 1]]
        if not len(words):
            rows.append((0.0,) * FEATURES)
            continue
        n, chars, symbols, dup_lines, repeated = base_counts(t, words)
        raw = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        size = len(t)
        count = np.unique(words, return_counts=True)[1]
        lines = t.count(b"\n") + 1
        upper, lower = raw[65:91].sum(), raw[97:123].sum() + raw[0xC3]
        rows.append((
            math.log1p(n), chars / n, symbols / n, upper / (upper + lower + 1), raw[48:58].sum() / size, raw[33] / n,
            (raw[44] + raw[46]) / n, (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / size, raw[124] / n,
            math.log(len(count)) / math.log(n + 1), count.max() / n, float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
            repeated / n, dup_lines / lines, math.log1p(n / lines), math.log(len(compress(t)) / size + 0.02), raw[128:].sum() / size,
            (raw[60] + raw[62] + raw[123] + raw[125]) / size,
        ))
    return np.array(rows, float).reshape(len(texts), FEATURES)


def _forward(x, p):
    h = np.tanh(x @ p[0] + p[1])
    return h, h @ p[2] + p[3]


def _back(x, h, d, p):
    """Gradients for d = dloss/doutput."""
    dh = d[:, None] * p[2][None] * (1 - h**2)
    return [x.T @ dh, dh.sum(axis=0), h.T @ d, np.array(d.sum())]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def gradients(q: np.ndarray, u: np.ndarray, p: list[np.ndarray], prior: float | None) -> list[np.ndarray]:
    """Gradients of the risk of a batch q of positives and u of unlabelled rows; logistic loss: l(z, +1) = log(1 + e^-z),
    l(z, -1) = log(1 + e^z). prior None: a plain discriminator of q against u."""
    (hu, gu), (hq, gq) = _forward(u, p), _forward(q, p)
    if prior is None:
        return [a + b for a, b in zip(_back(q, hq, -_sigmoid(-gq) / len(q), p), _back(u, hu, _sigmoid(gu) / len(u), p), strict=True)]
    negative = [a + b for a, b in zip(_back(u, hu, _sigmoid(gu) / len(u), p), _back(q, hq, -prior * _sigmoid(gq) / len(q), p), strict=True)]
    if np.logaddexp(0, gu).mean() < prior * np.logaddexp(0, gq).mean():  # overfitted: go back along the negative risk
        return [-a for a in negative]
    return [a + b for a, b in zip(_back(q, hq, -prior * _sigmoid(-gq) / len(q), p), negative, strict=True)]


def _train(xp: np.ndarray, xu: np.ndarray, prior: float | None, epochs: int, seed: int) -> list[np.ndarray]:
    """Adam over batches. prior None: a plain discriminator of xp against xu."""
    rng = np.random.default_rng(seed)
    d = xp.shape[1]
    p = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.array(0.0)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    size = 256
    for _ in range(epochs):
        order = rng.permutation(len(xu))
        for i in range(0, len(xu), size):
            grads = gradients(xp[rng.integers(0, len(xp), size)], xu[order[i : i + size]], p, prior)
            step += 1
            for k in range(4):
                g = grads[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def estimate_prior(xp: np.ndarray, xu: np.ndarray, seed: int = 3) -> float:
    """The share of positives among the unlabelled: trained on one half, read off the other."""
    p = _train(xp[::2], xu[::2], None, 12, seed)
    gp, gu = np.sort(_forward(xp[1::2], p)[1]), np.sort(_forward(xu[1::2], p)[1])
    cuts = np.quantile(gp, np.linspace(0.005, 0.5, 100))
    above_p = 1 - np.searchsorted(gp, cuts, "left") / len(gp)
    above_u = 1 - np.searchsorted(gu, cuts, "left") / len(gu)
    error = np.sqrt(above_u * (1 - above_u) / len(gu)) + np.sqrt(above_p * (1 - above_p) / len(gp))
    return float(np.clip(((above_u + error) / np.maximum(above_p - error, 1e-3)).min(), 0.05, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray) -> dict:
    """Both as rows of features()."""
    if len(positives) < 4 or len(unlabelled) < 4:
        return {}
    mean, std = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    std[std == 0] = 1
    xp, xu = (np.clip((x - mean) / std, -6, 6) for x in (positives, unlabelled))
    prior = estimate_prior(xp, xu)
    nets = [_train(xp, xu, prior, 40, seed) for seed in (1, 2, 3)]
    return {"mean": mean, "std": std, "prior": prior, "nets": nets}


def numbers_of(sample: DataFrame) -> np.ndarray:
    """The features of a sample's texts, made in tasks, in order of id."""
    rows = common.per_row(sample, ["id"], "text", lambda t: [pa.array([x.tobytes() for x in features(t)], pa.binary())], "x binary").collect()
    return np.frombuffer(b"".join(r.x for r in sorted(rows, key=lambda r: r.id))).reshape(len(rows), FEATURES)


def predict(texts: list[bytes], model: dict) -> np.ndarray:
    if not model:
        return np.zeros(len(texts))
    raw = features(texts)
    x = np.clip((raw - model["mean"]) / model["std"], -6, 6)
    s = np.mean([_sigmoid(_forward(x, p)[1]) for p in model["nets"]], axis=0)
    return np.where(raw[:, 0] > 0, s, 0.0)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        s = predict(texts, sent.value)
        return [pa.array(s, pa.float64()), pa.array((s >= KEEP).astype(np.int32), pa.int32())]

    return common.per_row(docs, [id_col], text_col, run, SCHEMA)


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    good = labels.where(~held_out("doc_id", 4, 2) & (F.col("quality") == 1)).select(F.col("doc_id").cast("long").alias("id"), F.lit(1).alias("g"))
    # no label is read here, so held-out documents may be among the unlabelled texts
    any_ = docs.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).alias("g"))
    positives, unlabelled = (numbers_of(labelled.with_texts(docs, labelled.draw(rows, {g: n}, seed), "doc_id", "text")) for rows, g, n, seed in ((good, 1, POSITIVES, 5), (any_, 0, UNLABELLED, 6)))
    model = fit(positives, unlabelled)
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


QUERIES = {"op8_pu_quality": op8_pu_quality}
ORACLE: dict[str, str] = {}
