"""Language identification by string kernels.

The blended-spectrum presence kernel counts the character n-grams (1 to 4) that two texts share, normalised per length
so that every n weighs alike. A text is cut into windows of a fixed number of characters and is the mean of their
presence vectors, so that long texts do not fill all slots. Nyström landmarks (a bounded sample of training texts, as
many per language) turn the kernel into features K(x, L) W^-1/2; a kernel ridge regression per language (one against the
rest) on them gives its score. Predicting a batch is two matrix products: presence by landmarks, by the weights (the
whitening is folded into them).

n-grams are hashed to a fixed number of slots; whole texts are used, at fitting and at scoring. Fitting reads at most
``per_language`` texts of each language (fewer where ``rows`` texts in all would be exceeded, at least two), chosen by a
hash of the id. Their texts stay in a table: tasks turn them into landmarks and kernel values, which are what the driver
gets (LANDMARKS numbers a text).

Defined results: null texts and texts without a letter are ``und`` with score 0; a table without usable training rows
predicts ``und`` everywhere; ties between languages go to the first in order of name; lang, source and ids are never
inputs of a prediction; of training rows that share an id the first by text counts; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

ORDERS = (1, 2, 3, 4)
SLOTS = 4_096  # per order
WINDOW = 4_096  # characters
PER_LANGUAGE = 150
FIT_ROWS = 12_000
LANDMARKS = 240
RIDGE = 1e-2
SCHEMA = "lang_pred string, score double"
_MULTIPLY = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_PART = 128 * WINDOW


def presence(texts: list[str]) -> np.ndarray:
    """Normalised presence vectors, averaged over windows: rows of texts, columns of orders times slots. A dot product is
    the kernel. A window's n-grams are those that begin in it."""
    out = np.zeros((len(texts), len(ORDERS) * SLOTS), np.float32)
    for row, text in zip(out, texts, strict=True):
        chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
        for part in range(0, len(chars), _PART):
            c = chars[part : part + _PART + max(ORDERS) - 1]
            own = min(_PART, len(chars) - part)
            for i, n in enumerate(ORDERS):
                h = np.zeros(max(min(len(c) - n + 1, own), 0), np.uint32)
                for j in range(n):
                    h = (h ^ c[j : j + len(h)]) * np.uint32(_MULTIPLY[j])
                    h ^= h >> np.uint32(15)
                there = np.zeros((-(-own // WINDOW), SLOTS), bool)
                there[np.arange(len(h)) // WINDOW, h % np.uint32(SLOTS)] = True
                held = np.maximum(there.sum(axis=1), 1)
                row[i * SLOTS : (i + 1) * SLOTS] += (1 / np.sqrt(held * len(ORDERS))).astype(np.float32) @ there
        row /= -(-len(chars) // WINDOW)
    return out


def landmarks_of(names: list[str], langs: list[str], landmarks: int = LANDMARKS) -> list[int]:
    """Which training texts become landmarks: as many of each language, in order of names and of the texts."""
    share = max(1, landmarks // len(names))
    at: dict[str, list[int]] = {k: [] for k in names}
    for i, k in enumerate(langs):
        at[k].append(i)
    return [i for k in names for i in at[k][:share]]


def solve(marks: np.ndarray, kernel: np.ndarray, langs: list[str], names: list[str], ridge: float = RIDGE) -> dict:
    """The ridge regressions on the whitened kernel values (rows of texts, columns of landmarks)."""
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    z = np.c_[kernel.astype(np.float64) @ white, np.ones(len(kernel))]
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    count = np.maximum((y > 0).sum(axis=0), 1)
    weight = 1 / count[[names.index(k) for k in langs]]  # each language counts alike
    a = (z * weight[:, None]).T @ z
    a[np.diag_indices_from(a)] += ridge * weight.sum() / len(a)
    beta = np.linalg.solve(a, (z * weight[:, None]).T @ y)
    return {"names": names, "marks": np.ascontiguousarray(marks.T), "beta": np.ascontiguousarray(white @ beta[:-1]).astype(np.float32), "bias": beta[-1].astype(np.float32)}


def predict(texts: list[str], model: dict | None) -> tuple[list[str], np.ndarray]:
    lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    if model is None or not lettered.any():
        return ["und"] * len(texts), np.zeros(len(texts))
    names, best, score = model["names"], np.zeros(len(texts), int), np.zeros(len(texts))
    for i in range(0, len(texts), 128):  # 128 presence vectors at once: 8 MB
        margin = (presence(texts[i : i + 128]) @ model["marks"]) @ model["beta"] + model["bias"]
        p = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)).astype(np.float64))
        best[i : i + 128] = margin.argmax(axis=1)
        score[i : i + 128] = 1 / p.sum(axis=1)
    return [names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def fit_table(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, fit_rows: int = FIT_ROWS) -> dict | None:
    """Fit on a bounded sample of the rows that have a language and a letter."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("g"), F.col(text_col).alias("text"))
    found = [r.g for r in rows.select("g").distinct().collect()]
    if not found:
        return None
    each = max(2, min(per_language, fit_rows // len(found)))
    drawn = labelled.draw(rows.select("id", "g"), dict.fromkeys(found, each), 11)
    # an id that repeats with several languages counts for the first
    held = labelled.with_texts(rows, drawn.groupBy("id").agg(F.min("g").alias("g"), F.min("place").alias("place"), F.max("total").alias("total")), "id", "text")
    order = held.select("id", "g").orderBy("g", "place", "id").collect()
    if not order:
        return None
    ids, langs = [r.id for r in order], [r.g for r in order]
    names = sorted(set(langs))
    chosen = [ids[i] for i in landmarks_of(names, langs)]
    marked = held.where(F.col("id").isin(chosen))
    bits = {r.id: r.x for r in common.per_row(marked, ["id"], "text", lambda t: [pa.array([x.tobytes() for x in presence([s.decode() for s in t])], pa.binary())], "x binary").collect()}
    marks = np.frombuffer(b"".join(bits[i] for i in chosen), np.float32).reshape(len(chosen), -1)
    sent = held.sparkSession.sparkContext.broadcast(np.ascontiguousarray(marks.T))

    def against(t: list[bytes]) -> list[pa.Array]:
        k = [presence([s.decode() for s in t[i : i + 128]]) @ sent.value for i in range(0, len(t), 128)]
        return [pa.array([x.tobytes() for part in k for x in part], pa.binary())]

    kernel = {r.id: r.k for r in common.per_row(held, ["id"], "text", against, "k binary").collect()}
    return solve(marks, np.frombuffer(b"".join(kernel[i] for i in ids), np.float32).reshape(len(ids), -1), langs, names)


def languages(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. The model (bounded by its landmarks) is broadcast once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        names, score = predict([t.decode() for t in texts], sent.value)
        return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

    return common.per_row(docs, [id_col], text_col, run, SCHEMA)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit_table(docs.where(~held_out("doc_id", 3, 1)))
    return languages(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLE: dict[str, str] = {}
