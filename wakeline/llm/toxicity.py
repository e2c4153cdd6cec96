"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text: densities of a learned lexicon (words, stems and de-obfuscated words that toxic training texts
hold far more often), nearness of second-person words to lexicon hits, capitals, punctuation and obfuscation rates.
The training sample (at most TOXIC and CLEAN rows, drawn by a hash of the id) is split in three: the lexicon is
learned on one part, the trees on the second, the calibration on the third, so no part judges what it has learned.
Terms are counted and features made in tasks; the driver gets the lexicon and 18 numbers a text.

Defined results: null and empty texts have all features 0 and a score like any other; without training rows of both
classes the score is the share of label 1 (0 without labels); equal texts get equal scores; labels, lang, source and
ids are never inputs of a score; of rows that share an id the first by text is learned from; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common, labelled
from .language_id import held_out

TOXIC, CLEAN = 4_000, 6_000
LEXICON = 3_000
STEMS = (4, 5, 6)
MEMO = 300_000
FEATURES = 18
SECOND_PERSON = frozenset("you your yours yourself u ur thou du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus vuestro".split())
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
_LEET = str.maketrans("013457@$!", "oieastasi")
_RUN = re.compile(r"(.)\1{2,}")
SCHEMA = "score double, predicted int"


def plain(word: str) -> str:
    """A word without outer punctuation, lower-cased."""
    return word.strip(_STRIP).lower()


def unmasked(word: str) -> str:
    """A word as it reads without digits for letters, inner marks and drawn-out letters; '' if it has none of these."""
    w = word.lower()
    core = "".join(c for c in w.strip(".,;:?!\"'()").translate(_LEET) if c.isalpha())
    core = _RUN.sub(r"\1", core)
    return core if len(core) > 2 and core != plain(word) else ""


def terms(text: str) -> set[str]:
    """Words (as they are and as they read) and stems ('stem*') of a text."""
    parts = set(text.split())
    words = ({plain(w) for w in parts} | {unmasked(w) for w in parts}) - {""}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[y].update(terms(text))
        names = list(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([held[y][w] for w in names], pa.int64()) for y in (1, 0)]], names=["w", "a", "b"])


def learn_lexicon(texts: DataFrame, n1: int, n0: int, size: int = LEXICON) -> dict[str, float]:
    """The terms that mark toxic texts, with their log odds: those of the most odds. texts: text, g (1 toxic); n1 and
    n0 texts of either kind. Counted in tasks; at most ``size`` terms leave them."""
    held = texts.select("text", F.col("g").cast("int")).mapInArrow(_term_counts, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    v = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    # few texts may share a rare word by chance: two standard errors less
    v = v - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) - 1 / (n1 + 1) - 1 / (n0 + 1))
    best = held.where("a >= 4").select("w", v.alias("v")).where("v > 0.7").orderBy(F.desc("v"), "w").limit(size).collect()
    return {r.w: r.v for r in best}


class Words(dict):
    """What a word adds to the features, remembered per Python worker up to a bound."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple | None:
        p = plain(word)
        get = self.lexicon.get
        v = get(p, 0.0)
        stem = max((get(p[:n] + "*", 0.0) for n in STEMS if len(p) > n), default=0.0)
        hidden = 0.0
        masked = any(c.isalpha() for c in p) and not p.isalpha()
        if masked or _RUN.search(p):
            x = unmasked(word)
            if x:
                hidden = max(get(x, 0.0), max((get(x[:n] + "*", 0.0) for n in STEMS if len(x) > n), default=0.0))
        second, upper = p in SECOND_PERSON, len(word) > 2 and word.isupper()
        got = (v, stem, hidden, second, upper, masked) if v or stem or hidden or second or upper or masked else None
        if len(self) >= MEMO:
            self.clear()
        self[word] = got
        return got


def nearby(hits: list[int], you: list[int], reach: int = 4) -> int:
    """How many hits have a second-person word at most ``reach`` words away; both in ascending order."""
    return int((np.searchsorted(you, np.array(hits) + reach, "right") > np.searchsorted(you, np.array(hits) - reach, "left")).sum()) if hits and you else 0


def features(texts: list[str], words: Words) -> np.ndarray:
    rows = []
    for text in texts:
        parts = text.split()
        found = [(i, c) for i, c in enumerate(map(words.__getitem__, parts)) if c]
        n = max(len(parts), 1)
        hits = [(i, max(c[0], c[1], c[2])) for i, c in found if c[0] or c[1] or c[2]]
        you = [i for i, c in found if c[3]]
        near = nearby([i for i, _ in hits], you)
        raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
        chars = max(int(raw.sum()), 1)
        marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
        strong = sorted((v for _, v in hits), reverse=True)[:3] + [0.0] * 3
        rows.append((
            math.log1p(len(hits)), len(hits) / n, sum(v for _, v in hits) / n, math.log1p(sum(1 for _, v in hits if v > 2)),
            sum(1 for _, c in found if c[0]) / n, sum(1 for _, c in found if c[1]) / n, math.log1p(sum(1 for _, c in found if c[2])),
            strong[0], strong[1], strong[2], len(you) / n, near / n, raw[65:91].sum() / chars, sum(1 for _, c in found if c[4]) / n,
            raw[33] / chars, marks / chars, sum(1 for _, c in found if c[5]) / n, math.log1p(n),
        ))
    return np.array(rows, float).reshape(len(texts), FEATURES)


def _numbers(rows: DataFrame, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of sampled rows, made in tasks, in order of id."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([x.tobytes() for x in features([t.decode() for t in texts], _remembered(sent.value))], pa.binary())]

    out = sorted(common.per_row(rows, ["id", "g", "weight"], "text", run, "x binary").collect(), key=lambda r: r.id)
    return np.frombuffer(b"".join(r.x for r in out)).reshape(len(out), FEATURES), np.array([r.g for r in out], int), np.array([r.weight for r in out], float)


def fit(sample: DataFrame) -> dict:
    """sample: id, g (1 toxic, 0 not), total (labelled rows of that class), text."""
    part = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(10))
    part = F.when(part < 5, 0).when(part < 8, 1).otherwise(2)
    count = {(r.part, r.g): (r["count"], r.total) for r in sample.groupBy(part.alias("part"), "g").agg(F.count("*").alias("count"), F.max("total").alias("total")).collect()}
    rows_of = {y: sum(n for (_, g), (n, _) in count.items() if g == y) for y in (0, 1)}
    total = {y: max((t for (_, g), (_, t) in count.items() if g == y), default=0) for y in (0, 1)}
    prior = total[1] / max(sum(total.values()), 1)
    if any((i, y) not in count for i in range(3) for y in (0, 1)):
        return {"prior": prior}
    sample = sample.withColumn("weight", F.when(F.col("g") == 1, F.lit(total[1] / rows_of[1])).otherwise(F.lit(total[0] / rows_of[0])))
    lexicon = learn_lexicon(sample.where(part == 0), count[0, 1][0], count[0, 0][0])
    x, y, w = _numbers(sample.where(part == 1), lexicon)
    trees = boosting.fit_trees(x, y, w)
    x, y, w = _numbers(sample.where(part == 2), lexicon)
    return {"lexicon": lexicon, "trees": trees, "curve": boosting.fit_isotonic(boosting.margins(x, trees), y, w)}


_words: dict[int, Words] = {}


def _remembered(lexicon: dict[str, float]) -> Words:
    key = hash(frozenset(lexicon.items()))
    if key not in _words:
        _words.clear()
        _words[key] = Words(lexicon)
    return _words[key]


def predict(texts: list[str], model: dict) -> np.ndarray:
    if "trees" not in model:
        return np.full(len(texts), model["prior"])
    m = boosting.margins(features(texts, _remembered(model["lexicon"])), model["trees"])
    return np.clip(boosting.calibrated(m, model["curve"]), 0.0, 1.0)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        s = predict([t.decode() for t in texts], sent.value)
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return common.per_row(docs, [id_col], text_col, run, SCHEMA)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    sample = labelled.balanced(docs, labels.where(~held_out("doc_id", 5, 0)), "toxic", {1: TOXIC, 0: CLEAN})
    return score(docs, fit(sample)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
