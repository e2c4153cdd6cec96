"""Kernels, ridge, features, trees, calibration and risk against plain versions on a few documents."""

import itertools
import math
import random

import numpy as np
import pytest

from wakeline.llm import boosting, labelled, language_id, pu_quality, toxicity

DIR = "/root/testdata/sf0.001"


def windows_of(text):
    """Per order and window the set of slots of the n-grams that begin in it, with plain integers."""
    s = [ord(c) for c in f" {' '.join(text.lower().split())} "]
    out = {}
    for n in language_id.ORDERS:
        for i in range(len(s) - n + 1):
            h = 0
            for j in range(n):
                h = (h ^ s[i + j]) * language_id._MULTIPLY[j] % 2**32
                h ^= h >> 15
            out.setdefault((n, i // language_id.WINDOW), set()).add(h % language_id.SLOTS)
    return out, -(-len(s) // language_id.WINDOW)


def kernel(a, b):
    (x, nx), (y, ny) = windows_of(a), windows_of(b)
    return sum(len(p & q) / math.sqrt(len(p) * len(q)) for (n, _), p in x.items() for (m, _), q in y.items() if n == m) / (len(language_id.ORDERS) * nx * ny)


def test_kernel_of_whole_texts(texts):
    rng = random.Random(3)
    some = ["", "a", "Zur Stadt", *rng.sample(sorted(filter(None, texts.values())), 6), " ".join(rng.sample(sorted(filter(None, texts.values())), 12))]
    assert max(map(len, some)) > 2 * language_id.WINDOW
    x = language_id.presence(some)
    for i, j in itertools.combinations_with_replacement(range(len(some)), 2):
        assert abs(x[i] @ x[j] - kernel(some[i], some[j])) < 1e-4


def test_long_texts_do_not_saturate():
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60_000))
    a, b, c = make("abcdefghij"), make("abcdefghij"), make("klmnopqrst")
    x = language_id.presence([a, b, c])
    assert x[0] @ x[1] > 2 * (x[0] @ x[2])


def test_ridge_by_least_squares():
    rng = np.random.default_rng(1)
    marks, langs = rng.random((5, 40)).astype(np.float32), ["a"] * 20 + ["b"] * 10 + ["c"] * 5
    x = rng.random((35, 40)).astype(np.float32)
    model = language_id.solve(marks, x @ marks.T, langs, ["a", "b", "c"], ridge=0.1)
    w = np.array([1 / langs.count(k) for k in langs])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    z = np.c_[(x @ marks.T) @ vector / np.sqrt(value), np.ones(35)]
    lam = 0.1 * w.sum() / z.shape[1]
    for k, name in enumerate("abc"):
        y = np.array([1.0 if v == name else -1.0 for v in langs])
        want = np.linalg.lstsq(np.r_[z * np.sqrt(w)[:, None], np.sqrt(lam) * np.eye(z.shape[1])], np.r_[y * np.sqrt(w), np.zeros(z.shape[1])], rcond=None)[0]
        assert np.allclose(z @ want, x @ model["marks"] @ model["beta"][:, k] + model["bias"][k], atol=1e-3)


def test_predictions_by_kernel_values(spark, texts):
    model = language_id.fit_table(spark.read.parquet(f"{DIR}/documents.parquet"))
    some = [t for t in texts.values() if t and len(t) < 3000][:5]
    x = language_id.presence(some)
    names, score = language_id.predict(some, model)
    for i in range(len(some)):
        margin = [sum(float(x[i] @ model["marks"][:, m]) * float(model["beta"][m, k]) for m in range(model["marks"].shape[1])) + float(model["bias"][k]) for k in range(len(model["names"]))]
        assert names[i] == model["names"][int(np.argmax(margin))]
        assert abs(score[i] - 1 / sum(math.exp(4 * (v - max(margin))) for v in margin)) < 1e-2


def plain_features(text, lexicon):
    """The features of one text, word by word and pair by pair."""
    parts = text.split()
    n, raw = max(len(parts), 1), text.encode()
    look = lambda w: lexicon.get(w, 0.0)
    stem = lambda w: max([look(w[:k] + "*") for k in toxicity.STEMS if len(w) > k], default=0.0)
    rows = []
    for w in parts:
        p = toxicity.plain(w)
        masked = any(c.isalpha() for c in p) and not p.isalpha()
        u = toxicity.unmasked(w) if masked or any(a == b == c for a, b, c in zip(p, p[1:], p[2:])) else ""
        rows.append((look(p), stem(p), max(look(u), stem(u)) if u else 0.0, p in toxicity.SECOND_PERSON, len(w) > 2 and w.isupper(), masked))
    hits = [(i, max(r[:3])) for i, r in enumerate(rows) if any(r[:3])]
    you = [i for i, r in enumerate(rows) if r[3]]
    strong = sorted((v for _, v in hits), reverse=True)[:3] + [0.0] * 3
    chars = max(len(raw), 1)
    marks = sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in raw)
    return [
        math.log1p(len(hits)), len(hits) / n, sum(v for _, v in hits) / n, math.log1p(sum(v > 2 for _, v in hits)), sum(r[0] > 0 for r in rows) / n, sum(r[1] > 0 for r in rows) / n,
        math.log1p(sum(r[2] > 0 for r in rows)), *strong[:3], len(you) / n, sum(any(abs(i - j) <= 4 for j in you) for i, _ in hits) / n, sum(65 <= b < 91 for b in raw) / chars,
        sum(r[4] for r in rows) / n, raw.count(b"!") / chars, marks / chars, sum(r[5] for r in rows) / n, math.log1p(n),
    ]


def test_features_and_lexicon(spark, texts):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if r.toxic is not None}
    rows = [(i, texts[i] or "", toxic[i]) for i in sorted(toxic)]
    sample = spark.createDataFrame(rows, "id long, text string, g int")
    n = [sum(g == y for *_, g in rows) for y in (0, 1)]
    lexicon = toxicity.learn_lexicon(sample, n[1], n[0])
    want, held = {}, [[toxicity.terms(t) for _, t, g in rows if g == y] for y in (0, 1)]
    for w in set().union(*held[1]):
        b, a = (sum(w in x for x in held[y]) for y in (0, 1))
        v = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) - 1 / (n[1] + 1) - 1 / (n[0] + 1))
        if a >= 4 and v > 0.7:
            want[w] = v
    assert lexicon.keys() == want.keys() and all(abs(lexicon[w] - want[w]) < 1e-9 for w in want)
    lexicon |= {"idiot": 3.0, "stup*": 2.0, "thon*": 1.0, "there": 0.9}
    some = [t for _, t, g in rows if g][:6] + [t for _, t, g in rows if not g][:6] + ["", "YOU 1d10t! you!! idiooot there, stupidly i.d.i.o.t", "you there " * 1_500]
    assert np.allclose(toxicity.features(some, toxicity.Words(lexicon)), [plain_features(t, lexicon) for t in some], atol=1e-9)


def test_trees_by_exhaustive_search():
    rng = np.random.default_rng(4)
    x, w = np.round(rng.normal(size=(300, 3)), 1), rng.integers(1, 4, 300).astype(float)
    y = (x[:, 1] + 0.3 * rng.normal(size=300) > 0.2).astype(int)
    model = boosting.fit_trees(x, y, w, trees=1, depth=1, rate=1.0, l2=1.0)
    u = w / w.mean()
    p = (u * y).sum() / u.sum()
    g, h = u * (y - p), u * p * (1 - p)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c), -j, -c) for j in range(3) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, boosting.BINS + 1)[1:-1])))
    got = (model["feature"][0][0], model["cut"][0][0])
    assert abs(gain(x[:, got[0]] <= got[1]) + gain(x[:, got[0]] > got[1]) - best[0]) < 1e-9
    for row, m in zip(x, boosting.margins(x, model), strict=True):
        side = x[:, got[0]] > got[1] if row[got[0]] > got[1] else x[:, got[0]] <= got[1]
        assert abs(m - math.log(p / (1 - p)) - g[side].sum() / (h[side].sum() + 1)) < 1e-9


def test_isotonic_by_the_max_min_formula():
    rng = np.random.default_rng(6)
    s, y, w = np.sort(rng.random(40)), rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.1
    curve = boosting.fit_isotonic(s, y, w)
    mean = lambda j, k: (w[j : k + 1] * y[j : k + 1]).sum() / w[j : k + 1].sum()
    want = [max(min(mean(j, k) for k in range(i, 40)) for j in range(i + 1)) for i in range(40)]
    assert np.allclose(boosting.calibrated(s, curve), want)


@pytest.mark.parametrize("prior", [None, 0.4, 0.95])
def test_risk_gradients_by_differences(prior):
    rng = np.random.default_rng(8)
    q, u = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4))
    p = [rng.normal(size=(4, pu_quality.HIDDEN)), rng.normal(size=pu_quality.HIDDEN), rng.normal(size=pu_quality.HIDDEN), np.array(0.3)]
    if prior == 0.95:
        p[3] = np.array(-9.0)  # all unlabelled rows look negative: the bracket is below zero
        q = q + 40 * np.sign(p[0] @ p[2])

    def risk():
        gu, gq = pu_quality._forward(u, p)[1], pu_quality._forward(q, p)[1]
        down = lambda z: np.logaddexp(0, z).mean()
        if prior is None:
            return down(-gq) + down(gu)
        bracket = down(gu) - prior * down(gq)
        return prior * down(-gq) + bracket if bracket >= 0 else -bracket

    if prior == 0.95:
        assert np.logaddexp(0, pu_quality._forward(u, p)[1]).mean() < prior * np.logaddexp(0, pu_quality._forward(q, p)[1]).mean()
    for a, grad in zip(p, pu_quality.gradients(q, u, p, prior), strict=True):
        for at in itertools.islice(np.ndindex(a.shape), 12):
            held, step = a[at], 1e-5
            a[at] = held + step
            up = risk()
            a[at] = held - step
            down_ = risk()
            a[at] = held
            assert abs((up - down_) / (2 * step) - grad[at]) < 1e-4


def test_samples_are_bounded_by_rows_not_by_length(spark):
    rows = [(i % 900 if i % 9 else None, f"text {i} " * (20_000 if i == 5 else 1), "x", 7) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g string, place int")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(1200)] + [(5, True), (None, True)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) AS toxic")
    all_ = labelled.balanced(docs, labels, "toxic", {0: 5000, 1: 5000}).collect()
    seen = [r.id for r in all_]
    assert len(seen) == len(set(seen)) and set(seen) == {r[0] for r in rows if r[0] is not None} and max(len(r.text) for r in all_) > 100_000
    assert next(r.g for r in all_ if r.id == 5) == 1 and all(r.text == min(t for i, t, *_ in rows if i == r.id) for r in all_)
    few = labelled.balanced(docs, labels, "toxic", {0: 30, 1: 10}).collect()
    assert 20 <= len(few) <= 40 and {(r.g, r.total) for r in few} == {(0, 799), (1, 401)}
    assert labelled.balanced(docs, labels.limit(0), "toxic", {0: 30, 1: 10}).count() == 0 and labelled.balanced(docs.limit(0), labels, "toxic", {0: 30, 1: 10}).count() == 0


def test_every_language_is_learned(spark):
    rows = [(n * 10 + i, f"{chr(0x4E00 + n) * 3} {chr(0x4E00 + n)} {i}", f"lang{n:03}") for n in range(450) for i in range(3)]
    model = language_id.fit_table(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model["names"]) == 450
