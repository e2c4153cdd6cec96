import zlib

import numpy as np

from wakeline.llm import boosting, language_id, pu_quality, toxicity

DIR = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_accuracy(spark):
    rows = language_id.op6_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_presence_kernel_by_hand():
    a, b = language_id.presence(["ab", "ab ba"])
    assert abs(a @ a - 1) < 1e-5 and 0 < a @ b < 1
    assert language_id.presence([""]).shape[0] == 1


def test_language_odd_rows(spark, odd):
    model = language_id.fit_table(odd)
    out = {r.doc_id: r for r in language_id.languages(odd, model).collect()}
    assert out[1].lang_pred == "und" and out[3].lang_pred == "und" and out[4].lang_pred == "en" and out[1].score == 0
    assert language_id.fit_table(odd.limit(0)) is None
    assert {r.lang_pred for r in language_id.languages(odd, None).collect()} == {"und"}
    assert language_id.languages(odd.limit(0), model).count() == 0


def test_toxicity_on_held_out_labels(spark):
    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    held = [(r.toxic, r.predicted, r.score) for r in rows if r.held_out]
    y, p = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    assert (y == p).mean() > 0.97 and p[y == 1].mean() > 0.85
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)


def test_obfuscated_words_are_read():
    assert toxicity.unmasked("1d10t!") == "idiot" and toxicity.unmasked("i.d.i.o.t") == "idiot" and toxicity.unmasked("idiooooot") == "idiot" and toxicity.unmasked("plain,") == ""


def test_toxicity_odd_rows(spark, odd):
    kind = "id long, text string, g int, total long, place int"
    rows = toxicity.score(odd, toxicity.fit(spark.createDataFrame([], kind))).collect()
    assert len(rows) == 10 and {r.score for r in rows} == {0.0}
    model = toxicity.fit(spark.createDataFrame([(i, "you idiot" if i % 2 else "fine day", i % 2, 200, 0) for i in range(400)], kind))
    assert len(toxicity.score(odd, model).collect()) == 10 and toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.predict(["you idiot"], model)[0] > 0.9 > 0.1 > toxicity.predict(["fine day"], model)[0]


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    m = boosting.fit_trees(x, y, np.ones(2000))
    assert ((boosting.margins(x, m) > 0) == y).mean() > 0.95
    at, v = boosting.fit_isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(v) >= 0).all() and boosting.calibrated(np.array([0.0, 2.5, 9.0]), (at, v)).tolist() == [0.0, 0.5, 1.0]


def test_quality_on_held_out_labels(spark):
    rows = pu_quality.op8_pu_quality(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    held = [(r.quality, r.predicted) for r in rows if r.held_out]
    y, p = np.array(held).T
    assert (y == p).mean() > 0.9
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    p = rng.normal(0, 1, (2000, 4))
    u = np.vstack([rng.normal(0, 1, (2100, 4)), rng.normal(4, 1, (900, 4))])
    assert abs(pu_quality.estimate_prior(p, rng.permutation(u)) - 0.7) < 0.07


def test_quality_odd_rows(spark, odd):
    assert {r.score for r in pu_quality.score(odd, {}).collect()} == {0.0}
    texts = [f"one two {i} three, four and five more words here".encode() for i in range(50)]
    model = pu_quality.fit(pu_quality.features(texts), pu_quality.features(texts + [b"x " * 50] * 20))
    out = {r.doc_id: r.score for r in pu_quality.score(odd, model).collect()}
    assert out[1] == out[2] == out[3] == 0 and pu_quality.score(odd.limit(0), model).count() == 0
