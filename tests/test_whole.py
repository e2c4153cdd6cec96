"""Queries and operators over all their rows, groups and features, by brute force."""

import json
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from wakeline.operators import models, splits
from wakeline.plans import model_queries

DIR = "/root/testdata/sf0.001"


def test_overlaps_of_all_images(spark):
    images, want = {}, []
    for r in model_queries.boxes(spark, DIR).collect():
        images.setdefault(r.image_id, []).append((r.ann_id, r.x, r.y, float(r.w), r.h))
    for found in images.values():
        for a, b in combinations(sorted(found), 2):
            i = max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0) * max(min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), 0)
            v = i / (a[3] * a[4] + b[3] * b[4] - i)
            if a[0] < b[0] and v >= 0.3:
                want.append((a[0], b[0], v))
    got = sorted((r.a, r.b, r.iou) for r in model_queries.box_overlaps(spark, DIR).collect())
    assert len(got) == len(want) and np.allclose(np.array(got), np.array(sorted(want)), rtol=0, atol=1e-6)


def embeddings(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    return [r.vec_id for r in rows], np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)


def test_all_components_are_features(spark):
    ids, labels, x = embeddings(spark)
    assert x.shape[1] == 64
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = {r.row_id: r.score for r in model_queries.diagonal_score(spark, DIR).collect()}
    assert all(abs(got[i] - v) < 1e-4 for i, v in zip(ids, (z**2).sum(axis=1), strict=True))
    got = {r.row_id: r for r in model_queries.standardize(spark, DIR).collect()}
    for k in set(labels):
        part = x[labels == k]
        std = part.std(axis=0)
        z = (part - part.mean(axis=0)) / np.where(std > 0, std, 1.0)
        for i, v in zip(np.array(ids)[labels == k], z, strict=True):
            assert np.allclose([got[i][f"f{j}"] for j in range(64)], v, atol=2e-5)


def test_an_abnormal_late_component_raises_the_scores(spark, tmp_path):
    x = np.random.default_rng(0).normal(0, 1, (600, 64))
    odd = np.arange(9, 600, 100)  # test rows
    x[odd, 63] = 40.0
    data = [(i, i % 4, v) for i, v in enumerate(x.tolist())]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for f in (model_queries.mahalanobis_score, model_queries.gmm_score):
        got = {r.row_id: r.score for r in f(spark, str(tmp_path)).collect()}
        usual = max(v for i, v in got.items() if i not in odd)
        assert len(got) == 600 and all(got[i] > usual for i in odd)


def test_splits_follow_one_rule_at_every_number_of_groups(spark):
    rng = np.random.default_rng(0)
    for hot, classes in ((1500, None), (0, "c"), (40, "c")):
        n = [hot] * (hot > 0) + rng.integers(1, 6, 300).tolist()
        data = [(g, "rare" if g in (7, 50, 90, 200) else f"c{g % 3}", g == 5) for g, k in enumerate(n) for _ in range(k)]
        items = spark.createDataFrame(data, "g long, c string, fixed boolean")
        near, far = ({r.g: r.split for r in splits.assign_splits(items, "g", max_groups=m, train_only=F.col("fixed"), classes=classes).distinct().collect()} for m in (1000, 0))
        assert near == far and len(far) == len(n)
        if classes:
            assert {far[g] for g in (7, 50, 90, 200)} == {"train", "val", "test"}


def test_runs_equal_the_greedy_pass():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = dict(enumerate(np.minimum(rng.zipf(1.6, rng.integers(1, 300)), 500).tolist()))
        order = sorted(sizes, key=lambda g: (-sizes[g], str(g)))
        counts = Counter(sizes[g] for g in order)
        runs = splits._runs(list(counts.items()), {n: sum(sizes.values()) * r for n, r in zip(splits.NAMES, splits.RATIOS)})
        dealt = [names[i % len(names)] for _, a, b, names in runs for i in range(b - a)]
        want = splits.greedy_split(sizes)
        assert dealt == [want[g] for g in order]


def test_mahalanobis_is_fitted_on_all_rows(spark):
    x = np.random.default_rng(0).normal(size=(3000, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 3.0]])
    df = spark.createDataFrame([(i, "e" if i % 3 else None, "train", *v) for i, v in enumerate(x.tolist())], "row_id long, env string, split string, a double, b double, c double")
    got = {r.env: r for r in models.fit_models(df, ["env"], ["a", "b", "c"], ["mahalanobis"], max_rows=100).collect()}
    for key, part in (("e", x[np.arange(3000) % 3 > 0]), (None, x[::3])):
        want, m = models.fit_family("mahalanobis", part, part[:0]), json.loads(got[key].model)
        assert got[key].n_train == len(part) and all(np.allclose(m[k], want[k]) for k in ("mean", "std", "centre", "precision", "shrinkage"))


def test_components_link_long_documents(spark, tmp_path):
    data = [(1, "a" * 500, "s", 500), (2, "b" * 500, "s", 500), (3, "c" * 500, "t", 500), (4, "d", "s", None), (5, "e", "s", None)]
    spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.group_id for r in model_queries.components(spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
