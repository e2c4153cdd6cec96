"""Mixtures fitted start by start."""

import json

import numpy as np
from pyspark.sql import functions as F

from wakeline.operators import models


def test_each_start_is_a_task_and_the_choice_is_that_of_one_fit(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-3, 1, (90, 2)), rng.normal(3, 1, (90, 2))])
    data = [(i, "e", "val" if i % 5 == 0 else "train", v) for i, v in enumerate(x.tolist())]
    rows = spark.createDataFrame(data, "row_id long, env string, split string, _x array<double>")
    fits = models.mixture_fits(rows, ["env"], "split", "row_id", 2, 20).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.k, r.start) for r in fits}) == len({r.task for r in fits}) == len(fits) == 3 * len(models.COMPONENTS) - 2
    at = {r.task: r.k for r in fits}
    assert [at[t] for t in sorted(at)] == sorted(at.values(), reverse=True)

    wide = rows.select("row_id", "env", "split", F.col("_x")[0].alias("a"), F.col("_x")[1].alias("b"))
    (got,) = models.fit_models(wide, ["env"], ["a", "b"], ["mixture"]).collect()
    val = np.arange(180) % 5 == 0
    want, m = models.fit_family("mixture", x[~val], x[val]), json.loads(got.model)
    assert (got.family, got.n_train, m["k"]) == ("mixture", 144, want["k"]) and m.keys() == want.keys()
    assert all(np.allclose(m[c], want[c]) for c in ("mean", "std", "weights", "means", "chol", "ll", "val_ll"))


def test_mixtures_of_large_groups_are_fitted_on_all_rows(spark):
    """Groups beyond max_rows: in passes, with what one fit of all rows gives; the others as before, NULL keys included."""
    rng = np.random.default_rng(3)
    data, parts = [], {"large": 900, None: 700, "small": 90, "unseen": 8}
    for env, n in parts.items():
        x = rng.normal(size=(n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 3.0]]) + 6 * rng.integers(0, 3, (n, 1))
        parts[env] = x, np.arange(n) % 5 == 0 if env else np.zeros(n, bool)
        data += [(i, env, "val" if parts[env][1][i] else "train", *v) for i, v in enumerate(x.tolist())]
    data += [(i, "unseen", "val", 0.0, 0.0, float(i)) for i in range(8, 200)]
    df = spark.createDataFrame(data, "row_id long, env string, split string, a double, b double, c double").repartition(4, "c")
    got = {r.env: r for r in models.fit_models(df, ["env"], ["a", "b", "c"], ["mixture"], min_rows=20, max_rows=100).collect()}
    assert got.keys() == {"large", None, "small"}
    for env, r in got.items():
        x, val = parts[env]
        want, m = models.fit_family("mixture", x[~val], x[val]), json.loads(r.model)
        assert (r.family, r.n_train, m["k"]) == ("mixture", (~val).sum(), want["k"]) and m.keys() == want.keys()
        assert all(np.allclose(m[c], want[c], rtol=1e-6, atol=1e-8) for c in ("mean", "std", "weights", "means", "chol", "ll", "val_ll"))
