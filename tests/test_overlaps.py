"""Overlaps of boxes, by batches and by the join for images of many boxes."""

import numpy as np

from wakeline.operators import images
from wakeline.plans import model_queries


def test_overlaps_by_batches_and_by_join(spark):
    rng = np.random.default_rng(0)
    box = [(int(m), i, *map(float, rng.integers(0, 40, 4))) for i, m in enumerate(rng.choice([1, 2, 2, 3, 3, 3, 4], 400))]
    odd = [(None, 900, 0.0, 0.0, 9.0, 9.0), (None, 901, 0.0, 0.0, 9.0, 9.0), (1, 902, None, 0.0, 9.0, 9.0), (5, 903, 0.0, 0.0, 9.0, 9.0), (5, 903, 0.0, 0.0, 9.0, 9.0), (5, 904, 1.0, 0.0, 9.0, 9.0)]
    table = spark.createDataFrame(box + odd, "image_id int, ann_id long, x double, y double, w double, h double")
    want = {(903, 904, 0.8): 2}
    for a in box + odd[2:3]:
        for b in box + odd[2:3]:
            if a[0] == b[0] and a[1] < b[1]:
                known = [v for v in (a, b) if v[2] is not None]  # least() and greatest() leave NULL out
                i = max(min(v[2] + v[4] for v in known) - max(v[2] for v in known), 0) * max(min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), 0)
                if i and i / (a[4] * a[5] + b[4] * b[5] - i) >= 0.3:
                    want[a[1], b[1], i / (a[4] * a[5] + b[4] * b[5] - i)] = 1
    rows = sorted(k for k, n in want.items() for _ in range(n))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # images go on over many batches
    try:
        for most in (4096, 100, 0):
            got = sorted(map(tuple, images.overlaps(table, 0.3, most).collect()))
            assert len(got) == len(rows) and all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_row_is_made_for_a_pair_that_does_not_overlap(spark):
    plan = model_queries.box_overlaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
