"""The whole flow on made tracks, and the entry points without the corpus operators."""

import importlib.util

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import tracks
from wakeline.plans import flows
from wakeline.sources import readers


def messages(spark, vessels=60):
    rng, rows = np.random.default_rng(0), []
    for v in range(vessels):
        speed = 6.0 if v % 2 else 14.0
        kind, lat, lon = (37.0 if v % 2 else 70.0), 25.0 + v * 0.01, -80.0
        for i in range(30):
            lat += speed * 60 / 3600 / 60
            t = 1685577600 + 61 * i + (7200 if i >= 15 else 0)
            s = float(max(0.1, speed + rng.normal(0, 0.5)))
            stamp = np.datetime64(t, "s").astype(str)
            rows.append((v + 1, stamp, float(lat), lon, s, float(rng.normal(0, 3) % 360), 511.0, kind, "A"))
    return spark.createDataFrame(rows, readers.POSITIONS)


def test_messages_to_decisions(spark, tmp_path):
    got = flows.ingest(messages(spark), {37: "pleasure"}, [(70, 79, "cargo")], {"cargo": "benign", "pleasure": "benign"})
    trips = flows.split_vessels(got.trips).cache()
    assert trips.count() == 120 and {r.cls for r in got.vessels.select("cls").distinct().collect()} == {"cargo", "pleasure"}
    assert got.points.groupBy("mmsi", "trip_seq").count().where("count <> 15").count() == 0
    assert trips.groupBy("mmsi").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    rows = flows.windows(got.points, trips, (300, 600))
    fitted = flows.fit(rows, min_rows=20)
    assert {(r.cls, r.subspace) for r in fitted.registry.collect()} == {(c, s) for c in ("cargo", "pleasure") for s in ("core", "core_course")}
    policy = spark.createDataFrame([("cargo", "score", "cargo", None), ("pleasure", "abstain", None, "few")], "class string, policy string, envelope string, reason string")
    d = flows.decide(fitted, policy).cache()
    assert d.count() == 120 and {r.status for r in d.where("asserted_class = 'cargo'").collect()} == {"scored"} and {r.action for r in d.where("asserted_class = 'pleasure'").collect()} == {"abstain"}
    far = {r.cls: r for r in flows.false_alarms(d).collect()}
    assert far["cargo"].far is not None and far["pleasure"].far is None
    # a frozen bundle decides alike, and a changed one is refused
    digests = flows.freeze(fitted, str(tmp_path / "bundle"))
    again = flows.thaw(rows, str(tmp_path / "bundle"), digests)
    key = ["mmsi", "trip_seq", "window_s", "status", "action"]
    assert sorted(map(tuple, flows.decide(again, policy).select(*key).collect()), key=str) == sorted(map(tuple, d.select(*key).collect()), key=str)
    with pytest.raises(ValueError, match="digest"):
        flows.thaw(rows, str(tmp_path / "bundle"), {"registry": "0" * 64})


def test_unknown_vessels_are_dealt_out(spark):
    df = spark.createDataFrame([(0, float(i), 1.0 * i, 2.0) for i in range(100)] + [(7, 0.0, 1.0, 1.0)], "mmsi long, t double, lat double, lon double")
    out = tracks.apart(df, 8)
    assert out.where("mmsi = 0").count() == 0 and out.where("mmsi < 0").select("mmsi").distinct().count() == 8 and out.where("mmsi = 7").count() == 1


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("wakeline.llm", "corpus_pipeline") else find(name, *a))
    assert "class_summary" in entry.queries() and not any(k.startswith("op") or k == "pipeline" for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
