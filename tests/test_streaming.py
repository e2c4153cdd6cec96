"""A replay in pieces gives the batch result."""

import math
import random
import time

from pyspark.sql import functions as F

from wakeline.operators import tracks
from wakeline.streaming import replay


def test_replay_equals_batch(spark, tmp_path):
    pts = [(m, float(t + m), 10.0, 10.0, float(t % 7), None) for m in (1, 2) for t in (0, 600, 1200, 4000, 4600, 9000)] + [(9, 100_000.0, 0.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(pts, "mmsi long, t double, lat double, lon double, sog double, cog double")
    for low, high in ((0, 1000), (1000, 4300), (4300, 20_000), (20_000, 1e9)):
        df.where((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = replay.prepare(replay.read_points(spark, str(tmp_path / "in"), df.schema), "1 second")
    q = replay.write(replay.trips(stream), "closed_trips", str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.mmsi, r.t_start): (r.n_points, r.t_end, r.sog_max) for r in spark.table("closed_trips").collect()}
    batch = tracks.trip_sequence(df).where("mmsi < 9").groupBy("mmsi", "trip_seq").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n"), F.max("sog").alias("top"))
    want = {(r.mmsi, r.t_start): (r.n, r.t_end, r.top) for r in batch.collect()}
    assert got == want


def test_first_flags(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, 0.2), (1, 6.0, 0.9), (1, 7.0, 0.95), (2, 1.0, 0.1)], "mmsi long, t double, score double")
    for low, high in ((0, 6.5), (6.5, 99)):
        df.where((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = replay.write(replay.first_flags(replay.read_points(spark, str(tmp_path / "in"), df.schema), 0.5), "flags", str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("flags").collect()] == [(1, 6.0)]


def test_an_earlier_flag_in_a_later_batch(spark, tmp_path):
    schema = "mmsi long, t double, score double"
    for n, rows in enumerate(([(1, 9.0, 0.9)], [(1, 4.0, 0.8), (1, 12.0, 0.7)], [(1, 6.0, 0.9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    q = replay.write(replay.first_flags(replay.read_points(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), 0.5), "early", str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.t_flag for r in spark.table("early").collect()] == [9.0, 4.0]


def test_windows_and_decisions_equal_batch(spark, tmp_path):
    """Teleports, thinning, trips, last windows and decisions of a replay in pieces against the batch plans."""
    rng, rows = random.Random(5), []
    for m in range(1, 9):
        t, lat, lon = float(rng.randrange(600)), 25.0 + m / 10, -80.0
        for i in range(120):
            t += rng.choice([20, 45, 60, 70, 300, 900, 1800, 1801, 4000])
            lat, lon = lat + rng.uniform(-0.004, 0.006), lon + rng.uniform(-0.004, 0.006)
            jump = 3.0 if i % 17 == 5 else 0.0
            rows.append((m, t, lat + jump, lon, None if i % 11 == 0 else rng.uniform(0, 30), None))
    rows.append((99, 1e7, 0.0, 0.0, 1.0, None))
    df = spark.createDataFrame(rows, "mmsi long, t double, lat double, lon double, sog double, cog double")
    top = max(r[1] for r in rows[:-1])
    for i in range(5):
        df.where((F.col("t") >= i * top / 4) & (F.col("t") < (i + 1) * top / 4 if i < 4 else F.lit(True))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    lengths = [600.0, 3600.0]
    stream = replay.prepare(replay.read_points(spark, str(tmp_path / "in"), df.schema), "1 second")
    policy = spark.createDataFrame([("cargo", "score", "e", None), ("tug", "abstain", None, "few")], "class string, policy string, envelope string, reason string")
    contacts = spark.createDataFrame([(m, "cargo" if m % 3 else "tug") for m in range(1, 8)], "mmsi long, asserted_class string")
    table = spark.createDataFrame([("e", w, "core", 0.05, 24.0) for w in lengths], "envelope_used string, window_s double, subspace string, far_target double, threshold double")
    got = {}
    for name, make in (("win", lambda w: w), ("act", lambda w: replay.decide(w, contacts, policy, table, 0.05))):
        q = replay.write(make(replay.trip_windows(stream, lengths)), name, str(tmp_path / name))
        q.awaitTermination(180)
        got[name] = spark.table(name).where("mmsi < 99").collect()
    batch = tracks.last_windows(tracks.segment(df, ["t"]), lengths, ("mmsi", "trip_seq")).where("mmsi < 99")
    want = {(r.mmsi, r.trip_seq, r.window_s): r for r in batch.collect()}
    assert len(got["win"]) == len(want) > 60
    for r in got["win"]:
        w = want[r.mmsi, r.trip_seq, r.window_s]
        assert (r.n_points, r.duration_s, r.window_complete) == (w.n_points, w.duration_s, w.window_complete)
        for c in ("sog_mean", "sog_med", "sog_p95", "sog_std", "path_km", "net_km"):
            a, b = r[c], w[c]
            assert (a is None or math.isnan(a)) == (b is None) and (b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), c
    actions = replay.decide(batch, contacts, policy, table, 0.05).collect()
    key = lambda r: (r.mmsi, r.trip_seq, r.window_s, r.status, r.action)
    assert sorted(map(key, got["act"])) == sorted(map(key, actions)) and {r.action for r in actions} == {"flag", "pass", "abstain"}
