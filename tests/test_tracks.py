"""F1-F6, W1-W7, A1-A5 of the inventory, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo, tables
from wakeline.operators import tracks
from wakeline.sources import readers

COLS = "mmsi long, t double, lat double, lon double, sog double, cog double, heading double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cleaning_f1_f3(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 5.0, 10.0, 10.0), (2, 1.0, 95.0, 0.0, 5.0, 10.0, 10.0), (3, 1.0, 20.0, 10.0, 102.3, 360.0, 511.0), (4, 0.0, 20.0, 10.0, 1.0, 1.0, 1.0), (5, 1.0, 20.0, 10.0, 102.2, 0.0, 359.9)], COLS)
    out = tracks.sentinels_to_null(tracks.valid_fixes(df))
    assert rows(out, "mmsi", "sog", "cog", "heading") == [(3, None, None, None), (5, 102.2, 0.0, 359.9)]


def test_gap_and_duplicates_w6_f5(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1800.0), (1, 3601.0), (2, 5.0)], "mmsi long, t double")
    assert rows(tracks.trip_sequence(df), "mmsi", "t", "trip_seq") == [(1, 0.0, 1), (1, 1800.0, 1), (1, 3601.0, 2), (2, 5.0, 1)]
    dup = spark.createDataFrame([(1, 5.0, 2, "late"), (1, 5.0, 1, "first")], "mmsi long, t double, n int, v string")
    assert rows(tracks.first_of_duplicates(dup, ["mmsi", "t"], ["n"]), "v") == [("first",)]


def test_teleport_is_one_pass_w4(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 10.0), (1, 60.0, 11.0, 10.0), (1, 120.0, 10.0, 10.0), (1, 180.0, 10.001, 10.0)], "mmsi long, t double, lat double, lon double")
    assert rows(tracks.drop_teleports(df), "t") == [(0.0,), (180.0,)]  # the point after the outlier goes too


def test_thinning_w5(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 59.0), (1, 60.0)], "mmsi long, t double")
    assert rows(tracks.thin(df), "t") == [(0.0,), (60.0,)]


def test_features_and_nulls_a1_a4(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0, 10.0, 0.1, 359.0), (1, 60.0, 10.01, 10.0, None, 1.0), (2, 0.0, 10.0, 10.0, 4.0, None)], "trip_id long, t double, lat double, lon double, sog double, cog double")
    out = {r.trip_id: r for r in tracks.trip_features(df).collect()}
    a, b = out[1], out[2]
    assert a.n_points == 2 and a.loiter_frac == 0.5 and math.isclose(a.turn_rate_mean_dps, 2 / 60)
    assert math.isclose(a.straightness, 1.0) and math.isclose(a.path_km, a.net_km)
    assert b.path_km == 0 and b.straightness is None and b.sog_std is None and b.cog_circ_std_deg is None


def test_windows_w7_w11(spark):
    df = spark.createDataFrame([(1, float(t), 10.0, 10.0, 5.0, 0.0) for t in range(0, 601, 60)], "trip_id long, t double, lat double, lon double, sog double, cog double")
    w = tracks.last_windows(df, (300, 1200), whole=True)
    assert rows(w, "window_s", "n_points", "window_complete") == [(300.0, 6, True), (1200.0, 11, True), (math.inf, 11, True)]
    assert rows(tracks.longest_complete(w.where("window_s < 1000"), ["trip_id"], ["n_points"]), "window_s", "n_points") == [(300.0, 6)]


def test_modal_takes_smallest_on_tie_a5(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "mmsi long, v string")
    assert rows(tracks.modal("v", ["mmsi"], df), "v") == [("a",)]


def test_geometry_g1_g6(spark):
    df = spark.createDataFrame([(1.0, 359.0)], "a double, b double").select(
        geo.angle_difference("a", "b").alias("d"), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"), geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n"),
        geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"), geo.closest_approach(F.lit(-1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(60.0))[0].alias("dcpa"), geo.closest_approach(F.lit(-1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(60.0))[1].alias("tcpa"),
    )
    r = df.first()
    assert r.d == 2 and math.isclose(r.h, 111.195, rel_tol=1e-4) and r.n is None and math.isclose(r.b, 90) and math.isclose(r.dcpa, 1) and math.isclose(r.tcpa, 60)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0, 1), (math.nan, 2)], "x double, k int")
    assert tables.nan_to_null(df).agg(F.avg("x")).first()[0] == 1.0
    with pytest.raises(KeyError):
        tables.require(df, ["y"])


def test_global_ids_follow_vessels(spark):
    df = spark.createDataFrame([(5, 0.0, 1), (5, 9.0, 2), (3, 0.0, 1), (9, 1.0, 1)], "mmsi long, t double, trip_seq long")
    assert rows(tracks.global_trip_id(df), "mmsi", "trip_id") == [(3, 0), (5, 1), (5, 2), (9, 3)]


def test_position_csv_and_zip(spark, tmp_path):
    import zipfile

    text = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselType,TransceiverClass,Extra\n7,2023-06-01T00:00:00,25.5,-80.0,102.3,10.0,511,30,A,x\n8,bad,25.5,-80.0,1,1,1,,B,y\n"
    (tmp_path / "a.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", text)
    for raw in (readers.positions_csv(spark, str(tmp_path / "a.csv")), readers.positions_zip(spark, str(tmp_path / "a.zip"))):
        out = readers.points(raw).collect()
        assert [(r.mmsi, r.t, r.sog, r.heading, r.transceiver) for r in out] == [(7, 1685577600, None, None, "A")]


def test_stationary_runs_and_checkpoints(spark):
    df = spark.createDataFrame([(1, 0.0, 0.1), (1, 4000.0, 0.2), (1, 8000.0, 9.0), (1, 9000.0, 0.1)], "trip_id long, t double, sog double")
    assert rows(tracks.stationary_runs(df, dwell_s=3600), "t") == [(0.0,), (4000.0,)]
    assert rows(tracks.prefixes(df, ["trip_id"], 4000, 3000), "t_check") == [(4000.0,), (7000.0,), (9000.0,)]
