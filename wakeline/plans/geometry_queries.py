"""Encounter queries over the driver's tables, with their SQL: features per vessel and reference point, per observation
window, joined with motion features, and what is decided from them. The annulus is wide because the stand-in tracks are
coarse; a vessel's whole track is its trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import encounters, models, rates, tracks
from .model_queries import _w
from .track_queries import PTS, SEED_SQL, SEEDS, _seeds, hav, points, rounded

WIDE = encounters.Annulus(0.25, 30.0)
LENGTHS = (604_800.0, 2_592_000.0, 7_776_000.0)
KINDS = (("berth_approach", 0.0, 0.0), ("anchorage", 0.08, 0.05))
COLUMNS = ("range_min_nm", "closing_rate_med_kn", "closing_rate_p90_kn", "bearing_rate_std_dps", "dcpa_nm", "tcpa_s", "closing_frac", "inbound_leg_persistence_s", "n_points_in_annulus", "cpa_range_nm")


def assets(spark):
    rows = [(f"{region}__{kind}", region, kind, lat + a, lon + b) for region, lat, lon in SEEDS for kind, a, b in KINDS]
    return spark.createDataFrame(rows, "asset_id string, port_region string, placement_class string, lat double, lon double")


def encounter_features(spark, sf_dir):
    """Encounters of vessels with seeds that they come near."""
    p = encounters.near_tracks(points(spark, sf_dir), _seeds(spark).withColumnRenamed("port_region", "asset_id"), ["mmsi"], ["asset_id"], WIDE.max_range_nm)
    return rounded(encounters.encounter_features(p, ["mmsi", "asset_id"], "seed_lat", "seed_lon", WIDE), tcpa_s=3)


def windows(spark, sf_dir):
    """Encounter features of the placements of each vessel's region, per window."""
    p = points(spark, sf_dir)
    near = encounters.closest_points(encounters.radius_join(p, _seeds(spark), 60.0), ["mmsi", "port_region"])
    region = near.groupBy("mmsi").agg(F.min_by("port_region", F.struct("cpa_range_nm", "port_region")).alias("port_region"))
    return encounters.encounter_windows(p.withColumnRenamed("mmsi", "trip_id"), region.withColumnRenamed("mmsi", "trip_id"), assets(spark), LENGTHS, annulus=WIDE)


def encounter_windows(spark, sf_dir):
    return rounded(windows(spark, sf_dir), tcpa_s=3)


def geometry_kinematics(spark, sf_dir):
    """Encounter features beside the motion features of the same window."""
    k = tracks.last_windows(points(spark, sf_dir), LENGTHS, ("mmsi",)).select(F.col("mmsi").alias("trip_id"), "window_s", "n_points", "sog_med", "path_km", "window_complete")
    g = windows(spark, sf_dir).select("trip_id", "asset_id", "window_s", "range_min_nm", "closing_frac")
    return rounded(g.join(k, ["trip_id", "window_s"]))


def longest(spark, sf_dir):
    """The longest window of each (vessel, placement) that has an encounter, with the placement's class and a split."""
    w = windows(spark, sf_dir).withColumn("window_complete", F.lit(True))
    rows = tracks.longest_complete(w, ["trip_id", "asset_id"], ["range_min_nm", "closing_rate_med_kn"])
    split = F.when(F.col("trip_id") % 10 < 7, "train").when(F.col("trip_id") % 10 < 9, "val").otherwise("test")
    return rows.join(tables.small(assets(spark).select("asset_id", "placement_class")), "asset_id").withColumn("split", split)


def geometry_longest(spark, sf_dir):
    return rounded(longest(spark, sf_dir))


def _flagged(rows, target=0.2):
    """Scores beyond the threshold of the placement class, calibrated on validation rows."""
    s = rows.withColumnRenamed("closing_rate_med_kn", "score")
    t = models.thresholds(s, ["placement_class"], (target,)).select(F.col("placement_class").alias("asserted_class"), "threshold")
    return s, t


def geometry_far(spark, sf_dir):
    """False alarms of rows that were not trained on, by placement class."""
    s, t = _flagged(longest(spark, sf_dir))
    rows = s.where("split <> 'train'").join(tables.small(t), F.col("placement_class") == F.col("asserted_class")).withColumn("flag", F.col("score") > F.col("threshold"))
    return rounded(rates.far_by(rows, ["placement_class"]))


def coverage_cells(spark, sf_dir):
    """Encounters by placement class and window, thin cells marked."""
    rows = windows(spark, sf_dir).join(tables.small(assets(spark).select("asset_id", "placement_class")), "asset_id")
    return encounters.coverage(rows, ["placement_class", "window_s"])


def geometry_label_swap(spark, sf_dir):
    """Encounters with placements of one class judged by the threshold of another."""
    s, t = _flagged(longest(spark, sf_dir))
    rows = s.where("split <> 'train'").join(tables.small(t), F.col("placement_class") != F.col("asserted_class"))
    return rounded(rows.groupBy(F.col("placement_class").alias("source_class"), "asserted_class").agg(F.count("*").alias("n"), F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("flag_rate")))


def _features(source: str, keys: str) -> tuple[str, ...]:
    """CTEs up to ``enc``: the features of each encounter from a table with keys, t, lat, lon, lat0, lon0."""
    lo, hi = WIDE.min_range_nm, WIDE.max_range_nm
    bearing = "(degrees(atan2(sin(radians(lon0 - lon)) * cos(radians(lat0)), cos(radians(lat)) * sin(radians(lat0)) - sin(radians(lat)) * cos(radians(lat0)) * cos(radians(lon0 - lon)))) + 360) % 360"
    w, a = f"WINDOW w AS (PARTITION BY {keys} ORDER BY t)", f"OVER (PARTITION BY {keys})"
    return (
        f"r1 AS (SELECT *, {hav('lat', 'lon', 'lat0', 'lon0')} / 1.852 AS r, {bearing} AS b, (lon - lon0) * 60 * cos(radians(lat0)) AS e, (lat - lat0) * 60 AS n, row_number() OVER w AS i, t - lag(t) OVER w AS dt1 FROM {source} {w})",
        f"r2 AS (SELECT *, lag(e) OVER w AS e0, lag(n) OVER w AS n0, max(CASE WHEN r BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END) {a} AS hit FROM r1 {w})",
        f"r3 AS (SELECT *, row_number() OVER w AS k FROM r2 WHERE CASE WHEN hit = 1 THEN r BETWEEN {lo} AND {hi} ELSE r <= {hi} END {w})",
        f"r4 AS (SELECT *, i - k AS island, count(*) {a} AS held, min(r) {a} AS cr FROM r3)",
        f"r5 AS (SELECT *, first_value(k) OVER v AS ck, first_value(island) OVER v AS ci FROM r4 WINDOW v AS (PARTITION BY {keys} ORDER BY r, k))",
        f"leg AS (SELECT *, t - lag(t) OVER w AS dt, r - lag(r) OVER w AS dr, b - lag(b) OVER w AS db, (e - e0) / nullif(dt1, 0) AS ve, (n - n0) / nullif(dt1, 0) AS vn FROM r5 WHERE held >= {WIDE.min_points} AND ck - 1 >= {WIDE.points_before_cpa} AND island = ci AND k <= ck {w})",
        "rate AS (SELECT *, CASE WHEN dt > 0 THEN -dr / dt * 3600.0 END AS closing, CASE WHEN dt > 0 THEN (((db + 180) % 360 + 360) % 360 - 180) / dt END AS turn, ve * ve + vn * vn AS s2, -(e0 * ve + n0 * vn) / nullif(ve * ve + vn * vn, 0) AS tc FROM leg)",
        f"""enc AS (SELECT {keys}, min(r) AS range_min_nm, quantile_cont(closing, 0.5) AS closing_rate_med_kn, quantile_cont(closing, 0.9) AS closing_rate_p90_kn, stddev_pop(turn) AS bearing_rate_std_dps,
 max(CASE WHEN k = ck AND dt1 > 0 THEN CASE WHEN s2 > 0 THEN sqrt(pow(e0 + ve * tc, 2) + pow(n0 + vn * tc, 2)) ELSE sqrt(e0 * e0 + n0 * n0) END END) AS dcpa_nm, max(CASE WHEN k = ck AND dt1 > 0 AND s2 > 0 THEN tc END) AS tcpa_s,
 avg(CASE WHEN closing > 0 THEN 1.0 WHEN closing <= 0 THEN 0.0 END) AS closing_frac, max(t) - min(t) AS inbound_leg_persistence_s, max(held) AS n_points_in_annulus, max(cr) AS cpa_range_nm FROM rate GROUP BY {keys} HAVING count(*) >= {WIDE.min_points} AND count(closing) > 0)""",
    )


def _shown(keys: str) -> str:
    cols = ", ".join(c if c == "n_points_in_annulus" else f"round({c}, {3 if c == 'tcpa_s' else 6}) AS {c}" for c in COLUMNS)
    return f"SELECT {keys}, {cols}, true AS geometry_usable FROM enc"


ASSETS = "assets(asset_id, port_region, placement_class, lat0, lon0) AS (VALUES " + ", ".join(f"('{r}__{k}', '{r}', '{k}', {lat}::DOUBLE + {a}::DOUBLE, {lon}::DOUBLE + {b}::DOUBLE)" for r, lat, lon in SEEDS for k, a, b in KINDS) + ")"
WINDOWED = _w(
    PTS, SEED_SQL, ASSETS,
    f"near AS (SELECT mmsi, port_region, min({hav('lat', 'lon', 'seed_lat', 'seed_lon')} / 1.852) AS m FROM points, seeds GROUP BY ALL HAVING m <= 60)",
    "region AS (SELECT mmsi, port_region FROM near QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY m, port_region) = 1)",
    "win(window_s) AS (VALUES " + ", ".join(f"({w}::DOUBLE)" for w in LENGTHS) + ")",
    "src AS (SELECT p.mmsi AS trip_id, asset_id, window_s, t, lat, lon, lat0, lon0 FROM (SELECT *, max(t) OVER (PARTITION BY mmsi) AS last FROM points) p JOIN region USING (mmsi) JOIN assets USING (port_region), win WHERE t >= last - window_s)",
    *_features("src", "trip_id, asset_id, window_s"),
).rstrip()
LONGEST = f"longest AS (SELECT trip_id, asset_id, max(window_s) AS window_s, arg_max(range_min_nm, window_s) AS range_min_nm, arg_max(closing_rate_med_kn, window_s) AS closing_rate_med_kn, CASE WHEN trip_id % 10 < 7 THEN 'train' WHEN trip_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM enc GROUP BY trip_id, asset_id)"
SCORED = f"{WINDOWED}, {LONGEST}, s AS (SELECT *, closing_rate_med_kn AS score FROM longest JOIN assets USING (asset_id)), cut AS (SELECT placement_class, coalesce(quantile_cont(score, 0.8) FILTER (split = 'val'), quantile_cont(score, 0.8) FILTER (split = 'train')) AS threshold FROM s GROUP BY placement_class) "
ORACLE = {
    "encounter_features": _w(PTS, SEED_SQL, "src AS (SELECT mmsi, port_region AS asset_id, t, lat, lon, seed_lat AS lat0, seed_lon AS lon0 FROM points, seeds)", *_features("src", "mmsi, asset_id")) + _shown("mmsi, asset_id"),
    "encounter_windows": WINDOWED + " " + _shown("trip_id, asset_id, window_s"),
    "geometry_kinematics": WINDOWED + """, kin AS (SELECT mmsi AS trip_id, window_s, count(*) AS n_points, quantile_cont(sog, 0.5) AS sog_med, coalesce(sum(km), 0) AS path_km, count(*) >= 2 AND max(t) - min(t) >= 0.5 * window_s AS window_complete FROM (
 SELECT *, """ + hav("lag(lat) OVER v", "lag(lon) OVER v", "lat", "lon") + """ AS km FROM (SELECT *, max(t) OVER (PARTITION BY mmsi) AS last FROM points), win WHERE t >= last - window_s WINDOW v AS (PARTITION BY mmsi, window_s ORDER BY t)) GROUP BY mmsi, window_s)
SELECT trip_id, window_s, asset_id, round(range_min_nm, 6) AS range_min_nm, round(closing_frac, 6) AS closing_frac, n_points, round(sog_med, 6) AS sog_med, round(path_km, 6) AS path_km, window_complete FROM enc JOIN kin USING (trip_id, window_s)""",
    "geometry_longest": WINDOWED + f", {LONGEST} SELECT asset_id, trip_id, window_s, round(range_min_nm, 6) AS range_min_nm, round(closing_rate_med_kn, 6) AS closing_rate_med_kn, placement_class, split FROM longest JOIN assets USING (asset_id)",
    "geometry_far": SCORED + "SELECT placement_class, count(*) AS n, count(*) FILTER (score > threshold) AS n_flag, round(count(*) FILTER (score > threshold)::DOUBLE / count(*), 6) AS far FROM s JOIN cut USING (placement_class) WHERE split <> 'train' GROUP BY placement_class",
    "coverage_cells": WINDOWED + " SELECT placement_class, window_s, count(*) AS n, count(DISTINCT trip_id) AS n_trips, count(*) < 30 AS thin FROM enc JOIN assets USING (asset_id) GROUP BY placement_class, window_s",
    "geometry_label_swap": SCORED + "SELECT s.placement_class AS source_class, cut.placement_class AS asserted_class, count(*) AS n, round(avg(CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END), 6) AS flag_rate FROM s JOIN cut ON s.placement_class <> cut.placement_class WHERE split <> 'train' GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (encounter_features, encounter_windows, geometry_kinematics, geometry_longest, geometry_far, geometry_label_swap, coverage_cells)}
