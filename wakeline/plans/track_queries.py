"""Track queries over the driver's tables, with their SQL. ``events`` is the point stream: user_id is the vessel, value the
speed, event_type the class; positions and angles are one expression of the ids in both engines. Trips break after
43,200 s. Results are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import geo, tables
from ..operators import encounters, rates, splits, tracks

LIMITS = tracks.Limits(gap_s=43_200, cadence_s=43_200, min_points=2, min_duration_s=300, loiter_kn=20.0)
WINDOWS = (86_400.0, 259_200.0, 604_800.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = lambda c: F.col(c).cast("double")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(
        "event_id", F.col("user_id").alias("mmsi"), (us / F.lit(1e6)).alias("t"), F.col("value").alias("sog"), F.col("event_type").alias("cls"),
        (F.lit(25.0) + d("user_id") % 20 * 0.05 + d("event_id") % 500 * 0.0002).alias("lat"), (F.lit(-80.0) + d("user_id") % 15 * 0.05 + (d("event_id") * 7) % 500 * 0.0002).alias("lon"),
        ((d("event_id") * 37) % 360).alias("cog"), F.when(F.col("event_id") % 5 != 0, (d("event_id") * 53) % 360).alias("heading"), "props",
    )


PTS = """points AS (SELECT event_id, user_id AS mmsi, epoch_us(ts) / 1e6 AS t, value AS sog, event_type AS cls,
 25::DOUBLE + (user_id % 20)::DOUBLE * 0.05::DOUBLE + (event_id % 500)::DOUBLE * 0.0002::DOUBLE AS lat,
 -80::DOUBLE + (user_id % 15)::DOUBLE * 0.05::DOUBLE + ((event_id * 7) % 500)::DOUBLE * 0.0002::DOUBLE AS lon,
 ((event_id * 37) % 360)::DOUBLE AS cog, CASE WHEN event_id % 5 <> 0 THEN ((event_id * 53) % 360)::DOUBLE END AS heading, props FROM events)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


NUM = f"""numbered AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS trip_seq FROM (
 SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 43200 OR t - lag(t) OVER w <= 0 THEN 1 ELSE 0 END AS new FROM points WINDOW w AS (PARTITION BY mmsi ORDER BY t)))"""


def step_sql(keys: str, source: str) -> str:
    return f"""steps AS (SELECT *, t - lag(t) OVER w AS dt, {hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} AS seg_km,
 CASE WHEN t - lag(t) OVER w > 0 THEN abs(((cog - lag(cog) OVER w + 180) % 360 + 360) % 360 - 180) / (t - lag(t) OVER w) END AS turn_dps,
 CASE WHEN t - lag(t) OVER w > 0 THEN (sog - lag(sog) OVER w) / ((t - lag(t) OVER w) / 60.0) END AS accel FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t))"""


AGG = f"""count(*) AS n_points, round(max(t) - min(t), 6) AS duration_s, round(avg(sog), 6) AS sog_mean, round(quantile_cont(sog, 0.5), 6) AS sog_med,
 round(quantile_cont(sog, 0.95), 6) AS sog_p95, round(max(sog), 6) AS sog_max, round(stddev_samp(sog), 6) AS sog_std,
 round(avg(CASE WHEN sog < 20 THEN 1.0 ELSE 0.0 END), 6) AS loiter_frac, round(coalesce(sum(seg_km), 0), 6) AS path_km,
 round({hav("arg_min(lat, t)", "arg_min(lon, t)", "arg_max(lat, t)", "arg_max(lon, t)")}, 6) AS net_km,
 round(CASE WHEN sum(seg_km) > 0 THEN {hav("arg_min(lat, t)", "arg_min(lon, t)", "arg_max(lat, t)", "arg_max(lon, t)")} / sum(seg_km) END, 6) AS straightness,
 round(avg(turn_dps), 6) AS turn_rate_mean_dps, round(quantile_cont(turn_dps, 0.95), 6) AS turn_rate_p95_dps,
 round(degrees(sqrt(-2 * ln(least(greatest(sqrt(pow(avg(sin(radians(cog))), 2) + pow(avg(cos(radians(cog))), 2)), 1e-9), 1)))), 4) AS cog_circ_std_deg,
 round(avg(abs(accel)), 6) AS accel_mean_abs, round(stddev_samp(accel), 6) AS accel_std"""
NAMES = ("n_points", "duration_s", "sog_mean", "sog_med", "sog_p95", "sog_max", "sog_std", "loiter_frac", "path_km", "net_km", "straightness", "turn_rate_mean_dps", "turn_rate_p95_dps", "cog_circ_std_deg", "accel_mean_abs", "accel_std")


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Doubles to a fixed number of places, other columns as they are."""
    return df.select(*[F.round(c, other.get(c, places)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.trip_sequence(points(spark, sf_dir), limits=LIMITS)


def trip_segmentation(spark, sf_dir):
    t = trips(spark, sf_dir).groupBy("mmsi", "trip_seq").agg(F.count("*").alias("n_points"), (F.max("t") - F.min("t")).alias("duration_s"), F.percentile("sog", 0.95).alias("sog_p95"), F.stddev_samp("sog").alias("sog_std"))
    return rounded(t)


def trip_features(spark, sf_dir):
    return rounded(tracks.trip_features(trips(spark, sf_dir), ("mmsi", "trip_seq"), limits=LIMITS).select("mmsi", "trip_seq", *NAMES, "heading_avail_frac"), cog_circ_std_deg=4)


def kept_trips(spark, sf_dir):
    t = tracks.trip_features(trips(spark, sf_dir), ("mmsi", "trip_seq"), limits=LIMITS)
    return rounded(tracks.keep_long(t, LIMITS).select("mmsi", "trip_seq", "n_points", "duration_s"))


def class_summary(spark, sf_dir):
    """Per class: trips, vessels and medians, most frequent class of a vessel as its class."""
    p = trips(spark, sf_dir)
    t = tracks.trip_features(p, ("mmsi", "trip_seq"), limits=LIMITS)
    c = tracks.modal("cls", ["mmsi"], p)
    t = session.checkpoint(t.join(c, "mmsi").select("cls", "mmsi", "sog_med", "duration_s", "path_km"))
    out = t.groupBy("cls").agg(F.count("*").alias("n_trips"), F.countDistinct("mmsi").alias("n_vessels"))
    for x in ("sog_med", "duration_s", "path_km"):
        out = out.join(tables.exact_quantiles(t, ["cls"], x, [0.5]).select("cls", F.col("cuts").getItem(0).alias(f"{x}_median")), "cls", "left")
    return rounded(out, 4)


def modal_class(spark, sf_dir):
    return tracks.modal("cls", ["mmsi"], points(spark, sf_dir))


def dedup_first(spark, sf_dir):
    """Messages of which every third comes again later, and of some an earlier copy under another number."""
    p = points(spark, sf_dir).select("mmsi", "t", "event_id")
    p = p.unionByName(p.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 10_000_000)).unionByName(p.where("event_id % 5 = 0").withColumn("event_id", -F.col("event_id")))
    return rounded(tracks.first_of_duplicates(p, ["mmsi", "t"], ["event_id"]))


def cadence_thin(spark, sf_dir):
    return tracks.thin(points(spark, sf_dir), limits=LIMITS).select("mmsi", "event_id")


def teleport_filter(spark, sf_dir):
    return tracks.drop_teleports(points(spark, sf_dir), limits=tracks.Limits(teleport_kn=2.0)).select("event_id", "mmsi")


def coordinate_filter(spark, sf_dir):
    """Some fixes are made unusable: (0, 0), out of range, no time."""
    p = points(spark, sf_dir)
    bad = F.col("event_id") % 40
    p = p.withColumns({"lat": F.when(bad == 0, 0.0).when(bad == 1, 95.0).otherwise(F.col("lat")), "lon": F.when(bad == 0, 0.0).when(bad == 2, -190.0).otherwise(F.col("lon")), "t": F.when(bad == 3, 0.0).otherwise(F.col("t"))})
    inside = tracks.valid_fixes(p, box=(25.2, 25.8, -79.9, -79.5)).select("event_id", F.lit(True).alias("in_box"))
    return tracks.valid_fixes(p).select("event_id").join(inside, "event_id", "left").na.fill(False, ["in_box"])


def sentinel_nulls(spark, sf_dir):
    p = tracks.sentinels_to_null(points(spark, sf_dir), limits=tracks.Limits(max_sog=50.0))
    return p.groupBy("cls").agg(F.count("*").alias("n"), F.count("sog").alias("n_sog"), F.count("heading").alias("n_heading"))


def steps(spark, sf_dir):
    s = tracks.steps(trips(spark, sf_dir), ("mmsi", "trip_seq"))
    return rounded(s.select("event_id", "dt", "seg_km", "turn_dps", "accel_kn_min"))


def global_trip_ids(spark, sf_dir):
    return tracks.global_trip_id(trips(spark, sf_dir)).select("event_id", "trip_id")


def last_window_features(spark, sf_dir):
    w = tracks.last_windows(trips(spark, sf_dir), WINDOWS, ("mmsi", "trip_seq"))
    keep = ("n_points", "duration_s", "sog_mean", "sog_med", "sog_p95", "sog_std", "path_km", "net_km")
    return rounded(w.select("mmsi", "trip_seq", "window_s", *keep, "window_complete"))


def window_stats(spark, sf_dir):
    w = tracks.last_windows(trips(spark, sf_dir), WINDOWS, ("mmsi", "trip_seq"))
    w = session.checkpoint(w.select("window_s", "window_complete", "sog_med"))
    out = w.groupBy("window_s").agg(F.count("*").alias("n_rows"), F.count_if("window_complete").alias("n_complete"))
    return rounded(out.join(tables.exact_quantiles(w, ["window_s"], "sog_med", [0.5]).select("window_s", F.col("cuts").getItem(0).alias("sog_med_median")), "window_s", "left"))


def longest_horizon(spark, sf_dir):
    w = tracks.last_windows(trips(spark, sf_dir), WINDOWS, ("mmsi", "trip_seq"))
    return rounded(tracks.longest_complete(w, ["mmsi", "trip_seq"], ["n_points", "sog_p95"]))


def stationary_runs(spark, sf_dir):
    r = tracks.stationary_runs(points(spark, sf_dir), ("mmsi",), below_kn=60.0, dwell_s=86_400)
    return r.groupBy("mmsi", "run").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 6).alias("span_s"))


def first_crossing(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("r", geo.range_nm("lat", "lon", F.lit(25.5), F.lit(-79.7)))
    return rounded(tracks.first_crossing(p, ["mmsi"], "r", 12.0))


def checkpoint_times(spark, sf_dir):
    c = tracks.prefixes(points(spark, sf_dir), ["mmsi"], 86_400, 604_800)
    return rounded(c.groupBy("mmsi").agg(F.count("*").alias("n_checks"), F.max("t_check").alias("last_check"), F.min("t_check").alias("first_check")))


SEEDS = (("north", 25.6, -79.7), ("south", 25.2, -79.9), ("east", 25.4, -79.4))


def _seeds(spark):
    return spark.createDataFrame(list(SEEDS), "port_region string, seed_lat double, seed_lon double")


SEED_SQL = "seeds AS (SELECT * FROM (VALUES ('north', 25.6::DOUBLE, -79.7::DOUBLE), ('south', 25.2::DOUBLE, -79.9::DOUBLE), ('east', 25.4::DOUBLE, -79.4::DOUBLE)) v(port_region, seed_lat, seed_lon))"


def radius_join(spark, sf_dir):
    return rounded(encounters.radius_join(points(spark, sf_dir), _seeds(spark), 10.0).select("event_id", "port_region", "range_nm"))


def closest_point(spark, sf_dir):
    p = encounters.radius_join(points(spark, sf_dir), _seeds(spark), 15.0)
    return rounded(encounters.closest_points(p, ["mmsi", "port_region"]))


def bearings(spark, sf_dir):
    p = points(spark, sf_dir)
    lat, lon = geo.offset_point("lat", "lon", "cog", F.lit(2.0))
    return rounded(p.select("event_id", geo.bearing_deg("lat", "lon", F.lit(25.5), F.lit(-79.7)).alias("bearing"), lat.alias("lat2"), lon.alias("lon2"), geo.angle_difference("cog", "heading").alias("drift")))


def approach(spark, sf_dir):
    """Closest approach to the first seed for each pair of successive points."""
    e, n = geo.local_plane("lat", "lon", F.lit(25.6), F.lit(-79.7))
    w = Window.partitionBy("mmsi").orderBy("t")
    p = points(spark, sf_dir).withColumns({"e": e, "n": n}).withColumns({"e0": F.lag("e").over(w), "n0": F.lag("n").over(w), "dt": F.col("t") - F.lag("t").over(w)})
    d, t = geo.closest_approach("e0", "n0", "e", "n", "dt")
    return p.select("event_id", F.round(d, 5).alias("dcpa_nm"), F.round(t, 3).alias("tcpa_s"))


def densest_cell(spark, sf_dir):
    return rounded(encounters.densest_cell(points(spark, sf_dir), 0.1, ["cls"]))


def top_cells(spark, sf_dir):
    return rounded(encounters.top_cells(points(spark, sf_dir), 8, 0.1, ["cls"]))


def placements(spark, sf_dir):
    return rounded(encounters.derive_placements(tracks.trip_sequence(points(spark, sf_dir), limits=LIMITS).withColumnRenamed("mmsi", "trip_id"), _seeds(spark), moored_kn=60.0))


def placement_validity(spark, sf_dir):
    p = points(spark, sf_dir).withColumnRenamed("mmsi", "trip_id")
    return rounded(encounters.placement_validity(p, encounters.derive_placements(p, _seeds(spark), moored_kn=60.0), min_legs=5))


def region_bands(spark, sf_dir):
    band = geo.bands("lon", ((-79.9, "west"), (-79.6, "middle"), (-79.4, "east")), "far")
    return points(spark, sf_dir).groupBy(band.alias("region")).agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("n_vessels"))


def geo_cell(spark, sf_dir):
    return points(spark, sf_dir).groupBy(geo.cell("lat", "lon", 0.25).alias("cell")).count().withColumnRenamed("count", "n")


def contingency(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("band", geo.bands("lon", ((-79.9, "west"), (-79.6, "middle")), "east"))
    return tables.contingency(p, "cls", "band", ["west", "middle", "east"])


def null_profile(spark, sf_dir):
    return rounded(tables.null_profile(points(spark, sf_dir), ["heading", "sog", "cog", "props"]))


def quantile_profile(spark, sf_dir):
    p = points(spark, sf_dir)
    cuts = tables.exact_quantiles(p, ["cls"], "sog", (0.05, 0.5, 0.95))
    return rounded(cuts.select("cls", *[F.col("cuts").getItem(i).alias(n) for i, n in enumerate(("p05", "p50", "p95"))]))


def vessel_split_check(spark, sf_dir):
    """Vessels in more than one split when points, not vessels, are dealt out: what the check must report."""
    p = points(spark, sf_dir).withColumn("split", F.when(F.col("event_id") % 10 < 7, "train").when(F.col("event_id") % 10 < 9, "val").otherwise("test"))
    return splits.leaks(p, "mmsi")


def vessel_split(spark, sf_dir):
    """Vessels assigned greedily by points: rows and share of each split."""
    s = splits.assign_splits(points(spark, sf_dir).select("mmsi"), "mmsi")
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("n_vessels")).withColumn("share", F.round(F.col("n") / total, 3))


def props_json(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/events.parquet")
    return p.select("event_id", F.json_object_keys("props").alias("k")).select("event_id", F.size("k").alias("n_keys"), F.array_join(F.array_sort("k"), ",").alias("keys"))


def session_counts(spark, sf_dir):
    """Trips by the built-in session window: its gap rule agrees with the segmentation on where trips begin."""
    p = points(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    return p.groupBy("mmsi", F.session_window("ts", "43200 seconds")).count().groupBy("mmsi").agg(F.count("*").alias("n_sessions"))


def far_strata(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("flag", F.when(F.col("event_id") % 11 != 0, F.col("sog") > 90))
    return rounded(rates.far_by(p, ["cls"]))


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TRIP = _with(PTS, NUM)
STEPS = _with(PTS, NUM, step_sql("mmsi, trip_seq", "numbered"))
LAST = _with(
    PTS, NUM, "ended AS (SELECT *, max(t) OVER (PARTITION BY mmsi, trip_seq) AS t_end FROM numbered)",
    "cut AS (SELECT e.*, w.window_s FROM ended e, (VALUES (86400::DOUBLE), (259200::DOUBLE), (604800::DOUBLE)) w(window_s) WHERE t >= t_end - window_s)",
    step_sql("mmsi, trip_seq, window_s", "cut"),
    f"feats AS (SELECT mmsi, trip_seq, window_s, {AGG}, count(*) >= 2 AND max(t) - min(t) >= 0.5 * window_s AS window_complete FROM steps GROUP BY mmsi, trip_seq, window_s)",
)
RADIUS = f"near AS (SELECT p.*, s.port_region, {hav('lat', 'lon', 'seed_lat', 'seed_lon')} / 1.852 AS range_nm FROM points p, seeds s)"
FEATS = f"feats AS (SELECT mmsi, trip_seq, {AGG} FROM steps GROUP BY ALL)"
FAR_R = hav("lat", "lon", "25.5::DOUBLE", "-79.7::DOUBLE")
BEARING = "(degrees(atan2(sin(radians(-79.7::DOUBLE - lon)) * cos(radians(25.5::DOUBLE)), cos(radians(lat)) * sin(radians(25.5::DOUBLE)) - sin(radians(lat)) * cos(radians(25.5::DOUBLE)) * cos(radians(-79.7::DOUBLE - lon)))) + 360) % 360"
CELLS = "cells AS (SELECT cls, floor(lat / 0.1::DOUBLE)::BIGINT AS cell_i, floor(lon / 0.1::DOUBLE)::BIGINT AS cell_j, count(*) AS n, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM points GROUP BY ALL)"
PLANE = "plane AS (SELECT event_id, t, mmsi, (lon + 79.7::DOUBLE) * 60 * cos(radians(25.6::DOUBLE)) AS e, (lat - 25.6::DOUBLE) * 60 AS n FROM points)"
PAIRS = "pairs AS (SELECT *, lag(e) OVER w AS e0, lag(n) OVER w AS n0, t - lag(t) OVER w AS dt FROM plane WINDOW w AS (PARTITION BY mmsi ORDER BY t))"
VEL = "vel AS (SELECT *, (e - e0) / dt AS ve, (n - n0) / dt AS vn FROM pairs)"
TCPA = "tc AS (SELECT *, ve * ve + vn * vn AS s2, -(e0 * ve + n0 * vn) / nullif(ve * ve + vn * vn, 0) AS tc FROM vel)"



def brg(a: str, b: str, c: str, d: str) -> str:
    """Bearing from (a, b) to (c, d)."""
    return f"((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360) % 360)"


def off(lat: str, lon: str, bearing: str, nm: float) -> str:
    """The point at a distance along a bearing, as two columns."""
    return f"{lat} + {nm}::DOUBLE / 60 * cos(radians({bearing})) AS lat, {lon} + {nm}::DOUBLE / 60 * sin(radians({bearing})) / cos(radians({lat})) AS lon"


def _densest(source: str, where: str) -> str:
    return f"SELECT port_region, floor(lat / 0.1::DOUBLE)::BIGINT AS i, floor(lon / 0.1::DOUBLE)::BIGINT AS j, count(*) AS n, median(lat) AS lat, median(lon) AS lon FROM {source} {where} GROUP BY ALL"


_TURN = "least((({a} - {b}) % 360 + 360) % 360, 360 - (({a} - {b}) % 360 + 360) % 360) <= 90"
PLACED = _with(
    PTS, SEED_SQL, RADIUS, "local AS (SELECT * FROM near WHERE range_nm <= 40)",
    "fair AS (SELECT * FROM (" + _densest("local", "WHERE sog >= 5") + ") QUALIFY row_number() OVER (PARTITION BY port_region ORDER BY n DESC, i, j) = 1)",
    "base AS (SELECT *, " + brg("seed_lat", "seed_lon", "f_lat", "f_lon") + " AS out_brg FROM (SELECT s.port_region, seed_lat, seed_lon, coalesce(f.lat, seed_lat) AS f_lat, coalesce(f.lon, seed_lon) AS f_lon FROM seeds s LEFT JOIN fair f USING (port_region)))",
    "slow AS (SELECT * FROM (SELECT *, sum(CASE WHEN sog < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY port_region, mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM local) WHERE sog < 60)",
    "stays AS (SELECT * FROM slow QUALIFY max(t) OVER (PARTITION BY port_region, mmsi, run) - min(t) OVER (PARTITION BY port_region, mmsi, run) >= 21600)",
    "tops AS (SELECT *, row_number() OVER (PARTITION BY port_region ORDER BY n DESC, i, j) AS k FROM (" + _densest("stays", "") + ") QUALIFY k <= 8)",
    "spots AS (SELECT t.*, f_lat, f_lon, out_brg, " + brg("f_lat", "f_lon", "lat", "lon") + " AS brg FROM tops t JOIN base USING (port_region))",
    "berth AS (SELECT port_region, arg_max(lat, (n * w, -k)) AS lat, arg_max(lon, (n * w, -k)) AS lon FROM (SELECT *, CASE WHEN " + _TURN.format(a="brg", b="(out_brg + 180)") + " THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS w FROM spots) GROUP BY port_region)",
    "at_berth AS (SELECT base.*, coalesce(berth.lat, f_lat) AS b0_lat, coalesce(berth.lon, f_lon) AS b0_lon FROM base LEFT JOIN berth USING (port_region))",
    "moved AS (SELECT *, lat AS b_lat, lon AS b_lon FROM (SELECT *, " + off("b0_lat", "b0_lon", brg("b0_lat", "b0_lon", "f_lat", "f_lon"), 0.15) + " FROM at_berth))",
    "anchor AS (SELECT port_region, arg_max(lat, (n * w, -k)) AS lat, arg_max(lon, (n * w, -k)) AS lon FROM (SELECT s.*, CASE WHEN " + _TURN.format(a="brg", b="s.out_brg") + " THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS w FROM spots s JOIN (SELECT port_region, b_lat, b_lon FROM moved) m USING (port_region) WHERE " + hav("b_lat", "b_lon", "s.lat", "s.lon") + " / 1.852 >= 1) GROUP BY port_region)",
    "stand_in AS (SELECT port_region, " + off("f_lat", "f_lon", "out_brg", 1.5) + " FROM base)",
    "placed AS (SELECT port_region, 'berth_approach' AS placement_class, b_lat AS lat, b_lon AS lon FROM moved UNION ALL SELECT port_region, 'anchorage', coalesce(a.lat, s.lat), coalesce(a.lon, s.lon) FROM stand_in s LEFT JOIN anchor a USING (port_region) UNION ALL SELECT port_region, 'offshore_terminal', lat, lon FROM (SELECT port_region, " + off("f_lat", "f_lon", brg("b_lat", "b_lon", "f_lat", "f_lon"), 4.0) + " FROM (SELECT port_region, f_lat, f_lon, b_lat, b_lon FROM moved)) UNION ALL SELECT port_region, 'fairway_stress', f_lat, f_lon FROM base)",
    "named AS (SELECT port_region || '__' || placement_class AS asset_id, * FROM placed)",
)
ORACLE = {
    "placements": PLACED + "SELECT asset_id, port_region, placement_class, round(lat, 6) AS lat, round(lon, 6) AS lon FROM named",
    "placement_validity": PLACED.rstrip() + ", reach AS (SELECT asset_id, mmsi, t, " + hav("p.lat", "p.lon", "a.lat", "a.lon") + """ / 1.852 AS r FROM points p, named a), close AS (SELECT *, row_number() OVER (PARTITION BY asset_id, mmsi ORDER BY t) - 1 AS i FROM reach WHERE r <= 6),
legs AS (SELECT asset_id, count(*) AS n FROM (SELECT asset_id, mmsi FROM close GROUP BY asset_id, mmsi HAVING count(*) >= 4 AND arg_min(i, (r, t)) >= 3) GROUP BY asset_id),
seen AS (SELECT asset_id, min(r) AS m FROM reach WHERE r <= 40 GROUP BY asset_id),
v AS (SELECT asset_id, port_region, placement_class, lat, lon, m, coalesce(n, 0) AS n, coalesce(m <= 1, false) AS wet FROM named LEFT JOIN seen USING (asset_id) LEFT JOIN legs USING (asset_id)),
w AS (SELECT *, concat_ws(',', CASE WHEN NOT wet THEN 'not_over_water' END, CASE WHEN n < 5 THEN 'inbound_legs<5' END, CASE WHEN coalesce(m > 3.5, true) THEN 'min_range>3.5' END) AS why FROM v)
SELECT asset_id, port_region, placement_class, round(lat, 6) AS lat, round(lon, 6) AS lon, round(m, 6) AS min_observed_range_nm, n AS n_inbound_legs_in_annulus, wet AS water_occupied, why AS reject_reason, why = '' AS valid FROM w""",
    "trip_segmentation": TRIP + "SELECT mmsi, trip_seq, count(*) AS n_points, round(max(t) - min(t), 6) AS duration_s, round(quantile_cont(sog, 0.95), 6) AS sog_p95, round(stddev_samp(sog), 6) AS sog_std FROM numbered GROUP BY ALL",
    "trip_features": STEPS + f"SELECT mmsi, trip_seq, {AGG}, round(avg(CASE WHEN heading IS NULL THEN 0.0 ELSE 1.0 END), 6) AS heading_avail_frac FROM steps GROUP BY ALL",
    "kept_trips": TRIP + "SELECT mmsi, trip_seq, count(*) AS n_points, round(max(t) - min(t), 6) AS duration_s FROM numbered GROUP BY ALL HAVING count(*) >= 2 AND max(t) - min(t) >= 300",
    "class_summary": STEPS[:-1] + f""", {FEATS}, counts AS (SELECT mmsi, cls, count(*) AS n FROM points GROUP BY ALL),
 modal AS (SELECT mmsi, cls FROM counts QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY n DESC, cls) = 1)
SELECT cls, count(*) AS n_trips, count(DISTINCT mmsi) AS n_vessels, round(quantile_cont(sog_med, 0.5), 4) AS sog_med_median, round(quantile_cont(duration_s, 0.5), 4) AS duration_s_median, round(quantile_cont(path_km, 0.5), 4) AS path_km_median FROM feats JOIN modal USING (mmsi) GROUP BY cls""",
    "modal_class": _with(PTS) + "SELECT mmsi, cls FROM (SELECT mmsi, cls, count(*) AS n FROM points GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY n DESC, cls) = 1",
    "dedup_first": _with(PTS) + "SELECT mmsi, round(t, 6) AS t, min(event_id) AS event_id FROM (SELECT mmsi, t, event_id FROM points UNION ALL SELECT mmsi, t, event_id + 10000000 FROM points WHERE event_id % 3 = 0 UNION ALL SELECT mmsi, t, -event_id FROM points WHERE event_id % 5 = 0) GROUP BY mmsi, t",
    "cadence_thin": _with(PTS) + "SELECT mmsi, arg_min(event_id, t) AS event_id FROM points GROUP BY mmsi, floor(t / 43200)",
    "teleport_filter": _with(PTS) + f"SELECT event_id, mmsi FROM (SELECT *, t - lag(t) OVER w AS dt, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} / 1.852 AS nm FROM points WINDOW w AS (PARTITION BY mmsi ORDER BY t)) WHERE NOT coalesce(dt > 0 AND nm / (dt / 3600.0) > 2, false)",
    "coordinate_filter": _with(PTS) + "SELECT event_id, lat BETWEEN 25.2::DOUBLE AND 25.8::DOUBLE AND lon BETWEEN -79.9::DOUBLE AND -79.5::DOUBLE AS in_box FROM points WHERE event_id % 40 > 3",
    "sentinel_nulls": _with(PTS) + "SELECT cls, count(*) AS n, count(CASE WHEN sog BETWEEN 0 AND 50 THEN 1 END) AS n_sog, count(CASE WHEN heading >= 0 AND heading < 360 THEN 1 END) AS n_heading FROM points GROUP BY cls",
    "steps": STEPS + "SELECT event_id, round(dt, 6) AS dt, round(seg_km, 6) AS seg_km, round(turn_dps, 6) AS turn_dps, round(accel, 6) AS accel_kn_min FROM steps",
    "global_trip_ids": TRIP + "SELECT event_id, sum(new) OVER (ORDER BY mmsi, t ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS trip_id FROM numbered",
    "last_window_features": LAST + "SELECT mmsi, trip_seq, window_s, n_points, duration_s, sog_mean, sog_med, sog_p95, sog_std, path_km, net_km, window_complete FROM feats",
    "window_stats": LAST + "SELECT window_s, count(*) AS n_rows, count(*) FILTER (window_complete) AS n_complete, round(quantile_cont(sog_med, 0.5), 6) AS sog_med_median FROM feats GROUP BY window_s",
    "longest_horizon": LAST + "SELECT mmsi, trip_seq, max(window_s) AS window_s, arg_max(n_points, window_s) AS n_points, arg_max(sog_p95, window_s) AS sog_p95 FROM feats WHERE window_complete GROUP BY mmsi, trip_seq",
    "stationary_runs": _with(PTS) + "SELECT mmsi, run, count(*) AS n, round(max(t) - min(t), 6) AS span_s FROM (SELECT *, sum(CASE WHEN sog < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM points) WHERE sog < 60 GROUP BY mmsi, run HAVING max(t) - min(t) >= 86400",
    "first_crossing": _with(PTS) + f"SELECT mmsi, round(min(CASE WHEN {FAR_R} / 1.852 <= 12 THEN t END), 6) AS t_enter FROM points GROUP BY mmsi",
    "checkpoint_times": _with(PTS, "ends AS (SELECT mmsi, min(t) AS t0, max(t) AS t1 FROM points GROUP BY mmsi HAVING min(t) + 86400 <= max(t) + 1e-9)", "checks AS (SELECT mmsi, t0 + 86400 + i * 604800.0::DOUBLE AS t_check FROM ends, range(100000) r(i) WHERE i <= floor((t1 - t0 - 86400 + 1e-9) / 604800) UNION SELECT mmsi, t1 FROM ends)") + "SELECT mmsi, count(*) AS n_checks, round(max(t_check), 6) AS last_check, round(min(t_check), 6) AS first_check FROM checks GROUP BY mmsi",
    "radius_join": _with(PTS, SEED_SQL, RADIUS) + "SELECT event_id, port_region, round(range_nm, 6) AS range_nm FROM near WHERE range_nm <= 10",
    "closest_point": _with(PTS, SEED_SQL, RADIUS) + "SELECT mmsi, port_region, count(*) AS n_points, round(min(range_nm), 6) AS cpa_range_nm, round(arg_min(t, range_nm), 6) AS t_cpa, arg_min(i, range_nm) AS points_before_cpa FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, port_region ORDER BY t) - 1 AS i FROM near WHERE range_nm <= 15) GROUP BY mmsi, port_region",
    "bearings": _with(PTS) + f"SELECT event_id, round({BEARING}, 6) AS bearing, round(lat + 2.0::DOUBLE / 60 * cos(radians(cog)), 6) AS lat2, round(lon + 2.0::DOUBLE / 60 * sin(radians(cog)) / cos(radians(lat)), 6) AS lon2, round(((cog - heading + 180) % 360 + 360) % 360 - 180, 6) AS drift FROM points",
    "approach": _with(PTS, PLANE, PAIRS, VEL, TCPA) + "SELECT event_id, round(CASE WHEN dt > 0 THEN CASE WHEN s2 > 0 THEN sqrt(pow(e0 + ve * tc, 2) + pow(n0 + vn * tc, 2)) ELSE sqrt(e0 * e0 + n0 * n0) END END, 5) AS dcpa_nm, round(CASE WHEN dt > 0 AND s2 > 0 THEN tc END, 3) AS tcpa_s FROM tc",
    "densest_cell": _with(PTS, CELLS) + "SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY cls ORDER BY n DESC, cell_i, cell_j) = 1",
    "top_cells": _with(PTS, CELLS) + "SELECT *, CAST(row_number() OVER (PARTITION BY cls ORDER BY n DESC, cell_i, cell_j) AS INTEGER) AS rank FROM cells QUALIFY row_number() OVER (PARTITION BY cls ORDER BY n DESC, cell_i, cell_j) <= 8",
    "region_bands": _with(PTS) + "SELECT CASE WHEN lon < -79.9::DOUBLE THEN 'west' WHEN lon < -79.6::DOUBLE THEN 'middle' WHEN lon < -79.4::DOUBLE THEN 'east' ELSE 'far' END AS region, count(*) AS n, count(DISTINCT mmsi) AS n_vessels FROM points GROUP BY region",
    "geo_cell": _with(PTS) + "SELECT floor(lat / 0.25::DOUBLE)::BIGINT || '_' || floor(lon / 0.25::DOUBLE)::BIGINT AS cell, count(*) AS n FROM points GROUP BY cell",
    "contingency": _with(PTS) + "SELECT cls, count(*) FILTER (lon < -79.9::DOUBLE) AS west, count(*) FILTER (lon >= -79.9::DOUBLE AND lon < -79.6::DOUBLE) AS middle, count(*) FILTER (lon >= -79.6::DOUBLE) AS east FROM points GROUP BY cls",
    "null_profile": _with(PTS, *[f"p_{c} AS (SELECT '{c}' AS column_name, count(*) AS n, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_frac FROM points)" for c in ("heading", "sog", "cog", "props")]) + "SELECT * FROM p_heading UNION ALL SELECT * FROM p_sog UNION ALL SELECT * FROM p_cog UNION ALL SELECT * FROM p_props",
    "quantile_profile": _with(PTS) + "SELECT cls, round(quantile_cont(sog, 0.05), 6) AS p05, round(quantile_cont(sog, 0.5), 6) AS p50, round(quantile_cont(sog, 0.95), 6) AS p95 FROM points GROUP BY cls",
    "vessel_split": "WITH RECURSIVE " + PTS + """,
s AS (SELECT mmsi, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(mmsi AS VARCHAR)) AS r FROM points GROUP BY mmsi),
go(r, a, b, c, n, split) AS (SELECT 0::BIGINT, sum(n) * 0.70::DOUBLE, sum(n) * 0.15::DOUBLE, sum(n) * 0.15::DOUBLE, 0::BIGINT, '' FROM s UNION ALL SELECT s.r, a - CASE WHEN pick = 'train' THEN s.n ELSE 0 END, b - CASE WHEN pick = 'val' THEN s.n ELSE 0 END, c - CASE WHEN pick = 'test' THEN s.n ELSE 0 END, s.n, pick
 FROM (SELECT *, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END AS pick FROM go) g JOIN s ON s.r = g.r + 1)
SELECT split, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_vessels, round(sum(n) / (SELECT sum(n) FROM s), 3) AS share FROM go WHERE r > 0 GROUP BY split""",
    "vessel_split_check": _with(PTS) + "SELECT mmsi, count(DISTINCT CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 < 9 THEN 'val' ELSE 'test' END) AS n_splits, count(*) AS n FROM points GROUP BY mmsi HAVING n_splits > 1",
    "props_json": "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n_keys, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "session_counts": TRIP + "SELECT mmsi, count(DISTINCT trip_seq) AS n_sessions FROM numbered GROUP BY mmsi",
    "far_strata": _with(PTS) + "SELECT cls, count(*) FILTER (event_id % 11 <> 0) AS n, count(*) FILTER (event_id % 11 <> 0 AND sog > 90) AS n_flag, round(count(*) FILTER (event_id % 11 <> 0 AND sog > 90)::DOUBLE / count(*) FILTER (event_id % 11 <> 0), 6) AS far FROM points GROUP BY cls",
}
QUERIES = {f.__name__: f for f in (
    trip_segmentation, trip_features, kept_trips, class_summary, modal_class, dedup_first, cadence_thin, teleport_filter, coordinate_filter, sentinel_nulls, steps, global_trip_ids,
    last_window_features, window_stats, longest_horizon, stationary_runs, first_crossing, checkpoint_times, radius_join, closest_point, bearings, approach, densest_cell,
    top_cells, placements, placement_validity, region_bands, geo_cell, contingency, null_profile, quantile_profile, vessel_split_check, vessel_split, props_json, session_counts, far_strata,
)}
