"""Tracks against reference points: radius joins, encounter features, placements.

Seeds and placements are small tables (a bounded number of ports), so they are broadcast, after a check of their row
count, and the radius test follows a box test that any engine can evaluate first. Contiguity is islands over row
numbers in SQL: no grouped Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .tracks import stationary_runs

MAX_REFERENCE_ROWS = 100_000

# Fixed values of the placements: search radius (nm), speed of a moving point and of a moored one (kn), length of a stay (h),
# distance of the anchorage from the berth and of the terminal from the fairway (nm), weights of long stays on the wrong
# side, offsets of the berth toward the fairway and of a fairway's stand-in anchorage (nm).
SEARCH_NM, MOVING_KN, MOORED_KN, DWELL_H = 40.0, 5.0, 0.5, 6.0
SEPARATION_NM, SEAWARD_NM = 1.0, 4.0
SEAWARD_BERTH, LANDWARD_ANCHORAGE = 0.3, 0.4
BERTH_OFFSET_NM, ANCHORAGE_OFFSET_NM = 0.15, 1.5
# Fixed values of their validity: inbound legs, least range (nm), range of a fix that shows water (nm).
MIN_LEGS, MAX_MIN_RANGE_NM, WATER_NM = 50, 3.5, 1.0


@dataclass(frozen=True)
class Annulus:
    """Fixed values of an encounter."""

    min_range_nm: float = 0.25
    max_range_nm: float = 6.0
    min_points: int = 4
    points_before_cpa: int = 3


def _small(df: DataFrame) -> DataFrame:
    """A broadcast if the table has at most MAX_REFERENCE_ROWS rows; a larger one joins by a shuffle."""
    return F.broadcast(df) if df.limit(MAX_REFERENCE_ROWS + 1).count() <= MAX_REFERENCE_ROWS else df


def radius_join(points: DataFrame, seeds: DataFrame, radius_nm: float, lat: str = "lat", lon: str = "lon", seed_lat: str = "seed_lat", seed_lon: str = "seed_lon") -> DataFrame:
    """Every (point, seed) within the radius, with range_nm; a point may have several seeds.

    Both sides get latitude bands as wide as the radius; seeds also stand in the neighbouring bands. That makes an
    equi-join of it, so it also works where seeds are many; few seeds are broadcast.
    """
    band = radius_nm / geo.NM_PER_DEGREE
    spread = seeds.withColumn("_band", F.explode(F.array(*[(F.floor(F.col(seed_lat) / band) + i).cast("long") for i in (-1, 0, 1)])))
    rows = points.withColumn("_band", F.floor(F.col(lat) / band).cast("long")).join(_small(spread), "_band").drop("_band")
    return rows.withColumn("range_nm", geo.range_nm(lat, lon, seed_lat, seed_lon)).where(F.col("range_nm") <= radius_nm)


def near_tracks(points: DataFrame, references: DataFrame, track: Sequence[str], reference: Sequence[str], radius_nm: float, ref_lat: str = "seed_lat", ref_lon: str = "seed_lon") -> DataFrame:
    """All points of every (track, reference) of which any point lies within the radius, with the reference's columns: the
    pairs by a radius join, then an equi-join by track. Other pairs never meet."""
    near = radius_join(points.select(*track, "lat", "lon"), references, radius_nm, seed_lat=ref_lat, seed_lon=ref_lon).select(*track, *reference).distinct()
    return points.join(near.join(_small(references), list(reference)), list(track))


def closest_points(points: DataFrame, by: Sequence[str], range_col: str = "range_nm", t: str = "t") -> DataFrame:
    """Per track: the least range, its time (the first on a tie) and how many points come before it."""
    w = Window.partitionBy(*by).orderBy(t)
    rows = points.withColumn("_i", F.row_number().over(w) - 1)
    best = F.struct(F.col(range_col).alias("r"), F.col(t).alias("t"), F.col("_i").alias("i"))
    out = rows.groupBy(*by).agg(F.min(best).alias("_b"), F.count("*").alias("n_points"))
    return out.select(*by, "n_points", F.col("_b.r").alias("cpa_range_nm"), F.col("_b.t").alias("t_cpa"), F.col("_b.i").cast("long").alias("points_before_cpa"))


def encounter_features(points: DataFrame, by: Sequence[str], lat0: str, lon0: str, annulus: Annulus = Annulus(), t: str = "t") -> DataFrame:
    """One row per usable encounter (track and reference point); what has too little is absent, never zero-filled.

    In the annulus (or within its outer border, if no point lies in it) the closest point ends the inbound leg: the
    points before it without a break in the track. All steps partition by the encounter: one shuffle.
    """
    a, w = annulus, Window.partitionBy(*by).orderBy(t)
    all_ = Window.partitionBy(*by)
    rows = points.withColumn("_r", geo.range_nm("lat", "lon", lat0, lon0))
    rows = rows.withColumn("_b", geo.bearing_deg("lat", "lon", lat0, lon0)).withColumn("_i", F.row_number().over(w))
    e, n = geo.local_plane("lat", "lon", lat0, lon0)
    rows = rows.withColumn("_e", e).withColumn("_n", n)
    rows = rows.withColumns({"_dt1": F.col(t) - F.lag(t).over(w), "_e0": F.lag("_e").over(w), "_n0": F.lag("_n").over(w)})
    inside = F.col("_r").between(a.min_range_nm, a.max_range_nm)
    rows = rows.withColumn("_any", F.max(F.coalesce(inside, F.lit(False))).over(all_))
    rows = rows.where(F.when(F.col("_any"), inside).otherwise(F.col("_r") <= a.max_range_nm))
    rows = rows.withColumn("_k", F.row_number().over(w)).withColumn("_island", F.col("_i") - F.col("_k"))
    cpa = F.struct(F.col("_r").alias("r"), F.col("_k").alias("k"), F.col("_island").alias("island"))
    rows = rows.withColumn("_c", F.min(cpa).over(all_)).withColumn("_count", F.count("*").over(all_))
    rows = rows.where((F.col("_count") >= a.min_points) & (F.col("_c.k") - 1 >= a.points_before_cpa))
    leg = rows.where((F.col("_island") == F.col("_c.island")) & (F.col("_k") <= F.col("_c.k")))
    dt = F.col(t) - F.lag(t).over(w)
    leg = leg.withColumn("_dt", dt)
    leg = leg.withColumn("_closing", F.when(F.col("_dt") > 0, -(F.col("_r") - F.lag("_r").over(w)) / F.col("_dt") * 3600.0))
    leg = leg.withColumn("_turn", F.when(F.col("_dt") > 0, geo.angle_difference(F.col("_b"), F.lag("_b").over(w)) / F.col("_dt")))
    dcpa, tcpa = geo.closest_approach("_e0", "_n0", "_e", "_n", "_dt1")
    at_cpa = lambda c: F.max(F.when(F.col("_k") == F.col("_c.k"), c))
    q = F.percentile("_closing", [0.5, 0.9])
    out = leg.groupBy(*by).agg(
        F.min("_r").alias("range_min_nm"), q.getItem(0).alias("closing_rate_med_kn"), q.getItem(1).alias("closing_rate_p90_kn"),
        F.stddev_pop("_turn").alias("bearing_rate_std_dps"), at_cpa(dcpa).alias("dcpa_nm"), at_cpa(tcpa).alias("tcpa_s"),
        F.avg(F.when(F.col("_closing").isNotNull(), (F.col("_closing") > 0).cast("double"))).alias("closing_frac"),
        (F.max(t) - F.min(t)).cast("double").alias("inbound_leg_persistence_s"), F.max("_count").alias("n_points_in_annulus"),
        F.max("_c.r").alias("cpa_range_nm"), F.count("*").alias("_leg"), F.count("_closing").alias("_ok"),
    )
    return out.where((F.col("_leg") >= a.min_points) & (F.col("_ok") > 0)).drop("_leg", "_ok").withColumn("geometry_usable", F.lit(True))


def encounter_windows(points: DataFrame, trip_regions: DataFrame, placements: DataFrame, lengths: Sequence[float], trip: str = "trip_id", annulus: Annulus = Annulus(), t: str = "t") -> DataFrame:
    """Features per (trip, placement, window): the placements of the trip's region that any of its points reaches. The
    window is the last W seconds of the trip."""
    p = placements.select("asset_id", F.col("port_region").alias("_region"), F.col("lat").alias("asset_lat"), F.col("lon").alias("asset_lon"))
    end = F.max(t).over(Window.partitionBy(trip))
    rows = points.join(trip_regions, trip).withColumn("_end", end)
    rows = near_tracks(rows, p, [trip], ["asset_id"], annulus.max_range_nm, "asset_lat", "asset_lon").where(F.col("_region") == F.col("port_region"))
    rows = rows.withColumn("window_s", F.explode(F.array(*[F.lit(float(x)) for x in lengths]))).where(F.col(t) >= F.col("_end") - F.col("window_s"))
    return encounter_features(rows, [trip, "asset_id", "window_s"], "asset_lat", "asset_lon", annulus, t)


def cells(points: DataFrame, degrees: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Per grid cell: points and the medians of their coordinates. Counts are summed before the shuffle."""
    at = points.withColumn("cell_i", geo.cell_row("lat", degrees)).withColumn("cell_j", geo.cell_row("lon", degrees))
    return at.groupBy(*by, "cell_i", "cell_j").agg(F.count("*").alias("n"), F.median("lat").alias("lat"), F.median("lon").alias("lon"))


def densest_cell(points: DataFrame, degrees: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """The cell with most points, the smallest key on a tie."""
    best = F.max_by(F.struct("cell_i", "cell_j", "n", "lat", "lon"), F.struct("n", -F.col("cell_i"), -F.col("cell_j"))).alias("_c")
    c = cells(points, degrees, by)
    return (c.groupBy(*by) if by else c.groupBy()).agg(best).select(*by, "_c.*")


def top_cells(points: DataFrame, k: int = 8, degrees: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "cell_i", "cell_j")
    return cells(points, degrees, by).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _turned(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def derive_placements(points: DataFrame, seeds: DataFrame, search_nm: float = SEARCH_NM, moving_kn: float = MOVING_KN, moored_kn: float = MOORED_KN, dwell_h: float = DWELL_H, separation_nm: float = SEPARATION_NM, seaward_nm: float = SEAWARD_NM) -> DataFrame:
    """Four reference points per seed: fairway, berth, anchorage and offshore terminal.

    seeds: port_region, seed_lat, seed_lon. The fairway is the densest cell of moving points; berth and anchorage come
    from the densest cells of long stays, landward and seaward of it; the terminal lies seaward. Everything after the
    cells is arithmetic on at most eight rows per seed.
    """
    local = radius_join(points, seeds, search_nm)
    key = ["port_region"]
    fair = densest_cell(local.where(F.col("sog") >= moving_kn), by=key).select("port_region", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    base = seeds.join(fair, "port_region", "left").withColumns({"f_lat": F.coalesce("f_lat", "seed_lat"), "f_lon": F.coalesce("f_lon", "seed_lon")})
    base = base.withColumn("out_brg", geo.bearing_deg("seed_lat", "seed_lon", "f_lat", "f_lon"))
    stays = stationary_runs(local, ("port_region", "trip_id"), below_kn=moored_kn, dwell_s=dwell_h * 3600)
    spots = top_cells(stays, by=key).join(base, "port_region").withColumn("brg", geo.bearing_deg("f_lat", "f_lon", "lat", "lon"))
    landward = F.when(_turned(F.col("brg"), F.col("out_brg") + 180.0) <= 90, 1.0).otherwise(SEAWARD_BERTH)
    berth = spots.groupBy(*key).agg(F.max_by(F.struct("lat", "lon"), F.struct((F.col("n") * landward).alias("s"), (-F.col("rank")).alias("r"))).alias("_p")).select("port_region", F.col("_p.lat").alias("b_lat"), F.col("_p.lon").alias("b_lon"))
    base = base.join(berth, "port_region", "left").withColumns({"b_lat": F.coalesce("b_lat", "f_lat"), "b_lon": F.coalesce("b_lon", "f_lon")})
    lat, lon = geo.offset_point("b_lat", "b_lon", geo.bearing_deg("b_lat", "b_lon", "f_lat", "f_lon"), BERTH_OFFSET_NM)
    base = base.withColumns({"b_lat": lat, "b_lon": lon})
    far = spots.join(base.select("port_region", "b_lat", "b_lon"), "port_region").where(geo.range_nm("b_lat", "b_lon", "lat", "lon") >= separation_nm)
    seaward = F.when(_turned(F.col("brg"), F.col("out_brg")) <= 90, 1.0).otherwise(LANDWARD_ANCHORAGE)
    anchor = far.groupBy(*key).agg(F.max_by(F.struct("lat", "lon"), F.struct((F.col("n") * seaward).alias("s"), (-F.col("rank")).alias("r"))).alias("_p")).select("port_region", F.col("_p.lat").alias("a_lat"), F.col("_p.lon").alias("a_lon"))
    lat, lon = geo.offset_point("f_lat", "f_lon", F.col("out_brg"), ANCHORAGE_OFFSET_NM)
    base = base.join(anchor, "port_region", "left").withColumns({"a_lat": F.coalesce(F.col("a_lat"), lat), "a_lon": F.coalesce(F.col("a_lon"), lon)})
    lat, lon = geo.offset_point("f_lat", "f_lon", geo.bearing_deg("b_lat", "b_lon", "f_lat", "f_lon"), seaward_nm)
    base = base.withColumns({"o_lat": lat, "o_lon": lon})
    four = F.explode(F.array(*[F.struct(F.lit(k).alias("placement_class"), F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lon").alias("lon")) for k, p in (("berth_approach", "b"), ("anchorage", "a"), ("offshore_terminal", "o"), ("fairway_stress", "f"))]))
    return base.select("port_region", four.alias("_p")).select(F.concat_ws("__", "port_region", "_p.placement_class").alias("asset_id"), "port_region", "_p.placement_class", "_p.lat", "_p.lon")


def placement_validity(points: DataFrame, placements: DataFrame, search_nm: float = SEARCH_NM, min_legs: int = MIN_LEGS, max_min_range_nm: float = MAX_MIN_RANGE_NM, annulus: Annulus = Annulus()) -> DataFrame:
    """placements with inbound legs, least range, occupancy of the water, valid and reject_reason."""
    p = placements.select("asset_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = radius_join(points, p, search_nm, seed_lat="p_lat", seed_lon="p_lon")
    least = near.groupBy("asset_id").agg(F.min("range_nm").alias("min_observed_range_nm"))
    cpa = closest_points(near.where(F.col("range_nm") <= annulus.max_range_nm), ["asset_id", "trip_id"])
    legs = cpa.where((F.col("n_points") >= annulus.min_points) & (F.col("points_before_cpa") >= annulus.points_before_cpa)).groupBy("asset_id").agg(F.count("*").alias("n_inbound_legs_in_annulus"))
    out = placements.join(least, "asset_id", "left").join(legs, "asset_id", "left").na.fill(0, ["n_inbound_legs_in_annulus"])
    wet = F.coalesce(F.col("min_observed_range_nm") <= WATER_NM, F.lit(False))
    reason = F.concat_ws(",", F.when(~wet, "not_over_water"), F.when(F.col("n_inbound_legs_in_annulus") < min_legs, f"inbound_legs<{min_legs}"), F.when(F.coalesce(F.col("min_observed_range_nm") > max_min_range_nm, F.lit(True)), f"min_range>{max_min_range_nm}"))
    return out.withColumn("water_occupied", wet).withColumn("reject_reason", reason).withColumn("valid", reason == "")


def coverage(rows: DataFrame, by: Sequence[str], least: int = 30) -> DataFrame:
    """Encounters per cell and whether the cell is thin."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("trip_id").alias("n_trips")).withColumn("thin", F.col("n") < least)
