"""Point streams: cleaning, de-duplication, teleport removal, thinning, segmentation into trips, features, windows.

All window steps partition by vessel, so that one shuffle by vessel serves the whole chain. The order of a vessel's points
is what the steps are about, so a vessel stays in one task, which spills. Where one key holds far more points than any vessel
sends (mmsi 0 stands for all without an identity), ``block_s`` cuts its track into blocks of time: each block gets the
end of the one before, counts run over the blocks, and the results are the same. ``apart`` deals such points out by place
instead, for those who do not want them as one track.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import geo


#: Points of one key beyond which its track is cut into blocks: a vessel sends some 10 million a year at a cadence of 3 s.
HOT_POINTS = 20_000_000


@dataclass(frozen=True)
class Limits:
    """Fixed values of the cleaning rules."""

    cadence_s: int = 60
    gap_s: int = 1800
    teleport_kn: float = 80.0
    min_points: int = 5
    min_duration_s: int = 300
    loiter_kn: float = 0.5
    max_sog: float = 102.2


def parse_time(column: str, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """Epoch seconds; NULL for what does not parse. The session's time zone is meant to be UTC."""
    return F.unix_timestamp(F.try_to_timestamp(F.col(column), F.lit(pattern)))


def valid_fixes(df: DataFrame, lat: str = "lat", lon: str = "lon", t: str = "t", box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows with a usable position and time; (0, 0) is no position. box: least and greatest latitude and longitude."""
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & ~((F.col(lat) == 0) & (F.col(lon) == 0)) & (F.col(t) > 0)
    if box:
        ok = ok & F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])
    return df.where(ok)


def sentinels_to_null(df: DataFrame, sog: str | None = "sog", angles: Sequence[str] = ("cog", "heading"), limits: Limits = Limits()) -> DataFrame:
    """Values that stand for 'not available' become NULL; the rows stay."""
    new = {c: F.when((F.col(c) >= 0) & (F.col(c) < 360), F.col(c)) for c in angles if c in df.columns}
    if sog and sog in df.columns:
        new[sog] = F.when(F.col(sog).between(0, limits.max_sog), F.col(sog))
    return df.withColumns(new) if new else df


def apart(points: DataFrame, parts: int, key: str = "mmsi", unknown: Sequence[int] = (0,), cell: str | None = None) -> DataFrame:
    """Negative stand-in keys for points without an identity, by a hash of a cell (or of the fix itself): points of many
    vessels under one number are no track, and would be one task."""
    spread = F.pmod(F.xxhash64(*([cell] if cell else [c for c in ("lat", "lon") if c in points.columns])), F.lit(parts))
    return points.withColumn(key, F.when(F.col(key).isin(list(unknown)), -1 - spread).otherwise(F.col(key)))


def first_of_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order (the order of ingest), so that the choice can be repeated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_previous(df: DataFrame, by: Sequence[str], columns: Sequence[str], t: str = "t", block_s: float | None = None) -> DataFrame:
    """df with _p_<column>: the value at the point before in the same track; NULL at the first. block_s: in blocks of so many
    seconds, so that no task orders a whole track (times of a track are then to be distinct)."""
    if block_s is None:
        w = Window.partitionBy(*by).orderBy(t)
        return df.withColumns({f"_p_{c}": F.lag(c).over(w) for c in columns})
    df = df.withColumn("_block", F.floor(F.col(t) / block_s))
    ends = df.groupBy(*by, "_block").agg(F.max_by(F.struct(*columns), t).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*by).orderBy("_block")))
    w = Window.partitionBy(*by, "_block").orderBy(t)
    df = df.join(ends, [*by, "_block"]).withColumn("_first", F.row_number().over(w) == 1)
    return df.withColumns({f"_p_{c}": F.when(F.col("_first"), F.col(f"_end.{c}")).otherwise(F.lag(c).over(w)) for c in columns}).drop("_block", "_end", "_first")


def drop_teleports(df: DataFrame, key: str = "mmsi", t: str = "t", lat: str = "lat", lon: str = "lon", limits: Limits = Limits(), block_s: float | None = None) -> DataFrame:
    """Without points whose implied speed from the raw predecessor is above the limit; one pass, never repeated."""
    rows = with_previous(df, [key], [t, lat, lon], t, block_s)
    hours = (F.col(t) - F.col(f"_p_{t}")) / 3600.0
    speed = geo.range_nm(f"_p_{lat}", f"_p_{lon}", F.col(lat), F.col(lon)) / hours
    rows = rows.withColumn("_kn", F.when(hours > 0, speed)).where(F.coalesce(F.col("_kn") <= limits.teleport_kn, F.lit(True)))
    return rows.drop("_kn", *[f"_p_{c}" for c in (t, lat, lon)])


def thin(df: DataFrame, key: str = "mmsi", t: str = "t", limits: Limits = Limits()) -> DataFrame:
    """The first point of each cadence bin of a vessel."""
    w = Window.partitionBy(key, F.floor(F.col(t) / limits.cadence_s)).orderBy(t)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def trip_sequence(df: DataFrame, key: str = "mmsi", t: str = "t", limits: Limits = Limits(), block_s: float | None = None) -> DataFrame:
    """trip_seq: number of a vessel's trip, from 1; a new one after a gap longer than the limit or no progress in time."""
    rows = with_previous(df, [key], [t], t, block_s)
    gap = F.col(t) - F.col(f"_p_{t}")
    rows = rows.withColumn("_new", F.when(gap.isNull() | (gap > limits.gap_s) | (gap <= 0), 1).otherwise(0)).drop(f"_p_{t}")
    if block_s is None:
        w = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("trip_seq", F.sum("_new").over(w).cast("long")).drop("_new")
    rows = rows.withColumn("_block", F.floor(F.col(t) / block_s))
    sums = rows.groupBy(key, "_block").agg(F.sum("_new").alias("_n"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy(key, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, [key, "_block"])
    return rows.withColumn("trip_seq", (F.sum("_new").over(w) + F.col("_base")).cast("long")).drop("_new", "_block", "_base")


def global_trip_id(df: DataFrame, key: str = "mmsi", vessels_per_range: int = 100_000, save=None) -> DataFrame:
    """trip_id: trips numbered over vessels in key order, by a prefix sum over one row per vessel.

    The prefix runs over vessels (not points) in two levels: within ranges of vessels, then over the ranges. The trips of
    each vessel are counted once and kept (``save``), so the segmentation before is not run again.
    """
    save = save or session.checkpoint
    per = save(df.groupBy(key).agg(F.max("trip_seq").alias("_n")))
    ranges = max(1, -(-per.count() // vessels_per_range))
    per = save(per.repartitionByRange(ranges, key).withColumn("_b", F.spark_partition_id())) if ranges > 1 else per.withColumn("_b", F.lit(0))
    base, seen = [], 0
    for r in sorted(per.groupBy("_b").agg(F.sum("_n").alias("n")).collect(), key=lambda r: r["_b"]):
        base.append((r["_b"], seen))
        seen += r["n"]
    w = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    base = df.sparkSession.createDataFrame(base or [(0, 0)], "_b int, _base long")
    offset = per.join(F.broadcast(base), "_b").select(key, (F.col("_base") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_offset"))
    return df.join(offset, key).withColumn("trip_id", F.col("_offset") + F.col("trip_seq") - 1).drop("_offset")


def segment(points: DataFrame, order: Sequence[str], key: str = "mmsi", t: str = "t", limits: Limits = Limits(), block_s: float | None = None) -> DataFrame:
    """De-duplicate, drop teleports, thin and number trips, in this order."""
    points = first_of_duplicates(points, [key, t], order)
    return trip_sequence(thin(drop_teleports(points, key, t, limits=limits, block_s=block_s), key, t, limits), key, t, limits, block_s)


def hot_blocks(points: DataFrame, key: str = "mmsi", most: int = HOT_POINTS) -> float | None:
    """A day, where any key holds more than ``most`` points, as block_s of the steps above; else None: the same results."""
    top = points.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return 86_400.0 if top > most else None


def steps(points: DataFrame, trip: Sequence[str] = ("trip_id",), t: str = "t", block_s: float | None = None) -> DataFrame:
    """dt, seg_km, turn_dps and accel_kn_min against the point before in the same trip; NULL for the first."""
    rows = with_previous(points, list(trip), [t, "lat", "lon", "cog", "sog"], t, block_s)
    dt = F.col(t) - F.col(f"_p_{t}")
    return rows.withColumns({
        "dt": dt,
        "seg_km": geo.haversine_km("_p_lat", "_p_lon", F.col("lat"), F.col("lon")),
        "turn_dps": F.when(dt > 0, F.abs(geo.angle_difference(F.col("cog"), F.col("_p_cog"))) / dt),
        "accel_kn_min": F.when(dt > 0, (F.col("sog") - F.col("_p_sog")) / (dt / 60.0)),
    }).drop(*[f"_p_{c}" for c in (t, "lat", "lon", "cog", "sog")])


def circular_std(column: str) -> Column:
    """Degrees; from the mean resultant held in [1e-9, 1]. NULL if no angle is known (greatest() would hide that)."""
    r = F.sqrt(F.pow(F.avg(F.sin(F.radians(F.col(column)))), 2) + F.pow(F.avg(F.cos(F.radians(F.col(column)))), 2))
    return F.when(r.isNotNull(), F.degrees(F.sqrt(-2 * F.log(F.least(F.greatest(r, F.lit(1e-9)), F.lit(1.0))))))


def trip_aggregates(limits: Limits = Limits(), t: str = "t") -> list[Column]:
    """The aggregates of one trip (or window) over the output of ``steps``. Unknown speeds count as not loitering."""
    sog = F.percentile("sog", [0.5, 0.95])
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(t)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(t)))
    net = geo.haversine_km(known("lat"), known("lon"), last("lat"), last("lon"))
    path = F.coalesce(F.sum("seg_km"), F.lit(0.0))
    return [
        F.count("*").alias("n_points"), F.min(t).alias("t_start"), F.max(t).alias("t_end"), (F.max(t) - F.min(t)).cast("double").alias("duration_s"),
        F.avg("sog").alias("sog_mean"), sog.getItem(0).alias("sog_med"), sog.getItem(1).alias("sog_p95"), F.max("sog").alias("sog_max"), F.stddev_samp("sog").alias("sog_std"),
        F.avg(F.coalesce(F.col("sog") < limits.loiter_kn, F.lit(False)).cast("double")).alias("loiter_frac"),
        path.alias("path_km"), net.alias("net_km"), F.when(path > 0, net / path).alias("straightness"),
        F.avg("turn_dps").alias("turn_rate_mean_dps"), F.percentile("turn_dps", 0.95).alias("turn_rate_p95_dps"), circular_std("cog").alias("cog_circ_std_deg"),
        F.avg(F.abs("accel_kn_min")).alias("accel_mean_abs"), F.stddev_samp("accel_kn_min").alias("accel_std"),
    ]


def trip_features(points: DataFrame, trip: Sequence[str] = ("trip_id",), extra: Sequence[Column] = (), limits: Limits = Limits(), block_s: float | None = None) -> DataFrame:
    """One row per trip. Windows and aggregate share the partitioning by trip."""
    more = [F.avg(F.col("heading").isNotNull().cast("double")).alias("heading_avail_frac")] if "heading" in points.columns else []
    return steps(points, trip, block_s=block_s).groupBy(*trip).agg(*trip_aggregates(limits), *more, *extra)


def keep_long(trips: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return trips.where((F.col("n_points") >= limits.min_points) & (F.col("duration_s") >= limits.min_duration_s))


def modal(column: str, by: Sequence[str], df: DataFrame) -> DataFrame:
    """The most frequent value of each group, the smallest on a tie; NULL values do not count."""
    return df.groupBy(*by).agg(F.mode(column, True).alias(column))


def last_windows(points: DataFrame, lengths: Sequence[float], trip: Sequence[str] = ("trip_id",), min_points: int = 2, min_span: float = 0.5, t: str = "t", whole: bool = False, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per trip and length: features of the last W seconds (border included), and whether they are complete.

    Steps are taken inside each window: its first point has no predecessor. ``whole`` adds the whole track as an
    infinite window. One pass: points are repeated for the windows that hold them, at most once per length.
    """
    lengths = [float(w) for w in lengths] + ([float("inf")] if whole else [])
    end = F.max(t).over(Window.partitionBy(*trip))
    rows = points.withColumn("_end", end).withColumn("window_s", F.explode(F.array(*[F.lit(w) for w in lengths])))
    rows = rows.where(F.col(t) >= F.col("_end") - F.col("window_s")).drop("_end")
    out = trip_features(rows, (*trip, "window_s"), extra)
    complete = (F.col("n_points") >= min_points) & ((F.col("duration_s") >= min_span * F.col("window_s")) | (F.col("window_s") == float("inf")))
    return out.withColumn("window_complete", complete)


def longest_complete(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of the longest complete window of each contact; contacts without one are absent."""
    held = F.struct(*[F.col(c) for c in columns])
    best = rows.where("window_complete").groupBy(*by).agg(F.max("window_s").alias("window_s"), F.max_by(held, "window_s").alias("_r"))
    return best.select(*by, "window_s", *[F.col(f"_r.{c}").alias(c) for c in columns if c not in (*by, "window_s")])


def first_crossing(points: DataFrame, by: Sequence[str], range_col: str, limit: float, t: str = "t") -> DataFrame:
    """When each track is first within a range; NULL if never."""
    return points.groupBy(*by).agg(F.min(F.when(F.col(range_col) <= limit, F.col(t))).alias("t_enter"))


def stationary_runs(points: DataFrame, trip: Sequence[str] = ("trip_id",), t: str = "t", below_kn: float = 0.5, dwell_s: float = 6 * 3600) -> DataFrame:
    """Points of runs of consecutive slow points that last at least dwell_s; an unknown speed ends a run."""
    w = Window.partitionBy(*trip).orderBy(t)
    slow = F.coalesce(F.col("sog") < below_kn, F.lit(False))
    rows = points.withColumn("_slow", slow).withColumn("_island", F.sum(F.when(F.col("_slow"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("_slow")
    run = Window.partitionBy(*trip, "_island")
    rows = rows.withColumn("_span", F.max(t).over(run) - F.min(t).over(run))
    return rows.where(F.col("_span") >= dwell_s).drop("_slow", "_span").withColumnRenamed("_island", "run")


def at_checkpoints(points: DataFrame, checks: DataFrame, by: Sequence[str], mean: str, last: str, t: str = "t") -> DataFrame:
    """by, t_check, ``score`` (mean of a column over the track's points up to then, within 1e-9), ``last`` (a column at the
    last of them): running values in one pass over points and checkpoints in order of time, linear in both. Checkpoints
    before the first point are absent."""
    held = points.select(*by, F.col(t).cast("double").alias("_at"), F.lit(None).cast("double").alias("t_check"), F.col(mean).alias("_m"), F.struct(F.col(last).alias("v")).alias("_l"))
    none = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("_m", "_l")]
    both = held.unionByName(checks.select(*by, (F.col("t_check") + 1e-9).alias("_at"), F.col("t_check").cast("double").alias("t_check"), *none))
    run = Window.partitionBy(*by).orderBy("_at", F.col("t_check").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"score": F.avg("_m").over(run), "_l": F.last("_l", True).over(run)})
    return both.where("t_check is not null and _l is not null").select(*by, "t_check", "score", F.col("_l.v").alias(last))


def prefixes(points: DataFrame, trip: Sequence[str], min_history_s: float, stride_s: float, t: str = "t") -> DataFrame:
    """Checkpoints of each track: from the first time with enough history in fixed strides, and its end."""
    ends = points.groupBy(*trip).agg(F.min(t).cast("double").alias("_t0"), F.max(t).cast("double").alias("_t1"))
    stride = max(1.0, float(stride_s))
    n = F.floor((F.col("_t1") - F.col("_t0") - min_history_s + 1e-9) / stride)
    ends = ends.where(F.col("_t0") + min_history_s <= F.col("_t1") + 1e-9)
    at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long")), lambda i: F.col("_t0") + min_history_s + i * F.lit(stride))
    return ends.select(*trip, F.explode(F.array_distinct(F.array_append(at, F.col("_t1")))).alias("t_check"))
