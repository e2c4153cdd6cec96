"""Point streams: the batch rules on Structured Streaming. A replay of a finished table gives the batch result.

Trips are kept per vessel as keyed state: the last point and running sums of the open trip, or (``trip_windows``) the open
trip's points of the longest window. A trip is emitted when a gap shows or when the watermark passes its last point by
the gap (event-time timeout), so state does not grow with a vessel's history. ``decide`` judges the emitted windows with
static tables of policy and thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import decisions
from ..operators.tracks import Limits

TRIPS = "mmsi long, trip_seq long, n_points long, t_start double, t_end double, sog_max double, sog_sum double, n_sog long"
STATE = "seq long, n long, t0 double, t1 double, top double, total double, known long"


def read_points(spark, path: str, schema, max_files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def prepare(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event time from epoch seconds, a watermark, and one row per (vessel, time) within it."""
    ts = F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))
    return stream.withColumn("event_time", ts).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["mmsi", "event_time"])


def trips(stream: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Closed trips of a prepared stream. Points of a batch are taken in order of time; points that are late against the
    watermark have been dropped before, points older than the vessel's last one open no new trip and are left out."""
    gap = float(limits.gap_s)

    def row(key, s) -> dict:
        seq, n, t0, t1, top, total, known = s
        return {"mmsi": key, "trip_seq": seq, "n_points": n, "t_start": t0, "t_end": t1, "sog_max": top if known else None, "sog_sum": total, "n_sog": known}

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        s = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([row(key[0], s)])
            return
        points = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, sog in zip(points["t"], points["sog"], strict=True):
            if s is not None and t <= s[3]:
                continue
            if s is None or t - s[3] > gap:
                if s is not None:
                    out.append(row(key[0], s))
                s = [(s[0] if s else 0) + 1, 0, t, t, float("-inf"), 0.0, 0]
            s[1], s[3] = s[1] + 1, t
            if pd.notna(sog):
                s[4], s[5], s[6] = max(s[4], float(sog)), s[5] + float(sog), s[6] + 1
        if s is not None:
            state.update(tuple(s))
            due = int((s[3] + gap) * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRIPS.split(", ")])

    return stream.groupBy("mmsi").applyInPandasWithState(run, TRIPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


WINDOWS = "mmsi long, trip_seq long, window_s double, n_points long, duration_s double, sog_mean double, sog_med double, sog_p95 double, sog_std double, path_km double, net_km double, window_complete boolean"
#: Last raw fix (for the speed test), last cadence bin, trip number, and the open trip's points of the longest window.
OPEN = "raw_t double, raw_lat double, raw_lon double, bin long, seq long, t array<double>, lat array<double>, lon array<double>, sog array<double>"
EARTH_KM, KM_PER_NM = 6371.0088, 1.852


def _km(lat0, lon0, lat1, lon1):
    a = np.sin(np.radians(lat1 - lat0) / 2) ** 2 + np.cos(np.radians(lat0)) * np.cos(np.radians(lat1)) * np.sin(np.radians(lon1 - lon0) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


def _window(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, sog: np.ndarray, length: float) -> list:
    """Features of the last ``length`` seconds of a closed trip; its first point there has no predecessor."""
    at = t >= t[-1] - length
    t, lat, lon, sog = t[at], lat[at], lon[at], sog[at]
    known = sog[~np.isnan(sog)]
    span = float(t[-1] - t[0])
    stats = [known.mean(), *np.percentile(known, [50, 95]), known.std(ddof=1) if len(known) > 1 else None] if len(known) else [None] * 4
    return [length, len(t), span, *stats, float(_km(lat[:-1], lon[:-1], lat[1:], lon[1:]).sum()), float(_km(lat[0], lon[0], lat[-1], lon[-1])), len(t) >= 2 and span >= 0.5 * length]


def trip_windows(stream: DataFrame, lengths: list[float], limits: Limits = Limits()) -> DataFrame:
    """Window features of each closed trip of a prepared stream, as batch segmentation and ``last_windows`` give them: points
    with an impossible speed against the raw predecessor go, each cadence bin keeps its first point, a gap ends the trip."""
    longest, names = max(lengths), [c.split()[0] for c in WINDOWS.split(", ")]

    def rows(key, seq, pts) -> list:
        t, lat, lon, sog = (np.array([np.nan if v is None else v for v in x], float) for x in zip(*pts, strict=True))
        return [[key, seq, *_window(t, lat, lon, sog, w)] for w in lengths]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list = []
        raw, last_bin, seq, pts = None, None, 0, []
        if state.exists:
            s = state.get
            raw, last_bin, seq, pts = s[:3], s[3], s[4], list(zip(*s[5:], strict=True))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(rows(key[0], seq, pts), columns=names)
            return
        batch = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, lat, lon, sog in zip(batch["t"], batch["lat"], batch["lon"], batch["sog"], strict=True):
            if raw is not None and t <= raw[0]:
                continue
            fast = raw is not None and _km(raw[1], raw[2], lat, lon) / KM_PER_NM / ((t - raw[0]) / 3600.0) > limits.teleport_kn
            raw = (float(t), float(lat), float(lon))
            now = int(t // limits.cadence_s)
            if fast or now == last_bin:
                continue
            last_bin = now
            if not pts or t - pts[-1][0] > limits.gap_s:
                if pts:
                    out += rows(key[0], seq, pts)
                seq, pts = seq + 1, []
            pts.append((float(t), float(lat), float(lon), None if pd.isna(sog) else float(sog)))
            if pts[0][0] < t - 2 * longest:
                pts = [p for p in pts if p[0] >= t - longest]
        if raw is not None:
            state.update((*raw, last_bin, seq, *(list(x) for x in zip(*pts, strict=True))))
            state.setTimeoutTimestamp(max(int((pts[-1][0] + limits.gap_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy("mmsi").applyInPandasWithState(run, WINDOWS, OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def decide(windows: DataFrame, contacts: DataFrame, policy: DataFrame, table: DataFrame, far_target: float, score: str = "sog_p95") -> DataFrame:
    """Emitted windows with status and action under static tables: contacts (mmsi, asserted_class), policy as in
    ``decisions.resolve``, thresholds (envelope_used, window_s, subspace, far_target, threshold). A stateless chain: each
    complete window is judged by itself; the longest one of a trip is the trip's decision."""
    rows = windows.where("window_complete").join(F.broadcast(contacts), "mmsi", "left")
    rows = decisions.resolve(rows, policy).withColumn("score", F.col(score)).withColumn("subspace", F.lit("core"))
    known = table.select("envelope_used").distinct().withColumn("envelope_known", F.lit(True))
    rows = rows.join(F.broadcast(known), "envelope_used", "left").withColumn("has_window", F.lit(True)).withColumn("status", decisions.status())
    return decisions.with_threshold(rows, table, far_target).withColumn("action", decisions.action())


def session_counts(stream: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Points per session of a vessel with the built-in session window; agrees with trips on where they begin."""
    return stream.groupBy("mmsi", F.session_window("event_time", f"{limits.gap_s} seconds")).agg(F.count("*").alias("n_points"))


def window_features(stream: DataFrame, length: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Sliding-window aggregates per vessel, emitted when the watermark has passed them."""
    w = F.window("event_time", length, slide)
    return stream.groupBy("mmsi", w).agg(F.count("*").alias("n_points"), F.avg("sog").alias("sog_mean"), F.max("sog").alias("sog_max"))


def first_flags(stream: DataFrame, threshold: float, score: str = "score", forget_s: float | None = None) -> DataFrame:
    """(mmsi, t_flag): the first time of each vessel at which its score is above the threshold. An earlier time that comes in
    a later batch is told as well, so the least row of a vessel holds. forget_s: state of a vessel goes so many seconds of
    event time after its last row (the stream needs a watermark); a later flag of it is then told anew."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        hit = rows.loc[rows[score] > threshold, "t"]
        before, last = state.get if state.exists else (None, float("-inf"))
        first = float(hit.min()) if len(hit) else None
        told = first is not None and (before is None or first < before)
        last = max(last, float(rows["t"].max()))
        state.update((first if told else before, last))
        if forget_s is not None:
            state.setTimeoutTimestamp(max(int((last + forget_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame({"mmsi": [key[0]], "t_flag": [first]})

    timeout = GroupStateTimeout.NoTimeout if forget_s is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy("mmsi").applyInPandasWithState(run, "mmsi long, t_flag double", "t double, last double", "append", timeout)


def write(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: str = "memory", path: str | None = None):
    """Start a query over everything that is there (availableNow) and return it."""
    w = df.writeStream.outputMode(mode).format(sink).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.start(path) if path else w.start()
