"""Whole flows: raw messages to trips, trips to models and false-alarm rates, contacts to decisions.

Each step is a plan; what several steps read again is written to the shared folder in between (``keep``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import tables
from ..operators import decisions, models, rates, splits, tracks
from ..sources import readers

CORE = ("sog_med", "sog_p95", "sog_std", "loiter_frac", "straightness", "accel_mean_abs")
COURSE = ("turn_rate_mean_dps", "cog_circ_std_deg")


@dataclass(frozen=True)
class Tracks:
    points: DataFrame
    trips: DataFrame
    vessels: DataFrame


def ingest(raw: DataFrame, exact: dict[int, str], ranges: Sequence[tuple[int, int, str]], roles: dict[str, str], limits: tracks.Limits = tracks.Limits(), targets_only: bool = False, keep=session.checkpoint) -> Tracks:
    """Messages to points with trips, trips with features, and the static class and role of each vessel.

    The class is taken from all valid messages, before segmentation; trips too short are dropped, and their points. Of
    messages that repeat a vessel's time the first counts: by their place in the files (``_place``, which the readers of
    files give), else in the order of raw. targets_only: without trips of classes that have no role.
    """
    fixes = readers.points(raw)
    fixes = keep(fixes if "_order" in fixes.columns else fixes.withColumn("_order", F.monotonically_increasing_id()))
    modal = tracks.modal("vessel_type", ["mmsi"], fixes)
    tx = tracks.modal("transceiver", ["mmsi"], fixes)
    cls = tables.code_class("vessel_type", exact, ranges, "unknown_other")
    role = F.coalesce(*[F.when(F.col("cls") == c, r) for c, r in roles.items()], F.lit("non_target")) if roles else F.lit("non_target")
    vessels = modal.join(tx, "mmsi").withColumn("cls", cls).withColumn("role", role)
    block = tracks.hot_blocks(fixes)
    pts = keep(tracks.segment(fixes, ["_order"], limits=limits, block_s=block).drop("_order", "vessel_type", "transceiver"))
    trips = tracks.keep_long(tracks.trip_features(pts, ("mmsi", "trip_seq"), limits=limits, block_s=block), limits)
    trips = tables.attach(trips, vessels, ["mmsi"])
    trips = trips.where("role <> 'non_target'") if targets_only else trips
    return Tracks(pts.join(trips.select("mmsi", "trip_seq"), ["mmsi", "trip_seq"], "left_semi"), trips, vessels)


def split_vessels(trips: DataFrame, ratios: Sequence[float] = splits.RATIOS) -> DataFrame:
    """trips with split: a vessel is in one split, vessel 0 in train."""
    return splits.assign_splits(trips, "mmsi", ratios, train_only=F.col("mmsi") == 0)


def windows(points: DataFrame, trips: DataFrame, lengths: Sequence[float]) -> DataFrame:
    """Last-window features with the class, role and split of the trip."""
    w = tracks.last_windows(points, lengths, ("mmsi", "trip_seq"))
    return w.join(trips.select("mmsi", "trip_seq", "cls", "role", "split"), ["mmsi", "trip_seq"])


@dataclass(frozen=True)
class Fitted:
    registry: DataFrame
    thresholds: DataFrame
    scored: DataFrame


def _subspaces(extra: Sequence[str] = ()) -> dict[str, list[str]]:
    return {"core": [*CORE, *extra], "core_course": [*CORE, *COURSE, *extra]}


def score(rows: DataFrame, registry: DataFrame, family: str = "mahalanobis", extra: Sequence[str] = ()) -> DataFrame:
    """rows with the score of their subspace (score), that of the core (core_score) and of the course model (course_score). Rows
    with all course features are scored by the course model where there is one, others by the core model."""
    session.ship(rows.sparkSession)
    by = ["cls", "window_s"]
    rows = rows.withColumn("row_id", F.xxhash64("mmsi", "trip_seq", "window_s"))
    each = {k: models.score_rows(rows, registry.where(F.col("subspace") == k), by, features, family) for k, features in _subspaces(extra).items()}
    held = registry.where("subspace = 'core_course'").select(*by, F.lit(True).alias("has_course")).distinct()
    both = each["core"].withColumnRenamed("score", "core_score").join(each["core_course"].select("row_id", F.col("score").alias("course_score")), "row_id").join(tables.small(held), by, "left")
    both = both.withColumn("subspace", models.subspace(COURSE, F.coalesce("has_course", F.lit(False))))
    return both.withColumn("score", F.when(F.col("subspace") == "core_course", F.col("course_score")).otherwise(F.col("core_score"))).drop("has_course")


def fit(rows: DataFrame, family: str = "mahalanobis", far_targets: Sequence[float] = models.FAR_TARGETS, min_rows: int = models.MIN_ROWS, extra: Sequence[str] = (), keep=session.checkpoint) -> Fitted:
    """A model per class, window and subspace on benign training rows, thresholds on validation rows, all rows scored.
    extra: further features of both subspaces, such as those of an encounter (rows without them have no score)."""
    session.ship(rows.sparkSession)
    rows = keep(rows)
    benign = decisions.benign_only(rows.withColumn("row_id", F.xxhash64("mmsi", "trip_seq", "window_s")))
    by = ["cls", "window_s"]
    registry = keep(reduce(DataFrame.unionByName, [models.fit_models(benign, by, features, [family], min_rows=min_rows).withColumn("subspace", F.lit(k)) for k, features in _subspaces(extra).items()]))
    scored = keep(score(rows, registry, family, extra))
    cal = scored.where("role = 'benign'")
    t = models.thresholds(cal.withColumn("score", F.col("core_score")), by, far_targets).withColumn("subspace", F.lit("core"))
    t = t.unionByName(models.thresholds(cal.withColumn("score", F.col("course_score")), by, far_targets).withColumn("subspace", F.lit("core_course")))
    return Fitted(registry, keep(t), scored)


def freeze(fitted: Fitted, path: str, note: str = "") -> dict[str, str]:
    """Models and thresholds below path, and their digests."""
    return {k: models.save_registry(getattr(fitted, k), f"{path}/{k}", note) for k in ("registry", "thresholds")}


def thaw(rows: DataFrame, path: str, digests: Mapping[str, str] | None = None, family: str = "mahalanobis", extra: Sequence[str] = ()) -> Fitted:
    """What ``freeze`` wrote, checked against its digests, with rows scored by it: nothing is fitted again."""
    registry, thresholds = (models.load_registry(rows.sparkSession, f"{path}/{k}", (digests or {}).get(k)) for k in ("registry", "thresholds"))
    return Fitted(registry, thresholds, score(rows, registry, family, extra))


def decide(fitted: Fitted, policy: DataFrame, far_target: float = 0.05, override: str | None = None) -> DataFrame:
    """One decision per trip: its longest complete window, scored under the envelope of its class."""
    rows = tracks.longest_complete(fitted.scored, ["mmsi", "trip_seq"], ["cls", "role", "split", "subspace", "score"])
    all_ = fitted.scored.select("mmsi", "trip_seq", F.col("cls").alias("asserted_class")).distinct()
    rows = all_.join(rows, ["mmsi", "trip_seq"], "left").withColumn("has_window", F.col("window_s").isNotNull())
    rows = decisions.resolve(rows, policy, override)
    known = fitted.registry.select(F.col("cls").alias("envelope_used"), F.lit(True).alias("envelope_known")).distinct()
    rows = rows.join(tables.small(known), "envelope_used", "left").withColumn("status", decisions.status())
    rows = decisions.with_threshold(rows, fitted.thresholds.withColumnRenamed("cls", "envelope_used"), far_target)
    return rows.withColumn("action", decisions.action())


def false_alarms(decided: DataFrame, by: Sequence[str] = ("cls",)) -> DataFrame:
    """False-alarm rate of held-out benign trips by stratum."""
    rows = decided.where("split = 'test' AND role = 'benign'").withColumn("flag", F.when(F.col("action") == "flag", True).when(F.col("action") == "pass", False))
    return rates.far_by(rows, by)
