"""From contacts to decisions: class policy, thresholds, status and action. Policies and thresholds are small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables

# Fixed values.
FLAG_OUTCOMES = ("missed", "mislabeled")
PASS_OUTCOMES = ("detected",)
#: Classes are configuration: more than this are an error.
MAX_CLASSES = 1_000
BLOCKED_ROLES = ("hostile", "adversary", "attack", "held_out")


def resolve(contacts: DataFrame, policy: DataFrame, override: str | None = None, asserted: str = "asserted_class") -> DataFrame:
    """contacts with policy, envelope_used and note. policy: class, policy, envelope, reason (one row per class).

    An override replaces the envelope of scoreable classes alone.
    """
    p = tables.small(policy.select(F.col("class").alias("_class"), F.coalesce("policy", F.lit("abstain")).alias("_policy"), F.col("envelope").alias("_envelope"), F.col("reason").alias("_reason")))
    out = contacts.join(p, F.col(asserted) == F.col("_class"), "left")
    score = (F.col("_policy") == "score") & F.col("_envelope").isNotNull() & (F.col("_envelope") != "")
    kind = F.when(F.col("_class").isNull(), "unknown_class").when(score, "score").otherwise("abstain")
    out = out.withColumn("policy", kind)
    used = F.when(F.col("policy") == "score", F.lit(override) if override else F.col("_envelope"))
    note = F.when(F.col("policy") == "unknown_class", F.concat(F.lit("class "), F.coalesce(F.col(asserted), F.lit("NULL")), F.lit(" has no policy")))
    note = note.when((F.col("_policy") == "score") & (F.col("policy") == "abstain"), "score policy without an envelope")
    note = note.when((F.col("policy") == "score") & F.lit(bool(override)), "envelope_override").otherwise(F.col("_reason"))
    return out.withColumn("envelope_used", used).withColumn("note", note).drop("_class", "_policy", "_envelope", "_reason")


def status(known_envelope: str = "envelope_known", has_window: str = "has_window", score: str = "score") -> Column:
    """In this order: unknown class, abstain, missing envelope, no window, missing features, scored."""
    return (
        F.when(F.col("policy") == "unknown_class", "unknown_class").when(F.col("policy") == "abstain", "abstain")
        .when(~F.coalesce(F.col(known_envelope), F.lit(False)), "missing_envelope").when(~F.coalesce(F.col(has_window), F.lit(False)), "no_window")
        .when(F.col(score).isNull(), "nan_features").otherwise("scored")
    )


def with_threshold(rows: DataFrame, table: DataFrame, far_target: float, keys: Sequence[str] = ("envelope_used", "window_s")) -> DataFrame:
    """rows with the threshold of their subspace, that of 'core' where it has none. table: keys, subspace, far_target, threshold."""
    t = table.where(F.abs(F.col("far_target") - far_target) < 1e-12).select(*keys, "subspace", "threshold")
    wide = t.groupBy(*keys).agg(F.max(F.when(F.col("subspace") == "core", F.col("threshold"))).alias("_core"), F.max(F.when(F.col("subspace") == "core_course", F.col("threshold"))).alias("_course"))
    out = rows.join(tables.small(wide), list(keys), "left")
    return out.withColumn("threshold", F.when(F.col("subspace") == "core_course", F.coalesce("_course", "_core")).otherwise(F.col("_core"))).drop("_core", "_course")


def action(score: str = "score", threshold: str = "threshold", state: str = "status") -> Column:
    """flag above the threshold (strictly), else pass; abstain if not scored or without a threshold."""
    return F.when((F.col(state) != "scored") | F.col(score).isNull() | F.col(threshold).isNull(), "abstain").when(F.col(score) > F.col(threshold), "flag").otherwise("pass")


def presence(track_present: str, outcome: str, flags: Sequence[str] = FLAG_OUTCOMES, passes: Sequence[str] = PASS_OUTCOMES) -> Column:
    """Presence rule: struct(action, status). An outcome outside both lists is an error, with or without a track."""
    o = F.col(outcome)
    known = o.isin(*flags, *passes)
    wrong = F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce(o, F.lit("NULL")))).cast("string")
    act = F.when(~F.coalesce(known, F.lit(False)), wrong).when(~F.col(track_present), "abstain").when(o.isin(*flags), "flag").otherwise("pass")
    return F.struct(act.alias("action"), F.when(F.col(track_present), "scored").otherwise("abstain_no_track").alias("status"))


def observations(truth: DataFrame, detections: DataFrame, target: int, by: Sequence[str] = ("image_id",), conf: float = 0.25) -> DataFrame:
    """What a camera says of each frame with a vessel: detected (the target class is seen), mislabeled (only others) or
    missed. track_present is for the caller to join."""
    seen = detections.where(F.col("score") >= conf).groupBy(*by).agg(F.max(F.col("category_id") == target).alias("_hit"))
    frames = truth.select(*by).distinct().join(seen, list(by), "left")
    return frames.withColumn("outcome", F.when(F.col("_hit"), "detected").when(~F.col("_hit"), "mislabeled").otherwise("missed")).drop("_hit")


def decide(rows: DataFrame, backend: str, **columns) -> DataFrame:
    """One surface for both backends: rows with action."""
    if backend == "consistency":
        return rows.withColumn("action", action(**columns))
    if backend == "presence_only":
        return rows.withColumn("action", presence(**columns)["action"])
    raise ValueError(f"unknown backend {backend}")


def benign_only(rows: DataFrame, roles: str = "role", source: str | None = None, blocked_sources: Sequence[str] = (), classes: str | None = None, blocked_classes: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Training firewall: benign rows of sources and classes that are not blocked; strict: any other row is an error."""
    ok = F.coalesce(F.lower(F.trim(roles)) == "benign", F.lit(False))
    for c, blocked in ((source, blocked_sources), (classes, blocked_classes)):
        if c and blocked:
            ok = ok & ~F.coalesce(F.lower(F.trim(c)).isin([b.lower() for b in blocked]), F.lit(False))
    if strict:
        return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("row is not allowed in training")).cast("boolean")))
    return rows.where(ok)


def admissible_splits(pairs: DataFrame, policy: DataFrame, members: DataFrame, proxy_envelope: str, proxy_sources: Sequence[str], proxy_asserted: Sequence[str] = ()) -> DataFrame:
    """pairs (source_class, asserted_class) with the splits that may be scored: held-out ones for the class itself, for
    what touches the proxy pool and for members of the envelope; none without an envelope; else all."""
    env = policy.where("policy = 'score'").select(F.col("class").alias("asserted_class"), F.col("envelope").alias("_env"))
    known = members.select(F.col("envelope").alias("_env"), F.col("member_class").alias("source_class")).distinct().withColumn("_member", F.lit(True))
    rows = pairs.join(tables.small(env), "asserted_class", "left").join(tables.small(known), ["_env", "source_class"], "left")
    held, all_ = F.array(F.lit("test"), F.lit("val")), F.array(F.lit("test"), F.lit("train"), F.lit("val"))
    proxy = (F.coalesce(F.col("_env") == proxy_envelope, F.lit(False)) | F.col("asserted_class").isin(list(proxy_asserted) or [""])) & F.col("source_class").isin(list(proxy_sources) or [""])
    none = F.array().cast("array<string>")
    out = F.when(F.col("source_class") == F.col("asserted_class"), held).when(proxy, held).when(F.col("_env").isNull(), none).when(F.col("_member"), held).otherwise(all_)
    return rows.select("source_class", "asserted_class", out.alias("splits"))


def class_lists(policy: DataFrame) -> DataFrame:
    """(list, classes): scoreable classes (with an envelope) and abstained ones, sorted and comma-joined."""
    kind = F.when((F.col("policy") == "score") & (F.coalesce("envelope", F.lit("")) != ""), "scoreable").otherwise("abstain")
    return policy.groupBy(kind.alias("list")).agg(F.array_join(F.array_sort(F.collect_set("class")), ",").alias("classes"))


def swap_pairs(classes: DataFrame, column: str = "class") -> DataFrame:
    """All ordered pairs of different classes of a (small) class table."""
    names = sorted(r[0] for r in classes.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect())
    if len(names) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    kind = classes.schema[column].dataType.simpleString()
    return classes.sparkSession.createDataFrame([(a, b) for a in names for b in names if a != b], f"source_class {kind}, asserted_class {kind}")


def fast_and_straight(min_sog: float = 30.0, min_straightness: float = 0.95) -> Column:
    band = (F.col("sog_p95") >= min_sog) & (F.col("straightness") >= min_straightness) & F.col("window_complete") & (F.col("role") == "benign")
    return F.coalesce(band, F.lit(False))


def resolve_window(requested: str, available: str, primary: Column | int) -> Column:
    """The longest requested window that has a model, else the primary one. Both columns are arrays of seconds."""
    both = F.array_intersect(F.coalesce(F.col(requested), F.array().cast("array<int>")), F.col(available))
    return F.coalesce(F.array_max(both), primary if isinstance(primary, Column) else F.lit(primary))


def first_flag(checks: DataFrame, by: Sequence[str], t: str = "t_check", range_col: str = "range_nm") -> DataFrame:
    """From scored checkpoints (growing prefixes of a track): the first flag's time and range, NULL if there is none."""
    flag = F.col("action") == "flag"
    return checks.groupBy(*by).agg(
        F.count_if(flag).cast("boolean").alias("flagged"), F.min(F.when(flag, F.col(t))).alias("t_flag"), F.min_by(range_col, F.when(flag, F.col(t))).alias("range_flag_nm"), F.count("*").alias("n_checkpoints")
    )
