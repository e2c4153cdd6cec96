"""Roll-ups behind reports: coverage of envelopes and windows, eligibility, rosters, labels of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import in_all


def envelope_coverage(tracks: DataFrame, envelopes: dict[str, dict[str, Sequence]], vessel: str = "mmsi", by: str | None = None) -> DataFrame:
    """Tracks and vessels of each envelope (by class too). A track may be in several envelopes: one pass, rows repeated
    for the envelopes they are in."""
    tags = F.array_compact(F.array(*[F.when(in_all(m), F.lit(name)) for name, m in envelopes.items()]))
    keys = ["envelope", by] if by else ["envelope"]
    return tracks.withColumn("envelope", F.explode(tags)).groupBy(*keys).agg(F.count("*").alias("n_tracks"), F.countDistinct(vessel).alias("n_vessels"))


def window_coverage(rows: DataFrame, by: Sequence[str], track: Sequence[str]) -> DataFrame:
    """Per group and window: contacts, complete ones and their share; and of how many contacts it is the longest complete
    one. track: the columns that name a contact."""
    longest = F.max(F.when(F.col("window_complete"), F.col("window_s"))).over(Window.partitionBy(*track))
    rows = rows.withColumn("_longest", F.coalesce(F.col("window_complete") & (F.col("window_s") == longest), F.lit(False)))
    out = rows.groupBy(*by, "window_s").agg(F.count("*").alias("n"), F.count_if("window_complete").alias("n_complete"), F.count_if("_longest").alias("n_longest"))
    return out.withColumn("share", F.col("n_complete") / F.col("n"))


def eligibility(boxes: DataFrame, by: Sequence[str], least: float = 8.0) -> DataFrame:
    """Boxes, eligible boxes and images with an eligible box, per split (or other group)."""
    ok = F.least("w", "h") >= least
    return boxes.groupBy(*by).agg(F.count("*").alias("n_boxes"), F.count_if(ok).alias("n_eligible"), F.countDistinct(F.when(ok, F.col("image_id"))).alias("n_images"), F.avg(ok.cast("double")).alias("share"))


def filter_annotations(boxes: DataFrame, images: DataFrame | None = None, categories: Sequence | None = None, floor: float = 0.0, side: tuple[float, float] | None = None, area: tuple[float, float] | None = None) -> DataFrame:
    """Boxes of the given images and categories with a short side of at least floor, in half-open side and area ranges."""
    out = boxes.where(F.least("w", "h") >= floor)
    if categories is not None:
        out = out.where(F.col("category").isin(list(categories)))
    if side:
        out = out.where((F.least("w", "h") >= side[0]) & (F.least("w", "h") < side[1]))
    if area:
        out = out.where((F.col("w") * F.col("h") >= area[0]) & (F.col("w") * F.col("h") < area[1]))
    return out.join(images.select("image_id").distinct(), "image_id", "left_semi") if images is not None else out


def sequence_key(path: str, source: str, by_stem: Sequence[str], by_folder: Sequence[str]) -> Column:
    """Key of the sequence that an image belongs to: the stem before the last '_', the folder, or the path itself."""
    stem = F.regexp_replace(F.substring_index(F.col(path), "/", -1), r"\.[^.]*$", "")
    head = F.regexp_replace(stem, r"_[^_]*$", "")
    folder = F.regexp_replace(F.col(path), r"/[^/]*$", "")
    key = F.when(F.col(source).isin(list(by_stem) or [""]), head).when(F.col(source).isin(list(by_folder) or [""]), folder).otherwise(F.col(path))
    return F.concat_ws(":", F.col(source), key)


def roster(registry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Envelopes with the digest of their models: what a freeze manifest lists."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "family", F.sha2("model", 256)))), ","), 256)
    return registry.groupBy(*by).agg(F.count("*").alias("n_models"), F.max("n_train").alias("n_train"), digest.alias("digest"))


def operating_far(rates: DataFrame, arm: str, default: float) -> DataFrame:
    """rates with far, or the default where it was not measured."""
    return rates.withColumn("operating_far", F.coalesce(F.col("far"), F.lit(default))).withColumn("arm", F.lit(arm))


def cell_kind(control: str, swap: str) -> Column:
    """nc for negative controls, swp for swaps, else unc."""
    return F.when(F.coalesce(F.col(control), F.lit(False)), "nc").when(F.coalesce(F.col(swap), F.lit(False)), "swp").otherwise("unc")


def pooled_gap(specific: DataFrame, pooled: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rates under class envelopes against the pooled one."""
    p = pooled.select(*on, F.col("rate").alias("pooled_rate"), F.col("n").alias("pooled_n"))
    return specific.join(p, list(on), "left").withColumn("pooled_gap", F.col("rate") - F.col("pooled_rate"))
