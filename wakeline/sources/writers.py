"""Sinks: partitioned Parquet, CSV, JSON summaries, Markdown, COCO and YOLO exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def parquet(df: DataFrame, path: str, by: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    """Parquet, one folder per value of ``by``. Rows are rebalanced over them, so that a large value gets several files."""
    if by:
        df = df.hint("rebalance", *[F.col(c) for c in by])
    if sort:
        df = df.sortWithinPartitions(*by, *sort)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str, drop: Sequence[str] = ()) -> None:
    df.drop(*drop).write.mode("overwrite").option("header", True).csv(path)


def json_summary(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON document; more rows are an error, not a cut."""
    if df.limit(2).count() > 1:
        raise ValueError("more than one row: not a summary")
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, max_rows: int = 200) -> str:
    """A small result as a Markdown table; more than max_rows rows is an error, not a cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: not a report table")
    show = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def yolo_lines(x: str, y: str, w: str, h: str, width: str, height: str, class_id: str) -> Column:
    """'class cx cy w h' with 6 places."""
    b = geo.yolo_box(x, y, w, h, width, height)
    return F.format_string("%d %.6f %.6f %.6f %.6f", F.col(class_id), b["cx"], b["cy"], b["w"], b["h"])


def yolo(boxes: DataFrame) -> DataFrame:
    """(image_id, label text): what a YOLO label file of the image holds, lines in order of the annotation."""
    line = yolo_lines("x", "y", "w", "h", "width", "height", "class_id")
    held = F.array_sort(F.collect_list(F.struct(F.col("ann_id").alias("i"), line.alias("s"))))
    return boxes.groupBy("image_id").agg(F.array_join(F.transform(held, lambda r: r["s"]), "\n").alias("label"))


def coco_export(images: DataFrame, boxes: DataFrame, min_side: float, split: str) -> tuple[DataFrame, DataFrame]:
    """images and annotations of one split, boxes with a short side of at least min_side; ready for write.json."""
    kept = images.where(F.col("split") == split)
    a = boxes.where(F.least("w", "h") >= min_side).join(kept.select(F.col("id").alias("_id")), F.col("image_id") == F.col("_id"), "left_semi")
    return kept, a.select("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))
