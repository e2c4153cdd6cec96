"""Bounded samples of rows for fitting, chosen by a hash of the id.

The bound is one on rows. The texts of a sample, whole and of any length, stay in a table in the shared folder; what
reaches the driver are numbers made of them in tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_UNIT = 1 << 30


def draw(rows: DataFrame, per_group: dict, seed: int) -> DataFrame:
    """rows: id, g. Of each group (null ids and groups left out) the per_group[g] ids with the smallest hash, as a written
    table (id, g, total, place): total is the group's number of rows, place counts from 1.

    A first cut by the hash leaves about twice as many ids as wanted, so no group is ordered or made distinct as a
    whole; where most rows of a group repeat their ids, fewer than wanted may be left.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("g").isNotNull())
    kind = rows.schema["g"].dataType.simpleString()
    total = {r.g: r["count"] for r in rows.groupBy("g").count().collect() if r.g in per_group}
    bounds = [(k, n, min(1.0, (2 * per_group[k] + 40) / n), per_group[k]) for k, n in sorted(total.items())]
    bounds = F.broadcast(rows.sparkSession.createDataFrame(bounds, f"g {kind}, total long, share double, wanted int").coalesce(1))
    key = F.xxhash64(F.lit(seed), "id")
    near = rows.join(bounds, "g").where((F.pmod(key, F.lit(_UNIT)) + 0.5) / _UNIT < F.col("share")).select("id", "g", "total", "wanted").distinct()
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.pmod(key, F.lit(_UNIT)), "id"))
    return common.materialize(near.withColumn("place", place).where("place <= wanted").drop("wanted"), "drawn")


def with_texts(docs: DataFrame, drawn: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The drawn rows (a bounded number, broadcast) with their whole texts, as a written table; null texts are empty, of
    rows that share an id the first by text counts."""
    small = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    held = small.join(F.broadcast(drawn), "id").groupBy("id", "g", "total", "place").agg(F.min("text").alias("text"))
    return common.materialize(held, "sample")


def balanced(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> DataFrame:
    """A written table (id, g, total, place, text) with at most per_class[g] labelled rows of each class g; an id with
    several labels has the largest."""
    given = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("g"))
    return with_texts(docs, draw(common.materialize(given, "labels"), per_class, seed), id_col, text_col)
