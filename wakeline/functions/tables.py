"""Small helpers over whole tables: NaN to NULL, required columns, grouped rates and shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means 'not computable': every float column gets NULL instead, so that aggregates skip it."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


#: A table is sent to all tasks up to this many rows.
SMALL_ROWS = 100_000
#: Groups of more rows than this get their quantiles by ranges instead of one aggregate.
GROUP_ROWS = 2_000_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df ready for a broadcast if it has at most ``most`` rows, checked by reading them once; else df, for a shuffle."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} lacks columns {missing}")
    return df


def share(part, whole) -> Column:
    """part / max(whole, 1)."""
    return part / F.greatest(whole, F.lit(1))


def slug(column: str) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), F.lit("-"))


def json_value(column: str, path: str, default: str) -> Column:
    """What stands at a path of nested JSON, as text; the default where there is nothing."""
    return F.coalesce(F.get_json_object(column, path), F.lit(default))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, null_frac) in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"f{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"f{i}").alias("null_frac")) for i, c in enumerate(columns)]))
    return one.select("n", pairs.alias("p")).select("p.column_name", "n", "p.null_frac")


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and the given column values, 0 where there are none; naming the values saves a pass."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def code_class(code: str, exact: dict[int, str], ranges: Sequence[tuple[int, int, str]], rest: str) -> Column:
    """A code's class: an exact entry, else the first range that holds it, else rest. NULL gets rest."""
    c, out = F.col(code), None
    for k, v in exact.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    for low, high, v in ranges:
        test = c.between(low, high)
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(rest) if out is not None else F.lit(rest)


def in_all(values: dict[str, Sequence]) -> Column:
    """Row is a member if each column holds one of its values; NULL is no member."""
    out = F.lit(True)
    for c, v in values.items():
        out = out & F.col(c).isin(list(v))
    return F.coalesce(out, F.lit(False))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], group_rows: int = GROUP_ROWS, save=None) -> DataFrame:
    """by and ``cuts``: the exact linearly interpolated quantiles of the known values of each group, an array in order of
    shares. Groups without a value are absent.

    One aggregate holds a map of a group's distinct values; where a group has more rows than group_rows the values are
    counted, sorted in ranges, and only the ranges in which a wanted rank lies are looked at, whatever a group's size.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    shares = [float(s) for s in shares]
    if most <= group_rows:
        return rows.groupBy(*by).agg(F.percentile("_v", shares).alias("cuts"))
    save = save or session.checkpoint
    values = rows.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    parts = max(2, -(-values.count() // group_rows) * 4)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"_k{i}") for i, c in enumerate(by)]
    values = save(values.select(*by, "_v", "_c", *keys).repartitionByRange(parts, *[f"_k{i}" for i in range(len(by))], "_v").withColumn("_p", F.spark_partition_id()))
    ks = [f"_k{i}" for i in range(len(by))]
    sums = values.groupBy(*ks, "_p").agg(F.sum("_c").alias("_n"))
    order = Window.partitionBy(*ks).orderBy("_p")
    sums = sums.withColumn("_before", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*ks)))
    place = lambda s: F.lit(s) * (F.col("_all") - 1)
    ranks = F.array(*[f(place(s)).cast("long") for s in shares for f in (F.floor, F.ceil)])
    sums = sums.withColumn("_ranks", ranks).where(F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))))
    near = values.join(small(sums), [*ks, "_p"])
    upto = F.sum("_c").over(Window.partitionBy(*ks, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    near = near.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    at = [F.max(F.when((F.get("_ranks", F.lit(i)) >= F.col("_from")) & (F.get("_ranks", F.lit(i)) < F.col("_to")), F.col("_v"))).alias(f"_r{i}") for i in range(2 * len(shares))]
    found = near.groupBy(*ks).agg(*[F.first(c).alias(c) for c in by], F.first("_all").alias("_all"), *at)
    cut = [F.when(F.col(f"_r{2 * i}") == F.col(f"_r{2 * i + 1}"), F.col(f"_r{2 * i}")).otherwise((F.ceil(place(s)) - place(s)) * F.col(f"_r{2 * i}") + (place(s) - F.floor(place(s))) * F.col(f"_r{2 * i + 1}")) for i, s in enumerate(shares)]
    return found.select(*by, F.array(*cut).alias("cuts"))


def percent_text(rate: str) -> Column:
    return F.when(F.col(rate).isNull(), "-").otherwise(F.format_string("%.1f%%", F.col(rate) * 100))


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that fails while it runs if a key occurs twice on either side, or only on one."""
    a = left.groupBy(*on).agg(F.count("*").alias("_l"), F.first(F.struct(*[c for c in left.columns if c not in on])).alias("_a"))
    b = right.groupBy(*on).agg(F.count("*").alias("_r"), F.first(F.struct(*[c for c in right.columns if c not in on])).alias("_b"))
    ok = (F.coalesce(F.col("_l"), F.lit(0)) == 1) & (F.coalesce(F.col("_r"), F.lit(0)) == 1)
    both = a.join(b, list(on), "full_outer").where(F.when(ok, True).otherwise(F.raise_error(F.lit("join is not one to one")).cast("boolean")))
    return both.select(*on, "_a.*", "_b.*")


def attach(rows: DataFrame, other: DataFrame, on: Sequence[str], fill: Sequence[str] = ()) -> DataFrame:
    """Left join; the columns in fill, which both sides have, take the left value and else the right."""
    right = other.select(*on, *[F.col(c).alias(f"_r_{c}") for c in fill], *[c for c in other.columns if c not in on and c not in rows.columns])
    out = rows.join(right, list(on), "left")
    return out.withColumns({c: F.coalesce(c, f"_r_{c}") for c in fill}).drop(*[f"_r_{c}" for c in fill]) if fill else out


def smoke(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows for a trial run: those with the smallest digest of the key, the same ones each time. Each task keeps
    n rows; no table is sorted as a whole."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
