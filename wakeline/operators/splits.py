"""Leakage groups, splits that keep groups whole, near-duplicate hashes, and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session

NAMES = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)


def components(edges: DataFrame, a: str = "a", b: str = "b", save=None) -> DataFrame:
    """(id, group_id): the least id of each connected component of the edges, by alternating stars.

    Each round goes to the checkpoint folder of the session (or through ``save``), which also cuts the lineage; it
    takes a logarithmic number of rounds. Components never reach the driver.
    """
    save = save or session.checkpoint
    at = save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    last = None
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        at = save(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    top = at.groupBy("u").agg(F.min("v").alias("group_id"))
    return top.select(F.col("u").alias("id"), "group_id").unionByName(top.select(F.col("group_id").alias("id"), "group_id")).distinct()


def leakage_groups(items: DataFrame, keys: Sequence[str], id_col: str = "id", links: DataFrame | None = None, save=None) -> DataFrame:
    """items with group_id: rows that share a value of any key, or that a link (a, b) joins, directly or by others."""
    edges = None
    for k in keys:
        first = items.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(id_col).alias("b"))
        e = items.where(F.col(k).isNotNull()).join(first, k).select(F.col(id_col).alias("a"), "b")
        edges = e if edges is None else edges.unionByName(e)
    if links is not None:
        edges = links if edges is None else edges.unionByName(links)
    groups = components(edges, save=save).withColumnRenamed("id", "_id")
    return items.join(groups, F.col(id_col) == F.col("_id"), "left").drop("_id").withColumn("group_id", F.coalesce("group_id", id_col))


def greedy_split(sizes: dict, ratios: Sequence[float] = RATIOS, classes: dict | None = None, names: Sequence[str] = NAMES) -> dict:
    """Group to split, in two passes over group sizes on the driver.

    Each class that spans at least as many groups as there are splits is put into every split first, the rarest class
    first and with its smallest groups; then the largest groups go where most is missing. Ties go by group, so that
    the result can be repeated.
    """
    total = sum(sizes.values())
    missing = {n: total * r for n, r in zip(names, ratios, strict=True)}
    out: dict = {}

    def put(g, n):
        out[g] = n
        missing[n] -= sizes[g]

    spans: dict = {}
    for g, cs in (classes or {}).items():
        for c in cs:
            spans.setdefault(c, []).append(g)
    for _, groups in sorted(spans.items(), key=lambda x: (len(x[1]), str(x[0]))):
        if len(groups) >= len(names):
            free = sorted((g for g in groups if g not in out), key=lambda g: (sizes[g], str(g)))
            for n in names:
                if free and not any(out.get(g) == n for g in groups):
                    put(free.pop(0), n)
    for g in sorted((g for g in sizes if g not in out), key=lambda g: (-sizes[g], str(g))):
        put(g, max(names, key=lambda n: missing[n]))
    return out


def _runs(counts: Sequence, missing: dict) -> list[tuple]:
    """The greedy pass over (size, number of groups), largest first, as runs (size, first rank, end, names): within a run
    the groups of a size take the names in turn. A size has a few runs, however many groups it has."""
    names, out = list(missing), []
    for size, m in counts:
        at = 0
        while at < m:
            ahead = [max(names, key=lambda n: missing[n])]
            if m - at >= 2 * len(names):
                # what is within one size of the top takes turns; the rest waits until the top comes down to it
                top = missing[ahead[0]]
                ahead = sorted((n for n in names if missing[n] > top - size), key=lambda n: (-missing[n], names.index(n)))
                waits = [missing[n] for n in names if n not in ahead]
                low = missing[ahead[-1]]
                rounds = (m - at) // len(ahead) if not waits else min((m - at) // len(ahead), max(int((low - max(waits)) // size) - 1, 0))
                if rounds < 1:
                    ahead, rounds = ahead[:1], 1
            else:
                rounds = 1
            out.append((size, at, at + rounds * len(ahead), ahead))
            for n in ahead:
                missing[n] -= rounds * size
            at += rounds * len(ahead)
    return out


def _covering(held: DataFrame, group: str) -> dict:
    """Groups that the coverage pass places, from (group, n, classes). A class needs at most as many candidates as all
    classes together can place, and three: its smallest ones."""
    one = held.select(group, "n", F.explode("classes").alias("c"))
    spans = {r.c: r["count"] for r in one.groupBy("c").count().collect()}
    most = len(NAMES) * (len(spans) + 1)
    order = Window.partitionBy("c").orderBy("n", F.col(group).cast("string"))
    near = one.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select(group).distinct()
    found = held.join(near, group, "left_semi").collect()
    sizes, by_class, out = {r[group]: r["n"] for r in found}, {}, {}
    for r in found:
        for c in r["classes"]:
            by_class.setdefault(c, []).append(r[group])
    for c in sorted(spans, key=lambda c: (spans[c], str(c))):
        if spans[c] >= len(NAMES):
            free = sorted((g for g in by_class[c] if g not in out), key=lambda g: (sizes[g], str(g)))
            for n in NAMES:
                if free and not any(out.get(g) == n for g in by_class[c]):
                    out[free.pop(0)] = n
    return {g: (n, sizes[g]) for g, n in out.items()}


def assign_splits(items: DataFrame, group: str, ratios: Sequence[float] = RATIOS, max_groups: int = 200_000, train_only: Column | None = None, classes: str | None = None, save=None) -> DataFrame:
    """items with split: whole groups; groups with a train_only row go to train, others by ``greedy_split``, with its
    coverage of the values of the column ``classes``.

    Up to max_groups groups are placed on the driver. Beyond, the same rule runs over the sizes and how many groups have
    each (at most the root of twice the rows), and groups find their place by their rank within their size.
    """
    flag = F.max(train_only).alias("_t") if train_only is not None else F.max(F.lit(False)).alias("_t")
    seen = F.collect_set(classes).alias("classes") if classes else F.max(F.lit(None).cast("array<string>")).alias("classes")
    sizes = items.groupBy(group).agg(F.count("*").alias("n"), flag, seen)
    kind, spark = items.schema[group].dataType.simpleString(), items.sparkSession
    if sizes.count() <= max_groups:
        rows = sizes.collect()
        held = {r[group]: "train" for r in rows if r["_t"]}
        free = greedy_split({r[group]: r["n"] for r in rows if not r["_t"]}, ratios, {r[group]: sorted(r["classes"], key=str) for r in rows if not r["_t"]} if classes else None)
        table = spark.createDataFrame(list({**held, **free}.items()) or [], f"`{group}` {kind}, split string")
        return items.join(F.broadcast(table), group)
    save = save or session.checkpoint
    # neighbours in (size, group) lie in one partition or in the next, so ranks within a size need only counts by partition
    sizes = sizes.where(F.col(group).isNotNull()).withColumn("_g", F.col(group).cast("string"))
    sizes = save(sizes.repartitionByRange(F.desc("n"), "_g").withColumn("_p", F.spark_partition_id()))
    rest = sizes.where("_t is null or not _t")
    total = rest.agg(F.sum("n")).first()[0] or 0
    missing = {n: total * r for n, r in zip(NAMES, ratios, strict=True)}
    placed = _covering(rest, group) if classes else {}
    for n, size in placed.values():
        missing[n] -= size
    done = spark.createDataFrame([(g, n) for g, (n, _) in placed.items()], f"`{group}` {kind}, split string")
    rest = rest.join(F.broadcast(done), group, "left_anti").select(group, "n", "_g", "_p")
    parts = sorted(((-r.n, r._p, r["count"]) for r in rest.groupBy("n", "_p").count().collect()))
    first, counts = [], {}
    for n, p, k in parts:
        first.append((-n, p, counts.get(-n, 0)))
        counts[-n] = counts.get(-n, 0) + k
    first = spark.createDataFrame(first, "n long, _p int, _first long")
    runs = spark.createDataFrame(_runs(list(counts.items()), missing), "n long, _from long, _to long, _names array<string>")
    rank = F.row_number().over(Window.partitionBy("n", "_p").orderBy("_g")) - 1 + F.col("_first")
    rest = rest.join(F.broadcast(first), ["n", "_p"]).withColumn("_r", rank)
    rest = rest.join(F.broadcast(runs), "n").where("_r >= _from AND _r < _to").select(group, F.get("_names", ((F.col("_r") - F.col("_from")) % F.size("_names")).cast("int")).alias("split"))
    table = rest.unionByName(done).unionByName(sizes.where("_t").select(group, F.lit("train").alias("split")))
    return items.join(table, group)


def assign_by_source(items: DataFrame, group: str, source: str, classes: str | None = None, ratios: Sequence[float] = RATIOS, most: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """items with split, each source split by itself (a group belongs to the source of most of its rows, the first by name on
    a tie), and the report (source, class, n_groups) of classes that span fewer groups of a source than there are splits
    and so cannot stand in all of them. Sources are configuration: more than ``most`` are an error."""
    count = items.groupBy(group, source).agg(F.count("*").alias("n"))
    home = count.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(source).alias("s"))).alias("_s")).select(group, F.col("_s.s").alias("_home"))
    rows = items.join(home, group)
    names = [r[0] for r in home.select("_home").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} sources")
    out = None
    for name in sorted(names, key=str):
        part = assign_splits(rows.where(F.col("_home").eqNullSafe(F.lit(name))), group, ratios, classes=classes)
        out = part if out is None else out.unionByName(part)
    report = None
    if classes:
        report = rows.groupBy(F.col("_home").alias("source"), F.col(classes).alias("class")).agg(F.countDistinct(group).alias("n_groups")).where(F.col("n_groups") < len(NAMES))
    return (out if out is not None else rows.withColumn("split", F.lit(None).cast("string"))).drop("_home"), report


def leaks(items: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that stand in more than one split: empty for a sound split."""
    return items.groupBy(group).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def grouping_stats(items: DataFrame, group: str) -> DataFrame:
    one = items.groupBy(group).count()
    return one.agg(F.count("*").alias("n_groups"), F.sum("count").alias("n_items"), F.count_if(F.col("count") == 1).alias("n_singletons"), F.max("count").alias("largest"), F.sum(F.col("count") - 1).alias("n_collapsed"))


def exact_duplicates(items: DataFrame, digest: str, id_col: str) -> DataFrame:
    """Members of digests that occur more than once, with the least id of the digest and its size."""
    groups = items.groupBy(digest).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return items.join(groups, digest)


def hash_keys(hash_col: str, radius: int, blocks: int = 8) -> Column:
    """array<struct<combo, value>> of a 64-bit hash: the bits of each choice of blocks - radius blocks. Two hashes within
    the radius differ in at most radius blocks, so they agree on a whole choice."""
    width = 64 // blocks
    part = lambda i: F.shiftrightunsigned(F.col(hash_col), i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    keys = []
    for n, combo in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(0).cast("long")
        for i in combo:
            value = F.shiftleft(value, width).bitwiseOR(part(i))
        keys.append(F.struct(F.lit(n).alias("combo"), value.alias("value")))
    return F.array(*keys)


def near_duplicate_hashes(items: DataFrame, hash_col: str, id_col: str, radius: int = 5, blocks: int = 8) -> DataFrame:
    """(a, b, distance): every pair of different 64-bit hashes within the radius, and copies linked to their first id.

    Equal hashes are one class, represented by its least id. Classes meet in the buckets of ``hash_keys`` (for radius 5:
    56 keys of 24 bits); a pair is told in the first choice on which it agrees, so none comes twice. A bucket that many
    classes share is joined by choice and value, which AQE splits if it is large.
    """
    items = items.select(F.col(hash_col).alias("h"), F.col(id_col).alias("item")).where("h is not null")
    classes = items.groupBy("h").agg(F.min("item").alias("id"))
    same = items.join(classes, "h").where("item <> id").select(F.col("id").alias("a"), F.col("item").alias("b"), F.lit(0).alias("distance"))
    keyed = classes.select("id", "h", F.explode(hash_keys("h", radius, blocks)).alias("k")).select("id", "h", "k.combo", "k.value")
    x, y = keyed.alias("x"), keyed.alias("y")
    d = F.bit_count(F.col("x.h").bitwiseXOR(F.col("y.h")))
    # which blocks agree, as a number; the first choice of agreeing blocks for each such number
    width = 64 // blocks
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    agree = F.lit(0)
    for i in range(blocks):
        agree = agree + F.when(F.shiftrightunsigned(differ, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) == 0, 1 << i).otherwise(0)
    at = {combo: n for n, combo in enumerate(combinations(range(blocks), blocks - radius))}
    first = [at.get(tuple(i for i in range(blocks) if m >> i & 1)[: blocks - radius], -1) for m in range(1 << blocks)]
    once = F.element_at(F.lit(first), agree + 1) == F.col("x.combo")
    near = x.join(y, (F.col("x.combo") == F.col("y.combo")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.id") < F.col("y.id")) & (d <= radius) & once)
    return same.unionByName(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), d.alias("distance")))


def numbered(items: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "global_id", rows_per_range: int = 1_000_000, save=None) -> DataFrame:
    """Row numbers in an explicit order within groups. Without groups the table is sorted into ranges, rows are numbered
    within each and shifted by the rows of the ranges before; rows that are equal in the order have any of their numbers."""
    if by:
        return items.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    save = save or session.checkpoint
    ranges = max(1, -(-items.count() // rows_per_range))
    items = save(items.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()))
    base, seen = [], 0
    for r in sorted(items.groupBy("_p").count().collect(), key=lambda r: r["_p"]):
        base.append((r["_p"], seen))
        seen += r["count"]
    base = items.sparkSession.createDataFrame(base, "_p int, _base long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return items.join(F.broadcast(base), "_p").withColumn(name, rank + F.col("_base")).drop("_p", "_base")
