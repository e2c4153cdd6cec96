"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Token shares are raised to an exponent between 0 (equal weights) and 1 (as they are) and normalised. The exponent is
bisected: the largest whose weights reach a target entropy (the sources' own and a share of what it lacks to the largest
possible one, or a share of the latter), raised further if a source would repeat more than a limit. A token budget times
a weight is a source's quota: whole epochs of the source and a part of one more.

Rows are dealt into blocks by a digest of their id; every epoch permutes the blocks of a source and the rows of each
block by digests of (seed, epoch, block) and (seed, epoch, id). The part epoch takes blocks in that order while they fit,
and of the next block the rows that fit. Order by digest makes the choice two cut values per source, so applying the
plan is one join with a row per source: no shuffle of texts, whatever a source's size. The cut block is found in two
steps, first among the sums of 4,096 ranges of keys and then among the blocks of one range, so no task orders all blocks
of a source.

Defined results: a null source is a source of its own; null and empty texts have no tokens and come with every whole
epoch; rows with one id are taken or left together, rows without an id go by their text; an empty table gives an empty
mix; further columns pass through, whatever their names: a new column whose name is taken gets underscores at its end.
A quota is met within one row (plus rows that go with it).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS = 512
SEED = 20240607
#: Sources are configuration: their totals are weighed on the driver. More than this is an error, not a cap.
MAX_SOURCES = 100_000
#: The target entropy lies halfway between the sources' own and the largest.
GAP = 0.5
MAX_REPEATS = 4.0
ROUNDS = 60
_NULL = "\u0000"
_RANGE_DIGITS = 3
NEW = ("mix_epoch", "mix_block_key", "mix_row_key")


def weights(tokens: dict[str, int], budget: float | None = None, entropy: float | None = None, gap: float | None = GAP, max_repeats: float | None = MAX_REPEATS) -> tuple[float, dict[str, float]]:
    """Exponent and weights. entropy: a target as a share of the largest; gap: a target by the share of the missing
    entropy (the higher target holds); max_repeats: epochs of any source."""
    total = sum(tokens.values())
    live = {k: v / total for k, v in tokens.items() if v > 0}
    budget = total if budget is None else budget

    def at(x: float) -> dict[str, float]:
        raised = {k: s**x for k, s in live.items()}
        whole = math.fsum(raised.values())
        return {k: r / whole for k, r in raised.items()}

    def spread(w: dict[str, float]) -> float:
        return -math.fsum(p * math.log(p) for p in w.values() if p)

    def within(w: dict[str, float]) -> bool:
        return max(w[k] * budget / tokens[k] for k in w) <= max_repeats * (1 + 1e-12)

    def bisect(ok_low: bool, test) -> float:
        """The border of a test that holds on one side: the largest x that passes, or the smallest."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            mid = (low + high) / 2
            if test(at(mid)) == ok_low:
                low = mid
            else:
                high = mid
        return low if ok_low else high

    x = 1.0
    if len(live) > 1:
        own, most = spread(live), math.log(len(live))
        target = max((entropy or 0.0) * most, own + (gap or 0.0) * (most - own)) - 1e-12
        if own < target:
            x = bisect(True, lambda w: spread(w) >= target)
        if max_repeats is not None and not within(at(x)):
            x = max(x, bisect(False, within))
    return x, at(x) | {k: 0.0 for k in tokens if k not in live} if live else {k: 0.0 for k in tokens}


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(epoch, part) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), part.cast("string")))


def _block(ident: str, blocks: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:block:"), F.col(ident))), 1, 8), 16, 10).cast("long") % F.col(blocks)


def _ident(id_: str, text: str) -> Column:
    return F.coalesce(F.col(id_).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def plan(rows: DataFrame, budget: float | None = None, **target) -> DataFrame:
    """Per source: blocks, whole epochs, the rest and the cuts of the part epoch. rows: ident, src, tokens."""
    spark = rows.sparkSession
    found = rows.groupBy("src").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r.src: r.t for r in sorted(found, key=lambda r: r.src)}
    budget = float(sum(tokens.values())) if budget is None else float(budget)
    _, w = weights(tokens, budget, **target) if found else (1.0, {})
    todo = []
    for r in found:
        quota = round(w[r.src] * budget)
        epochs, rest = divmod(quota, r.t) if r.t else (1, 0)
        todo.append((r.src, -(-r.n // BLOCK_ROWS), epochs, rest, w[r.src], quota))
    todo = spark.createDataFrame(todo, "src string, blocks long, epochs long, rest long, weight double, quota long").coalesce(1)
    rows = rows.join(F.broadcast(todo), "src").where("rest > 0").select("src", "ident", "tokens", "epochs", "rest", _block("ident", "blocks").alias("block"))
    sums = rows.groupBy("src", "block", "epochs", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("key", _key(F.col("epochs"), F.concat(F.lit("b"), "block")))
    sums = common.materialize(sums.withColumn("range", F.substring("key", 1, _RANGE_DIGITS)), "block-sums")

    def first_over(df: DataFrame, by: str, rest: str) -> DataFrame:
        """Per source the first row by ``by`` at which the running sum passes the rest, with what is left before it as room."""
        df = df.withColumn("upto", F.sum("tokens").over(Window.partitionBy("src").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
        return df.where(f"upto > {rest} and upto - tokens <= {rest}").withColumn("room", F.expr(f"{rest} - upto + tokens")).where("tokens > 0").drop("upto")

    ranges = first_over(sums.groupBy("src", "range", "rest").agg(F.sum("tokens").alias("tokens")), "range", "rest").select("src", "range", F.col("room").alias("range_room"))
    cut = first_over(sums.join(F.broadcast(ranges), ["src", "range"]), "key", "range_room")
    cut = common.materialize(cut.select("src", "key", F.col("block").alias("cut_block"), "room"), "cut-blocks")
    last = rows.join(F.broadcast(cut), "src").where("block = cut_block")
    each = last.groupBy("src", "room", _key(F.col("epochs"), F.col("ident")).alias("row_key")).agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy("src").orderBy("row_key").rowsBetween(Window.unboundedPreceding, 0)
    row_cut = each.withColumn("upto", F.sum("tokens").over(run)).where("upto <= room").groupBy("src").agg(F.max("row_key").alias("row_cut"))
    out = todo.join(cut.select("src", F.col("key").alias("block_cut")), "src", "left").join(row_cut, "src", "left")
    return common.materialize(out.coalesce(1), "plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None, budget: float | None = None, keys: bool = True, **target) -> DataFrame:
    """docs as often as the mix holds each row; with keys also mix_epoch, mix_block_key and mix_row_key (the mix's order).

    tokens: a column over docs (words if not given); target: see weights().
    """
    names, held = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    all_ = docs.withColumn("__tokens", F.coalesce(tokens, F.lit(0)).cast("long")).toDF(*held, "given") if tokens is not None else docs.toDF(*held)
    id_, text, source = (held[names.index(c)] for c in (id_col, text_col, source_col))
    all_ = all_.withColumn("src", F.coalesce(F.col(source).cast("string"), F.lit(_NULL))).withColumn("ident", _ident(id_, text))
    rows = common.materialize(all_.select("ident", "src", (F.col("given") if tokens is not None else word_count(text)).alias("tokens")), "tokens")
    p = plan(rows, budget, **target).select("src", "blocks", "epochs", "rest", "block_cut", "row_cut")
    all_ = all_.join(F.broadcast(p), "src").withColumn("block", F.concat(F.lit("b"), _block("ident", "blocks")))
    epochs, cut = F.col("epochs"), F.col("block_cut")
    key, row = _key(epochs, F.col("block")), _key(epochs, F.col("ident"))
    part = (F.col("rest") > 0) & ((key < cut) | ((key == cut) & F.coalesce(row <= F.col("row_cut"), F.lit(False))))
    all_ = all_.withColumn("copies", epochs + F.when(part, 1).otherwise(0)).where("copies > 0")
    all_ = all_.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    out = [F.col(h).alias(n) for h, n in zip(held, names, strict=True)]
    if keys:
        taken = {n.lower() for n in names}
        for new, value in zip(NEW, (F.col("epoch"), _key(F.col("epoch"), F.col("block")), _key(F.col("epoch"), F.col("ident"))), strict=True):
            while new in taken:
                new += "_"
            out.append(value.alias(new))
    return all_.select(*out)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "source", word_count("text").alias("n_tokens"), "mix_epoch", "mix_block_key", "mix_row_key")


QUERIES = {"op4_temperature_mixing": op4_temperature_mixing}
ORACLE = {
    "op4_temperature_mixing": f"""WITH RECURSIVE r AS (SELECT doc_id, source, coalesce(source, chr(0)) AS src, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS ident, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
tot AS (SELECT src, CAST(sum(tokens) AS BIGINT) AS t, count(*) AS n FROM r GROUP BY src),
live AS (SELECT list(t / (SELECT sum(t) FROM tot) ORDER BY src) AS s, CAST((SELECT sum(t) FROM tot) AS BIGINT) AS budget FROM tot WHERE t > 0),
goal AS (SELECT s, budget, own, own + {GAP} * (ln(len(s)) - own) - 1e-12 AS target FROM (SELECT s, budget, -list_sum(list_transform(s, lambda p: p * ln(p))) AS own FROM live)),
flat(i, low, high) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT i, low, high, mid, ln(z) - mid * list_sum(list_transform(s, lambda p: pow(p, mid) * ln(p))) / z >= target AS ok FROM (SELECT i, low, high, (low + high) / 2 AS mid, s, target, list_sum(list_transform(s, lambda p: pow(p, (low + high) / 2))) AS z FROM flat, goal WHERE i < {ROUNDS}))),
few(i, low, high) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT i, low, high, mid, list_max(list_transform(s, lambda p: pow(p, mid) / z / p)) <= {MAX_REPEATS} * (1 + 1e-12) AS ok FROM (SELECT i, low, high, (low + high) / 2 AS mid, s, list_sum(list_transform(s, lambda p: pow(p, (low + high) / 2))) AS z FROM few, goal WHERE i < {ROUNDS}))),
exponent AS (SELECT CASE WHEN many THEN greatest(x, (SELECT high FROM few WHERE i = {ROUNDS})) ELSE x END AS x FROM (SELECT x, list_max(list_transform(s, lambda p: pow(p, x) / list_sum(list_transform(s, lambda q: pow(q, x))) / p)) > {MAX_REPEATS} * (1 + 1e-12) AS many
  FROM (SELECT s, CASE WHEN len(s) < 2 OR own >= target THEN 1 ELSE (SELECT low FROM flat WHERE i = {ROUNDS}) END AS x FROM goal))),
quotas AS (SELECT src, t, n, CASE WHEN t = 0 THEN 0 ELSE CAST(round(pow(t / budget, x) / list_sum(list_transform(s, lambda p: pow(p, x))) * budget) AS BIGINT) END AS quota FROM tot, goal, exponent),
todo AS (SELECT src, CAST(ceil(n / {BLOCK_ROWS}) AS BIGINT) AS blocks, CASE WHEN t = 0 THEN 1 ELSE quota // t END AS epochs, CASE WHEN t = 0 THEN 0 ELSE quota % t END AS rest FROM quotas),
dealt AS (SELECT r.*, epochs, rest, 'b' || CAST(CAST('0x' || substr(md5('{SEED}:block:' || ident), 1, 8) AS BIGINT) % blocks AS VARCHAR) AS block FROM r JOIN todo USING (src)),
keyed AS (SELECT *, md5('{SEED}:' || CAST(epochs AS VARCHAR) || ':' || block) AS k, md5('{SEED}:' || CAST(epochs AS VARCHAR) || ':' || ident) AS rk FROM dealt),
upto AS (SELECT src, k, rest, tokens, sum(tokens) OVER (PARTITION BY src ORDER BY k) AS upto FROM (SELECT src, k, rest, sum(tokens) AS tokens FROM keyed WHERE rest > 0 GROUP BY ALL)),
cut AS (SELECT src, min(k) AS block_cut, arg_min(rest - upto + tokens, k) AS room FROM upto WHERE upto > rest GROUP BY src),
within AS (SELECT src, max(rk) AS row_cut FROM (SELECT src, rk, room, sum(tokens) OVER (PARTITION BY src ORDER BY rk) AS upto FROM (SELECT src, rk, room, sum(tokens) AS tokens FROM keyed JOIN cut USING (src) WHERE k = block_cut GROUP BY ALL)) WHERE upto <= room GROUP BY src),
copies AS (SELECT keyed.*, epochs + CASE WHEN rest > 0 AND (k < block_cut OR k = block_cut AND coalesce(rk <= row_cut, false)) THEN 1 ELSE 0 END AS copies FROM keyed LEFT JOIN cut USING (src) LEFT JOIN within USING (src))
SELECT doc_id, source, tokens AS n_tokens, e AS mix_epoch, md5('{SEED}:' || CAST(e AS VARCHAR) || ':' || block) AS mix_block_key, md5('{SEED}:' || CAST(e AS VARCHAR) || ':' || ident) AS mix_row_key FROM (SELECT *, unnest(range(CAST(copies AS BIGINT))) AS e FROM copies)"""
}
