"""Document fingerprints by I-Match over randomised lexicon subsets, with DataFrame functions only.

The lexicon is the terms whose inverse document frequency lies in a band, given by shares of the documents (document
frequency between LOW and HIGH of all, and in FLOOR documents at least). A share as lower border bounds the lexicon by the
average number of terms over that share, whatever the corpus; it is not cut further.
A text's distinct terms inside the lexicon are sorted and hashed as a whole, and again for each of 64 random subsets
of the lexicon: 16 disjoint subsets at each of four sampling rates, so that short and long texts alike have subsets in
which an edit changes nothing. The likeness of two fingerprints is the share of subsets on which they agree among those
that hold terms of either.

The lexicon travels inside the plan as hashed slots; texts move once, when each document is put beside its next one.

Defined results: null is the empty text; a text without lexicon terms is fingerprinted by all its terms and is like
another (1) only if these are equal, else 0; a null id comes last in the order; rows with one id are ordered by the
hash of their text; a single document is its own next; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LOW, HIGH = 0.001, 0.15
FLOOR = 2
#: Slots of the lexicon, at least; more where it has over 8 terms a slot.
SLOTS = 8_192
RATES = (16, 64, 256, 1024)
PER_RATE = 16
#: Documents of a bucket in which neighbours are looked up, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 1_024, 16_384


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased terms: runs without blanks and ASCII punctuation."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+", -1), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Term hashes of the band, by descending document frequency; counted over all documents. A term of the band is held
    by FLOOR documents or more, however few there are: what a single document holds tells nothing about another."""
    n = docs.count()
    seen = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").count()
    band = seen.where((F.col("count") >= max(FLOOR, math.ceil(low * n))) & (F.col("count") <= max(FLOOR, math.floor(high * n))))
    return [r.term for r in band.orderBy(F.desc("count"), "term").collect()]


def _slots(words: list[int], n: int) -> Column:
    slots: list[list[int]] = [[] for _ in range(n)]
    for w in words:
        slots[w % n].append(w)
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<array<bigint>>")


def banded(found: Column, words: list[int]) -> Column:
    """The sorted terms that are in the lexicon."""
    n = max(SLOTS, -(-len(words) // 8))
    slots = _slots(words, n)
    return F.sort_array(F.filter(found, lambda t: F.array_contains(F.get(slots, F.pmod(t, F.lit(n)).cast("int")), t)))


def _cells(inside: Column) -> Column:
    """(subset, term) of the lexicon terms, for each subset that holds them, sorted; each subset begins with a null term.

    A rate has PER_RATE disjoint subsets, each with one term in ``rate``; they are numbered through over the rates."""
    def of_rate(i: int, rate: int) -> Column:
        def cell(t):
            return F.pmod(F.xxhash64(F.lit(rate), t), F.lit(rate)).cast("int")

        held = F.filter(inside, lambda t: cell(t) < PER_RATE) if rate > PER_RATE else inside
        return F.transform(held, lambda t: F.struct((cell(t) + i * PER_RATE).alias("c"), t.alias("t")))

    begins = F.array(*[F.struct(F.lit(j).alias("c"), F.lit(None).cast("long").alias("t")) for j in range(len(RATES) * PER_RATE)])
    parts = [begins, *[of_rate(i, rate) for i, rate in enumerate(RATES)]]
    return F.sort_array(F.concat(*parts))


def _chains(cells: Column) -> Column:
    """The hash of each subset's terms in their order, in one pass; null where it holds none."""

    def step(acc, x):
        begins = F.struct(F.lit(None).cast("long").alias("h"), F.array_append(acc["out"], acc["h"]).alias("out"))
        goes_on = F.struct(F.xxhash64(F.coalesce(acc["h"], F.lit(42).cast("long")), x["t"]).alias("h"), acc["out"].alias("out"))
        return F.when(x["t"].isNull(), begins).otherwise(goes_on)

    seed = F.struct(F.lit(None).cast("long").alias("h"), F.array().cast("array<long>").alias("out"))
    # the first subset's beginning ends none
    return F.aggregate(cells, seed, step, lambda a: F.slice(F.array_append(a["out"], a["h"]), 2, len(RATES) * PER_RATE))


def with_codes(rows: DataFrame, inside: str, found: str, out: str) -> DataFrame:
    """rows with array<string>: the hash of all terms inside the lexicon, then one per subset; null where a subset holds
    none."""
    whole = F.when(F.size(inside) > 0, F.hex(F.xxhash64(inside))).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64(F.sort_array(found)))))
    parts = F.transform(_chains(_cells(F.col(inside))), lambda h: F.substring(F.lpad(F.hex(h), 16, "0"), 9, 8))
    rest = [c for c in rows.columns if c not in (inside, found)]
    return rows.select(*rest, F.concat(F.array(F.lpad(whole, 17, "0")), parts).alias(out))


def fingerprint(c: str) -> Column:
    return F.lower(F.array_join(F.col(c), "", "........"))


def likeness(a: str, b: str) -> Column:
    pairs = F.slice(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), 2, len(RATES) * PER_RATE)
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    either = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    return F.when(F.col(a) == F.col(b), 1.0).when(F.element_at(a, 1) == F.element_at(b, 1), 1.0).when(either > 0, same / either).otherwise(0.0)


def _bucket(id_col: str, bounds: list[int]) -> Column:
    """How many bounds are not above the id, looked up in two steps; 0 for a null id."""
    step = max(1, math.isqrt(len(bounds)))
    id_, every = F.col(id_col), F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    coarse = F.from_json(F.lit(json.dumps(bounds[step - 1 :: step])), "array<bigint>")
    blocks = F.size(F.filter(coarse, lambda b: b <= id_))
    rest = F.size(F.filter(F.slice(every, blocks * step + 1, step), lambda b: b <= id_))
    return F.coalesce(F.when(id_.isNull(), F.lit(0)).otherwise(blocks * step + rest), F.lit(0))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, object]:
    """(bucket, ghost, id, text, next): each document with the next one's text, by descending id; and that order.

    Ids are cut into buckets at their quantiles; the first rows of a bucket are also put, as ghosts, behind the last
    rows of the bucket before it, so that neighbours are found within buckets alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = rows.count()
    k = min(MAX_BUCKETS, -(-n // BUCKET_ROWS))
    cuts = rows.approxQuantile("id", [i / k for i in range(1, k)], 1 / (4 * k)) if k > 1 else []
    bounds = sorted({int(c) for c in cuts})
    bucket = _bucket("id", bounds)
    heads = sorted(((r.b, r.head) for r in rows.groupBy(bucket.alias("b")).agg(F.max("id").alias("head")).collect()), reverse=True)
    before = [(b, h, heads[i - 1][0]) for i, (b, h) in enumerate(heads)]  # the first is a ghost in the last
    before = spark.createDataFrame(before, "hb int, head long, target int")
    placed = rows.withColumn("b0", bucket).join(F.broadcast(before), F.col("b0") == F.col("hb"), "left")
    real = F.struct(F.col("b0").alias("bucket"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("target").alias("bucket"), F.lit(True).alias("ghost"))
    at = F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.array(real, ghost)).otherwise(F.array(real)))
    placed = placed.select("id", "text", at.alias("at")).select("at.bucket", "at.ghost", "id", "text", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("id"), "h")
    return placed.withColumn("next", F.lead("text").over(order)), order


def edited(text: str = "text", nxt: str = "next") -> Column:
    """The text with its last half replaced by as much of the next document's beginning."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.char_length(text) - half), F.substring(F.coalesce(F.col(nxt), F.lit("")), F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next text's."""
    words = lexicon(docs, text_col, **band)
    rows, order = beside_next(docs, id_col, text_col)
    keys = ["bucket", "ghost", "id", "h"]
    rows = rows.select(*keys, F.char_length("text").cast("long").alias("n_chars"), "text", edited().alias("edited"))
    rows = rows.select(*keys, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("t"), terms(F.col("edited")).alias("e"))
    rows = rows.select("*", banded(F.col("t"), words).alias("ti"), banded(F.col("e"), words).alias("ei"))
    rows = with_codes(with_codes(rows, "ti", "t", "c"), "ei", "e", "d")
    rows = rows.withColumn("nc", F.lead("c").over(order)).where("not ghost")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint("c").alias("fingerprint"), fingerprint("d").alias("edited_fingerprint"),
        likeness("c", "d").alias("near_edited"), likeness("c", "nc").alias("near_next"),
    )


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_imatch": op3_imatch}
ORACLE: dict[str, str] = {}
