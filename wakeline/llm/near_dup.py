"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct k-word shingles (A-Z lower-cased). Each permutation of the hashed shingles gives
two values, its minimum and its maximum, so half as many hash evaluations as plain MinHash fill a signature. Bands
of two permutations (four values) are the buckets in which candidates meet. With 24 bands a pair at similarity 0.8
misses every bucket with a probability of about 3 in a million.

No pair inside a group is emitted without need:

1. documents with equal sets are one class, represented by its smallest id;
2. each class is tried against the smallest id of each of its buckets (a star, linear in the bucket);
3. confirmed links give components; only buckets that still hold several components go on. There each class outside
   the bucket's largest component is tried against the classes of other components, in slices of a hot bucket;
   classes of one component are never compared. A pair is tried in the first bucket that it shares;
4. a pair leaves the bucket only if its parity sketches allow the link: every shingle that one of the two sets lacks flips
   one of 1,536 bits, so the number of unequal bits never exceeds the true difference and the test loses no link. Sets too
   large for the sketch are compared inside the join, after an estimate by the signatures (five standard deviations);
5. every link is confirmed on the full shingle sets, and components are taken again.

Links, components and sets stay in tables in the shared folder; nothing but counts reaches the driver.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and are kept; a text of fewer
than k words is one shingle; rows with a null id get their class but carry no links; repeated rows are one class;
rows that share an id are one document: a link of any of its texts holds for it, and all its rows are returned with its
component; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from . import common

BANDS = 24
PERMUTATIONS = 2 * BANDS
SLACK = 0.2
#: Parity sketches: longs, and the largest set that goes by them.
PARITY = 24
SMALL = 2_000
#: Classes of a bucket that one slice holds.
SLICE = 512
#: A list of ids is broadcast up to this many rows (8 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_rng = np.random.default_rng(74207281)
_MUL = (_rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_SALT = common.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def minmax(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation."""
    lo = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    hi = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), 1 << 12):
        v = (s[None, i : i + (1 << 12)] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(lo, v.min(axis=1), out=lo)
        np.maximum(hi, v.max(axis=1), out=hi)
    return common.mix(lo), common.mix(hi)


def parity(s: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of shingles fell on them, as longs."""
    size = 64 * PARITY
    return np.packbits((np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(bool)).view(np.int64)


def sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    hashes, at = common.batch_words([t.lower() for t in texts])
    return [common.shingles(hashes[at[i] : at[i + 1]], k) for i in range(len(texts))]


def _long_lists(rows: list[np.ndarray], kind=np.int64) -> pa.Array:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows).view(kind) if rows else np.zeros(0, kind)))


def signatures(texts: list[bytes], k: int) -> list[pa.Array]:
    n, k1, k2, bands, sketch = [], [], [], [], []
    for s in sets_of(texts, k):
        n.append(len(s))
        if not len(s):
            k1.append(0), k2.append(0)
            bands.append(np.zeros(0, np.int64)), sketch.append(np.zeros(0, np.int64))
            continue
        k1.append(int(s.sum().view(np.int64)))
        k2.append(int(common.mix(s).sum().view(np.int64)))
        lo, hi = minmax(s)
        h = common.mix(lo[0::2] ^ _SALT)
        for x in (hi[0::2], lo[1::2], hi[1::2]):
            h = common.mix(h * np.uint64(0x100000001B3) ^ x)
        bands.append(h.view(np.int64))
        sketch.append(np.concatenate((lo, hi)).view(np.int64) if len(s) > SMALL else np.zeros(0, np.int64))
    return [pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _long_lists(bands), _long_lists(sketch)]


def only_ids(docs: DataFrame, ids: DataFrame, n: int, id_col: str, how: str = "left_semi") -> DataFrame:
    """docs with (left_semi) or without (left_anti) the n given ids: a broadcast up to the bound, else a shuffle."""
    right = F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("shuffle_merge")
    return docs.join(right.select(F.col("id").alias("__id")), docs[id_col] == F.col("__id"), how)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of each component of the edges (a, b); the rounds stay in the shared folder."""
    made: list[DataFrame] = []

    def save(df: DataFrame) -> DataFrame:
        made.append(common.materialize(df, "star"))
        return made[-1]

    out = common.materialize(splits.components(edges, save=save).withColumnRenamed("group_id", "comp"), "components")
    for df in made:
        common.discard(df)
    return out


def _similar(a: str, b: str, percent: int):
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among pairs (a, ka, b, kb) of classes: those whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("k1").alias("ka"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("k1").alias("kb"), F.col("s").alias("sb"))
    return pairs.join(left, ["a", "ka"]).join(right, ["b", "kb"]).where(_similar("sa", "sb", percent)).select("a", "b").where("a <> b")


def _first_common(a: str, b: str):
    """Whether a row's bucket is the first that the two documents share."""
    first = None
    for i in reversed(range(BANDS)):
        one = F.col(f"{a}.b{i}")
        same = one == F.col(f"{b}.b{i}")
        first = F.when(same, one) if first is None else F.when(same, one).otherwise(first)
    return F.col(f"{a}.bucket") == first


def _able(a: str, b: str, percent: int):
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _may_link(a: str, b: str, percent: int):
    """No small set's link fails this. Each shingle in one set alone changes one parity bit, and a link allows
    (100 - percent) / (100 + percent) of both sizes of them; large sets are compared, after the signatures' estimate."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    bits = F.lit(0)
    for i in range(PARITY):
        bits = bits + F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}")))
    equal = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    large = (F.size(f"{a}.s") > 0) & (F.size(f"{b}.s") > 0)
    close = (equal >= int(2 * PERMUTATIONS * (percent / 100 - SLACK))) & _similar(f"{a}.s", f"{b}.s", percent)
    return (bits * (100 + percent) <= n * (100 - percent)) & (~large | close)


def _between(members: DataFrame, first: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, ka, b, kb) of classes in different components that share a bucket and may be linked."""
    placed = members.select("bucket", "rep", "k1", "n").join(first, F.col("rep") == F.col("id"), "left").select("bucket", "rep", "k1", "n", F.coalesce("comp", "rep").alias("comp"))
    held = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    held = held.groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.sum("m").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    wide = [F.get("bands", F.lit(i)).alias(f"b{i}") for i in range(BANDS)] + [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY)]
    none = F.lit(None).cast("array<long>")
    marks = sets.select(F.col("id").alias("rep"), "k1", "parity", F.when(F.size("s") > SMALL, F.col("s")).otherwise(none).alias("s"))
    marks = reps.join(marks, ["rep", "k1"]).select("rep", "k1", *wide, "s", F.when(F.col("n") > SMALL, F.col("sketch")).otherwise(none).alias("sketch"))
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    open_ = placed.join(held.select("bucket", "major", slices.alias("slices")), "bucket").join(marks, ["rep", "k1"])
    open_ = common.materialize(open_, "open")
    x = open_.where("comp <> major").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("x")
    y = open_.withColumn("slice", F.pmod(F.xxhash64("rep", "k1"), F.col("slices")).cast("int")).alias("y")
    once = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.major")) | (F.col("x.comp") < F.col("y.comp")))
    fits = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.slice") == F.col("y.slice")) & once & _able("x.n", "y.n", percent) & _first_common("x", "y") & _may_link("x", "y", percent)
    pairs = x.join(y.hint("merge"), fits).select(F.col("x.rep").alias("a"), F.col("x.k1").alias("ka"), F.col("y.rep").alias("b"), F.col("y.k1").alias("kb"))
    pairs = common.materialize(pairs, "pairs")
    common.discard(open_)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sig = common.materialize(common.per_row(docs, ["id"], "text", lambda t: signatures(t, k), "n long, k1 long, k2 long, bands array<long>, sketch array<long>"), "signatures")
    reps = sig.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = common.materialize(reps, "classes")

    buckets = reps.select("rep", "k1", "n", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rep", "k1", "n")).alias("centre")).where("size > 1").drop("size")
    members = common.materialize(buckets.join(full, "bucket"), "members")
    needed = common.materialize(members.select(F.col("rep").alias("id")).distinct(), "needed")

    def sets_and_marks(texts: list[bytes]) -> list[pa.Array]:
        all_ = sets_of(texts, k)
        return [pa.array([int(s.sum().view(np.int64)) for s in all_], pa.int64()), _long_lists(all_), _long_lists([parity(s) for s in all_])]

    sets = common.per_row(only_ids(docs, needed, needed.count(), "id"), ["id"], "text", sets_and_marks, "k1 long, s array<long>, parity array<long>")
    sets = common.materialize(sets.where(F.size("s") > 0), "sets")
    if sets.count() != members.select("rep", "k1").distinct().count():  # ids that the input repeats: one row of each class
        sets = common.materialize(sets.groupBy("id", "k1").agg(F.first("s").alias("s"), F.first("parity").alias("parity")), "sets1")

    star = members.where("rep <> centre.rep").select(F.col("rep").alias("a"), F.col("k1").alias("ka"), "n", F.col("centre.rep").alias("b"), F.col("centre.k1").alias("kb"), F.col("centre.n").alias("nb"))
    star = star.where(_able("n", "nb", percent)).select("a", "ka", "b", "kb").distinct()
    links = _confirm(star, sets, percent)
    # an id with several texts joins their classes
    several = sig.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("k1", "k2", "n")).alias("low"), F.max(F.struct("k1", "k2", "n")).alias("high")).where("low <> high").select("id")
    both = sig.join(several, "id").where("n > 0").join(reps.select("rep", "k1", "k2", "n"), ["k1", "k2", "n"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = common.materialize(links.unionByName(both), "links")
    first = components(links)

    pairs = _between(members, first, sets, reps, percent)
    more = common.materialize(_confirm(pairs, sets, percent), "links2")
    final = components(links.unionByName(more))
    for df in (members, needed, sets, links, first, pairs, more):
        common.discard(df)

    comps = reps.join(final, F.col("rep") == F.col("id"), "left").select("k1", "k2", F.col("n").alias("n_"), F.coalesce("comp", "rep").alias("comp"))
    out = sig.join(comps, (sig["k1"] == comps["k1"]) & (sig["k2"] == comps["k2"]) & (sig["n"] == comps["n_"]), "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, all columns kept; of rows with one id, the first by text stays."""
    with common.temporary() as keep:
        found = near_duplicates(docs, id_col, text_col, k, percent)
        gone = keep(common.materialize(found.where("not kept").select(F.col(id_col).alias("id")).distinct(), "gone"))
    left = only_ids(docs, gone, gone.count(), id_col, "left_anti")
    twice = common.materialize(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).count().where("count > 1").select("id"), "twice")
    n = twice.count()
    if not n:
        return left
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last()))
    again = only_ids(left, twice, n, id_col).withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return only_ids(left, twice, n, id_col, "left_anti").unionByName(again)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES = {"op5_minhash": op5_minhash}
ORACLE = {
    "op5_minhash": """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.a = doc_id"""
}
