"""Integrity, digests, redaction and attestation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(pk).alias("_pk")).distinct(), F.col(fk) == F.col("_pk"), "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def integrity(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """One row: repeated parent ids, child rows, child rows without a parent."""
    a = repeated_keys(parent, [pk]).agg(F.count("*").alias("n_repeated"))
    b = child.agg(F.count("*").alias("n_child"))
    c = orphans(child, parent, fk, pk).agg(F.count("*").alias("n_orphans"))
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one").drop("_one")


def file_digests(spark, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime and sha256 of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def cached_digests(spark, path: str, cache: DataFrame, pattern: str = "*") -> DataFrame:
    """As file_digests; files whose path, length and time are in the cache (path, length, modificationTime, sha256) take their
    digest from it and are not read. The content of the others is read, since the list itself needs none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    key = ["path", "length", "modificationTime"]
    known = files.select(*key).join(cache.select(*key, "sha256"), key)
    names = files.select(*key).join(cache.select(*key), key, "left_anti").select("path").collect()
    if not names:
        return known
    new = spark.read.format("binaryFile").load([r.path.replace("{", "\\{").replace("[", "\\[") for r in names])
    return known.unionByName(new.select(*key, F.sha2("content", 256).alias("sha256")))


def reattest(frozen: DataFrame, found: DataFrame, rows: DataFrame, role: str = "role") -> DataFrame:
    """One row: whether a freeze still holds. frozen and found: path, sha256; rows: what was trained on, all benign."""
    v = verify(frozen, found).agg(F.count("*").alias("n_files"), F.count_if(F.col("state") != "ok").alias("n_changed"))
    a = attest(rows, role=role).select("n", "n_blocked")
    one = F.lit(1).alias("_one")
    both = v.select("*", one).join(a.select("*", one), "_one").drop("_one")
    return both.withColumn("holds", (F.col("n_changed") == 0) & (F.col("n_blocked") == 0))


def verify(expected: DataFrame, found: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """expected with state: ok, changed or missing."""
    f = found.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    state = F.when(F.col("_k").isNull(), "missing").when(F.col("_d") == F.col(digest), "ok").otherwise("changed")
    return expected.join(f, F.col(key) == F.col("_k"), "left").withColumn("state", state).drop("_k", "_d")


def inventory(found: DataFrame, stamp: str) -> DataFrame:
    """One row: files, bytes and a digest over the sorted digests."""
    joined = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "path"))), "\n")
    return found.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.sha2(joined, 256).alias("digest")).withColumn("release", F.lit(stamp))


def manifest_state(manifest: DataFrame, found: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row of counts: repeated ids, unknown channels, missing files, changed files."""
    v = verify(manifest, found)
    per_id = manifest.groupBy("item_id").count()
    one = F.lit(1).alias("_one")
    a = per_id.agg(F.count_if(F.col("count") > 1).alias("n_repeated"))
    b = v.agg(F.count_if(~F.coalesce(F.col("channel").isin(list(channels)), F.lit(False))).alias("n_bad_channel"), F.count_if(F.col("state") == "missing").alias("n_missing"), F.count_if(F.col("state") == "changed").alias("n_changed"))
    return a.select("*", one).join(b.select("*", one), "_one").drop("_one")


def refused_paths(paths: DataFrame, patterns: Sequence[str], column: str = "path") -> DataFrame:
    """Paths that a release must not hold."""
    bad: Column = F.lit(False)
    for p in patterns:
        bad = bad | F.col(column).rlike(p)
    return paths.where(bad)


def without_source(images: DataFrame, annotations: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Images of other sources, and the annotations that still have an image."""
    kept = images.where(~F.coalesce(F.col("source") == source, F.lit(False)))
    return kept, annotations.join(kept.select(F.col("id").alias("_id")), F.col("image_id") == F.col("_id"), "left_semi")


def for_release(df: DataFrame, private: Sequence[str] = ("mmsi",)) -> DataFrame:
    return df.drop(*private)


def attest(rows: DataFrame, allowed_role: str = "benign", role: str = "role") -> DataFrame:
    """One row: rows, rows of another role (an error in a frozen training set), distinct roles."""
    r = F.lower(F.trim(role))
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(r == allowed_role, F.lit(False))).alias("n_blocked"), F.array_join(F.array_sort(F.collect_set(r)), ",").alias("roles"))


def headline(tree: Mapping, places: Mapping[str, str]) -> dict:
    """Named values at dotted places of a nested summary; None where there is nothing."""
    out = {}
    for name, place in places.items():
        at = tree
        for part in place.split("."):
            at = at.get(part) if isinstance(at, Mapping) else None
        out[name] = at
    return out


def fact_checks(facts: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, holds) over a one-row table of facts: what a caption says against what the tables give. Unknown does not hold."""
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in checks.items()])
    return facts.select(F.explode(pairs).alias("p")).select("p.check", "p.holds")


def find_keys(tree, names: Iterable[str], at: str = "$") -> list[str]:
    """Places of the named keys anywhere in nested JSON data."""
    names, out = set(names), []
    if isinstance(tree, Mapping):
        for k, v in tree.items():
            if k in names:
                out.append(f"{at}.{k}")
            out += find_keys(v, names, f"{at}.{k}")
    elif isinstance(tree, list | tuple):
        for i, v in enumerate(tree):
            out += find_keys(v, names, f"{at}[{i}]")
    return out


def check_policy(policy: Mapping[str, Mapping], envelopes: Iterable[str], classes: Iterable[str]) -> list[str]:
    """What is wrong with a class policy: empty if nothing."""
    known, out = set(envelopes), []
    for c in sorted(set(classes) - set(policy)):
        out.append(f"class {c} has no policy")
    for c, e in sorted(policy.items()):
        kind = e.get("policy")
        if kind not in ("score", "abstain"):
            out.append(f"class {c}: unknown policy {kind}")
        elif kind == "score" and e.get("envelope") not in known:
            out.append(f"class {c}: unknown envelope {e.get('envelope')}")
        elif kind == "abstain" and not e.get("reason"):
            out.append(f"class {c}: abstains without a reason")
    return out
