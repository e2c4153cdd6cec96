"""From raw documents to token ids: five stages, each over all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet in the shared folder
and read again as the next stage's docs. What a stage makes on its way is removed when its result is written.

Defined results: null, empty and very short texts fail the quality stage; a null id is kept by the near-dedup (it is
linked with nothing) and goes by its text in the mix; of rows that share an id one stays after the near-dedup; a null
source is a source of its own; an empty table gives an empty result; further columns pass through all stages but the last,
whatever their names; equal rows are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import common, mixing, near_dup, quality_rules, secret_scan, sentencepiece_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    common.prepare(spark)
    return quality_rules.apply(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 in 100 of its five-word shingles."""
    common.prepare(spark)
    return near_dup.one_of_each(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by the name of their kind."""
    common.prepare(spark)
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, sources at their target weights: rows repeated or left out accordingly."""
    common.prepare(spark)
    return mixing.mix(docs, keys=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the ids of every row."""
    common.prepare(spark)
    out = sentencepiece_bpe.tokenize(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))


STAGES = [("quality_rules", quality), ("minhash_near_dedup", dedup), ("secret_scans", secrets), ("source_mixing", mixed), ("sentencepiece", tokens)]
#: zstandard ratios, min-max hashing and merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with common.temporary() as keep:
            docs = keep(common.materialize(stage(spark, docs, sf_dir), name))
        common.discard(before)
    return docs
