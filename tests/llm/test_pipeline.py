import hashlib

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import mixing, quality_rules, secret_scan, sentencepiece_bpe

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, texts):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [k for k, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    a = stage[names[0]](spark, docs, DIR)
    ids = sorted(texts)
    kept = {i for i, k in zip(ids, quality_rules.measure([texts[i].encode() for i in ids])[-1].to_pylist(), strict=True) if k}
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == kept
    b = stage[names[1]](spark, a, DIR)
    comp, _ = brute.components({i: texts[i] for i in kept}, 5, 80)
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == sorted({comp[i] for i in kept})
    c = stage[names[2]](spark, b, DIR)
    assert c.columns == docs.columns and {r.doc_id: r.text for r in c.collect()} == {r.doc_id: brute.redacted(r.text, secret_scan.RULES) for r in b.collect()}
    d = stage[names[3]](spark, c, DIR)
    assert d.columns == docs.columns and set(r.doc_id for r in d.collect()) <= set(r.doc_id for r in c.collect())
    have = {r.source: r.t for r in c.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("t")).collect()}
    got = {r.source: r.t for r in d.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("t")).collect()}
    _, w = mixing.weights(have)
    longest = c.agg(F.max(mixing.word_count("text"))).first()[0]
    assert all(abs(got.get(k, 0) - w[k] * sum(have.values())) <= longest for k in have)
    e = stage[names[4]](spark, d, DIR).collect()
    lib, text = sentencepiece_bpe.encoder(sentencepiece_bpe.default_model()), {r.doc_id: r.text for r in d.collect()}
    assert len(e) == d.count() and all(r.ids == [*lib.lib.encode(text[r.doc_id]), lib.end] and r.n_tokens == len(r.ids) for r in e)


def plain_run(rows, encode):
    """(doc_id, n_tokens, digest of the ids) as run() gives them, each stage by its plain version."""
    kept = {i: (t, s) for i, t, s in rows if brute.quality_verdict(t or "")}
    comp, _ = brute.components({i: t for i, (t, _) in kept.items()}, 5, 80)
    clean = {i: (brute.redacted(kept[i][0], secret_scan.RULES), kept[i][1]) for i in sorted(set(comp.values()))}
    taken = brute.mixed([(str(i), s, len(brute.words(t))) for i, (t, s) in clean.items()], mixing.BLOCK_ROWS, {})
    ids = {i: encode(t) for i, (t, _) in clean.items()}
    return sorted((int(i), len(ids[int(i)]), hashlib.sha256(" ".join(map(str, ids[int(i)])).encode()).hexdigest()) for i, _ in taken)


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    lib = sentencepiece_bpe.encoder(sentencepiece_bpe.default_model())
    want = plain_run([(r.doc_id, r.text, r.source) for r in docs], lambda t: [*lib.lib.encode(t), lib.end])
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == want and 0 < len({i for i, *_ in got}) < len(got) + 1 and len(docs) > len({i for i, *_ in got})


def test_odd_rows(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert [r.doc_id for r in docs.collect()] == [6]
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
