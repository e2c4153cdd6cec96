import math

import brute
import pytest

from wakeline.llm import mixing


def entropy(w):
    return -sum(p * math.log(p) for p in w.values() if p)


def test_bisection_meets_the_entropy():
    tokens = {"a": 9000, "b": 900, "c": 100}
    x, w = mixing.weights(tokens, entropy=0.8, max_repeats=None)
    assert 0 < x < 1 and math.isclose(entropy(w), 0.8 * math.log(3), abs_tol=1e-6) and math.isclose(sum(w.values()), 1)
    y, v = mixing.weights(tokens, entropy=0.8, max_repeats=2.0)
    assert y > x and math.isclose(max(v[k] * 10_000 / tokens[k] for k in tokens), 2.0, rel_tol=1e-6)
    assert mixing.weights({"a": 5, "b": 5})[0] == 1.0 and mixing.weights({}) == (1.0, {}) and mixing.weights({"a": 0})[1] == {"a": 0.0}


@pytest.fixture
def corpus(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "small", i) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch long").drop("mix_epoch")


def test_quotas_are_met(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    have = {}
    for r in corpus.collect():
        have[r.source] = have.get(r.source, 0) + len(r.text.split())
    _, w = mixing.weights(have, entropy=0.95)
    out = mixing.mix(corpus, entropy=0.95).collect()
    total, got, copies = sum(have.values()), {}, {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        copies.setdefault(r.source, {}).setdefault(r.doc_id, []).append(r.mix_epoch)
    for k in have:
        assert abs(got[k] - w[k] * total) <= 7
        n = [len(v) for v in copies[k].values()]
        assert max(n) - min(n) <= 1 or len(n) < len([1 for r in corpus.collect() if r.source == k])
        assert all(sorted(v) == list(range(len(v))) for v in copies[k].values())
    # an epoch takes whole blocks in the order of their keys, one of them cut
    part = [r for r in out if r.source == "big"]
    assert len({r.mix_block_key for r in part}) > 5


def test_repeats_with_tasks_lost_are_the_same(spark, corpus):
    a, b = (sorted(tuple(r) for r in mixing.mix(c).select("doc_id", "mix_epoch", "mix_row_key").collect()) for c in (corpus, corpus.repartition(7)))
    assert a == b


def test_the_target_binds(spark):
    """The query's own target is above the sources' entropy at every size, so weights, epochs and cuts all act."""
    d = "/root/testdata/sf0.01"
    out = mixing.op4_temperature_mixing(spark, d).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", mixing.word_count("text").alias("n")).collect()}
    have, got = {}, {}
    for r in docs.values():
        have[r.source] = have.get(r.source, 0) + r.n
    for r in out:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
    x, w = mixing.weights(have)
    share = {k: v / sum(have.values()) for k, v in have.items()}
    assert 0 < x < 1 and math.isclose(entropy(w) - entropy(share), 0.5 * (math.log(len(share)) - entropy(share)), rel_tol=1e-5)
    longest = max(r.n for r in docs.values())
    assert all(-1 <= w[k] * sum(have.values()) - got[k] <= longest for k in have)
    seen = [r.doc_id for r in out]
    assert len(set(seen)) < len(docs) and len(seen) > len(set(seen))


@pytest.mark.parametrize("block_rows", [7, 50, 512])
@pytest.mark.parametrize("target", [{}, {"entropy": 0.97, "max_repeats": None}, {"entropy": 1.0, "max_repeats": 1.5}])
def test_mix_matches_brute_force(spark, corpus, monkeypatch, block_rows, target):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    rows = [(str(r.doc_id), r.source, len(r.text.split())) for r in corpus.collect()]
    assert sorted((str(r.doc_id), r.mix_epoch) for r in mixing.mix(corpus, **target).collect()) == brute.mixed(rows, block_rows, target)


def test_odd_rows(spark, odd):
    out = mixing.mix(odd)
    assert set(odd.columns) < set(out.columns) and out.count() >= 9
    nulls = odd.withColumn("source", odd["source"].substr(5, 1)).drop("source").withColumnRenamed("t", "source")
    assert mixing.mix(nulls).count() >= 9
    assert mixing.mix(odd.limit(0)).count() == 0
    none = spark.createDataFrame([(1, "a b", None), (2, "a b", "s")], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 2


def test_clashing_names_and_rows_without_ids(spark):
    rows = [(None, f"w{i} " * (1 + i % 3), "big" if i % 4 else "small", i, "k", 7, "x", 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch long, mix_row_key string, Mix_Block_Key long, src string, c0 double")
    out = mixing.mix(df, entropy=0.99)
    assert out.columns == [*df.columns, "mix_epoch_", "mix_block_key_", "mix_row_key_"]
    assert mixing.mix(df, keys=False).columns == df.columns
    have, got = {}, {}
    for r in rows:
        have[r[2]] = have.get(r[2], 0) + len(r[1].split())
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert r.mix_epoch is not None and r.src == "x" and r.c0 == 1.5
    _, w = mixing.weights(have, entropy=0.99)
    assert all(abs(got[k] - w[k] * sum(have.values())) <= 3 for k in have)
