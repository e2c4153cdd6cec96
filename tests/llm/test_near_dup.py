import random

import brute
import numpy as np
import pytest

from wakeline.llm import near_dup


def agree(rows, texts, k):
    comp, size = brute.components(texts, k, 80)
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (comp[r.doc_id], size[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_query_matches_brute_force(spark, texts):
    agree(near_dup.op5_minhash(spark, "/root/testdata/sf0.001").collect(), texts, 2)


def test_chains_of_edits(spark):
    """Each copy is close to the one before, not to the first: links, not similarity, make the group."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(40):
        texts[i] = " ".join(words)
        words = list(words)
        words[rng.randrange(60)] = f"x{i}"
    for i in range(40, 60):
        texts[i] = " ".join(f"y{rng.randrange(9)}" for _ in range(8))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k in (2, 5):
        agree(near_dup.near_duplicates(df, k=k).collect(), texts, k)


def test_ids_with_several_texts(spark):
    """Rows that share an id are one document, in whatever order they come."""
    a = " ".join(f"a{i}" for i in range(30))
    b = " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, "something else here"), (9, b), (3, "x y z"), (3, "p q r"), (4, "p q r")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), k=2).collect()}
        assert got == {(5, 5, True), (6, 5, False), (7, 5, False), (9, 5, False), (8, 8, True), (3, 3, True), (4, 3, False)}


def test_parity_never_exceeds_the_difference():
    rng = random.Random(4)
    for n in (5, 150, 1_900, 5_000):
        base = [rng.getrandbits(64) for _ in range(n)]
        for share in (0.02, 0.1, 0.2, 0.5):
            k = int(n * share)
            a, b = np.array(base, np.uint64), np.array(base[k:] + [rng.getrandbits(64) for _ in range(k)], np.uint64)
            bits = sum(int(x).bit_count() for x in (near_dup.parity(a) ^ near_dup.parity(b)).view(np.uint64))
            assert bits <= 2 * k
            if n < 1_000 and share >= 0.2:  # and tells unlike sets
                assert bits * 180 > 2 * n * 20


@pytest.mark.parametrize("size", [60, 2_600])
def test_a_bucket_of_many_components(spark, monkeypatch, size):
    """Copies of one text with as many edits that some pairs are linked and most are not; slices of a few classes."""
    monkeypatch.setattr(near_dup, "SLICE", 7)
    rng = random.Random(6)
    texts = {}
    for i in range(70 if size < 100 else 25):
        words = [f"w{j}" for j in range(size)]
        for j in rng.sample(range(size), rng.randrange(size // 8)):
            words[j] = f"x{i}_{j}"
        texts[i] = " ".join(words)
        if i % 5 == 0:  # a near copy of it
            words[0] = f"z{i}"
            texts[1000 + i] = " ".join(words)
    comp, _ = brute.components(texts, 2, 80)
    assert len(set(comp.values())) > 5
    agree(near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=2).collect(), texts, 2)


def test_minmax_estimates_the_similarity():
    rng = random.Random(1)
    all_ = np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64)
    a, b = near_dup.minmax(all_[:900]), near_dup.minmax(all_[100:])
    same = [float((x == y).mean()) for x, y in zip(a, b, strict=True)]
    assert abs(sum(same) / 2 - 0.8) < 0.15


def test_odd_rows(spark, odd):
    rows = near_dup.near_duplicates(odd, k=2).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[3] == [(0, 3, True)] and got[4] == [(2, 4, True)] and got[5] == [(2, 4, False)] * 2 and got[None] == [(3, None, True)]
    one = near_dup.one_of_each(odd, k=5)
    assert one.columns == odd.columns and sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0 and near_dup.one_of_each(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.one_of_each(twice).collect()) == [(1, "a"), (2, "c")]
