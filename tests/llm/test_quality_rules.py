import random

import brute
import zstandard

from wakeline.llm import quality_rules as q

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts_match_brute_force(spark, texts):
    for r in q.op1_quality_rules(spark, "/root/testdata/sf0.001").collect():
        want = brute.base_counts(texts[r.doc_id])
        assert tuple(r[c] for c in BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_bands():
    rng, compress = random.Random(1), zstandard.ZstdCompressor(level=3).compress
    noise = bytes(rng.randrange(256) for _ in range(9000))
    words = [bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = b" ".join(rng.choice(words) for _ in range(4000))
    assert not q.bands_verdict(b"the same line\n" * 500, compress)[-1]
    assert not q.bands_verdict(noise, compress)[-1]
    assert q.bands_verdict(prose, compress)[-1]
    assert not q.bands_verdict(prose[:20000] + b"x" * 20000, compress)[-1]  # chunks tell on a part
    assert q.bands_verdict(b"short", compress)[-1] and not q.bands_verdict(b"", compress)[-1]


def test_verdict_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = q.op1_quality_rules(spark, d).collect()
    assert {r.doc_id: r.kept for r in rows} == {i: brute.quality_verdict(t) for i, t in texts.items()}
    assert sum(not r.kept and not r.base_failed for r in rows) >= 20  # the bands reject what the base rules pass


def test_bands_tell_good_from_bad(spark):
    d = "/root/testdata/sf0.1"
    r = q.op1_quality_rules(spark, d).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    r = r.join(spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "floor(log2(octet_length(text))) AS size"), "doc_id")
    rows = [(x.quality, x.size, x.kept) for x in r.collect()]
    good = [k for y, _, k in rows if y == 1]
    assert sum(good) >= 0.99 * len(good)
    for size, least in ((10, 0.25), (11, 0.7), (12, 0.9), (13, 0.9)):  # from 1, 2, 4 and 8 KB
        bad = [k for y, s, k in rows if y == 0 and s == size]
        assert bad and sum(bad) <= (1 - least) * len(bad)


def test_odd_rows(spark, odd):
    rows = q.quality_rules(odd).collect()
    assert len(rows) == 10
    for r in rows:
        if r.doc_id in (1, 2, 3, 8):
            assert r.n_words == 0 and not r.kept and r.base_failed
    kept = q.apply(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [6]
    assert q.quality_rules(odd.limit(0)).count() == 0 and q.apply(odd.limit(0)).count() == 0
