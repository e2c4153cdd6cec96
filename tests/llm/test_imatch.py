import hashlib
import math
import re
from collections import Counter

import xxhash

from wakeline.llm import imatch


def test_edits_and_likeness(spark, texts, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 16)
    rows = sorted(imatch.op3_imatch(spark, "/root/testdata/sf0.001").collect(), key=lambda r: -r.doc_id)
    ids = sorted(texts, reverse=True)
    assert [r.doc_id for r in rows] == ids
    by_text = {}
    for i, r in enumerate(rows):
        a, b = texts[ids[i]], texts[ids[(i + 1) % len(ids)]]
        half = len(a) // 2
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
        by_text.setdefault(a, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if a == b:
            assert r.near_next == 1
    assert all(len(v) == 1 for v in by_text.values())
    better = sum(r.near_edited > r.near_next for r in rows)
    assert better > 0.9 * len(rows)


def test_lexicon_matches_brute_force(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b, d"), (3, "A e"), (4, None)], "doc_id long, text string")
    words = set(imatch.lexicon(df, low=0.4, high=0.6))
    h = {w: spark.createDataFrame([(w,)], "w string").selectExpr("xxhash64(w) AS h").first().h for w in "abcde"}
    assert words == {h["b"]}


def _h(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed % 2**64).intdigest()


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


def _long(x: int, seed: int) -> int:
    return _h((x % 2**64).to_bytes(8, "little"), seed)


def plain_terms(text):
    words = dict.fromkeys(w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower(), flags=re.A) if w)
    return [_signed(_h(w.encode())) for w in words]


def plain_codes(found, lexicon):
    """The hash of the sorted terms in the lexicon (of all, if none is), then one per random subset."""

    def fold(ts):
        seed = 42
        for t in ts:
            seed = _long(t, seed)
        return seed

    inside = sorted(t for t in found if t in lexicon)
    out = ["0" * 1 + f"{fold(inside):X}".rjust(16, "0") if inside else ("-" + f"{fold(sorted(found)):X}").rjust(17, "0")]
    for rate in imatch.RATES:
        seed = _h(rate.to_bytes(4, "little"))
        cell = {t: _signed(_long(t, seed)) % rate for t in inside}
        for j in range(imatch.PER_RATE):
            held = [t for t in inside if cell[t] == j]
            h = 42
            for t in held:
                h = _long(t, _long(h, 42))
            out.append(f"{h:X}".rjust(16, "0")[8:] if held else None)
    return out


def plain_likeness(a, b):
    if a == b or a[0] == b[0]:
        return 1.0
    pairs = [(x, y) for x, y in zip(a[1:], b[1:], strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def test_codes_and_likeness_match_brute_force(spark, texts):
    ids = sorted(texts, reverse=True)
    count = Counter(t for x in texts.values() for t in plain_terms(x))
    n = len(texts)
    lexicon = {t for t, c in count.items() if max(2, math.ceil(imatch.LOW * n)) <= c <= max(2, math.floor(imatch.HIGH * n))}
    assert set(imatch.lexicon(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) == lexicon
    codes = {i: plain_codes(plain_terms(texts[i]), lexicon) for i in ids}
    got = {r.doc_id: r for r in imatch.op3_imatch(spark, "/root/testdata/sf0.001").collect()}
    for at, i in enumerate(ids):
        nxt = ids[(at + 1) % n]
        half = len(texts[i]) // 2
        changed = plain_codes(plain_terms(texts[i][: len(texts[i]) - half] + texts[nxt][:half]), lexicon)
        r = got[i]
        assert r.fingerprint == "".join(c or "........" for c in codes[i]).lower() and r.edited_fingerprint == "".join(c or "........" for c in changed).lower()
        assert abs(r.near_edited - plain_likeness(codes[i], changed)) < 1e-12 and abs(r.near_next - plain_likeness(codes[i], codes[nxt])) < 1e-12


def test_odd_rows(spark, odd):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == 10
    same = {r.fingerprint for r in rows if r.doc_id in (4, 5)}
    empty = {r.fingerprint for r in rows if r.doc_id in (1, 2, 3, 8)}
    assert len(same) == 1 and len(empty) == 1 and same != empty
    assert imatch.fingerprints(odd.limit(0)).count() == 0
    one = imatch.fingerprints(odd.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1
