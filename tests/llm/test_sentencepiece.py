import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.llm import sentencepiece_bpe as s

MODEL = s.default_model()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aeinrst ▁.,\n<0x>", max_size=200))
def test_ids_equal_the_library(text):
    e = s.encoder(MODEL)
    try:
        want = e.lib.encode(text)
    except Exception:
        pytest.skip("not a text the library takes")
    assert e.encode(text) == want


def test_heap_and_list_agree(monkeypatch):
    e = s.encoder(MODEL)
    parts = ["▁internationalisation", "▁▁▁▁▁▁▁", "aaaaaaaaaaaa", "▁the", "x"]
    a = [e.merge(p) for p in parts]
    monkeypatch.setattr(s, "SHORT", 0)
    assert [e.merge(p) for p in parts] == a


def test_query_on_documents(spark, texts):
    e = s.encoder(MODEL)
    for r in s.op2_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = [*e.lib.encode(texts[r.doc_id]), e.end]
        assert r.agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(e.lib.decode(ids).encode()).hexdigest()


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(s, "MEMO", 10)
    e = s.Encoder(MODEL)
    text = " ".join(f"w{i}" for i in range(200))
    for _ in range(3):
        assert e.encode(text) == e.lib.encode(text)
    e.encode("x")
    assert len(e.new) <= 10 + 250


def test_odd_rows_and_round_trip(spark, odd):
    rows = s.token_digests(odd).collect()
    assert len(rows) == 10 and all(r.agrees for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 8)} == {1}
    back = {r.doc_id: r.text for r in s.detokenize(s.tokenize(odd)).collect()}
    src = {r.doc_id: (r.text or "").replace("▁", " ") for r in odd.collect()}
    assert back == src
    assert s.token_digests(odd.limit(0)).count() == 0


def test_whole_texts_are_checked_where_pieces_span_words(monkeypatch):
    e = s.encoder(MODEL)
    texts = ["the cat", "", "internationalisation of it", "odd  blanks "]
    want = [[*e.lib.encode(t), e.end] for t in texts]
    monkeypatch.setattr(e, "inner_space", True)
    assert s.encode_batch(texts, MODEL) == (want, [True] * 4)
    merge = e.merge
    monkeypatch.setattr(e, "merge", lambda t: merge(t)[::-1])
    ids, agrees = s.encode_batch(texts, MODEL)
    assert ids == want and agrees == [False, True, False, False]
