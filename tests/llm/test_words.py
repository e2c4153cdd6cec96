import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.llm import common

TEXT = st.text(alphabet=st.sampled_from("ab \n\t\x0b\x0c\r  é"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_word_hashes_tell_words_apart(texts):
    h, at = common.batch_words([t.encode() for t in texts])
    want = [w for t in texts for w in brute.words(t)]
    assert len(h) == len(want) and [int(n) for n in np.diff(at)] == [len(brute.words(t)) for t in texts]
    seen = {}
    for x, w in zip(h.tolist(), want, strict=True):
        assert seen.setdefault(x, w) == w
    assert len(seen) == len(set(want))


def test_hash_does_not_depend_on_the_span(monkeypatch):
    data = b" ".join(b"w%d" % i for i in range(3000))
    whole = common.words_of(data)[2]
    monkeypatch.setattr(common, "_SPAN", 64)
    assert (common.words_of(data)[2] == whole).all()


def test_shingles():
    h, _ = common.batch_words([b"a b a b", b"a"])
    assert len(common.shingles(h[:4], 2)) == 2 and len(common.shingles(h[:4], 9)) == 1 and len(common.shingles(h[:0], 2)) == 0
