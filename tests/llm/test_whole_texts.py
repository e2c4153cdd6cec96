"""No limit of length or number leaves terms or words out."""

import numpy as np
from pyspark.sql import functions as F

from wakeline.llm import imatch, toxicity


def test_nearness_to_second_person_words_in_long_texts():
    rng = np.random.default_rng(0)
    for _ in range(50):
        hits, you = (sorted(rng.choice(80, rng.integers(0, 12), replace=False).tolist()) for _ in range(2))
        assert toxicity.nearby(hits, you) == sum(any(abs(i - j) <= 4 for j in you) for i in hits)
    words = toxicity.Words({"idiot": 3.0})
    short, long_ = toxicity.features(["you idiot " * 10, "you idiot " * 2000], words)
    assert short[11] == long_[11] == 0.5


def test_lexicon_holds_the_whole_band(spark):
    text = " ".join(f"w{i}" for i in range(70_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, "other")], "doc_id long, text string")
    words = imatch.lexicon(df, low=0.5, high=0.7)
    assert len(set(words)) == 70_000
    assert df.select(F.size(imatch.banded(imatch.terms(F.col("text")), words)).alias("n")).first().n == 70_000
