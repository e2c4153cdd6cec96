import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, further columns with clashing names."""
    rng = random.Random(9)
    long_ = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(120_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Same words here"), (5, "Same words here"), (5, "Same words here"), (None, "no id at all"), (6, long_), (7, "▁ éü \U0001f389 \x00"), (8, None)]
    return spark.createDataFrame([(i, t, "en", "s", 7, "x", 1.0, True, "t") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, score double, kept boolean, t string")
