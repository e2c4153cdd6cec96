"""What the corpus operators share: table reads, durable intermediate tables, Arrow batches and word hashing.

Words are runs of bytes other than the six ASCII blanks (space, \\t, \\n, \\v, \\f, \\r) in the UTF-8 text, which is
the same as ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

BLANKS = b" \t\n\x0b\x0c\r"
#: Rows and bytes of an Arrow batch: what a Python worker holds at once.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, in a session that is prepared."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Give the Python workers this package, and bound the Arrow batches they get."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and lost executors lose nothing.

    The tables are removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wakeline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that are made inside, but for those that are handed to what it gives: ``with temporary() as keep``."""
    before, kept = set(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_tables_of(df))
        return df

    yield keep
    for made in [m for m in _made if m not in before and m not in kept]:
        _remove(*made)
        _made.remove(made)


def _tables_of(df: DataFrame) -> list[tuple[SparkSession, str]]:
    names = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return [m for m in _made if any(n.endswith(m[1].split("://")[-1].rstrip("/")) for n in names)]


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() made and nothing will read again."""
    for made in _tables_of(df):
        _remove(*made)
        _made.remove(made)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone by now, and its folders with it
            return


def tidy() -> None:
    """Give freed memory of this worker back to the machine: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def per_row(df: DataFrame, keep: list[str], text: str, fn: Callable, schema: str) -> DataFrame:
    """Apply fn(list of bytes) -> list of columns to each Arrow batch of (keep..., text); null text is empty.

    Only the named columns reach Python, so further columns of the input cost nothing and cannot clash.
    """
    n_keep = len(keep)
    names = [f"k{i}" for i in range(n_keep)]
    small = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("t"))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    out_schema = ", ".join(x for x in (kept, schema) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                new = fn(b.column(n_keep).to_pylist())
                cols = [b.column(i) for i in range(n_keep)] + [x if isinstance(x, pa.Array) else pa.array(x) for x in new]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *out_names])
        tidy()

    out_names = [x.strip().split()[0].strip("`") for x in schema.split(",") if x.strip()]
    return small.mapInArrow(run, out_schema)


# --- word hashing -------------------------------------------------------------------------------------------------

_SPAN = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_blank = np.zeros(256, bool)
_blank[list(BLANKS)] = True
_codes = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        for name, base in (("_pow", _BASE), ("_inv", _INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte offsets) and 64-bit hash of each word; in spans of about 256 KB, cut at blanks."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _blank[raw], [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + _SPAN, "right")), i + 1)
        hi = ends[j - 1]
        p, q = _powers(int(hi - lo) + 1)
        total = np.zeros(int(hi - lo) + 1, np.uint64)
        np.cumsum(_codes[raw[lo:hi]] * p[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * q[s]
        i = j
    return starts, ends, mix(out)


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (one more entry than texts)."""
    starts, _, hashes = words_of(b"\n".join(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return hashes, np.searchsorted(starts, at)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-word window of one text, in order; the empty array if it has fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * np.uint64(0x100000001B3) ^ words[i : i + n] * np.uint64(2 * i + 1)
        h = mix(h)
    return mix(h)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingle hashes, sorted; with fewer words the whole sequence is one shingle; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(windows(words, k)) if len(words) >= k else windows(words, len(words)) ^ np.uint64(len(words))
