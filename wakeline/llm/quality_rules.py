"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. The ratio (compressed over raw bytes) has to lie
in a band that depends on the length: below it the text repeats itself, above it the text is noise that does not
compress. The limits are given at a few lengths and interpolated in the logarithm of the length between them (outside,
the nearest limit holds). A text also fails when more than ``max_bad_chunks`` of its whole chunks lie outside the chunk
band, so that a repetitive or random part cannot hide behind an ordinary rest. Beside it stand plain counts (words,
symbols, repeated lines and windows) and two base rules.

Where the limits come from: ordinary prose of four languages compresses at level 3 to 0.54 - 0.72 of its bytes at 300
bytes, 0.47 - 0.56 at 1.5 KB, 0.43 - 0.47 at 6 KB, 0.40 - 0.43 at 24 KB. Texts that reuse a small vocabulary or whole
phrases lie 0.03 to 0.06 below prose of their length, random letters or digits above 0.6 at any length. The lower limits
stand just below the lowest hundredth of prose (measured on texts labelled good), the upper ones well above its highest.

Defined results: null and empty texts have no words and fail the base rules (ratio 0, no chunks); a text below the
shortest limit is never judged by compression; equal rows get equal results; further columns pass through ``apply``
and are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common

#: (bytes, lowest ratio, highest ratio), interpolated in log2(bytes); shorter texts than the first are not judged.
BANDS = ((256, 0.56, 0.85), (512, 0.515, 0.77), (1024, 0.475, 0.69), (2048, 0.45, 0.63), (4096, 0.43, 0.58), (8192, 0.415, 0.56), (16384, 0.40, 0.55), (65536, 0.38, 0.54), (1 << 20, 0.34, 0.53))
CHUNK_BYTES = 4096
CHUNK_BAND = (0.425, 0.58)
MAX_BAD_CHUNKS = 0.3
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, base_failed boolean, kept boolean"


def repeated_window_words(words: np.ndarray, k: int = 3) -> int:
    """Words inside k-word windows that the text holds at least twice."""
    h = common.windows(words, k)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h) + k, np.int32)
    at = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    np.add.at(twice, at, 1)
    np.add.at(twice, at + k, -1)
    return int((np.cumsum(twice)[: len(words)] > 0).sum())


def base_counts(text: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = np.frombuffer(text, np.uint8)
    count = np.bincount(raw, minlength=256)
    chars = int(count[:0x80].sum() + count[0xC0:].sum() - count[list(common.BLANKS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip(common.BLANKS)]
    return len(words), chars, int(count[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_window_words(words)


def limits_at(n: int, bands=BANDS) -> tuple[float, float] | None:
    """Lowest and highest ratio of a text of n bytes; None where no band holds."""
    if n < bands[0][0]:
        return None
    if n >= bands[-1][0]:
        return bands[-1][1:]
    i = next(i for i in range(1, len(bands)) if n < bands[i][0])
    (n0, low0, high0), (n1, low1, high1) = bands[i - 1], bands[i]
    x = math.log2(n / n0) / math.log2(n1 / n0)
    return low0 + x * (low1 - low0), high0 + x * (high1 - high0)


def bands_verdict(text: bytes, compress, bands=BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND, max_bad=MAX_BAD_CHUNKS) -> tuple[float, int, int, int, bool]:
    """Whole ratio, chunks, chunks below and above the chunk band, and whether the text passes."""
    n = len(text)
    if not n:
        return 0.0, 0, 0, 0, False
    ratio = len(compress(text)) / n
    limit = limits_at(n, bands)
    if limit is None:
        return ratio, 0, 0, 0, True
    view, low, high, chunks = memoryview(text), 0, 0, 0
    for i in range(0, n - chunk_bytes + 1, chunk_bytes):  # a short tail compresses worse; the whole ratio covers it
        r = len(compress(view[i : i + chunk_bytes])) / chunk_bytes
        chunks, low, high = chunks + 1, low + (r < chunk_band[0]), high + (r > chunk_band[1])
    return ratio, chunks, low, high, limit[0] <= ratio <= limit[1] and low + high <= max_bad * chunks


def measure(texts: list[bytes], **limits) -> list[pa.Array]:
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    hashes, at = common.batch_words(texts)
    rows = []
    for i, t in enumerate(texts):
        base = base_counts(t, hashes[at[i] : at[i + 1]])
        ratio, chunks, low, high, ok = bands_verdict(t, compress, **limits)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        rows.append((*base, ratio, chunks, low, high, failed, ok and not failed))
    kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 3 + [pa.bool_()] * 2
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of docs: its id, the base counts, the ratios and ``kept``. No shuffle."""
    return common.per_row(docs, [id_col], text_col, lambda t: measure(t, **limits), SCHEMA)


def apply(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs that pass, with all their columns; each row is judged where it is read, without a join."""
    names, held = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.toDF(*held)
    text = held[names.index(text_col)]

    def run(batches):
        at = held.index(text)
        for b in batches:
            if b.num_rows:
                texts = [(t or "").encode() for t in b.column(at).to_pylist()]
                yield b.filter(measure(texts, **limits)[-1])
        common.tidy()

    return whole.mapInArrow(run, whole.schema).toDF(*names)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE: dict[str, str] = {}
