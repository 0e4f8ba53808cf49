"""Quality rule: compression bands.

A text that compresses far better than prose of its length repeats itself; a
text that hardly compresses is random. The Zstandard ratio (UTF-8 bytes over
compressed bytes) is taken of the whole text and of its fixed chunks, and each
is held against the limits for its own length, since short inputs compress
less whatever they say. A text is rejected when the whole lies outside its
band or when chunks with more than ``bad_share`` of the bytes do.

Defined cases: a null or empty text has ratio 1 and no chunks and fails the
base rule; repeated rows are judged alike; a text of any length is compressed
whole. Columns of the input with the name of a result column are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from . import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# (bytes below, lowest ratio, highest ratio): limits by length of what is compressed
BANDS = (
    (128, 0.0, 3.0),
    (512, 1.0, 3.25),
    (2048, 1.3, 3.75),
    (8192, 1.45, 4.5),
    (float("inf"), 1.5, 6.0),
)
CHUNK_BYTES = 4096
BAD_SHARE = 0.25
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FIELDS = [
    *[StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    StructField("base_failed", BooleanType()),
    StructField("kept", BooleanType()),
    StructField("ratio", DoubleType()),
    StructField("bad_chunk_share", DoubleType()),
]


def in_band(length: int, ratio: float, bands: Sequence[tuple[float, float, float]] = BANDS) -> bool:
    """Does the ratio lie within the limits for this length?"""
    for below, low, high in bands:
        if length < below:
            return low <= ratio <= high
    return True


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(codes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text the words that lie in a window of ``window`` words found
    twice or more in that text."""
    n_texts = len(starts) - 1
    at, text = common.window_starts(starts, window)
    if not len(at):
        return np.zeros(n_texts, np.int64)
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    key = common.window_hashes(mixed, window)[at] ^ (text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    equal = text[order[:-1][same]] == text[order[1:][same]]
    for k in range(window):
        equal &= codes[a + k] == codes[b + k]
    if not equal.all():  # two windows share a hash: compare the words themselves
        rows = np.stack([text, *[codes[at + k] for k in range(window)]], axis=1)
        _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        hits = at[count[back.ravel()] > 1]
    else:
        hits = np.unique(np.concatenate([a, b]))
    cover = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.subtract.at(cover, hits + window, 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts that the base rule and its neighbours use."""
    codes, starts, _ = common.words_of(texts, ascii_only=True)
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
    total = lambda marks: sum(number(pc.count_substring(texts, m)) for m in marks)
    return {
        "n_words": np.diff(starts),
        "word_chars": number(pc.utf8_length(texts)) - total(SPACES),
        "n_symbols": total(SYMBOLS),
        "n_dup_lines": np.fromiter((duplicate_lines(x) for x in common.strings(texts)), np.int64, len(texts)),
        "n_repeat_words": repeated_words(codes, starts),
    }


def compression_bands(
    df: DataFrame,
    text_col: str = "text",
    bands: Sequence[tuple[float, float, float]] = BANDS,
    chunk_bytes: int = CHUNK_BYTES,
    bad_share: float = BAD_SHARE,
    level: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with the base counts, ``ratio`` (whole text), ``bad_chunk_share``
    (share of bytes in chunks outside their band), ``base_failed`` and
    ``kept``. No shuffle: each row is judged by itself."""

    def work(piece: pa.RecordBatch) -> list:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level)
        texts = common.clean_texts(piece.column(text_col))
        base = base_counts(texts)
        failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
        ratios, shares, fits = np.ones(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        for i, data in enumerate(common.strings(texts.cast(pa.binary()))):
            if not data:
                continue
            ratios[i] = len(data) / len(squeeze.compress(data))
            bad = 0
            if len(data) > chunk_bytes:
                for at in range(0, len(data), chunk_bytes):
                    chunk = data[at : at + chunk_bytes]
                    if not in_band(len(chunk), len(chunk) / len(squeeze.compress(chunk)), bands):
                        bad += len(chunk)
            shares[i] = bad / len(data)
            fits[i] = in_band(len(data), ratios[i], bands) and shares[i] <= bad_share
        return [*base.values(), failed, ~failed & fits, ratios, shares]

    return common.add_columns(df, text_col, FIELDS, work, keep)
