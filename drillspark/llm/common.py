"""Helpers the text operators share: walking a text column in bounded pieces
inside Arrow tasks, and splitting a piece into words with a local vocabulary.

Python runs per Arrow batch, never per row of Spark's, and a task holds one
piece (a few MB of text, or one single longer text) at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

# executors get these helpers with the job and need not import the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 1 << 20


def table_of(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 length of each text; null counts as empty."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``limit`` bytes of text
    each (a single longer text is a slice of its own)."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(byte_lengths(batch.column(column)))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


def clean_texts(texts: pa.Array) -> pa.Array:
    """The texts as valid UTF-8 strings, null as empty. Bytes that are not
    UTF-8 become U+FFFD (Spark strings may hold any bytes)."""
    filled = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if pa.types.is_string(filled.type) or pa.types.is_large_string(filled.type):
        try:
            filled.validate(full=True)
            return filled
        except pa.ArrowInvalid:
            filled = filled.cast(pa.binary())
    try:
        return filled.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in filled.to_pylist()], pa.string())


def strings(array: pa.Array) -> list:
    """Python values of a string or binary array (null: None), by way of numpy:
    some ten times as fast as value by value."""
    return array.to_numpy(zero_copy_only=False).tolist()


def int_lists(array: pa.ListArray) -> list[list[int]]:
    """Python lists of a list array of numbers without nulls."""
    ends = array.offsets.to_numpy()
    values = array.values.to_numpy()
    return [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def add_columns(
    df: DataFrame,
    text_col: str,
    fields: list[StructField],
    work: Callable[[pa.RecordBatch], list],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (its ``keep`` columns, default all) plus the columns ``fields``
    that ``work`` computes from each piece of rows. A column of ``df`` with
    the name of a new one is replaced. Row order and count stay."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    out = StructType([*kept, *fields])
    names = [f.name for f in kept]
    arrow = to_arrow_schema(out)
    used = df.select(*dict.fromkeys([*names, text_col])) if text_col in df.columns else df

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text_col):
                made = work(piece)
                arrays = [piece.column(n) for n in names]
                arrays += [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(made, list(arrow)[len(names) :])]
                yield pa.RecordBatch.from_arrays(
                    [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow
                )

    return used.mapInArrow(run, out)


def words_of(texts: pa.Array, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space separated words of all texts: per word its position in the
    vocabulary of this piece, the offsets of each text's words (length
    n + 1), and the vocabulary (distinct words in order of appearance).
    ``ascii_only``: only the six ASCII white-space characters separate."""
    lists = pc.ascii_split_whitespace(texts) if ascii_only else pc.utf8_split_whitespace(texts)
    flat = lists.flatten()
    starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = starts - starts[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    vocab = coded.dictionary
    empty = pc.index(vocab, "").as_py() if len(vocab) else -1
    if empty >= 0:  # the splitter gives empty words at the ends of some texts
        keep = codes != empty
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return codes, starts, vocab


def hash_words(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a vocabulary."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings(vocab)), np.uint64, len(vocab))


def window_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words (windows across text ends
    included; the caller masks them)."""
    count = max(0, len(word_hash) - n + 1)
    h = np.full(count, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(n):
        h = (h ^ word_hash[k : k + count]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def window_starts(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ``n``-word windows that lie within one text, and the
    text of each."""
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(starts[-1])
    inside = at + n <= starts[1:][text]
    return at[inside], text[inside]
