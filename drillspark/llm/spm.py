"""SentencePiece encoding and decoding over a table of distinct chunks.

The model marks every space as U+2581 and none of its pieces holds a marker
after another character, so no piece, and no merge, crosses the start of a run
of markers. A text is therefore cut before each such run, each distinct chunk
(a run of markers and what follows) is segmented once by the library, and the
ids are joined back by position. The result is the library's own, token for
token; a model whose pieces do cross markers is refused.

The table belongs to a task and grows over all the texts the task reads, up to
``TABLE_CHUNKS`` chunks, when it is begun anew: memory is bounded and nothing
is shuffled. (One table for all tasks would need a shuffle of the distinct
chunks of every block of text and back, more bytes than the texts compressed;
segmenting a word again in another task is cheaper.)

Defined cases: a null text is encoded as the empty text, which has no ids; a
text of any length is encoded whole; repeated rows give equal ids.
"""

from __future__ import annotations

import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from . import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
TABLE_CHUNKS = 150_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> None:
    """Refuse a model for which chunks are not independent: pieces with a
    marker after another character, or a normaliser that changes texts."""
    sp = load(model)
    inner = re.compile(f"[^{MARK}]{MARK}")
    crossing = [p for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if inner.search(p)]
    if crossing:
        raise ValueError(f"pieces cross white-space markers, such as {crossing[0]!r}")
    probe = "  a  ▁b\tＡéé\n c "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model normalises texts; chunks cannot be taken from them as they are")


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker."""
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []


def chunk_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``common.words_of``, for chunks: per chunk its number, the offsets
    of each text's chunks, and the distinct chunks."""
    hard = pc.or_(
        pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)),
        pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.equal(pc.binary_length(texts), 0)),
    ).to_numpy(zero_copy_only=False)
    easy = np.flatnonzero(~hard)
    split = pc.split_pattern(texts.take(pa.array(easy)), " ")
    rest = [chunks(t) for t in texts.take(pa.array(np.flatnonzero(hard))).to_pylist()]
    counts = np.zeros(len(texts), np.int64)
    counts[easy] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    counts[hard] = [len(r) for r in rest]
    flat = pa.concat_arrays([split.flatten(), pa.array([c for r in rest for c in r], pa.string())])
    coded = flat.dictionary_encode()
    # back into text order
    starts = np.concatenate([[0], np.cumsum(counts)])
    order = np.concatenate([easy, np.flatnonzero(hard)])
    target = np.repeat(starts[order], counts[order]) + _within(counts[order])
    codes = np.empty(len(flat), np.int64)
    codes[target] = coded.indices.to_numpy(zero_copy_only=False)
    return codes, starts, coded.dictionary


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Table:
    """The distinct chunks met so far and their ids."""

    def __init__(self, model: bytes, most: int = TABLE_CHUNKS):
        self.sp, self.most = load(model), most
        self.marker = self.sp.piece_to_id(MARK)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def look_up(self, vocab: list[str]) -> np.ndarray:
        """The table row of each chunk; new chunks are segmented now."""
        if len(self.rows) > self.most:
            self._clear()
        new = [c for c in vocab if c not in self.rows]
        if new:
            # the library itself puts the first marker; of an empty text it makes nothing
            made = [ids if c else [self.marker] for c, ids in zip(new, self.sp.encode(new, num_threads=1))]
            first = len(self.rows)
            self.rows.update(zip(new, range(first, first + len(new))))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))])
        return np.fromiter(map(self.rows.__getitem__, vocab), np.int64, len(vocab))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        codes, starts, vocab = chunk_lists(texts)
        rows = self.look_up(common.strings(vocab))[codes]
        sizes = self.at[rows + 1] - self.at[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.at[rows], sizes) + _within(sizes)]
        return pa.ListArray.from_arrays(pa.array(ends[starts].astype(np.int32)), pa.array(ids, pa.int32()))


def encode(
    df: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None, decode: bool = False
) -> DataFrame:
    """``df`` with ``ids`` (array of int) and, if asked for, ``decoded``: the
    library's decoding of these ids. Columns of these names are replaced."""
    check_model(model)
    fields = [StructField("ids", ArrayType(IntegerType(), False))]
    if decode:
        fields.append(StructField("decoded", StringType()))
    table: list[Table] = []  # one for each task's copy of this function

    def work(piece: pa.RecordBatch) -> list:
        if not table:
            table.append(Table(model))
        ids = table[0].encode(common.clean_texts(piece.column(text_col)))
        if not decode:
            return [ids]
        return [ids, pa.array(table[0].sp.decode(common.int_lists(ids), num_threads=1), pa.string())]

    return common.add_columns(df, text_col, fields, work, keep)


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the library's decoding of an array of ids; null as empty."""
    kept = [f for f in df.schema.fields if f.name != name]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*kept, StructField(name, StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        sp = load(model)
        for batch in batches:
            lists = [x or [] for x in batch.column(ids_col).to_pylist()]
            made = pa.array(sp.decode(lists, num_threads=1) if lists else [], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], made], schema=arrow)

    return df.mapInArrow(run, schema)
