"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_BYTES`` bytes; its label says
nothing about which of them earned it. Every passage is encoded (hashed byte
pairs, character classes, repeats; then a learned tanh layer), a gated
attention ``w . (tanh(V h) * sigmoid(U h))`` weighs the passages of the
document, and a logistic unit scores the weighted sum (Ilse, Tomczak & Welling
2018). The document's label alone trains all of it.

Training takes a bounded, documented sample: at most ``fit_per_label``
documents of each label value that are not held out, by smallest hash of their
id (of rows that share an id the one with the smallest text); it runs in blocks on the executors (``mixing``). The sample's label shares
are corrected to those of all labels. Scores depend on the text alone.

Defined cases: a null or empty text is one empty passage; a text of any length
is encoded whole; labels that are null or have no document are ignored, ids
with several labels count as their most common; without both labels in the
training rows every score is the share of label 1, or 0.5 without any; an empty
table has no scores; repeated rows score alike; columns named as a new one are
replaced, others stay whatever their names.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField

from ..session import checkpointed
from . import common, mixing
from .mixing import Adam  # by name: tasks take this class along, not the module and what it imports

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGE_BYTES = 512
PAIR_BUCKETS = 128
REPEAT_SPAN = 8
HIDDEN, ATTENTION = 24, 12
FIT_PER_LABEL = 4000
ROWS_PER_BLOCK = 1000
BLOCK_BYTES = 32 << 20  # of features, as they are packed: four times that in a task
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 5, 8, 32, 0.01, 1e-4
ACCEPT = 0.7

CLASSES = ("upper", "lower", "digit", "space", "newline", "mark", "symbol", "control", "high")
N_FEATURES = PAIR_BUCKETS + len(CLASSES) + 3


def _byte_classes() -> np.ndarray:
    kind = np.full(256, CLASSES.index("control"), np.int64)
    for b in range(32, 127):
        c = chr(b)
        name = (
            "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "space" if c == " "
            else "mark" if c in ".,;:!?'\"()-" else "symbol"
        )
        kind[b] = CLASSES.index(name)
    kind[[9, 10, 13]] = CLASSES.index("space"), CLASSES.index("newline"), CLASSES.index("newline")
    kind[128:] = CLASSES.index("high")
    return kind


BYTE_CLASS = _byte_classes()


def passage_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (float32) and the offset of each text's
    first passage (length n + 1)."""
    data = texts.cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    raw, ends = raw[ends[0] : ends[-1]], ends - ends[0]
    sizes = np.diff(ends)
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.concatenate([[0], np.cumsum(counts)])
    padded = np.zeros(first[-1] * PASSAGE_BYTES, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(first[:-1] * PASSAGE_BYTES - ends[:-1], sizes)] = raw
    padded = padded.reshape(-1, PASSAGE_BYTES)
    length = np.minimum(
        PASSAGE_BYTES, np.repeat(sizes, counts) - PASSAGE_BYTES * (np.arange(first[-1]) - np.repeat(first[:-1], counts))
    )
    out = np.empty((first[-1], N_FEATURES), np.float32)
    step = 1024  # passages at once
    for at in range(0, first[-1], step):
        out[at : at + step] = _encode(padded[at : at + step], length[at : at + step])
    return out, first


def _encode(text: np.ndarray, length: np.ndarray) -> np.ndarray:
    rows = len(text)
    wide = text.astype(np.int64)
    inside = np.arange(PASSAGE_BYTES) < length[:, None]
    row = np.arange(rows)[:, None]
    scale = 1.0 / np.maximum(1, length)[:, None]

    pair = ((wide[:, :-1] * 31 + wide[:, 1:]) * 2654435761 >> 15) % PAIR_BUCKETS
    pair = np.where(inside[:, 1:], pair, PAIR_BUCKETS) + row * (PAIR_BUCKETS + 1)
    pairs = np.bincount(pair.ravel(), minlength=rows * (PAIR_BUCKETS + 1)).reshape(rows, -1)[:, :PAIR_BUCKETS]

    n = len(CLASSES) + 1
    kind = np.where(inside, BYTE_CLASS[text], n - 1) + row * n
    kinds = np.bincount(kind.ravel(), minlength=rows * n).reshape(rows, n)[:, : n - 1]

    # spans of eight bytes that occur earlier in the passage
    spans = np.zeros((rows, PASSAGE_BYTES - REPEAT_SPAN + 1), np.uint64)
    for k in range(REPEAT_SPAN):
        spans = spans * np.uint64(0x100000001B3) + text[:, k : k + spans.shape[1]].astype(np.uint64)
    valid = np.arange(spans.shape[1]) < (length - REPEAT_SPAN + 1)[:, None]
    spans = np.sort(np.where(valid, spans, np.uint64(2**64 - 1)), axis=1)
    n_spans = np.maximum(0, length - REPEAT_SPAN + 1)
    distinct = (spans[:, 1:] != spans[:, :-1]).sum(axis=1) + 1 - (n_spans < spans.shape[1])
    repeated = 1.0 - np.where(n_spans > 0, distinct / np.maximum(1, n_spans), 1.0)

    top = pairs.max(axis=1) * scale[:, 0]
    return np.concatenate(
        [np.sqrt(pairs * scale), np.sqrt(kinds * scale), np.stack([repeated, top, length / PASSAGE_BYTES], axis=1)], axis=1
    ).astype(np.float32)


def _sizes() -> list[tuple[str, tuple[int, ...]]]:
    d, h, a = N_FEATURES, HIDDEN, ATTENTION
    return [("W", (d, h)), ("b", (h,)), ("V", (h, a)), ("bv", (a,)), ("U", (h, a)), ("bu", (a,)), ("w", (a,)), ("c", (h,)), ("c0", (1,))]


def _split(params: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _sizes():
        n = int(np.prod(shape))
        out[name] = params[at : at + n].reshape(shape)
        at += n
    return out


def _start(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([
        (rng.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 else rng.normal(size=s) * 0.1 if n in "wc" else np.zeros(s)).ravel()
        for n, s in _sizes()
    ])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"] + p["bv"]), _sigmoid(h @ p["U"] + p["bu"])
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["c0"][0]}


def loss_and_gradient(params: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of the bags, with weight decay, and its gradient."""
    p = _split(params)
    f = _forward(p, x, first)
    h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
    loss = np.mean(np.logaddexp(0, f["logit"]) - y * f["logit"]) + DECAY / 2 * float(params @ params)
    d = (_sigmoid(f["logit"]) - y) / len(y)
    dz = d[bag][:, None] * p["c"]
    da = (dz * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dg = de[:, None] * p["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    parts = [x.T @ dh, dh.sum(0), h.T @ dt, dt.sum(0), h.T @ ds, ds.sum(0), (t * s).T @ de, f["z"].T @ d, [d.sum()]]
    return loss, np.concatenate([np.ravel(g) for g in parts]) + DECAY * params


@dataclass
class Model:
    """Parameters, the feature scale they were fitted on, and what corrects
    the sample's label shares. ``constant``: the score when nothing could be
    learned."""

    params: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shift: float
    constant: float | None = None

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text and the attention-heaviest passage's position."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), np.zeros(len(texts), np.int64)
        x, first = passage_features(texts)
        f = _forward(_split(self.params), (x - self.mean) / self.scale, first)
        peak = np.maximum.reduceat(f["a"], first[:-1])
        at = np.where(f["a"] == peak[f["bag"]], np.arange(len(x)) - first[:-1][f["bag"]], len(x))
        # matrix products differ in the last bits by a row's place in its batch
        return np.round(_sigmoid(f["logit"] + self.shift), 9), np.minimum.reduceat(at, first[:-1])


def _bags(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(rows["features"].to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(np.float64)
    counts = rows["passages"].to_numpy()
    return x, np.concatenate([[0], np.cumsum(counts)]), rows["label"].to_numpy().astype(np.float64)


def _train(rows: pa.Table, params: np.ndarray, round_: int, mean: np.ndarray, scale: np.ndarray):
    x, first, y = _bags(rows)
    x = (x - mean) / scale
    rng, adam = np.random.default_rng(100 + round_), Adam(len(params), RATE / (1 + round_))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            counts = first[pick + 1] - first[pick]
            ends = np.concatenate([[0], np.cumsum(counts)])
            take = np.arange(ends[-1]) + np.repeat(first[pick] - ends[:-1], counts)
            _, grad = loss_and_gradient(params, x[take], ends, y[pick])
            params = adam.step(params, grad)
    return params, len(y)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_per_label: int = FIT_PER_LABEL,
) -> Model:
    """Fit on at most ``fit_per_label`` documents of each label (0 and 1)."""
    shares = labels.where(f"{label_col} IN (0, 1)").where(~mixing.held_out(F.col(id_col))).groupBy(label_col).count()
    all_counts = {r[0]: r[1] for r in shares.collect()}  # two rows at most
    sample = mixing.label_sample(labels, id_col, label_col, [0, 1], fit_per_label)
    sample = checkpointed(sample.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label")))
    rows = mixing.texts_of(documents, sample, id_col, text_col)
    fields = [StructField("features", BinaryType()), StructField("passages", IntegerType())]

    def encode(piece: pa.RecordBatch) -> list:
        x, first = passage_features(common.clean_texts(piece.column("__text")))
        x = x.astype(np.float16)
        made = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        return [pa.array(made, pa.binary()), pa.array(np.diff(first).astype(np.int32))]

    encoded = checkpointed(common.add_columns(rows, "__text", fields, encode, keep=["__id", "label"]))
    n_docs, size = encoded.agg(F.count(F.lit(1)), F.sum(F.octet_length("features"))).first()
    table = mixing.pack_blocks(encoded, "__id", max(1, -(-n_docs // ROWS_PER_BLOCK), -(-(size or 0) // BLOCK_BYTES)))

    def moments(rows: pa.Table):
        x, _, y = _bags(rows)
        return np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum(), len(y)]]), 1.0

    found = mixing.over_blocks(table, moments)
    sums = sum((v for v, _ in found), np.zeros(2 * N_FEATURES + 3))
    n, ones, docs = sums[-3], sums[-2], sums[-1]
    if not docs or ones in (0, docs):
        constant = 0.5 if not docs else float(ones > 0)
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, constant)
    mean = sums[:N_FEATURES] / n
    scale = np.sqrt(np.maximum(sums[N_FEATURES:-3] / n - mean**2, 1e-4))
    params = mixing.mix(table, _start(), lambda rows, p, r: _train(rows, p, r, mean, scale), ROUNDS)
    shift = np.log(all_counts[1] / all_counts[0]) - np.log(ones / (docs - ones))
    return Model(params, mean, scale, float(shift))


def score(documents: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``score`` (0 to 1), ``predicted`` (1 if the score is
    at least ``ACCEPT``) and ``top_passage``, the position of the passage with
    the largest attention weight. Columns with these names are replaced."""
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("top_passage", IntegerType())]

    def work(piece: pa.RecordBatch) -> list:
        made, top = model.scores(common.clean_texts(piece.column(text_col)))
        return [made, (made >= ACCEPT).astype(np.int32), top.astype(np.int32)]

    return common.add_columns(documents, text_col, fields, work, keep)
