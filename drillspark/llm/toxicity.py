"""Toxicity severity by cumulative-link ordinal regression.

Grades 0, 1, ..., K are ordered: 0 is not toxic, the others mild to severe. One
weight vector over sparse word counts is shared by all thresholds,

    P(grade >= k) = sigmoid(w . x - theta_k),   theta_1 < theta_2 < ...,

and the expected severity is the sum of these probabilities (McCullagh 1980).

The label is only toxic or not. Words are kept as features when their document
counts among toxic and other documents differ by ``LEAST_Z`` standard errors of the
log odds ratio. Grades of toxic training documents come from their evidence: how
many of their words argue for toxicity, split into ``LEVELS`` grades at its
quantiles. Whether a word argues for toxicity in a document is judged by the
documents of the other half of the sample, so no document is graded by words that
were chosen on it. No label says how severe a text is: grades are ranks of that
evidence, no more. (The share of such words, which does not grow with a text's length,
was tried for grades: of held-out toxic documents 66 % were found instead of 85 %, as
the weights, shared by all thresholds, then have to call long toxic texts harmless.)

Training takes a bounded, documented sample: at most ``fit_per_label`` not
held-out documents of each label, by smallest hash of the id, weighted so that
both labels count alike (toxic documents are rare, and to be found); of rows that
share an id the one with the smallest text. It runs in blocks on the executors (``mixing``).
Scores depend on the text alone.

Defined cases: a null or empty text has no features and gets the score of
none; repeated rows score alike; a text of any length is read whole; null
labels and ids are ignored; without toxic or without other documents all
severities are 0; an empty table has no scores; columns named as a new one are
replaced, others stay whatever their names.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import checkpointed
from . import common, mixing
from .mixing import Adam  # by name: tasks take this class along, not the module and what it imports

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = 3
LEAST_Z = 3.0
LEAST_DOCS = 4
FIT_PER_LABEL = 5000
ROWS_PER_BLOCK = 2000
BLOCK_FEATURES = 4_000_000  # in a block: some 100 MB in a task
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 6, 15, 64, 0.1, 1e-5
FLAG = 0.6
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_counts(texts: pa.Array) -> list[Counter]:
    """Counts of each text's words, lower case, without outer punctuation."""
    codes, starts, vocab = common.words_of(texts)
    names = [w.lower().strip(PUNCTUATION) for w in common.strings(vocab)]
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        have, n = np.unique(codes[a:b], return_counts=True)
        counts: Counter = Counter()
        for c, k in zip(have.tolist(), n.tolist()):
            if names[c]:
                counts[names[c]] += k
        out.append(counts)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _thresholds(tail: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first and the logs of the steps."""
    return np.cumsum(np.concatenate([tail[:1], np.exp(tail[1:])]))


def at_least(eta: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... (rows: documents)."""
    return _sigmoid(eta[:, None] - theta[None, :])


def loss_and_gradient(params, rows, cols, values, n_words, grade, weight):
    """Weighted mean negative log likelihood and its gradient. ``rows``,
    ``cols``, ``values``: the sparse features; the last parameters are the
    first threshold and the logs of the steps."""
    w, tail = params[:n_words], params[n_words:]
    theta = _thresholds(tail)
    eta = np.bincount(rows, values * w[cols], len(grade))
    up = np.concatenate([np.ones((len(grade), 1)), at_least(eta, theta), np.zeros((len(grade), 1))], axis=1)
    at = np.arange(len(grade))
    high, low = up[at, grade], up[at, grade + 1]
    p = np.maximum(high - low, 1e-12)
    share = weight / weight.sum()
    loss = -(share * np.log(p)).sum() + DECAY / 2 * float(w @ w)
    d_high, d_low = high * (1 - high), low * (1 - low)
    d_eta = -share * (d_high - d_low) / p
    d_theta = np.zeros(len(theta) + 2)
    np.add.at(d_theta, grade, share * d_high / p)
    np.add.at(d_theta, grade + 1, -share * d_low / p)
    d_theta = d_theta[1:-1]
    tails = np.cumsum(d_theta[::-1])[::-1]  # a step moves every later threshold
    d_tail = np.concatenate([tails[:1], tails[1:] * np.exp(tail[1:])])
    d_w = np.bincount(cols, d_eta[rows] * values, n_words) + DECAY * w
    return loss, np.concatenate([d_w, d_tail])


def _block(rows: pa.Table):
    cols = rows["cols"].combine_chunks()
    sizes = np.diff(cols.offsets.to_numpy())
    at = np.concatenate([[0], np.cumsum(sizes)])
    return (
        at, cols.flatten().to_numpy(), rows["values"].combine_chunks().flatten().to_numpy(),
        rows["grade"].to_numpy(), rows["weight"].to_numpy(),
    )


def _train(rows: pa.Table, params: np.ndarray, round_: int, n_words: int):
    at, cols, values, grade, weight = _block(rows)
    rng, adam = np.random.default_rng(300 + round_), Adam(len(params), RATE / (1 + round_))
    for _ in range(EPOCHS):
        order = rng.permutation(len(grade))
        for first in range(0, len(order), BATCH):
            pick = order[first : first + BATCH]
            sizes = at[pick + 1] - at[pick]
            ends = np.cumsum(sizes)
            take = np.arange(ends[-1]) + np.repeat(at[pick] - (ends - sizes), sizes)
            owner = np.repeat(np.arange(len(pick)), sizes)
            _, grad = loss_and_gradient(params, owner, cols[take], values[take], n_words, grade[pick], weight[pick])
            params = adam.step(params, grad)
    return params, len(grade)


@dataclass
class Model:
    """Feature words with their weights, and the thresholds."""

    words: dict[str, int]
    weights: np.ndarray
    theta: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) of each text."""
        codes, starts, vocab = common.words_of(texts)
        known = np.array([self.words.get(w.lower().strip(PUNCTUATION), -1) for w in common.strings(vocab)], np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        word = known[codes] if len(codes) else np.zeros(0, np.int64)
        hit = word >= 0
        pair, n = np.unique(doc[hit] * (len(self.weights) + 1) + word[hit], return_counts=True)
        doc, word = pair // (len(self.weights) + 1), pair % (len(self.weights) + 1)
        eta = np.bincount(doc, np.log1p(n) * self.weights[word], len(texts))
        return at_least(eta, self.theta)


def z_score(t: Column, o: Column, toxic: int, other: int) -> Column:
    """Log odds ratio of a word in ``t`` of ``toxic`` and ``o`` of ``other`` documents, in
    standard errors."""
    rest_t, rest_o = F.lit(toxic) - t + 0.5, F.lit(other) - o + 0.5
    t, o = t + 0.5, o + 0.5
    return (F.log(t / rest_t) - F.log(o / rest_o)) / F.sqrt(1 / t + 1 / o + 1 / rest_t + 1 / rest_o)


def choose_words(counts: DataFrame, docs: dict[tuple[int, int], int]) -> DataFrame:
    """Feature words (word, bad0, bad1), from (word, t0, o0, t1, o1): in how many toxic and
    other documents of each half it occurs; ``docs``: their numbers by (label, half).
    ``bad0`` says whether the documents of half 1 take it for toxic, ``bad1`` those of
    half 0. Bounded by the sample: each word is in ``LEAST_DOCS`` of its documents."""
    n = lambda label, *halves: sum(docs.get((label, h), 0) for h in halves)
    whole = z_score(F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1"), n(1, 0, 1), n(0, 0, 1))
    sides = [(z_score(F.col(f"t{h}"), F.col(f"o{h}"), n(1, h), n(0, h)) > 0).alias(f"bad{1 - h}") for h in (0, 1)]
    often = counts.where(F.expr("t0 + t1 + o0 + o1") >= LEAST_DOCS)
    return often.where(F.abs(whole) >= LEAST_Z).select("word", *sides)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_per_label: int = FIT_PER_LABEL,
) -> Model:
    """Fit on at most ``fit_per_label`` documents of each label (0 and 1)."""
    none = Model({}, np.zeros(0), np.full(LEVELS, np.inf))
    sample = mixing.label_sample(labels, id_col, label_col, [0, 1], fit_per_label)
    sample = checkpointed(sample.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")))
    half = F.pmod(F.xxhash64("__id"), F.lit(2)).cast("int")
    texts = checkpointed(mixing.texts_of(documents, sample, id_col, text_col).withColumn("half", half))
    by_half = {(r[0], r[1]): r[2] for r in texts.groupBy("label", "half").count().collect()}
    found = {label: sum(n for (k, _), n in by_half.items() if k == label) for label, _ in by_half}
    if len(found) < 2:
        return none

    pair = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def count(piece: pa.RecordBatch) -> list:
        counts = word_counts(common.clean_texts(piece.column("__text")))
        return [[[{"word": w, "n": n} for w, n in c.items()] for c in counts]]

    counted = checkpointed(
        common.add_columns(texts, "__text", [StructField("counts", ArrayType(pair))], count, keep=["__id", "label", "half"])
    )
    by_word = counted.select("label", "half", F.explode("counts.word").alias("word")).groupBy("word")
    sums = {f"{kind}{h}": F.count(F.when((F.col("label") == k) & (F.col("half") == h), 1)) for kind, k in (("t", 1), ("o", 0)) for h in (0, 1)}
    chosen = choose_words(by_word.agg(*[c.alias(n) for n, c in sums.items()]), by_half).collect()
    words = {w: i for i, w in enumerate(sorted(r.word for r in chosen))}
    if not words:
        return none

    # how many words argue for toxicity, and the quantiles of that among toxic documents
    rows = [(r.word, words[r.word], r.bad0, r.bad1) for r in chosen]
    table = counted.sparkSession.createDataFrame(rows, "word string, col int, bad0 boolean, bad1 boolean")
    bad = F.when(F.col("half") == 0, F.col("bad0")).otherwise(F.col("bad1"))
    hits = (
        counted.select("__id", "label", "half", F.explode_outer("counts").alias("c"))
        .select("__id", "label", "half", "c.word", "c.n")
        .join(table, "word", "left")
        .groupBy("__id", "label")
        .agg(
            F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad"),
            F.sort_array(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", F.log1p("n").alias("v"))))).alias("x"),
        )
    )
    hits = checkpointed(hits)
    cuts = hits.where("label = 1 AND bad > 0").approxQuantile("bad", [k / LEVELS for k in range(1, LEVELS)], 0.001)
    grade = F.when(F.col("label") == 0, 0).otherwise(1 + sum((F.when(F.col("bad") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    weight = F.when(F.col("label") == 1, 1.0 / found[1]).otherwise(1.0 / found[0])
    rows = hits.select(
        "__id",
        F.col("x.col").alias("cols"),
        F.col("x.v").alias("values"),
        grade.cast("long").alias("grade"),
        weight.cast("double").alias("weight"),
    )
    n_docs, features = rows.agg(F.count(F.lit(1)), F.sum(F.size("cols"))).first()
    packed = mixing.pack_blocks(rows, "__id", max(1, -(-n_docs // ROWS_PER_BLOCK), -(-(features or 0) // BLOCK_FEATURES)))
    start = np.concatenate([np.zeros(len(words)), [1.0], np.zeros(LEVELS - 1)])
    params = mixing.mix(packed, start, lambda r, p, k: _train(r, p, k, len(words)), ROUNDS)
    return Model(words, params[: len(words)], _thresholds(params[len(words) :]))


def score(documents: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``expected_severity`` (0 to ``LEVELS``), ``severity``
    (the likeliest grade), ``toxic_score`` (P(grade >= 1)) and ``toxic`` (that is
    at least ``FLAG``). Columns with these names are replaced."""
    fields = [
        StructField("expected_severity", DoubleType()),
        StructField("severity", IntegerType()),
        StructField("toxic_score", DoubleType()),
        StructField("toxic", BooleanType()),
    ]

    def work(piece: pa.RecordBatch) -> list:
        up = model.score(common.clean_texts(piece.column(text_col)))
        each = np.concatenate([np.ones((len(up), 1)), up], axis=1) - np.concatenate([up, np.zeros((len(up), 1))], axis=1)
        return [up.sum(axis=1), each.argmax(axis=1).astype(np.int32), up[:, 0], up[:, 0] >= FLAG]

    return common.add_columns(documents, text_col, fields, work, keep)
