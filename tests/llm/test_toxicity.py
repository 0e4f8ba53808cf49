from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drillspark.llm import mixing, toxicity
from drillspark.llm import queries as q
from drillspark.llm.common import table_of
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.1"


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    rows, cols = np.array([0, 0, 1, 2, 3, 3]), np.array([0, 2, 1, 2, 0, 1])
    values, grade, weight = rng.random(6), np.array([0, 1, 3, 2]), rng.random(4)
    p = np.concatenate([rng.normal(size=3), [0.3, -0.2, 0.1]])
    args = rows, cols, values, 3, grade, weight
    _, grad = toxicity.loss_and_gradient(p, *args)
    for i in range(len(p)):
        d = np.zeros(len(p))
        d[i] = 1e-6
        slope = (toxicity.loss_and_gradient(p + d, *args)[0] - toxicity.loss_and_gradient(p - d, *args)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-6)


def test_thresholds_stay_ordered_and_shared_weights():
    theta = toxicity._thresholds(np.array([0.5, -3.0, 2.0]))
    assert (np.diff(theta) > 0).all()
    m = toxicity.Model({"bad": 0, "nice": 1}, np.array([3.0, -3.0]), theta)
    up = m.score(pa.array(["bad bad", "bad", "", "nice", "BAD!! nice"]))
    assert (np.diff(up, axis=1) < 0).all()  # P(grade >= k) falls with k
    expected = up.sum(axis=1)
    assert expected[0] > expected[1] > expected[2] > expected[3] and expected[4] == pytest.approx(expected[2])


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(table_of(spark, SF, "documents"), table_of(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    d = table_of(spark, SF, "documents").select("doc_id", "text")
    labels = table_of(spark, SF, "labels").select("doc_id", F.col("toxic").alias("y"))
    rows = toxicity.score(d, model, keep=["doc_id"]).where(mixing.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.y == 1]
    clean = [r for r in rows if r.y == 0]
    assert np.mean([r.toxic for r in toxic]) > 0.8  # a tenth of the toxic labels have no toxic word
    assert np.mean([r.toxic for r in clean]) < 0.01
    assert np.mean([t.expected_severity > c.expected_severity for t in toxic for c in clean]) > 0.93


def test_grades_follow_the_evidence(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(900):
        words = rng.choices(plain, k=30)
        bad = 0 if i % 5 < 2 else rng.randint(*[(1, 4), (5, 8), (9, 12)][i % 5 - 2])
        words[:bad] = rng.choices(["vile", "rotten", "awful"], k=bad)
        texts.append(" ".join(words))
        labels.append((i, 1, int(bad > 0)))
    m = toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: r for r in toxicity.score(docs(spark, texts), m).collect()}
    mean = [np.mean([rows[i].expected_severity for i in rows if i % 5 == k]) for k in range(5)]
    assert mean[1] < 0.3 < mean[2] < mean[3] < mean[4] and mean[4] > 2
    assert all(0 <= r.expected_severity <= toxicity.LEVELS and 0 <= r.severity <= toxicity.LEVELS for r in rows.values())


def test_edges(spark, model):
    texts = [None, "", "trash idiot scum", "trash idiot scum", "fine " * 60_000]
    d = docs(spark, texts).withColumn("toxic", F.lit("mine"))
    rows = toxicity.score(d, model).orderBy("doc_id").collect()
    assert rows[0].expected_severity == rows[1].expected_severity and not rows[0].toxic
    assert rows[2].toxic and rows[2].expected_severity == rows[3].expected_severity
    assert toxicity.score(d.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    d = docs(spark, ["a b", "c d"])
    for rows in ([], [(0, 1, 1)], [(0, 1, 0), (1, None, None), (None, 1, 1)]):
        m = toxicity.fit(d, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert {(r.expected_severity, r.toxic) for r in toxicity.score(d, m).collect()} == {(0.0, False)}


def test_query(spark):
    out = q.QUERIES["op2_ordinal_toxicity"](spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and {"doc_id", "held_out", "expected_severity", "severity", "toxic"} <= set(out.columns)


def plain_scores(words, weights, theta, text):
    """P(grade >= k) of one text, word by word."""
    counts = {}
    for w in (text or "").split():
        w = w.lower().strip(toxicity.PUNCTUATION)
        if w in words:
            counts[w] = counts.get(w, 0) + 1
    eta = sum(math.log1p(n) * weights[words[w]] for w, n in counts.items())
    return [1 / (1 + math.exp(t - eta)) for t in theta]


def test_fit_and_scores_by_plain_steps(spark, monkeypatch):
    """Training again on the packed blocks, document by document with numeric
    derivatives of the likelihood alone, and every score word by word."""
    packed = []
    pack = mixing.pack_blocks
    monkeypatch.setattr(mixing, "pack_blocks", lambda *a: packed.append(pack(*a)) or packed[-1])
    for name, value in (("ROUNDS", 2), ("EPOCHS", 2), ("BATCH", 40)):
        monkeypatch.setattr(toxicity, name, value)
    d = table_of(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").limit(300)
    texts = [(r.doc_id, r.text) for r in d.collect()]
    vile = [f"{t or ''} vile{i % 3} vile{i % 5} awful" if i % 4 == 0 else t for i, (_, t) in enumerate(texts)]
    docs_ = docs(spark, vile, [i for i, _ in texts])
    labels = spark.createDataFrame([(i, int(k % 4 == 0)) for k, (i, _) in enumerate(texts)], "doc_id long, toxic int")
    m = toxicity.fit(docs_, labels)
    assert {"vile0", "awful"} <= set(m.words)

    blocks = []
    for r in packed[0].collect():
        rows = pa.ipc.open_stream(bytes(r.block)).read_all().to_pylist()
        blocks.append(rows)
    assert sorted(r["__id"] for b in blocks for r in b) == sorted(i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 != 2)
    n = len(m.words)

    def loss(p, rows):
        theta, total, share = toxicity._thresholds(p[n:]), 0.0, sum(r["weight"] for r in rows)
        for r in rows:
            eta = sum(v * p[c] for c, v in zip(r["cols"], r["values"]))
            up = [1.0, *[1 / (1 + math.exp(t - eta)) for t in theta], 0.0]
            total -= r["weight"] / share * math.log(max(up[r["grade"]] - up[r["grade"] + 1], 1e-12))
        return total + toxicity.DECAY / 2 * float(p[:n] @ p[:n])

    params = np.concatenate([np.zeros(n), [1.0], np.zeros(toxicity.LEVELS - 1)])
    for round_ in range(2):
        made = []
        for rows in blocks:
            p, m1, m2, t = params.copy(), 0.0, 0.0, 0
            rng = np.random.default_rng(300 + round_)
            for _ in range(2):
                order = rng.permutation(len(rows))
                for at in range(0, len(order), 40):
                    batch = [rows[k] for k in order[at : at + 40]]
                    touched = sorted({c for r in batch for c in r["cols"]}) + list(range(n, len(p)))
                    grad = np.concatenate([toxicity.DECAY * p[:n], np.zeros(toxicity.LEVELS)])
                    for k in touched:
                        e = np.zeros(len(p))
                        e[k] = 1e-5
                        grad[k] = (loss(p + e, batch) - loss(p - e, batch)) / 2e-5
                    t += 1
                    m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
                    p = p - toxicity.RATE / (1 + round_) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            made.append((p, len(rows)))
        params = sum(p * w for p, w in made) / sum(w for _, w in made)
    far = np.abs(params[:n] - m.weights)
    assert np.median(far) < 1e-3 and np.abs(toxicity._thresholds(params[n:]) - m.theta).max() < 0.02

    for r in toxicity.score(docs_, m).collect():
        up = plain_scores(m.words, m.weights, m.theta, r.text)
        assert r.expected_severity == pytest.approx(sum(up), abs=1e-9) and r.toxic == (r.toxic_score >= toxicity.FLAG)
        each = [a - b for a, b in zip([1.0, *up], [*up, 0.0])]
        assert each[r.severity] == pytest.approx(max(each), abs=1e-9)


def test_one_text_an_id_and_words_beyond_any_count(spark):
    """An id with thousands of rows counts once; there is no cap on feature words."""
    toxic = " ".join(f"bad{i}" for i in range(21_000))
    d = docs(spark, [toxic] * 8 + ["fine words"] * 8 + ["fine words again"] * 3000, [*range(100, 116), *[115] * 3000])
    labels = spark.createDataFrame([(i, int(i < 108)) for i in range(100, 116)], "doc_id long, toxic int")
    sample = spark.createDataFrame([(i, int(i < 108)) for i in range(100, 116)], "__id long, label int")
    rows = mixing.texts_of(d, sample, "doc_id", "text").collect()
    assert len(rows) == 16 and {r["__text"] for r in rows if r["__id"] == 115} == {"fine words"}
    old = toxicity.LEAST_Z
    toxicity.LEAST_Z = 0.5
    try:
        assert len(toxicity.fit(d, labels).words) > 20_500
    finally:
        toxicity.LEAST_Z = old
