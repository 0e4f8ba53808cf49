from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drillspark.llm import mil, mixing
from drillspark.llm import queries as q
from drillspark.llm.common import table_of
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.01"


def brute_features(data: bytes) -> np.ndarray:
    rows = []
    for at in range(0, max(1, len(data)), mil.PASSAGE_BYTES):
        p = data[at : at + mil.PASSAGE_BYTES]
        n = max(1, len(p))
        pairs, kinds = np.zeros(mil.PAIR_BUCKETS), np.zeros(len(mil.CLASSES))
        for a, b in zip(p, p[1:]):
            pairs[((a * 31 + b) * 2654435761 >> 15) % mil.PAIR_BUCKETS] += 1
        for b in p:
            kinds[mil.BYTE_CLASS[b]] += 1
        spans = [p[i : i + 8] for i in range(len(p) - 7)]
        repeated = 1 - len(set(spans)) / len(spans) if spans else 0.0
        rows.append(np.concatenate([np.sqrt(pairs / n), np.sqrt(kinds / n), [repeated, pairs.max() / n, len(p) / 512]]))
    return np.array(rows)


def test_features_against_brute_force():
    texts = ["", "a", "abcdefgh" * 3, "Ünïcode — tëxt, with 12 marks! " * 60, "x" * 512, "y " * 700]
    got, first = mil.passage_features(pa.array(texts))
    for i, t in enumerate(texts):
        np.testing.assert_allclose(got[first[i] : first[i + 1]], brute_features(t.encode()), atol=1e-6)


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, mil.N_FEATURES)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])
    p = mil._start()
    _, grad = mil.loss_and_gradient(p, x, first, y)
    for i in rng.choice(len(p), 60, replace=False):
        d = np.zeros(len(p))
        d[i] = 1e-6
        slope = (mil.loss_and_gradient(p + d, x, first, y)[0] - mil.loss_and_gradient(p - d, x, first, y)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    return mil.fit(table_of(spark, SF, "documents"), table_of(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    d = table_of(spark, SF, "documents")
    out = mil.score(d, model, keep=["doc_id"]).withColumn("h", mixing.held_out(F.col("doc_id"))).where("h")
    rows = out.join(table_of(spark, SF, "labels"), "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.97


def test_score_depends_on_text_alone_and_edges(spark, model):
    texts = [None, "", "same text here", "same text here", "z" * 200_000]
    a = mil.score(docs(spark, texts), model).orderBy("doc_id").collect()
    b = mil.score(docs(spark, texts, ids=[50, 40, 30, 20, 10], lang="fr"), model).orderBy("doc_id", ascending=False).collect()
    assert all(0 <= r.score <= 1 for r in a)
    assert a[0].score == a[1].score and a[2].score == a[3].score
    assert [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-8)
    assert mil.score(docs(spark, texts).limit(0), model).count() == 0


def test_attention_finds_the_odd_passage(spark, model):
    d = table_of(spark, SF, "documents").join(table_of(spark, SF, "labels").where("quality = 1"), "doc_id")
    clean = max((r.text for r in d.select("text").collect()), key=len)[:4096]
    spoiled = clean[:2048] + "SPAM!! BUY!! NOW!! " * 27 + clean[2048:]
    got = mil.score(docs(spark, [spoiled]), model).first()
    assert 0 <= got.top_passage < 10


def test_no_labels_or_one_label(spark):
    d = docs(spark, ["a b c", "d e f"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in mil.score(d, mil.fit(d, none)).collect()} == {0.5}
    only = spark.createDataFrame([(0, 1, 0), (1, 1, None), (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in mil.score(d, mil.fit(d, only)).collect()} == {1.0}


def test_sample_is_bounded_and_leaves_held_out_alone(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 0), (1, 0)], "doc_id long, quality int")
    got = mixing.label_sample(labels, "doc_id", "quality", [0, 1], 50).collect()
    assert len(got) == 100 and len({r.doc_id for r in got}) == 100
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)


def test_query(spark):
    out = q.QUERIES["op10_attention_quality"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and all(r.predicted == int(r.score >= 0.7) for r in out)


def plain_forward(p, passages):
    """Logit of one document from its (scaled) passages, number by number."""
    e, hs = [], []
    for x in passages:
        h = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x)) if x[i]) + p["b"][j]) for j in range(mil.HIDDEN)]
        gate = 0.0
        for j in range(mil.ATTENTION):
            t = math.tanh(sum(h[i] * p["V"][i, j] for i in range(mil.HIDDEN)) + p["bv"][j])
            s = 1 / (1 + math.exp(-sum(h[i] * p["U"][i, j] for i in range(mil.HIDDEN)) - p["bu"][j]))
            gate += t * s * p["w"][j]
        e.append(gate)
        hs.append(h)
    a = [math.exp(v - max(e)) for v in e]
    z = [sum(a[k] * hs[k][i] for k in range(len(hs))) / sum(a) for i in range(mil.HIDDEN)]
    return sum(z[i] * p["c"][i] for i in range(mil.HIDDEN)) + p["c0"][0], a.index(max(a))


def test_fit_and_scores_by_plain_steps(spark, monkeypatch):
    """300 documents: features byte by byte, the training steps again with one document
    at a time, and every score number by number."""
    packed = []
    pack = mixing.pack_blocks
    monkeypatch.setattr(mixing, "pack_blocks", lambda *a: packed.append(pack(*a)) or packed[-1])
    monkeypatch.setattr(mil, "ROUNDS", 2)
    monkeypatch.setattr(mil, "EPOCHS", 2)
    monkeypatch.setattr(mil, "ROWS_PER_BLOCK", 120)
    d = table_of(spark, "/root/testdata/sf0.01", "documents").where("length(text) < 3000").orderBy("doc_id").limit(300)
    rows = {r.doc_id: r.text for r in d.collect()}
    labels = spark.createDataFrame([(i, int("the" in (t or ""))) for i, t in rows.items()], "doc_id long, quality int")
    m = mil.fit(d, labels)

    blocks = [pa.ipc.open_stream(bytes(r.block)).read_all().to_pylist() for r in packed[0].collect()]
    assert len(blocks) > 1
    want = {i: brute_features((t or "").encode()) for i, t in rows.items()}
    seen = [r for b in blocks for r in b]
    assert sorted(r["__id"] for r in seen) == sorted(i for i in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    for r in seen:
        x = np.frombuffer(r["features"], np.float16).reshape(-1, mil.N_FEATURES)
        np.testing.assert_allclose(x, want[r["__id"]], atol=2e-3)
    every = np.concatenate([np.frombuffer(r["features"], np.float16).reshape(-1, mil.N_FEATURES) for r in seen]).astype(float)
    np.testing.assert_allclose(m.mean, every.mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(m.scale, np.maximum(every.std(axis=0), 1e-2), atol=1e-6)

    params = mil._start()
    for round_ in range(2):
        made = []
        for b in blocks:
            p, m1, m2, t = params.copy(), 0.0, 0.0, 0
            rng = np.random.default_rng(100 + round_)
            xs = [(np.frombuffer(r["features"], np.float16).reshape(-1, mil.N_FEATURES).astype(float) - m.mean) / m.scale for r in b]
            for _ in range(2):
                order = rng.permutation(len(b))
                for at in range(0, len(order), mil.BATCH):
                    pick = order[at : at + mil.BATCH]
                    # one document at a time; its gradient is checked against differences elsewhere
                    grads = [mil.loss_and_gradient(p, xs[k], np.array([0, len(xs[k])]), np.array([float(b[k]["label"])]))[1] for k in pick]
                    grad = sum(g - mil.DECAY * p for g in grads) / len(pick) + mil.DECAY * p
                    t += 1
                    m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
                    p = p - mil.RATE / (1 + round_) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            made.append((p, len(b)))
        params = sum(p * w for p, w in made) / sum(w for _, w in made)
    assert np.median(np.abs(params - m.params)) < 1e-4

    split = mil._split(m.params)
    for r in mil.score(d, m, keep=["doc_id"]).collect():
        scaled = (np.float32(want[r.doc_id]) - m.mean) / m.scale
        logit, top = plain_forward(split, scaled.tolist())
        assert r.score == pytest.approx(1 / (1 + math.exp(-(logit + m.shift))), abs=1e-5) and r.top_passage == top


def test_blocks_by_bytes_and_one_text_an_id(spark, monkeypatch):
    """A repeated id counts once; documents of 4 MB make blocks of their own."""
    monkeypatch.setattr(mil, "BLOCK_BYTES", 1 << 20)
    monkeypatch.setattr(mil, "ROUNDS", 1)
    packed = []
    pack = mixing.pack_blocks
    monkeypatch.setattr(mixing, "pack_blocks", lambda *a: packed.append(a[2]) or pack(*a))
    texts = ["spam! " * 700_000 + str(i) for i in range(4)] + ["clean words here"] * 3000
    d = docs(spark, texts, [0, 1, 3, 4, *[5] * 3000])
    labels = spark.createDataFrame([(0, 0), (1, 0), (3, 0), (4, 0), (5, 1)], "doc_id long, quality int")
    mil.fit(d, labels, fit_per_label=5)
    assert packed[0] >= 4
