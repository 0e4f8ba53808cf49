from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from drillspark.llm import decontamination as dc
from drillspark.llm import queries as q
from tests.llm.helpers import docs


def brute(texts, items, threshold=dc.THRESHOLD, least=dc.OVERLAP):
    """{(text position, item id): (first word, score, overlaps)} by scoring
    every passage against every item."""
    bags = {i: [dc.term(w) for w in (t or "").split()] for i, t in items}
    full = {i: b for i, b in bags.items() if b}
    n, mean = len(full), sum(map(len, full.values())) / len(full)
    df = Counter(w for b in full.values() for w in set(b))

    def weight(w, b):
        tf, idf = b.count(w), math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        return idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(b) / mean))

    weights = {i: {w: weight(w, b) for w in set(b)} for i, b in full.items()}
    stride = max(dc.LEAST_STRIDE, max(map(len, full.values())))
    out = {}
    for k, text in enumerate(texts):
        words = [dc.term(w) for w in (text or "").split()]
        segments = -(-len(words) // stride)
        for first in range(0, max(1, segments - 1)):
            passage = words[first * stride : (first + 2) * stride]
            have = set(passage)
            for i, ws in weights.items():
                score = sum(x for w, x in ws.items() if w in have) / sum(ws.values())
                if score >= threshold - 1e-9:
                    question, answer = dc.split_item(dict(items)[i])
                    a, b = dc.overlap(question, passage), dc.overlap(answer, passage)
                    if a >= least and b >= least:
                        best = out.get((k, i))
                        if best is None or (a + b, score) > (best[2] + best[3], best[1] + 1e-9):
                            out[k, i] = (first * stride, score, a, b)
    return out


@pytest.fixture(scope="module")
def data():
    items = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in items] + [(900, None), (901, ""), (902, "Solo"), (903, "What is the capital of the old province?\nAnswer: the harbour town")]
    rng = random.Random(2)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:150]
    for i, t in items[:12]:
        host = texts[rng.randrange(100)].split()
        at = rng.randrange(len(host))
        words = t.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(host[:at] + words + host[at:]))
    texts += [None, "", "x", "What is the CAPITAL of the old province, then? the harbour town!", items[3][1] + " " + items[4][1]]
    return texts, items


def run(spark, data, **options):
    texts, items = data
    index = dc.build_index(spark.createDataFrame(items, "item_id long, text string"))
    out = dc.find_matches(docs(spark, texts), index, keep=["doc_id"], **options).collect()
    assert len(out) == len(texts)
    return {(r.doc_id, m.item_id): (m.first_word, m.bm25, m.question_overlap, m.answer_overlap) for r in out for m in r.matches}


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-6)


def test_against_brute_force(spark, data):
    want = brute(*data)
    assert len(want) >= 12
    same(run(spark, data), want)


def test_low_threshold_many_hits(spark, data):
    same(run(spark, data, threshold=0.3, least=0.0), brute(*data, threshold=0.3, least=0.0))


def test_many_shards_and_parts(spark, data, monkeypatch):
    monkeypatch.setattr(dc, "SHARD_ITEMS", 9)
    same(run(spark, data, ship_bytes=1), brute(*data))


def test_an_item_of_many_terms_is_held_once(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(2_000)]
    items = [(k, " ".join(rng.sample(words, 900)) + f" end{k}.") for k in range(300)]
    rows = spark.createDataFrame([(k, k, t) for k, t in items], "uid long, item_id long, text string")
    found = dc._item_terms(rows)
    assert "text" not in found.columns and found.count() == 300 * 901
    index = dc.build_index(rows)
    assert len(index.sizes) == 2  # 270,300 postings
    assert sum(index.sizes.values()) < 3 * sum(len(t) for _, t in items)
    out = dc.find_matches(docs(spark, [items[7][1], "other " + items[250][1]]), index, keep=["doc_id"]).collect()
    assert [[m.item_id for m in r.matches] for r in sorted(out, key=lambda r: r.doc_id)] == [[7], [250]]


def test_shards_by_bytes_and_postings(spark, data, monkeypatch):
    want = brute(*data)
    for name in ("SHARD_BYTES", "SHARD_POSTINGS"):
        with monkeypatch.context() as m:
            m.setattr(dc, name, 300)
            index = dc.build_index(spark.createDataFrame(data[1], "item_id long, text string"))
            assert len(index.sizes) > 2
            same(run(spark, data), want)


def test_a_long_item_leaves_the_passages_of_short_ones(spark, data):
    filler = " ".join(f"filler{i}" for i in range(3_000))
    short = "where did the grey ship land that winter\nAnswer: beside the northern pier"
    long = " ".join(f"long{i}" for i in range(6_000)) + "\nAnswer: nothing of the kind"
    question, answer = short.split("\nAnswer: ")
    texts = [f"{question} {filler} {answer}", f"{filler} {short} {filler}", f"{filler} {long} {filler}"]
    items = [(1, short), *data[1][:20]]
    for more in ([], [(2, long)]):
        index = dc.build_index(spark.createDataFrame(items + more, "item_id long, text string"))
        out = dc.find_matches(docs(spark, texts), index, keep=["doc_id"]).collect()
        got = {r.doc_id: [m.item_id for m in r.matches] for r in out}
        assert got == {0: [], 1: [1], 2: [2] if more else []}


def test_split_item():
    assert dc.split_item("One two three. Four five!") == (["one", "two", "three"], ["four", "five"])
    assert dc.split_item("Q here\nAnswer: yes no")[1] == ["yes", "no"]
    assert dc.split_item("a b c d") == (["a", "b", "c"], ["d"])
    assert dc.split_item("Solo") == (["solo"], ["solo"])


def test_empty_tables_and_other_id_types(spark, data):
    texts, items = data
    d = docs(spark, texts[:3])
    none = dc.build_index(spark.createDataFrame([], "item_id long, text string"))
    assert {len(r.matches) for r in dc.find_matches(d, none).collect()} == {0}
    index = dc.build_index(spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string"))
    assert dc.find_matches(d.limit(0), index).count() == 0
    found = dc.find_matches(docs(spark, [items[0][1]]), index).first()
    assert [m.item_id for m in found.matches] == ["i0"]


def test_repeated_items_and_rows(spark, data):
    text = data[1][0][1]
    index = dc.build_index(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), *data[1][5:9]], "item_id long, text string"))
    out = dc.find_matches(docs(spark, [text, text]), index).collect()
    assert [sorted(m.item_id or 0 for m in r.matches) for r in out] == [[0, 1, 1, 2]] * 2


def test_query_finds_every_whole_item(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in q.QUERIES["op8_bm25_wand_decontamination"](spark, sf).collect()}
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    texts = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    whole = {(d["doc_id"], i["item_id"]) for d in texts for i in items if i["text"] in d["text"]}
    assert whole and whole <= got


def test_a_full_shard_takes_memory_by_its_postings():
    """2048 items of 128 words that no other item has: 262,144 postings."""
    n, k = 2048, 128
    items = pa.table({"uid": range(n), "item_id": range(n), "text": [" ".join(f"w{i}x{j}" for j in range(k)) for i in range(n)]})
    postings = pa.table({
        "uid": np.repeat(np.arange(n), k), "term": [f"w{i}x{j}" for i in range(n) for j in range(k)], "weight": np.full(n * k, 1 / k),
    })
    shard = dc.Shard.build(items, postings, 0.65)
    arrays = [v for v in vars(shard).values() if isinstance(v, np.ndarray)]
    assert sum(a.nbytes for a in arrays) < 20 << 20
    vocab = [f"w7x{j}" for j in range(k)]
    found = list(shard.search(np.arange(k), np.array([0, k]), vocab, k, 0.65))
    assert [(d, i) for d, _, i, _ in found] == [(0, shard.ids.index(7))]


def test_parts_of_a_large_index_one_after_the_other(spark, data, monkeypatch):
    """A part's matches are written before the next part reaches the driver."""
    with monkeypatch.context() as m:
        m.setattr(dc, "SHARD_BYTES", 300)
        index = dc.build_index(spark.createDataFrame(data[1], "item_id long, text string"))
    written, alive = [], []
    monkeypatch.setattr(dc, "checkpointed", lambda df, keep=dc.checkpointed: written.append(1) or keep(df))
    searcher = dc._searcher
    monkeypatch.setattr(dc, "_searcher", lambda packed, *a: alive.append((len(packed), len(written))) or searcher(packed, *a))
    df = docs(spark, data[0]).withColumnRenamed("lang", "__matches0x").withColumnRenamed("source", "matches")
    out = dc.find_matches(df, index, ship_bytes=1)
    assert alive == [(1, k) for k in range(len(index.sizes))] and len(written) == len(index.sizes) - 1
    assert out.columns == ["doc_id", "text", "__matches0x", "n_chars", "matches"]
    got = {r.doc_id: sorted(m.item_id for m in r.matches) for r in out.collect()}
    whole = dc.find_matches(docs(spark, data[0]), dc.build_index(spark.createDataFrame(data[1], "item_id long, text string")))
    assert got == {r.doc_id: sorted(m.item_id for m in r.matches) for r in whole.collect()} and any(got.values())
