"""Ball-tree search against scoring every document for every item."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from drillspark.llm import ball_search as B
from drillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)) if text is not None else []


def brute_force(documents, items, k=10):
    """(item_id, rank, doc_id, score) rows, sorted; both inputs as (id, text) rows."""
    counted = [(i, Counter(terms(t))) for i, t in documents if terms(t)]
    n, length = len(counted), sum(c.total() for _, c in counted)
    holding = Counter(w for _, c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for w, df in holding.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * c.total() * n) // length
            s = sum(weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            scored += [(-s, i is None, i if i is not None else 0, i)] if s > 0 else []
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_matches_brute_force_and_sql(spark):
    import duckdb

    got = QUERIES["op11_ball_tree_search"](spark, SF_SMALL)
    assert [f"{c}:{t}" for c, t in got.dtypes] == ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"]
    d, b = (pd.read_parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_force(list(zip(d["doc_id"], d["text"])), list(zip(b["item_id"], b["text"])))
    assert ranked(got) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    assert sorted(con.execute(ORACLE_SQL["op11_ball_tree_search"]).fetchall(), key=str) == want


EDGE_TEXTS = [
    None, "", "   \n", "...!?", "Alpha beta GAMMA", "alpha-beta_gamma", "alpha beta gamma", "É É été alpha", "K9 k9 K9",
    "x" * 100_000, "beta " * 30_000, "zeta\x00eta", "gamma", "gamma", "数据 data", None,
]


def test_nulls_long_texts_ties_repeated_rows_and_clashing_names(spark):
    ids = [None, 3, 3, *range(10, 10 + len(EDGE_TEXTS) - 5), None, 3]
    texts = [*EDGE_TEXTS[:-2], "gamma", "gamma"]
    df = docs(spark, texts, ids).withColumnsRenamed({"lang": "ids", "source": "n", "n_chars": "score"})
    asked = ["alpha Beta", None, "", "gamma", "gamma", "k9 K9 été É", "数据", "nowhere", "x" * 100_000]
    want = brute_force(list(zip(ids, texts)), list(enumerate(asked)))
    assert ranked(B.rank_documents(df, items(spark, asked))) == want
    # several shards, one item each
    assert ranked(B.rank_documents(df, items(spark, asked), shard_bytes=1)) == want


def test_empty_tables(spark):
    some, none = docs(spark, ["alpha beta"]), docs(spark, [])
    for d, i in ((some, []), (none, ["alpha"]), (none, []), (docs(spark, [None, ""]), ["alpha"])):
        out = B.rank_documents(d, items(spark, i))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_other_id_types_and_repeated_items(spark):
    df = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "one"), ("d", "five")], "doc_id string, text string")
    twice = spark.createDataFrame([("i", "one"), ("i", "one")], "item_id string, text string")
    rows = B.rank_documents(df, twice, k=2).collect()
    assert sorted((r.rank, r.doc_id) for r in rows) == [(1, "c"), (1, "c"), (2, "a"), (2, "a")]


def test_a_third_of_the_rows_alike(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(200)] + ["w1 w2 w3 w4 w5"] * 100
    asked = ["w1 w2 w3", "w4 w50 w51", "w7"]
    df = docs(spark, texts).repartition(7)
    assert ranked(B.rank_documents(df, items(spark, asked))) == brute_force(list(enumerate(texts)), list(enumerate(asked)))


def tree_of(vectors):
    sizes = np.array([len(v) for v in vectors])
    ids = np.array([t for v in vectors for t in sorted(v)])
    values = np.array([v[t] for v in vectors for t in sorted(v)], np.int64)
    return B.Tree(list(range(len(vectors))), sizes, ids, values)


vector = st.dictionaries(st.integers(0, 40), st.integers(0, 3 * 10**10), min_size=1, max_size=12)


@given(st.lists(vector, min_size=1, max_size=60), st.sets(st.integers(0, 45), min_size=1), st.integers(1, 5), st.sampled_from([1, 3, 16]))
@settings(max_examples=150, deadline=None)
def test_no_bound_is_below_a_score(vectors, wanted, blocks, leaf):
    old = B.TERM_BLOCKS, B.LEAF_DOCS
    B.TERM_BLOCKS, B.LEAF_DOCS = blocks, leaf
    try:
        tree = tree_of(vectors)
        want = {i: sum(v.get(t, 0) for t in wanted) for i, v in enumerate(vectors)}
        place = [int(np.searchsorted(tree.vocab, t)) for t in wanted if t in tree.vocab]
        if place:
            bounds = tree.bounds(np.array(place))
            for lo, hi, bound in zip(tree.low, tree.high, bounds.tolist()):
                assert max(want[tree.ids[i]] for i in range(lo, hi)) <= bound
        best, seen = tree.search(np.array(sorted(wanted)), [], 4)
        assert best == sorted(((s, i) for i, s in want.items() if s > 0), key=lambda r: (-r[0], r[1]))[:4]
        assert not tree.mark.any() and seen <= len(vectors)
    finally:
        B.TERM_BLOCKS, B.LEAF_DOCS = old


def test_subtrees_are_pruned():
    """Groups of alike documents: only the group that is asked for is scored."""
    vectors = [{10 * g + t: 1000 + 7 * i for t in range(5)} for g in range(8) for i in range(40)]
    best, seen = tree_of(vectors).search(np.array([30, 31, 32]), [], 3)
    assert [i for _, i in best] == [159, 158, 157]
    assert seen < len(vectors) / 4


def test_trees_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(B, "TREE_DOCS", 5)
    monkeypatch.setattr(B, "TREE_ENTRIES", 20)
    sizes = [1, 30, 2, 2, 2, 2, 2, 2, 19, 19, 1, 25, 25]
    ids = pa.array([list(range(s)) for s in sizes], pa.list_(pa.int32()))
    tfs = pa.array([[1] * s for s in sizes], pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array(range(len(sizes))), pa.array(sizes, pa.int64()), ids, tfs], ["id", "n", "ids", "tfs"])
    ranking = B.Ranking(len(sizes), sum(sizes), np.full(30, 100, np.int64))
    made = list(B.trees([batch.slice(0, 4), batch.slice(4)], ranking))
    assert sorted(i for t in made for i in t.ids) == list(range(len(sizes)))
    for t in made:
        assert len(t.ids) <= 5 and (len(t.term) <= 20 or len(t.ids) == 1)


@pytest.mark.parametrize("text", ["Straße ΑΒΓ ABC", "a b", "a\x7fb", " x\u0085y", "0-9AZaz"])
def test_terms(text):
    codes, starts, vocab = B.terms_of(pa.array([text, None]))
    assert [vocab[int(c)].as_py() for c in codes] == terms(text) and starts.tolist() == [0, len(codes), len(codes)]
