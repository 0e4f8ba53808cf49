from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from drillspark.llm import ngram_join as nj
from tests.llm.helpers import docs


def grams(text):
    words = [w.lower().strip(nj.PUNCTUATION) or w.lower() for w in text.split()]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows, threshold=0.8):
    """doc position -> (class id, rep id, links)"""
    sets = [None if t is None else grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, reps = [0] * len(rows), [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if sets[i] is None or sets[j] is None:
                continue
            same = sets[i] == sets[j]
            if same:
                reps[i].append(rows[j][0])
            union = len(sets[i] | sets[j])
            if i != j and (same or (union and len(sets[i] & sets[j]) >= threshold * union - 1e-9)):
                links[i] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    low = lambda ids: min((x for x in ids if x is not None), default=None)
    for i, (doc, t) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((doc, low(members), low(reps[i]) if t is not None else doc, links[i]))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def run(spark, rows, **options):
    out = nj.ngram_join(docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]), **options).collect()
    return sorted(((r.doc_id, r.class_id, r.rep_id, r.n_links) for r in out), key=key)


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "changed%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    out = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    rng = random.Random(3)
    base = out[0][1]
    out += [(1000 + i, near(rng, base, 1 + i % 4)) for i in range(25)]  # chains around the threshold
    out += [(2000 + i, base) for i in range(4)] + [(2000, base)]
    out += [(3000, None), (3001, None), (None, None), (3002, ""), (3003, " \n"), (3004, "..."), (3005, "one two"), (3006, "One, two!"), (None, "one two")]
    return out


def test_bands_reach_the_recall():
    bands, width = nj.choose_bands()
    assert bands * width <= 128 and 1 - (1 - 0.8**width) ** bands >= 0.9995
    with pytest.raises(ValueError):
        nj.choose_bands(0.01, 0.999, 16)


def test_against_brute_force(spark, rows):
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_block_pairs_give_the_same(spark, rows):
    assert run(spark, rows, block_members=4, block_grams=2000) == sorted(brute(rows), key=key)


def test_blocks_without_a_member_count_nothing(spark):
    rng = random.Random(7)
    rows = []
    for group in range(16):  # two or three near copies each, dealt to more blocks than they fill
        base = " ".join(f"g{group}w{i}" for i in range(300))
        rows += [(10 * group + i, near(rng, base, 2)) for i in range(2 + group % 2)]
    assert run(spark, rows, block_grams=120) == sorted(brute(rows), key=key)


def test_hot_group_of_near_copies_stays_linear(spark):
    rng = random.Random(5)
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, near(rng, base, 3)) for i in range(120)]
    got = run(spark, rows)
    assert got == sorted(brute(rows), key=key)
    assert {r[1] for r in got} == {0}


def test_signature_agreement_estimates_similarity():
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = nj.band_hashes([np.sort(a[:1800]), np.sort(a[200:])], 400, 1)
    assert abs((one == two).mean() - 0.8) < 0.07


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(1, 40)] + [(b"\x80", b"\x81"), (b"\x90", b"\x90")]
    got = {bytes(r.v): bytes(r.label) for r in nj.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\x01" for i in range(1, 41)} | {b"\x80": b"\x80", b"\x81": b"\x80"}


def test_drop_near_copies(spark, rows):
    from pyspark.sql import functions as F

    d = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]).withColumn("rk", F.lit("mine"))
    kept = nj.drop_near_copies(d)
    assert kept.columns == d.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {}
    for (doc, text), (_, c, _, _) in zip(rows, brute(rows)):
        if text is not None:
            classes.setdefault(c, []).append((doc, text))
    assert sorted(i for i, t in got if t is None and i is not None) == [3000, 3001]
    assert len([g for g in got if g[1] is not None]) == len(classes)
    assert {g[0] for g in got if g[1] is not None} == set(classes)


def test_drop_near_copies_with_repeated_and_null_ids(spark, rows):
    rng = random.Random(11)
    texts = [" ".join(f"t{k}w{i}" for i in range(120)) for k in range(4)]
    more = [(7000, texts[0]), (7000, texts[1]), (7000, near(rng, texts[1], 1)), (7001, near(rng, texts[0], 1))]
    more += [(None, t) for t in (texts[2], near(rng, texts[2], 1), near(rng, texts[2], 1), texts[3], texts[3])]
    more += [(None, near(rng, texts[1], 1))]
    rows = [*rows, *more]
    kept = nj.drop_near_copies(docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
    classes = {}  # by the position of their first row
    for (doc, text), (_, c, _, _) in zip(rows, brute([(k, t) for k, (_, t) in enumerate(rows)])):
        if text is not None:
            classes.setdefault(c, []).append((doc, text))
    of = {text: c for c, members in classes.items() for _, text in members}
    got = [(r.doc_id, r.text) for r in kept if r.text is not None]
    assert sorted(of[t] for _, t in got) == sorted(classes)
    for doc, text in got:
        assert (doc, text) in classes[of[text]]
        assert doc == min((i for i, _ in classes[of[text]] if i is not None), default=None)


def test_empty_table(spark, rows):
    d = docs(spark, ["a"]).limit(0)
    assert nj.ngram_join(d).count() == 0 and nj.drop_near_copies(d).count() == 0


def test_recall_on_all_pairs_of_documents(spark):
    """Links of every document of sf0.01 against comparing all pairs of their sets."""
    from drillspark.llm import queries as q

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(texts)
    sets = [set(s.tolist()) for s in nj.gram_sets(pa.array([texts[i] or "" for i in ids]), 5)]
    holders = {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    shared = Counter()
    for ks in holders.values():
        for x in range(len(ks)):
            for y in range(x + 1, len(ks)):
                shared[ks[x], ks[y]] += 1
    links = Counter()
    for (x, y), n in shared.items():
        if n >= 0.8 * (len(sets[x]) + len(sets[y]) - n) - 1e-6:
            links[ids[x]] += 1
            links[ids[y]] += 1
    got = {r.doc_id: r.n_links for r in q.QUERIES["op7_ngram_jaccard_join"](spark, sf).collect()}
    wordless = {i for i, s in zip(ids, sets) if not s}
    found, want = sum(got[i] for i in ids if i not in wordless), sum(links.values())
    assert want > 100 and all(got[i] <= links[i] for i in ids if i not in wordless)
    assert found >= 0.995 * want, (found, want)
    print("links found", found, "of", want)
