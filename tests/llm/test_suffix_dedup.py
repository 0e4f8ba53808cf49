"""Repeated passages against comparing every window with every other one."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_ORACLE, SF_SMALL
from drillspark.llm import suffix_dedup as S
from drillspark.llm.queries import QUERIES
from tests.llm.helpers import docs


def brute_force(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def removed(spark, texts, length, **how):
    left = S.remove_repeats(docs(spark, texts).repartition(3), length=length, keep=["doc_id"], **how)
    rows = sorted(left.collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows]


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_query_matches_brute_force(spark, sf):
    got = QUERIES["op13_suffix_array_dedup"](spark, sf)
    assert [f"{c}:{t}" for c, t in got.dtypes] == [
        "doc_id:bigint", "n_bytes:bigint", "n_removed:bigint", "n_spans:bigint", "kept_sha256:string",
    ]
    d = pd.read_parquet(f"{sf}/documents.parquet")
    made = brute_force(list(d["text"]))
    want = {i: (*m[:3], hashlib.sha256(m[3]).hexdigest()) for i, m in zip(d["doc_id"], made)}
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert sum(m[1] for m in made) > 0


def passages(rng, n, parts, low=1, high=6):
    """Texts put together from a few shared parts, with odd bytes between them."""
    return ["".join(parts[k] + chr(rng.integers(97, 123)) * int(rng.integers(0, 3)) for k in rng.integers(0, len(parts), rng.integers(low, high))) for _ in range(n)]


@pytest.mark.parametrize("seed,sizes", [(1, (32, 8, 1)), (2, (1,)), (3, (5, 2, 1))])
def test_shared_passages_edges_and_copies(spark, monkeypatch, seed, sizes):
    """Shared passages in differing surroundings."""
    monkeypatch.setattr(S.repeated_runs, "__defaults__", (sizes,))
    rng = np.random.default_rng(seed)
    parts = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(5, 40))) for _ in range(40)]
    texts = passages(rng, 60, parts) + [None, "", "short", "a" * 100, "ab" * 60, "é" * 50, "ab" * 60]
    texts += [parts[0] + parts[1]] * 40  # a third of the rows alike
    assert removed(spark, texts, 24, batches=seed + 1) == brute_force(texts, 24)


def test_long_texts_in_segments_and_small_chunks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    long = "".join(chr(c) for c in rng.integers(97, 101, 6000))
    texts = [long, long[1000:3000] + "Z" + long[500:900], "x" * 700, "x" * 30 + long[-100:], long[::-1]]
    want = brute_force(texts, 30)
    assert removed(spark, texts, 30) == want
    # segments of 64 windows cut runs apart; the result stays
    pieces = [t.encode() for t in texts]
    raw, ends = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    monkeypatch.setattr(S, "SEGMENT", 64)
    runs = [r for part in S.runs_of(raw, ends, 30) for r in zip(*(x.tolist() for x in part))]
    assert sum(r[2] for r in runs) == sum(max(0, len(p) - 29) for p in pieces)


def test_empty_table_and_clashing_columns(spark):
    assert S.remove_repeats(docs(spark, [])).count() == 0
    df = docs(spark, ["abc" * 20, "abc" * 20, "q"], [None, 5, 5]).withColumnsRenamed({"lang": "uid", "source": "kept", "n_chars": "runs"})
    out = S.remove_repeats(df, length=10)
    assert out.columns == ["doc_id", "text", "uid", "runs", "n_bytes", "n_removed", "n_spans", "kept"]
    rows = sorted(tuple(r) for r in out.select("n_bytes", "n_removed", "uid", "runs").collect())
    assert rows == [(1, 0, "en", 1), (60, 60, "en", 60), (60, 60, "en", 60)]


def test_levels_merge_geometrically_and_scans_move_no_rows(spark):
    """Seven batches leave levels of 4, 2 and 1; joins of levels have no exchange."""
    family = S.Family(4)
    for b in range(7):
        rows = [(g, 1, g * 10 + b % 2, False) for g in range(b, b + 5)]
        family.add(S._bucketed(spark.createDataFrame(rows, "g long, n long, h long, mixed boolean"), "g", 4))
    family._settle()
    assert [rank for rank, _ in family.levels] == [2, 1, 0]
    top = {r.g: (r.n, r.mixed) for r in family.levels[0][1].collect()}
    assert top == {g: (n, n > 1) for g, n in {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 3, 6: 2, 7: 1}.items()}
    assert {r.g: r.mixed for r in family.matches().collect()} == {g: True for g in range(1, 10)}
    conf = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(conf, "-1")
    try:
        for scan in family.met[1::2]:
            plan = scan._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
    finally:
        spark.conf.unset(conf)


@given(st.lists(st.text("ab", max_size=40), max_size=6), st.integers(2, 12), st.sampled_from([7, 1 << 18]))
@settings(max_examples=200, deadline=None)
def test_runs_tell_equal_windows_apart(texts, length, segment):
    """Windows with different anchors differ; runs with equal h are equal texts; each window is in one run."""
    old, S.SEGMENT = S.SEGMENT, segment
    try:
        data = [t.encode() for t in texts]
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)
        anchor, stretch, windows = {}, {}, Counter()
        for text, start, run, g, h in (r for part in S.runs_of(raw, ends, length) for r in zip(*(x.tolist() for x in part))):
            whole = data[text][start : start + run + length - 1]
            assert len(whole) == run + length - 1
            assert stretch.setdefault((g, h), whole) == whole
            for p in range(run):
                windows[text, start + p] += 1
                assert anchor.setdefault(whole[p : p + length], g) == g
            inner = [whole[p : p + length] for p in range(run)]
            assert len(set(inner)) == run  # no window twice in a run
        assert windows == Counter((i, p) for i, b in enumerate(data) for p in range(len(b) - length + 1))
    finally:
        S.SEGMENT = old
