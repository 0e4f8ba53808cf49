from __future__ import annotations

from collections import Counter

import pyarrow.parquet as pq
import pytest

from drillspark.llm import langid
from drillspark.llm import queries as q
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    counts, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            for n in (1, 2, 3):
                padded = word if n == 1 else f"_{word}_"
                counts.update(padded[i : i + n] for i in range(len(padded) - n + 1))
            word = ""
    return counts


def brute_profiles(texts, langs, size):
    rows = []
    for lang in sorted({x for x in langs if x is not None}):
        total = Counter()
        for t, x in zip(texts, langs):
            if x == lang:
                total += brute_grams(t)
        top = sorted(total, key=lambda g: (-total[g], g))[:size]
        rows += [(lang, g, total[g], i) for i, g in enumerate(top)]
    return langid.profiles_of(rows, size)


def brute_predict(p, text):
    counts = brute_grams(text)
    if not counts or not p.languages:
        return "und", 0.0
    ranked = sorted(counts, key=lambda g: (-counts[g], p.places.get(g, len(p.places)), g))[: p.size]
    best = None
    for k, lang in enumerate(p.languages):
        away = 0
        for i, g in enumerate(ranked):
            r = p.ranks[g][k] if g in p.ranks else p.size
            away += p.size if r == p.size else abs(r - i)
        if best is None or away < best[1]:
            best = lang, away
    return best[0], 1 - best[1] / (p.size * len(ranked))


@pytest.fixture(scope="module")
def data():
    t = pq.read_table(f"{SF}/documents.parquet").slice(0, 300)
    texts = t["text"].to_pylist() + [None, "", "12 34!", "ÀÉ straße İstanbul", "日本語 テキスト 日本", "a\0b", "x" * 3000]
    return texts, t["lang"].to_pylist() + ["en", None, "fr", "de", None, "en", "en"]


def test_profiles_and_predictions_against_brute_force(spark, data):
    texts, langs = data
    d = docs(spark, texts, lang=langs)
    got = langid.learn(d, size=80)
    want = brute_profiles(texts, langs, 80)
    assert got.languages == want.languages and got.places == want.places
    assert {g: r.tolist() for g, r in got.ranks.items()} == {g: r.tolist() for g, r in want.ranks.items()}
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, got).collect()}
    for i, t in enumerate(texts):
        lang, score = brute_predict(want, t)
        assert out[i][0] == lang and out[i][1] == pytest.approx(score, abs=1e-12), t


def test_long_texts_are_counted_whole(data, monkeypatch):
    texts, langs = data
    p = brute_profiles(texts, langs, 80)
    whole = " ".join(t for t in texts if t)
    letters = langid.Letters()
    direct = p.predict([whole], letters)
    monkeypatch.setattr(langid, "LONG_TEXT", 1000)
    assert p.predict([whole, "le la"], letters)[0][0] == direct[0][0]
    assert p.predict([whole], letters)[1][0] == pytest.approx(direct[1][0])
    monkeypatch.setattr(langid, "DENSE_CELLS", 10)
    assert p.predict(["le la les", "the of and"], letters)[1] == pytest.approx([brute_predict(p, t)[1] for t in ("le la les", "the of and")])


def test_nothing_learned_and_empty_table(spark):
    d = docs(spark, ["a b", "c"], lang=[None, None])
    p = langid.learn(d)
    assert p.languages == []
    assert {(r.lang_pred, r.score) for r in langid.identify(d, p).collect()} == {("und", 0.0)}
    assert langid.identify(d.limit(0), p).count() == 0


def test_query_held_out_accuracy(spark):
    out = {r.doc_id: r for r in q.QUERIES["op9_rank_order_language"](spark, SF).collect()}
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    held = [(r.lang, out[r.doc_id].lang_pred) for r in truth if out[r.doc_id].held_out]
    assert len(out) == 1000 and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())


def test_counts_are_handed_on_before_they_grow(spark, monkeypatch):
    """An alphabet of a million n-grams: a task holds a bounded number of counts."""
    texts = ["".join(chr(0x4E00 + (i * 97 + j * 31) % 20_000) for j in range(400)) for i in range(60)] * 2
    df = docs(spark, texts, lang=["zh", "ja"] * 60)
    want = {(r.lang, r.gram): r.n for r in langid.gram_counts(df, "text", "lang").collect()}
    monkeypatch.setattr(langid, "TASK_GRAMS", 1000)
    got = {(r.lang, r.gram): r.n for r in langid.gram_counts(df, "text", "lang").collect()}
    assert got == want and len(want) > 20_000
