from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from drillspark.llm import langid, mil
from drillspark.llm import queries as q
from drillspark.llm.common import table_of
from tests.llm import test_decontamination, test_langid, test_ngram_join

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows after each stage."""
    base = tmp_path_factory.mktemp("pipeline")
    docs, out = table_of(spark, SF, "documents"), []
    out.append(docs.collect())
    for name, stage in cp.STAGES:
        made = stage(spark, docs, SF)
        if name != "tokens":
            assert made.columns == docs.columns
        made.write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs.collect())
    return out


def test_quality_and_language_reject_little_clean_text(spark, kept):
    first, second, third = ({r.doc_id for r in rows} for rows in kept[:3])
    labels = {r.doc_id: r.quality for r in table_of(spark, SF, "labels").collect()}
    good = [d for d, y in labels.items() if y == 1]
    bad = [d for d, y in labels.items() if y == 0]
    assert sum(d in second for d in good) / len(good) > 0.97
    assert sum(d in second for d in bad) / len(bad) < 0.25
    assert second - third == set() and second < first


def test_language_stage_against_brute_force(spark, kept):
    rows = [r for r in kept[1]]
    import zlib

    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    p = test_langid.brute_profiles([r.text for r in learn], [r.lang for r in learn], langid.PROFILE_SIZE)
    want = set()
    for r in rows:
        lang, score = test_langid.brute_predict(p, r.text)
        if lang != "und" and score >= cp.LEAST_LANGUAGE_SCORE:
            want.add(r.doc_id)
    assert {r.doc_id for r in kept[2]} == want


def test_near_copies_against_brute_force(kept):
    rows = [(r.doc_id, r.text) for r in kept[2]]
    classes = {c for _, c, _, _ in test_ngram_join.brute(rows)}
    assert {r.doc_id for r in kept[3]} == classes and len(kept[3]) == len(classes)


def test_decontamination_against_brute_force(kept):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    found = test_decontamination.brute([r.text for r in kept[3]], items)
    hit = {kept[3][k].doc_id for k, _ in found}
    assert {r.doc_id for r in kept[4]} == {r.doc_id for r in kept[3]} - hit


def test_tokens_against_the_library(kept):
    sp = q.spm.load(q.piece_model())
    text = {r.doc_id: r.text for r in kept[4]}
    assert {r.doc_id for r in kept[5]} == set(text)
    for r in kept[5]:
        ids = sp.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_gives_the_stages_rows(spark, kept):
    assert sorted(cp.run(spark, SF).collect()) == sorted(kept[5])


def test_odd_columns_and_nulls_pass_the_filters(spark, kept):
    d = spark.createDataFrame(
        [(1, kept[2][0].text, None, None, None, "a", 1), (None, kept[2][1].text, "xx", "s", 3, None, 2), (3, None, "en", "s", 0, "b", 3), (4, "", "en", None, 0, "c", 4)],
        "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int",
    )
    d = d.unionByName(d).withColumn("matches", F.lit("mine"))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        got = out.collect()
        assert all(r in set(d.collect()) for r in got)
        empty = stage(spark, d.limit(0), SF)
        assert empty.columns == d.columns and empty.count() == 0
    assert cp.STAGES[-1][1](spark, d, SF).count() == d.count()
    assert {r.doc_id for r in cp.near_copies(spark, d, SF).collect()} == {1, None, 3, 4}


def test_letters_at_random_have_no_language(spark, kept):
    import random

    rng = random.Random(0)
    noise = " ".join("".join(rng.choices("qxzjkwvyfp", k=9)) for _ in range(80))
    p = langid.learn(table_of(spark, SF, "documents"))
    d = spark.createDataFrame([(noise,)], "text string")
    assert langid.identify(d, p).first().score < cp.LEAST_LANGUAGE_SCORE
    assert mil.ACCEPT == 0.7
