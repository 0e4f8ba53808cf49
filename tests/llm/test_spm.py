from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from drillspark.llm import queries as q
from drillspark.llm import spm
from tests.llm.helpers import docs

MODEL = q.piece_model()
SP = spm.load(MODEL)
TABLE = spm.Table(MODEL, most=50)

ODD = [
    "", " ", "  ", "a", " a", "a ", "  a  b  ", "▁a", "a▁", "x ▁ y", "a\tb\n c\r\n d", "<s> x </s> <unk>",
    "ﬁ ① é é 日本語", "　x﻿​", "a\0b", "\U0001f600\U0001f468‍\U0001f469", " " * 40 + "x" + " " * 17,
    "word" * 5000, "12 345 6,789.00", "\n\n\n", "a \n b", "▁▁ ▁",
]


def check(texts):
    assert TABLE.encode(pa.array(texts, pa.string())).to_pylist() == SP.encode(texts)


def test_odd_texts():
    check(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n<s>/"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_any_text(texts):
    check(texts)


def test_whole_documents_and_query(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in q.QUERIES["op6_distinct_chunk_pieces"](spark, sf).collect()}
    assert len(got) == len(t)
    for d in t:
        ids = SP.encode(d["text"])
        r = got[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_rows_nulls_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    texts = [*ODD, None, "same words here", "same words here"]
    d = docs(spark, texts).withColumn("ids", F.lit("mine"))
    out = spm.encode(d, MODEL, decode=True).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in out] == [SP.encode(t or "") for t in texts]
    assert [r.decoded for r in out] == [SP.decode(SP.encode(t or "")) for t in texts]
    assert spm.encode(d.limit(0), MODEL).count() == 0
    again = spm.decode(spm.encode(d, MODEL), MODEL).orderBy("doc_id").collect()
    assert [r.decoded for r in again] == [r.decoded for r in out]


def test_model_check():
    spm.check_model(MODEL)
    assert spm.chunks("a  b") == ["a", "▁b"]
    with pytest.raises(Exception):
        spm.check_model(b"not a model")
