"""The registered queries without a SQL twin, checked against brute force on
the whole sf0.001 tables: greedy de-duplication of documents (G12) and the
logistic fit (T15)."""

from __future__ import annotations

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from test_evidence import _similar
from test_ranks_models_customers import _irls

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")


def test_dedup_documents_matches_brute_force(spark):
    got = {r["doc_id"]: r["kept"] for r in entry.queries()["G12_dedup_documents"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    kept_texts: list[str] = []
    expected = {}
    for r in docs:
        keep = not any(_similar(k, r["text"]) for k in kept_texts)
        expected[r["doc_id"]] = keep
        if keep:
            kept_texts.append(r["text"])
    assert got == expected
    assert not all(expected.values())  # the fixture has near copies: some are dropped


def test_logistic_fit_query_matches_numpy(spark):
    q = entry.queries()
    coefs = {r["term"]: r["coefficient"] for r in q["T15_logistic_fit_coefficients"](spark, SF_SMALL).collect()}
    metrics = q["T15_logistic_fit_metrics"](spark, SF_SMALL).first()
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pdf = lab.join(docs, "doc_id").select("quality", "n_chars").toPandas().dropna()
    b0, b1, acc = _irls(pdf[["n_chars"]].to_numpy(dtype=float), (pdf["quality"].astype(str) == "1").to_numpy(dtype=float))
    assert coefs["intercept"] == pytest.approx(round(b0, 4), abs=2e-4)
    assert coefs["n_chars"] == pytest.approx(round(float(b1[0]), 4), abs=2e-4)
    assert metrics["accuracy"] == pytest.approx(round(acc, 4))
    assert metrics["n"] == len(pdf) and metrics["positive_class"] == "1"
    assert np.isfinite(metrics["pseudo_r2_mcfadden"])
