from __future__ import annotations

import re
from collections import Counter

import pytest
import zstandard

from drillspark.llm import compression_bands as cb
from tests.llm.helpers import docs

PROSE = (
    "The harbour lay quiet under a thin morning fog while two fishing boats turned slowly towards the pier. "
    "Nobody spoke, though a dog barked twice near the old customs house and then thought better of it."
)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    data = text.encode()
    squeeze = zstandard.ZstdCompressor(level=3)

    def ratio(x):
        return len(x) / len(squeeze.compress(x))

    def fits(x):
        low, high = next((lo, hi) for below, lo, hi in cb.BANDS if len(x) < below)
        return low <= ratio(x) <= high

    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
    bad = sum(len(c) for c in chunks if not fits(c))
    ok = (not data) or (fits(data) and bad <= 0.25 * len(data))
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, not failed and ok


@pytest.fixture(scope="module")
def texts():
    from pathlib import Path

    import pyarrow.parquet as pq

    real = pq.read_table(Path("/root/testdata/sf0.001/documents.parquet"))["text"].to_pylist()
    return [
        None, "", " \n\t ", "one", PROSE, PROSE + "\n" + PROSE, "a " * 5000, "x\x0by\x0cz w # * | <b>",
        "same line\nsame line\n\nother\nsame line ", "é è " * 30, "word" * 30000, PROSE, *real,
    ]


def test_against_brute_force(spark, texts):
    out = cb.compression_bands(docs(spark, texts), keep=["doc_id"]).collect()
    got = {r.doc_id: tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in out}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdicts(spark):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(60))
    rows = {r.doc_id: r for r in cb.compression_bands(docs(spark, [PROSE, noise, "spam eggs " * 400])).collect()}
    assert rows[0].kept
    assert not rows[1].kept and not rows[1].base_failed  # incompressible
    assert not rows[2].kept and rows[2].ratio > 20


def test_empty_table_and_clashing_column(spark):
    from pyspark.sql import functions as F

    d = docs(spark, [PROSE]).withColumn("ratio", F.lit("mine"))
    assert cb.compression_bands(d).schema["ratio"].dataType.typeName() == "double"
    assert cb.compression_bands(d.limit(0)).count() == 0
