"""Frames the operator tests share."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


def docs(spark, texts, ids=None, lang="en"):
    """A documents table of the given texts."""
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, t, lang if not isinstance(lang, list) else lang[k], "s", len(t) if t is not None else None)
        for k, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, DOCS)
