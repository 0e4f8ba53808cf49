"""A training-corpus pipeline over the text operators.

Stages, in order: drop what the quality classifier rejects, drop what has no
known language, leave one document of each class of near copies, drop what
holds a benchmark item, and encode the rest. Each stage is written as Parquet
and read again by the next. All but the last return the columns of their
input; the last returns one row of token digests per document.

Defined cases: no stage drops a document for a null in another column; a null or
empty text is rejected by the language stage (it has no language), at the latest. Texts
of any length are read whole by every stage. Repeated rows and texts are copies: the
near-copy stage keeps one row of each class, by the smallest id, of rows that share it
by the smallest hash of id and text. Columns may have any names; those of ``documents``
come back as they were. An empty table runs through all stages and gives no rows; without
any label 1 to learn from, nothing reaches the quality stage's bar and no row is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillspark.llm import decontamination, langid, mil, mixing, spm
from drillspark.llm.common import table_of
from drillspark.llm.ngram_join import drop_near_copies
from drillspark.llm.queries import piece_model, token_digests
from drillspark.session import scratch_path

# A text this far from every profile is in none of the languages: prose of a
# learned language scores 0.4 and more, letters at random below 0.2.
LEAST_LANGUAGE_SCORE = 0.25


def _where(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], stays) -> DataFrame:
    """The rows of ``docs`` for which ``stays`` holds among the columns that
    ``judge`` adds; columns of ``docs`` come back as they were, whatever
    their names."""
    others = [c for c in docs.columns if c != "text"]
    judged = judge(docs.select("text", F.struct(*others).alias("__row")))
    return judged.where(stays).select(*["text" if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mil.fit(docs, table_of(spark, sf_dir, "labels"))
    return _where(docs, lambda d: mil.score(d, model), F.col("predicted") == 1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.learn(docs.where(~mixing.held_out(F.col("doc_id"))))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return _where(docs, lambda d: langid.identify(d, profiles), known)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(table_of(spark, sf_dir, "benchmark"))
    return _where(docs, lambda d: decontamination.find_matches(d, index), F.size("matches") == 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(spm.encode(docs.select("doc_id", "text"), piece_model(), keep=["doc_id"], decode=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

# trained models and hash-based search are not SQL; tests hold the rows
# against brute-force versions of the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
