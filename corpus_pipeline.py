"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Stages are named by the operator they call: language ID, MinHash near-dedup, PII, source mixing,
SentencePiece. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filelens.llm import language_id, near_dedup, personal_data, piece_lattice, source_mixing
from filelens.llm.common import documents
from filelens.operators.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters go."""
    return language_id.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: its smallest doc_id."""
    return near_dedup.stage(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the kind's name."""
    return personal_data.stage(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to 1.5 times as often."""
    return source_mixing.stage(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids' figures of every row."""
    return piece_lattice.op8(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal),
    ("mixing sources", mixture),
    ("SentencePiece", pieces),
]

#: Language scores, MinHash, EM and piece lattices have no SQL form; tests compare with a plain replay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
