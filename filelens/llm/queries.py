"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    context_mixing,
    divergence_cube,
    language_id,
    line_frequency,
    line_index,
    near_dedup,
    packed_negatives,
    paragraph_sketch,
    personal_data,
    piece_lattice,
    repeated_bytes,
    source_mixing,
    token_files,
)
from .common import documents


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.op1(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.op3(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op4(documents(spark, sf_dir))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.op5(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op6(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.op7(documents(spark, sf_dir))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.op8(documents(spark, sf_dir))


def op9_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.op9(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.op10(documents(spark, sf_dir))


def op11_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_negatives.op11(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.op12(documents(spark, sf_dir))


def op13_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_cube.op13(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_near_dedup": op2_near_dedup,
    "op3_context_mixing": op3_context_mixing,
    "op4_token_files": op4_token_files,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_language_id": op6_language_id,
    "op7_personal_data": op7_personal_data,
    "op8_piece_lattice": op8_piece_lattice,
    "op9_paragraph_sketch": op9_paragraph_sketch,
    "op10_source_mixing": op10_source_mixing,
    "op11_packed_negatives": op11_packed_negatives,
    "op12_line_index": op12_line_index,
    "op13_divergence_cube": op13_divergence_cube,
}

ORACLE: dict[str, str] = {
    "op11_packed_negatives": packed_negatives.ORACLE,
    "op12_line_index": line_index.ORACLE,
    "op13_divergence_cube": divergence_cube.ORACLE,
}
