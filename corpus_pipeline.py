"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm.language_id import keep_identified
from evenkeel.llm.line_dedup import without_repeated_lines
from evenkeel.llm.near_dedup import without_near_copies
from evenkeel.llm.packing import pack, token_pieces
from evenkeel.llm.substring_dedup import without_repeats
from evenkeel.session import discard, scratch_dir, scratch_scope, scratch_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a text or a letter go, and those with no clear language. Repeated rows stay."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those of which nothing is left go. Rows with a null key or text stay as they are."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least key, all its rows; those without words or with a null key stay."""
    return without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller key has; those of which nothing is left go. Null keys count as later than all."""
    return without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences; a null or empty text is a piece of one id. No documents, no rows."""
    return pack(token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next.

    A stage's scratch tables go once its rows are written, and its rows once the next stage's are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch_dir(spark)
        with scratch_scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(docs)
        docs = scratch_table(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
