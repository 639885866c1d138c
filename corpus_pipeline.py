"""From documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

Quality rejects documents, line dedup deletes passages that earlier documents hold, near-dedup keeps one document of each group,
mixing repeats documents of rare languages, and the last stage encodes what is left.

Each stage but the last returns the columns of its input, whatever their names, and an empty table for an empty one. A row without
text is an empty document; a row without doc_id passes every stage that does not reject it; repeated rows share each decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayline.llm import bpe_automaton, common, line_dedup, mixing, near_dup, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts; without labels of both classes, all or none by the share of good ones."""
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the aligned blocks that an earlier one holds; a document that loses all its lines has an empty text."""
    return line_dedup.cleaned(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; empty texts are near to nothing."""
    return near_dup.one_of_each(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, rounded by the hash of the row; languages keep their tokens or gain some."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row."""
    return bpe_automaton.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", accept_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_languages),
    ("bpe", encode),
]

#: A trained classifier, alignment and links cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.saved(docs, f"stage-{name}")
    return docs
