"""Documents to training sequences: quality, language, near duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rosterline.llm import language_id, ngram_jaccard, packing, quality_cotraining
from rosterline.llm.common import WRITTEN, forget_unread, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that stages have written and left; the next stage deletes those that its documents don't read.
_left: list[str] = []


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget_unread(docs, _left)
        before = list(WRITTEN)
        out = function(spark, docs, sf_dir)
        _left[:] = [p for p in WRITTEN if p in _left or p not in before]
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, with their columns; null and empty texts are judged like others."""
    return quality_cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised, with their columns; null and letterless texts go."""
    return language_id.keep_identified(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, with its columns; a null doc_id stays, rows of one doc_id become one."""
    return ngram_jaccard.keep_one_of_each(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their ids and their places in sequences; a null text is a piece of one token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack),
]

#: Trained models and tokenizers are not SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        _left.append(WRITTEN[-1])
    _left.remove(WRITTEN[-1])
    return docs
