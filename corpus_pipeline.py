"""From raw documents to packed training sequences, a stage at a time; each stage is one operator of weftline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import Scratch, shrink_executors
from weftline.llm.exact_dedup import drop_exact
from weftline.llm.language_id import fit, label_languages
from weftline.llm.mixing import mixed_documents
from weftline.llm.near_dedup import drop_near
from weftline.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter, empty and null ones go. A null lang is filled in.

    Without any label all texts with a letter stay. Equal rows are all kept. Other columns stay as they are; an empty
    table stays empty, as in all stages.
    """
    shrink_executors(spark)
    return label_languages(docs, fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id, one row of it where it is repeated; null counts as empty text. All columns stay."""
    shrink_executors(spark)
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more over five words in a row, the one with the smallest doc_id.

    Texts without words and rows with a null id are linked with nothing and stay. All columns stay.
    """
    shrink_executors(spark)
    return drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them; a shard's last one perhaps in part.

    A null source is a source, a text without words is never taken, and ties of the drawing order go by id. All columns
    stay.
    """
    shrink_executors(spark)
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 1024 ids; a null text counts as empty and gives its end id. Repeated rows are packed each."""
    shrink_executors(spark)
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Sketching, and encoding by a tokenizer, can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if n:
            scratch.drop(STAGES[n - 1][0])
    return docs
