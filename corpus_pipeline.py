"""The corpus pipeline: language, quality, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, language, near_duplicates, packing, quality
from lectern.llm.shared import delete, scratch, shared_dir, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language or with an unsure one: null, empty and letterless texts go.

    Long texts are read whole; equal scores go to the lesser name of a language; rows are judged one by one, repeats
    alike; all columns stay, whatever their names; an empty table stays empty.
    """
    return language.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; without labels it has no evidence and all stay.

    Null and empty texts are judged as texts without words, long ones are read whole; a score of exactly one half
    stays; null sources and languages are groups of their own; repeats are judged alike; all columns stay, whatever their
    names; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near-duplicates, and one of rows that repeat it; texts without words stay.

    Long texts are compared whole; a null id counts as greater than any other; all columns stay, whatever their
    names; an empty table stays empty.
    """
    return near_duplicates.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of words with a benchmark item; without items all stay.

    Null and empty texts share none and stay, long ones are read whole; repeats go or stay alike; all columns stay,
    whatever their names; an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises the documents that are left and packs them into sequences; null and empty texts are an end alone.

    Longer ones than a sequence are cut into whole pieces; repeats are packed one by one; pieces of equal size may stand
    in each other's place; other columns than id and text are not read; an empty table gives no sequence.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Networks, sampling and bin completion are not SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again.

    Every stage works on whole texts and on repeated rows one by one; an empty table gives an empty result. What a
    stage needed and the result before it are deleted when its own is written.
    """
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, made)
        if folder:
            delete(spark, folder)
        folder = made
    return docs
