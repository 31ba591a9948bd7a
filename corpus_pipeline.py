"""From documents to packed training sequences: five stages, each over all that the one before kept.

Every stage but the last returns the columns of its documents as they were, whatever
they are called (``keep``, ``share``, ``n_dropped``, ``sig``, ``_keys``); line dedup alone
changes their text.  Defined results, stage by stage:

- nulls: a document without text has no language and goes in the first stage; a
  null id is an id like others, and comes last where the least id stays;
- empty texts and texts without a letter go in the first stage as well;
- very long texts are judged, cut, hashed, searched and packed whole;
- ties: between languages the first in order, of near duplicates the least id, then
  the least text hash;
- repeated rows: one of them is left after the third stage;
- an empty table, or one that a stage empties, gives an empty table at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import bitsample, language, lsr, packing, templates
from tessellum.llm.shared import scratch, shared_folder, table
from tessellum.operators.materialise import delete


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.accepted(docs, language.train(docs))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines."""
    return templates.drop_lines(docs, counted=None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return bitsample.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return lsr.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_templates", drop_template_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: None of the five stages can be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table.

    Each stage's result is written to the shared folder and read again; what it
    made on the way, and its input if that was a stage's, is deleted then.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
