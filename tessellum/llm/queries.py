"""The registered queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsample, language, lm, lsr, mpeg, packing, quality, secrets, templates, toxicity
from .shared import lean, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsr.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.ownership(table(spark, sf_dir, "documents"))


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scores = lm.score(table(spark, sf_dir, "documents"), target)
    return scores.select("doc_id", "n_tokens", *[F.round(c, 4).alias(c) for c in ("loss_target", "loss_background", "difference")])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "lang", "text"), language.train(docs)).drop("text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def page_audio(pages: DataFrame) -> DataFrame:
    """(page_id, audio): each page's bytes carried in an MPEG stream of their own, since no table holds audio."""
    styles = ((3, 44100, 2, (128, 160, 192)), (3, 48000, 1, (64,)), (2, 22050, 2, (64, 80)), (0, 8000, 1, (8, 16, 24)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                version, rate, channels, kbits = styles[(page or 0) % 4]
                made.append(None if html is None else mpeg.encode(html.encode(), url or "", version, rate, channels, kbits, crc=(page or 0) % 3 > 0, table=(page or 0) % 5 > 0)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "audio"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), "page_id bigint, audio binary")


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.audio_info(page_audio(table(spark, sf_dir, "pages"))).select("page_id", "audio_info.*")


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsample.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_secret_ownership, op3_cross_entropy_difference, op4_language_id, op5_best_fit_packing, op6_toxicity, op7_mpeg_audio, op8_site_quality, op9_line_templates, op10_simhash_groups)}
ORACLES = {"op2_secret_ownership": secrets.oracle(), "op3_cross_entropy_difference": lm.oracle()}
