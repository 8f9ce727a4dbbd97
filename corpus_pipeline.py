"""From raw documents to a clean, tokenised corpus, stage by stage."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.durable import passing_tables, shared_folder
from pixelframe.llm import byte_bpe, decontamination, language_crf, near_copies, sentence_spans
from pixelframe.llm.queries import BYTE_BPE


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; it learns from the labelled ones among them."""
    return language_crf.keep_known(docs, language_crf.fit(docs, F.lit(True)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: proposed by op3's fingerprints, Jaccard 0.8 or more over shingles of five words."""
    return near_copies.keep_one(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of passages that stand elsewhere before."""
    return sentence_spans.rewrite(docs, context=True)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


#: ``(name, function(spark, docs, sf_dir) -> DataFrame)``, in order.
STAGES = [
    ("known_language", known_language),
    ("one_of_each", one_of_each),
    ("no_repeated_passages", no_repeated_passages),
    ("no_benchmark", no_benchmark),
    ("tokens", tokens),
]

#: Language model, fingerprints and merges have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with passing_tables(spark):  # a stage's own tables go with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
