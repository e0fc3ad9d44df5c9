"""The training-text pipeline: each stage's rows are written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import abacist
from abacist.llm import byte_net, containment, divergence, partition_join, sentence_pieces
from abacist.llm.columns import fresh
from abacist.llm.tables import Tables

# Task functions travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(abacist)

#: Sentence piece model of the last stage; None takes the public one.
MODEL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    verdict = fresh(docs, "quality")
    return divergence.quality_rules(docs, into=verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of the whole table, does not reject."""
    score = fresh(docs, "score")
    model = byte_net.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return byte_net.classify(docs, model, into=score).where(F.col(score) >= byte_net.CUT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of similar ones (five-word shingles, similarity 0.8 or more).

    Several rows of one doc_id count as one document; of rows without doc_id, equal texts count as one.
    """
    return partition_join.one_of_each(docs, width=5, p=8, q=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return containment.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in place of their texts, and their number."""
    import public_tokenizers

    model = MODEL or public_tokenizers.path("piece_bpe_32k.model")
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    return sentence_pieces.encode(docs.select(*rest, "text"), model).select(*rest, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: A trained classifier and token ids are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's rows are a table below the shared folder until the next one is written."""
    docs, tables, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = tables.save(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)
        before = name
    return docs
