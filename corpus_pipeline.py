"""Training-data pipeline over ``documents``.

Stages, each reading what its predecessor kept:

1. ``language_id``: documents whose language the compression classifier can't tell go (no letters,
   or a margin too narrow);
2. ``line_dedup``: of every group of near-equal lines the first stays, documents left without lines go;
3. ``near_duplicates``: of every group of documents linked on five-word shingles at a Jaccard
   similarity of 0.8 or more, the one with the smallest id stays;
4. ``decontamination``: documents in which a benchmark window occurs go;
5. ``packing``: the rest is tokenised and packed into windows of 2048 tokens.

All stages but the last return the columns of ``documents``; the last returns pieces. An empty
table passes through every stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import decontaminate, langid, line_dedup, ngram_join, packing
from merchantry.session import ensure_checkpoint_dir, materialize, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    training = docs.filter(~langid.held_out(F.col("doc_id"), 2, 4)).select("doc_id", "text", "lang")
    return langid.keep_identified(docs, training)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_duplicate_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


STAGES = [(fn.__name__, _stage(fn)) for fn in (language_id, dedup_lines, near_duplicates, decontamination, pack)]

#: Compression, MinHash and tokenising have no SQL form; the tests hold the last three stages against plain Python on
#: their own input, the first two by what they may remove (the operators behind them have their own tests).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
