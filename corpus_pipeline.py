"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents; their decisions take effect:

1. quality_rules: rejected documents go; kept ones go on without the lines that failed a rule, n_chars following.
2. simhash_dedup: of each near-duplicate component the document with the smallest doc_id stays, one row of it.
3. mix_sources: each document is repeated, or left out, as its source's repetition rate says.
4. best_fit_packing: one row per token piece, with its ids, its sequence and its offset there.

Null, empty and very long texts, repeated rows, empty tables and extra columns are treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, packing, quality, simhash
from tessera.llm.common import shared_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, weights=(5, 2, 1), max_repeats=3.0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, capacity=2048, ids=True), capacity=2048).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: SQL has no tokenizer and no XXH64: the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
