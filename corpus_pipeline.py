"""A corpus pipeline of five training-data operators.

Each stage takes the documents that its predecessor kept and returns the
columns of ``documents``; the last writes the token blocks and returns what it
reads back from them, a row per document.

1. language_id: trains on the stage's documents that are not held out, drops
   those of no language (null texts, texts without a letter), and gives a
   document without a lang the predicted one.
2. minhash_neardup: keeps one document of each group of near copies.
3. decontaminate: drops documents that hold a window of the benchmark.
4. mixing: draws documents until each source has its share of all words; one
   drawn again is repeated, one not drawn is gone.
5. token_output: packs the ids of the rest, in ascending doc_id order.

Between stages the rows are a Parquet table in the shared checkpoint folder: a
lost executor costs tasks of one stage. Empty tables pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontaminate, language, mixing, neardup, queries, tokens
from kinfold.llm.common import drop_tables, write_table

#: What a worker of the last stage remembers of words: less than the operator alone, as its executor has served four stages.
TOKEN_CACHE_BYTES = 24 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenize(docs, queries.word_bpe(), cache_bytes=TOKEN_CACHE_BYTES)


STAGES = [
    ("language_id", language_id),
    ("minhash_neardup", minhash_neardup),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
    ("token_output", token_output),
]

# A tokenizer, n-gram profiles and MinHash are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:  # what the stage read is no longer needed
            drop_tables(spark, [before])
        before = path
    return docs
