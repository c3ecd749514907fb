"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import decontaminate, encode, neighbours, quality, repeats
from wardlake.llm.scratch import Scratch


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neighbours.one_of_each(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def leaked_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids``."""
    encoded = encode.encode(docs.select("doc_id", "source", "text"), tokenizer_path("byte_bpe_50k.json"))
    return encoded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_text),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_text),
    ("benchmark decontamination", leaked_items),
    ("BPE encoding", token_ids),
]

#: No stage but the fourth can be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage kept is written, and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, last = Scratch(spark), len(STAGES) - 1
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < last:
            docs = scratch.keep(f"stage-{i}", docs)
            if i:
                scratch.drop(f"stage-{i - 1}")
    return docs
