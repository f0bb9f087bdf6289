"""The corpus pipeline: quality, near-duplicates, contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. Stages keep the columns of
documents and all rows that they don't reject; the last returns tokens besides.

Defined results: stages handle null and empty texts, repeated rows, further columns and empty tables as
their operators state. A document without text has no near-duplicates, no contamination and no secrets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkredact.llm import bpe, decontam, neardup, quality, secrets
from sparkredact.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality vote rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return neardup.keep_first(docs, neardup.plan(words=5, per_cent=80))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those contaminated by benchmark passages."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret in the text replaced by a mark."""
    return secrets.redact(docs, secrets.learn(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with token_ids and n_tokens; round_trip tells whether the ids decode to the text."""
    path, pattern = bpe.tokenizer()
    keep = [c for c in docs.columns if c not in ("token_ids", "decoded", "n_tokens", "round_trip")]
    both = bpe.encode(docs, path, pattern, keep=keep, decoded=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select(*keep, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: The vote and the field are no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
