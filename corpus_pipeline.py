"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes every
result below the shared folder and reads it back for the next stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrakit.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from terrakit.llm.queries import default_tokenizer
from terrakit.session import written


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines stay in one document only; every document stays."""
    return line_dedup.drop_repeated_lines(docs).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of near-duplicates the smallest id stays."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for each copy that the target weights ask for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every piece of every document with its sequence and place there."""
    return packing.packed(docs, default_tokenizer())


STAGES = [
    ("quality rules", keep_good_documents),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: the label model, the tokenizer and the packing cannot be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
