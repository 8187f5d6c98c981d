"""A training corpus from documents: quality rules, line dedup, near dedup, mixing, encoding.

Every stage works on all rows its predecessor kept and calls one operator of ``tallyspark.llm``. All but the last return the
columns they were given. Between stages the documents are a table in the shared folder, so a lost executor costs no stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, mixing, quality, simhash, sp_sample
from tallyspark.llm.common import store, whole_rows
from tallyspark.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy."""
    written = quality.ledger(whole_rows(docs).withColumn("text", F.col("_row.text")))
    return written.filter(quality.passes(quality.STANDARD)).select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; ``n_chars`` follows the text. A null text stays null."""
    deduped = line_dedup.dedup_lines(docs)
    text = F.when(F.col("_row.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return deduped.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked by at most four bits, over shingles of four words."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: documents as often as they are taken, those that are not taken left out."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two segmentations of every document of the mix."""
    return sp_sample.encode(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL has neither the fingerprints nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
