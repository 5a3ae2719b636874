"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing, one stage after another."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.base import materialize, read_table
from docquarry.llm.jaccard import drop_near_duplicates
from docquarry.llm.mixing import mix
from docquarry.llm.packing import pack
from docquarry.llm.passages import remove_passages, repeated_passages
from docquarry.llm.queries import TOKENIZER
from docquarry.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return scored.filter("toxicity = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs, k=5, num=80).select(*docs.columns)


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out of the later ones; n_chars follows the text."""
    return remove_passages(docs, repeated_passages(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that expected tokens come nearer to nine tenths of good quality; none goes (rates from 1)."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("domain"))
    mixed = mix(docs, labels, ["good", "poor"], [0.9, 0.1], min_rate=1.0, max_total=1.5)
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.withColumn("__dq_copy", copies).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", repeated), ("mixing", mixing), ("packing", packing)]

#: Trained models, chains and a tokenizer are beyond SQL; stages and run() are tested for columns and rows only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before it wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
