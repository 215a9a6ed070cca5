"""From raw documents to packed training sequences: quality, near-duplicates, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``documents``, and further columns
of any name with them.

Defined cases, at every stage: a null text counts as an empty one; rows without a doc_id are kept as rows
of their own; repeated rows share their fate (near-duplicates keeps one row of a doc_id); a null source is a
source of its own; ties go to the smaller doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.llm import mixing, near_dedup, packing, pii, quality_classifier
from partita.llm.common import discard, table, written
from partita.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level field scores below the threshold go; every fourth label is held out."""
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, quality_classifier.remainder(4) != 2)
    return quality_classifier.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return near_dedup.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mix", mix_to_targets),
    ("packing", pack_sequences),
]

#: The stages fit and apply models, which SQL can't express; tests hold each stage and the chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
        before = docs
    return docs
