"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs with the columns of documents, and returns
the documents it keeps with those columns, the last one the packed pieces. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionframe.llm import mixing, neardup, packing, repeats, toxicity
from regionframe.llm.shared import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The model is fitted on the labelled ones among docs that are not held out."""
    model = toxicity.trained(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least doc_id."""
    return neardup.without_near_duplicates(docs.select(*COLUMNS))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more with another start anywhere are cut out of every text that has them; every document
    stays, n_chars follows its text."""
    kept = repeats.without_repeats(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is there as often as the mix takes it, 0 to 3 times."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids: the pieces of every document that is there, each copy packed for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained model nor the sketches; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
