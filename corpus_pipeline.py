"""A corpus cleaned stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to the whole ``documents``
table.  All stages but the last return the columns of ``documents``.  A stage reads its input several times, so ``run``
writes what each stage but the last returns to the shared folder and gives the next one that table; a table is deleted once
the next one is written, so that two are there at most, and a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorspan.llm import decontaminate, language_id, mixing, ngram_join, toxicity
from floorspan.llm._common import Stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it is fitted on labelled rows of ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognized language; learned from the rows of ``docs`` that are not held out."""
    model = language_id.train(docs.filter(language_id.not_held_out("doc_id")))
    return language_id.keep_known(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle Jaccard links: five words a shingle, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside any benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``: how many times it takes each."""
    return mixing.apply_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifiers' fits can't be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        made = Stored(stage(spark, docs, sf_dir))
        if held is not None:
            held.drop()
        docs, held = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
