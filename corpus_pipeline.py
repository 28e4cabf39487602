"""The corpus pipeline: language, quality, near duplicates, packing. Each stage works on all that the one before it kept.

Defined results of every stage: null texts count as empty; rows that repeat are judged alike, and the near-duplicate stage
keeps one of them; columns besides doc_id, text, lang and source are carried along, whatever their names, up to packing; an
empty table gives an empty table. Null and repeated ids are allowed. Ties are broken as the operators' docstrings say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import jaccard, langid, packing, quality
from strandline.llm.common import drop_written, new_path, remainder, table, unused

#: A document is rejected if it has no letter, or if no language reaches this probability.
LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages. Columns stay as they are. Texts without a letter go."""
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    names = unused("language", docs.columns), unused("score", docs.columns)
    judged = langid.predict(docs, model, docs.columns, names)
    return judged.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_LANGUAGE)).drop(*names)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines are likely good. An empty text is scored as one empty line; without labels all stay."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    names = unused("score", docs.columns), unused("predicted", docs.columns)
    return quality.score(docs, quality.fit(docs, labels), docs.columns, names=names).where(F.col(names[1]) == 1).drop(*names)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the least id; ids may be null or repeat."""
    return jaccard.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of token sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("quality", good), ("near_duplicates", distinct), ("packing", packed)]

#: Models and best fit are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{i}-{name}")
        out.write.parquet(path)
        if before:
            drop_written(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
