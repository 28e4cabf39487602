"""The query of each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chunks, fingerprints, jaccard, langid, merkle, neighbours, packing, quality, tokenfile, urlrules
from .common import remainder, table


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return quality.score(docs, quality.fit(docs, labels), ["doc_id", "held_out"])


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(table(spark, sf_dir, "documents"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_pages(table(spark, sf_dir, "pages"))


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.encode_decode(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rules_table(spark))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_file, op2_language, op3_quality, op4_neighbours, op5_jaccard_join, op6_warc_fixity, op7_bpe_chunks, op8_url_rules, op9_best_fit, op10_minhash_fingerprints)
}

ORACLE: dict[str, str] = {"op6_warc_fixity": merkle.SQL, "op8_url_rules": urlrules.SQL}
