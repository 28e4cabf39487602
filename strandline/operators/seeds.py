"""Maximal exact matches by k-mer equi-join and gaps-and-islands.

A run (b, e, pos) says that query [b, e) equals the target from pos on and cannot be made longer. The seeds of a read follow
from its runs alone (hits.Runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import with_kmers


def seed_join(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """reads (read_id, seq), index (kmer, pos) -> read_id, q, pos. The index may be marked for broadcast
    (index.sized); else reads and targets are shuffled on k-mers."""
    exploded = with_kmers(reads, ["read_id"], "seq", k)
    return exploded.join(index, "kmer").select("read_id", "q", "pos")


def match_runs(seeds: DataFrame, k: int) -> DataFrame:
    """read_id, b, e, pos: consecutive seeds of a diagonal become one exact match."""
    w = W.partitionBy("read_id", "diag").orderBy("q")
    islands = seeds.withColumn("diag", F.col("pos") - F.col("q")).withColumn("island", F.col("q") - F.row_number().over(w))
    return islands.groupBy("read_id", "diag", "island").agg(F.min("q").alias("b"), (F.max("q") + k).alias("e")).select("read_id", "b", "e", (F.col("diag") + F.col("b")).alias("pos"))


def occurrence_sample(hits: DataFrame, keys: list[str], order: str, max_occ: int) -> DataFrame:
    """Of each seed every occurrence, or max_occ of them at equal strides in the order given: adds occ and rank."""
    w = W.partitionBy(*keys)
    step = F.when(F.col("occ") > max_occ, F.expr(f"occ div {max_occ}")).otherwise(1)
    ranked = hits.withColumn("occ", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(order)) - 1)
    return ranked.withColumn("step", step).where((F.col("rank") % F.col("step") == 0) & (F.floor(F.col("rank") / F.col("step")) < max_occ)).drop("step")


def union_length(spans: DataFrame, keys: list[str], b: str, e: str, name: str) -> DataFrame:
    """The length of the union of intervals [b, e) of each key: what each adds beyond the greatest end before it."""
    w = W.partitionBy(*keys).orderBy(b, e).rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max(e).over(w), F.col(b))
    return spans.withColumn("_new", F.greatest(F.lit(0), F.col(e) - F.greatest(F.col(b), reached))).groupBy(*keys).agg(F.sum("_new").alias(name))
