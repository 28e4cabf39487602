"""Targets as tables: contigs with offsets, the doubled base string, and the table of its k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import reverse_complement, upper, with_kmers

#: Positions per bin of the contig lookup.
BIN = 4096
#: K-mers of the targets up to which their table is broadcast; beyond it reads and targets meet by a shuffle.
MOST_BROADCAST = 1 << 20


def sized(kmers: DataFrame, targets: DataFrame) -> DataFrame:
    """The k-mer table of the targets, marked for broadcast if it is small enough."""
    positions = 2 * (targets.agg(F.sum(F.length("seq"))).first()[0] or 0)
    return F.broadcast(kmers) if positions <= MOST_BROADCAST else kmers


def contigs(targets: DataFrame) -> DataFrame:
    """targets (rid, name, seq) -> rid, name, len, off. One row per target sequence; offsets run over all of them."""
    w = W.orderBy("rid").rowsBetween(W.unboundedPreceding, W.currentRow)
    sized = targets.select("rid", "name", F.length("seq").cast("long").alias("len"))
    return sized.withColumn("off", F.sum("len").over(w) - F.col("len"))


def contig_bins(contigs_: DataFrame) -> DataFrame:
    """A row per contig and bin of positions that it touches: the equi-join side of a position lookup."""
    return contigs_.where("len > 0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("off") / BIN), F.floor((F.col("off") + F.col("len") - 1) / BIN))))


def locate(rows: DataFrame, contigs_: DataFrame, pos: str, prefix: str = "") -> DataFrame:
    """Adds the contig (rid, off, len) that holds each position; null outside all of them."""
    bins = contig_bins(contigs_).select("bin", F.col("rid").alias(f"{prefix}rid"), F.col("off").alias(f"{prefix}off"), F.col("len").alias(f"{prefix}len"))
    left = rows.withColumn("_bin", F.floor(F.col(pos) / BIN))
    on = (F.col("_bin") == F.col("bin")) & (F.col(pos) >= F.col(f"{prefix}off")) & (F.col(pos) < F.col(f"{prefix}off") + F.col(f"{prefix}len"))
    return left.join(bins, on, "left").drop("_bin", "bin")


def doubled_kmers(targets: DataFrame, k: int) -> DataFrame:
    """(kmer, pos) of every position of forward ++ reverse complement, contig and strand joints included.

    Each contig is joined with the first k - 1 bases behind it; contigs of no base hold none."""
    placed = targets.join(contigs(targets).select("rid", "off", "len"), "rid")
    total = contigs(targets).agg(F.sum("len").alias("half"))
    w = W.orderBy("off")
    forward = placed.where("len > 0").select("off", "len", "seq")
    both = forward.crossJoin(F.broadcast(total)).select(
        F.explode(F.array(F.struct("off", "seq"), F.struct((2 * F.col("half") - F.col("off") - F.col("len")).alias("off"), reverse_complement(F.col("seq")).alias("seq")))).alias("p")
    ).select("p.off", "p.seq")
    # the k - 1 bases behind a piece come from as many following pieces as it takes; only these heads are ordered in one place
    heads = both.select("off", F.substring("seq", 1, k - 1).alias("head"))
    behind = heads.select("off", F.array_join(F.collect_list("head").over(w.rowsBetween(1, k - 1)), "").substr(1, k - 1).alias("behind"))
    tail = both.join(behind, "off").withColumn("whole", F.concat("seq", "behind"))
    return with_kmers(tail, ["off"], "whole", k).select("kmer", (F.col("off") + F.col("q")).alias("pos"))


def holes(targets: DataFrame) -> DataFrame:
    """(rid, off, len, amb): runs of one letter other than A, C, G, T; a change of letter starts a new run."""
    parts = targets.select("rid", F.posexplode(F.regexp_extract_all(upper(F.col("seq")), F.lit(r"(?s)([ACGT]+)|(([^ACGT])\3*)"), F.lit(0))).alias("i", "part"))
    w = W.partitionBy("rid").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.length("part").cast("long")
    return parts.select("rid", (F.sum(size).over(w) - size).alias("off"), size.alias("len"), F.substring("part", 1, 1).alias("amb")).where("amb not in ('A', 'C', 'G', 'T')")


def ambiguous_in(spans: DataFrame, holes_: DataFrame) -> DataFrame:
    """spans (rid, b, e) with n_ambiguous: bases of holes inside each. A contig's holes meet its spans by an equi-join."""
    h = holes_.select("rid", F.col("off").alias("_o"), F.col("len").alias("_l"))
    inside = F.greatest(F.lit(0), F.least(F.col("e"), F.col("_o") + F.col("_l")) - F.greatest(F.col("b"), F.col("_o")))
    found = spans.join(h, "rid").where("_o < e and _o + _l > b").groupBy("rid", "b", "e").agg(F.sum(inside).alias("n_ambiguous"))
    return spans.join(found, ["rid", "b", "e"], "left").fillna(0, ["n_ambiguous"])


def save(targets: DataFrame, path: str, k: int) -> None:
    """The index as tables under `path`: targets, contigs, holes and the k-mers, clustered by k-mer."""
    for name, df in (("targets", targets), ("contigs", contigs(targets)), ("holes", holes(targets)), ("kmers", doubled_kmers(targets, k).repartition("kmer").sortWithinPartitions("kmer"))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("targets", "contigs", "holes", "kmers")}
