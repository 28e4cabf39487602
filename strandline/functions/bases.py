"""Columns over base strings: encoding, strands, composition, k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters a to z by the low two bits of their code, as bases. A fixed value of the fixtures.
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "CGTACGTACGTACGTACGTACGTACG"


def from_text(text: Column) -> Column:
    """Any text as a base string: its letters A-Z and a-z, each as one base."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, AS_BASES)


def upper(seq: Column) -> Column:
    """ASCII letters in upper case; other letters would change their number."""
    return F.translate(seq, LETTERS, LETTERS.upper())


def normal(seq: Column) -> Column:
    """A, C, G, T in upper case; every other letter as N."""
    return F.regexp_replace(upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def count_of(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


#: Bases of a piece of a sequence: reaching a base of a string takes time in proportion to its place.
PIECE = 256


def with_kmers(df: DataFrame, keep: list[str], seq: str, k: int) -> DataFrame:
    """The columns `keep`, and a row (q, kmer) for every substring of k bases without N and its start.

    Sequences are cut into overlapping pieces first, so that long ones take time in proportion to their length."""
    pieces = df.where(F.length(seq) >= k).select(*keep, F.col(seq).alias("_s"), F.explode(F.sequence(F.lit(0), F.length(seq) - k, F.lit(PIECE))).alias("_at")).select(*keep, "_at", F.expr(f"substring(_s, _at + 1, {PIECE + k - 1})").alias("_p"))
    rows = pieces.select(*keep, "_at", "_p", F.explode(F.sequence(F.lit(0), F.length("_p") - k)).alias("_i"))
    return rows.select(*keep, (F.col("_at") + F.col("_i")).alias("q"), F.expr(f"substring(_p, _i + 1, {k})").alias("kmer")).where("instr(kmer, 'N') = 0")


def fold(pos: Column, half: Column) -> Column:
    """A coordinate of the doubled space on the forward strand."""
    return F.when(pos >= half, 2 * half - 1 - pos).otherwise(pos)


def trim_read_number(name: Column) -> Column:
    """The name without a closing /digit, where more than that is left."""
    return F.regexp_replace(name, "(?<=.)/[0-9]$", "")
