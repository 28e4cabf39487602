"""SAM text as columns: CIGARs, flags, MD, lines, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ["name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def cigar_ops(cigar: Column) -> Column:
    """An array of structs (op, len)."""
    parts = F.regexp_extract_all(cigar, F.lit(r"[0-9]+[MIDSH]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, "[0-9]+", 0).cast("long").alias("len")))


def length_of(cigar: Column, ops: str) -> Column:
    """Bases of the operations given: MIS is the read's length, MD the target's, MISH the whole read's."""
    kept = F.filter(cigar_ops(cigar), lambda x: F.lit(ops).contains(x["op"]))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x["len"])


def flag_bits(flag: Column) -> list[Column]:
    """The bits of a flag as columns of booleans."""
    names = ["paired", "proper", "unmapped", "mate_unmapped", "is_rev", "mate_rev", "first", "second", "secondary", "failed", "duplicate", "supplementary"]
    return [(flag.bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(names)]


def line(df: DataFrame) -> Column:
    """One SAM line of a record of LINE and tags."""
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in LINE], "tags")


def header(spark: SparkSession, contigs: DataFrame, extra: tuple[str, ...] = (), program: str = "@PG\tID:strandline\tPN:strandline") -> DataFrame:
    """(n, line): @SQ lines of the contigs unless `extra` brings its own, then `extra`, then the program. One row per
    contig."""
    alt = F.when(F.col("is_alt"), F.lit("\tAH:*")).otherwise(F.lit("")) if "is_alt" in contigs.columns else F.lit("")
    own = contigs.select(F.col("rid").cast("long").alias("n"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string"), alt).alias("line"))
    if any(x.startswith("@SQ") for x in extra):
        own = own.limit(0)
    rest = spark.createDataFrame([(1 << 40 | i, x) for i, x in enumerate([*extra, program])], "n long, line string")
    return own.unionByName(rest)


def escaped(text: str) -> str:
    r"""\t, \n, \r and \\ of a header option as characters."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in "tnr\\":
            out.append({"t": "\t", "n": "\n", "r": "\r", "\\": "\\"}[text[i + 1]])
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def read_group(text: str) -> tuple[str, str]:
    """(header line, ID) of a read group option; ValueError where it is none."""
    lined = escaped(text)
    if not lined.startswith("@RG"):
        raise ValueError("a read group line starts with @RG")
    found = [f[3:] for f in lined.split("\t") if f.startswith("ID:")]
    if not found or not found[0]:
        raise ValueError("a read group line has an ID")
    if len(found[0]) > 255:
        raise ValueError("a read group ID has 255 characters at most")
    return lined, found[0]
