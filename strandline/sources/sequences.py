"""FASTA and FASTQ files as DataFrames, and SAM text out.

Files are read by Spark, so any store and compression it knows will do. Plain files are read by byte ranges in parallel: a
FASTA record is what lies between two lines that start with '>', a FASTQ record is four lines (read_fastq). Files of any
layout, gzip among them, can be read whole, each by one task (read_sequences)."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sam
from ..functions.bases import trim_read_number
from ..options import Options

RECORD = "file string, ordinal long, name string, comment string, seq string, qual string"


class Truncated(ValueError):
    """A quality string that does not match its sequence."""


def parse(text: str) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(name, comment, seq, qual) of each record: '>' or '@' starts one, sequences may take several lines, '+' starts the
    quality, which is read until it is as long as the sequence."""
    lines = text.splitlines()
    i, n = 0, len(lines)
    while i < n:
        if not lines[i][:1] in (">", "@") or not lines[i]:
            i += 1
            continue
        parts = lines[i][1:].split(None, 1)
        name, comment = parts[0] if parts else "", parts[1] if len(parts) > 1 else None
        i += 1
        seq, qual = [], None
        while i < n and lines[i][:1] not in (">", "@", "+"):
            seq.append("".join(lines[i].split()))
            i += 1
        bases = "".join(seq)
        if i < n and lines[i].startswith("+"):
            i += 1
            got, size = [], 0
            while i < n and size < len(bases):
                got.append(lines[i])
                size += len(lines[i])
                i += 1
            qual = "".join(got)
            if len(qual) != len(bases):
                raise Truncated(f"record {name}: {len(qual)} qualities for {len(bases)} bases")
        yield name, comment, bases, qual


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of one or more FASTA or FASTQ files, plain or gzip; ordinal counts from 0 within a file."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))

    def run(batches):
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                rows = [(file, i, *r) for i, r in enumerate(parse(text))]
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in RECORD.split(", ")])

    return texts.mapInArrow(run, RECORD)


def numbered_lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, n, value: what stands between separators, numbered within its file from 0.

    A byte range is a group; its rows keep their order, and the ranges before it only count."""
    rows = spark.read.text(path, lineSep=separator).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    sizes = rows.groupBy("file", "at").agg(F.count("*").alias("c"))  # a row for each byte range
    before = sizes.select("file", "at", (F.sum("c").over(W.partitionBy("file").orderBy("at")) - F.col("c")).alias("before"))
    inner = F.row_number().over(W.partitionBy("file", "at").orderBy("i")) - 1
    return rows.withColumn("k", inner).join(F.broadcast(before), ["file", "at"]).select("file", (F.col("before") + F.col("k")).alias("n"), "value")


def named(header: Column) -> tuple[Column, Column]:
    """Name and comment of a header line without its first character."""
    parts = F.split(F.trim(header), r"\s+", 2)
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.nullif(F.get(parts, F.lit(1)), F.lit(""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of plain FASTA files, by byte ranges: the rows of read_sequences."""
    rows = numbered_lines(spark, path, "\n>").where("not (n = 0 and value not like '>%')")
    text = F.when(F.col("n") == 0, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    head, body = F.regexp_extract(text, r"(?s)^([^\r\n]*)", 1), F.regexp_replace(F.regexp_replace(text, r"(?s)^[^\r\n]*", ""), r"\s", "")
    name, comment = named(head)
    none = F.lit(None).cast("string")
    return rows.select("file", F.col("n").cast("long").alias("ordinal"), name.alias("name"), comment.alias("comment"), body.alias("seq"), none.alias("qual"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of plain FASTQ files of four lines a record, by byte ranges: the rows of read_sequences."""
    lines = numbered_lines(spark, path, "\n").withColumn("value", F.rtrim(F.regexp_replace("value", "\r$", "")))
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    got = lines.groupBy("file", F.floor(F.col("n") / 4).cast("long").alias("ordinal")).agg(part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual")).where("head != ''")
    fine = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    wrong = F.raise_error(F.concat(F.lit("not a record of four lines with as many qualities as bases: "), F.col("head")))
    name, comment = named(F.substring("head", 2, 1 << 30))
    return got.select("file", "ordinal", name.alias("name"), comment.alias("comment"), F.when(F.coalesce(fine, F.lit(False)), F.col("seq")).otherwise(wrong).alias("seq"), "qual")


def read_pairs(spark: SparkSession, first: str, second: str, reader: Callable[[SparkSession, str], DataFrame] = read_sequences) -> DataFrame:
    """id, name, comment, seq, qual: record i of the first file has id 2 i, of the second 2 i + 1. Of several files the k-th of
    each side belong together, in order of their names, and i goes on from file to file. Records behind the end of the
    shorter file of two are left out, with a warning that says how many."""
    ends = []
    for path in (first, second):
        rows = reader(spark, path)
        files = rows.groupBy("file").agg((F.max("ordinal") + 1).alias("size"))
        order = files.select("file", "size", (F.row_number().over(W.orderBy("file")) - 1).alias("k"))  # a row for each file
        ends.append((rows.join(F.broadcast(order.select("file", "k")), "file"), {r["k"]: r["size"] for r in order.collect()}))
    sizes = [x[1] for x in ends]
    both = {k: min(sizes[0].get(k, 0), sizes[1].get(k, 0)) for k in sorted(set(sizes[0]) | set(sizes[1]))}
    surplus = sum(sum(x.values()) for x in sizes) - 2 * sum(both.values())
    if surplus:
        warnings.warn(f"{surplus} reads have no mate and are left out: files of mates differ in length", stacklevel=2)
    table, at = [], 0
    for k, n in both.items():
        table.append((k, at, n))
        at += n
    starts = F.broadcast(spark.createDataFrame(table, "k int, start long, n long"))
    out = [rows.join(starts, "k").where("ordinal < n").select((2 * (F.col("start") + F.col("ordinal")) + i).alias("id"), trim_read_number(F.col("name")).alias("name"), "comment", "seq", "qual") for i, (rows, _) in enumerate(ends)]
    return out[0].unionByName(out[1])


def read_targets(spark: SparkSession, path: str, alt: str | None = None, reader: Callable[[SparkSession, str], DataFrame] = read_sequences) -> DataFrame:
    """rid, name, anno, seq, is_alt. alt: a file whose first column names the alternative contigs; its '@' lines are none."""
    rows = reader(spark, path).withColumn("rid", (F.row_number().over(W.orderBy("file", "ordinal")) - 1).cast("int"))  # a row per contig
    out = rows.select("rid", "name", F.col("comment").alias("anno"), "seq")
    if alt is None:
        return out.withColumn("is_alt", F.lit(False))
    names = spark.read.text(alt).where("value not like '@%'").select(F.split("value", r"\t")[0].alias("name")).distinct().withColumn("is_alt", F.lit(True))
    return out.join(names, "name", "left").select("rid", "name", "anno", "seq", F.coalesce("is_alt", F.lit(False)).alias("is_alt"))


def write_sam(records: DataFrame, contigs: DataFrame, path: str, extra: tuple[str, ...] = (), options: Options | None = None) -> None:
    """Text files of SAM lines in the order of the reads, the header first (with the lines of the options' header); part files
    in name order are the file."""
    spark = records.sparkSession
    head = sam.header(spark, contigs, (*(options.header if options else ()), *extra)).select(F.lit(-1).cast("long").alias("id"), F.col("n"), F.col("line").alias("value"))
    body = records.select("id", F.monotonically_increasing_id().alias("n"), sam.line(records).alias("value"))
    head.unionByName(body).orderBy("id", "n").select("value").write.text(path)
