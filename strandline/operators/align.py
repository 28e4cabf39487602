"""Aligner: reads and targets in, alignment records out.

Seeds are found by Spark joins; what follows depends on order within a read and runs per read in Arrow batches. Paired
reads need one exchange more: insert sizes per chunk."""

from __future__ import annotations

from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bases import normal, trim_read_number
from ..options import Options
from . import index, kernels, pairs, profile, records, seeds
from .hits import Region, Runs, Target, assign_primaries, build_chains, filter_chains, leftmost_first, positions_of, regions_of, repetitive, rounds_of, seeds_of

REGION = "tb long, te long, qb int, qe int, rid int, score int, true_score int, csub int, band int, covered int, seed_size int, n_comp int, alt boolean, rep double"
FIELDS = [f.split()[0] for f in REGION.split(", ")]
REGIONS = "array<struct<" + ", ".join(f"{a}:{b}" for a, b in (f.split() for f in REGION.split(", "))) + ">>"
#: Bases of all targets up to which they are sent to every executor; larger collections are to be split.
MOST_TARGET = 1 << 29
#: Positions per block of running sums.
BLOCK = 1 << 16


def collected(targets: DataFrame, o: Options) -> Target:
    """The targets as one array, after a check of their size."""
    size = targets.agg(F.sum(F.length("seq"))).first()[0] or 0
    if size > MOST_TARGET:
        raise ValueError(f"{size} target bases; at most {MOST_TARGET} can be sent to the executors: split the collection and align to each part")
    alt = F.col("is_alt") if "is_alt" in targets.columns and not o.ignore_alt else F.lit(False)
    anno = F.col("anno") if "anno" in targets.columns else F.lit(None).cast("string")
    rows = targets.select("rid", "name", normal(F.col("seq")).alias("seq"), F.coalesce(alt, F.lit(False)).alias("alt"), anno.alias("anno")).orderBy("rid").collect()
    lengths = np.array([len(r["seq"]) for r in rows], np.int64)
    forward = np.concatenate([kernels.codes(r["seq"]) for r in rows]) if rows else np.zeros(0, np.uint8)
    return Target([r["name"] for r in rows], np.cumsum(lengths) - lengths, lengths, np.array([r["alt"] for r in rows], bool), forward, [r["anno"] for r in rows])


#: The generator of substitutes: state -> state * STEP + ADD modulo 2^48, and the state before the first.
STEP, ADD, FIRST, MASK48 = 0x5DEECE66D, 0xB, (11 << 16) + 0x330E, (1 << 48) - 1


def substitutes(before: int, n: int) -> np.ndarray:
    """The codes of n bases of the sequence, after the first `before` of it, which are jumped over."""
    state, mult, add, left = FIRST, STEP, ADD, before
    while left:  # mult and add are those of a power of two of steps
        if left & 1:
            state = (state * mult + add) & MASK48
        mult, add, left = mult * mult & MASK48, (mult + 1) * add & MASK48, left >> 1
    states = np.array([(state * STEP + ADD) & MASK48], np.uint64)
    mult, add = STEP, ADD  # of as many steps as there are states
    while len(states) < n:
        states = np.concatenate([states, (states * np.uint64(mult) + np.uint64(add)) & np.uint64(MASK48)])
        mult, add = mult * mult & MASK48, (mult + 1) * add & MASK48
    return (states[:n] >> np.uint64(17) & np.uint64(3)).astype(np.uint8)


def with_substitutes(targets: DataFrame) -> DataFrame:
    """Ambiguous target bases become bases of a 48-bit linear congruential sequence, in order of the contigs.

    Only the number of them in each contig is summed in one place; a contig's own are found and replaced where it lies."""
    others = F.length(F.regexp_replace("seq", "[ACGTacgt]", "")).cast("long")
    if not targets.where(others > 0).limit(1).count():
        return targets
    w = W.orderBy("rid").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = targets.select("rid", others.alias("_n")).select(F.col("rid").alias("_rid"), (F.sum("_n").over(w) - F.coalesce("_n", F.lit(0))).alias("_before"))
    letters, keep = np.frombuffer(b"ACGT", np.uint8), targets.columns

    def run(batches):
        for batch in batches:
            out = []
            for seq, before in zip(batch.column("seq").to_pylist(), batch.column("_before").to_pylist()):
                if seq is not None:
                    found = kernels.codes(seq.encode("ascii", "replace"))
                    unknown = found > 3
                    found[unknown] = substitutes(before or 0, int(unknown.sum()))
                    seq = letters[found].tobytes().decode()
                out.append(seq)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "seq" else batch.column(c) for c in keep], keep)

    return targets.join(counts, targets["rid"] == counts["_rid"]).select(*keep, "_before").mapInArrow(run, targets.schema)


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows of lower `order` (unique whole numbers), by blocks, so that no task holds all."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_s"))
    firsts = sums.select("_block", (F.sum("_s").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_s")).alias("_first"))
    w = W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = blocked.withColumn("_in", F.sum(value).over(w) - F.col(value))
    return inner.join(F.broadcast(firsts), "_block").withColumn(name, F.col("_first") + F.col("_in")).drop("_block", "_first", "_in")  # a row per block


def chunked(reads: DataFrame, chunk_bases: int) -> DataFrame:
    """Adds chunk_id: the whole chunks of bases before the read's pair. reads: id, seq; mates have ids 2 i and 2 i + 1."""
    sized = reads.withColumn("_n", F.length("seq").cast("long"))
    before = running_sum(sized.groupBy(F.expr("id div 2").alias("_pair")).agg(F.sum("_n").alias("_n")), "_pair", "_n", "_before")
    chunk = before.select("_pair", F.floor(F.col("_before") / chunk_bases).cast("long").alias("chunk_id"))
    return sized.drop("_n").withColumn("_pair", F.expr("id div 2")).join(chunk, "_pair").drop("_pair")


def smart_pairs(reads: DataFrame) -> DataFrame:
    """reads (ordinal, name, ...) -> pair_id, end (1, 2, or 0 for a single read). Ordinals are whole numbers without gaps.

    Neighbours of equal names pair from left to right: within a run of equal names by parity. Runs are found per block of
    ordinals; of each block only its last name and its first and last run start are ordered in one place."""
    inner = W.partitionBy("_block").orderBy("ordinal")
    named = reads.withColumn("_key", trim_read_number(F.col("name"))).withColumn("_block", F.floor(F.col("ordinal") / BLOCK))
    ends = named.groupBy("_block").agg(F.max_by(F.struct("_key"), "ordinal")["_key"].alias("_last"), F.lit(True).alias("_is"))
    before = ends.select((F.col("_block") + 1).alias("_block"), "_last", "_is")
    near = named.join(F.broadcast(before), "_block", "left")  # a row per block
    head = F.row_number().over(inner) == 1
    same = F.when(head, F.coalesce("_is", F.lit(False)) & F.col("_last").eqNullSafe(F.col("_key"))).otherwise(F.lag("_key").over(inner).eqNullSafe(F.col("_key")))
    start = near.withColumn("_start", F.when(~same, F.col("ordinal"))).drop("_last", "_is")
    blocks = start.groupBy("_block").agg(F.min("_start").alias("_s"), F.max("_start").alias("_e"), F.max("ordinal").alias("_o"))
    over = W.orderBy("_block")
    bounds = blocks.select("_block", F.max("_e").over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_from"), F.min("_s").over(over.rowsBetween(1, W.unboundedFollowing)).alias("_to"), (F.max("_o").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) + 1).alias("_all"))
    placed = start.join(F.broadcast(bounds), "_block")
    first = F.coalesce(F.max("_start").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow)), F.col("_from"))
    stop = F.coalesce(F.min("_start").over(inner.rowsBetween(1, W.unboundedFollowing)), F.col("_to"), F.col("_all"))
    placed = placed.withColumn("_k", F.col("ordinal") - first).withColumn("_n", stop - first)
    paired = F.col("_k") < F.col("_n") - F.col("_n") % 2
    return placed.withColumn("end", F.when(paired, F.col("_k") % 2 + 1).otherwise(0).cast("int")).withColumn("pair_id", F.when(paired, F.col("ordinal") - F.col("_k") % 2).otherwise(F.col("ordinal"))).drop("_key", "_block", "_start", "_from", "_to", "_all", "_k", "_n")


def as_rows(regions: list[Region]) -> list[dict]:
    return [{f: d[f] for f in FIELDS} for d in map(asdict, regions)]


def from_rows(rows) -> list[Region]:
    return [Region(**r) for r in rows or []]


class Aligner:
    """align(reads, targets): reads (id, name, seq, and if present comment, qual), targets (rid, name, seq, is_alt).

    run() takes reads in the order of a file (ordinal instead of id): single ones, or with the option interleaved a mix of
    single reads and neighbours of equal names, which are mates."""

    def __init__(self, options: Options | None = None, kmers: DataFrame | None = None, **given):
        """kmers: the k-mer table of the targets, if index.save() wrote it; else it is made."""
        self.o = options if options and not given else replace(options, **given) if options else Options.of(**given)
        self.kmers = kmers

    def told(self, targets: DataFrame) -> tuple[DataFrame, Broadcast]:
        """targets with substitutes, and their bases, collected once and sent to the executors."""
        targets = with_substitutes(targets)
        return targets, targets.sparkSession.sparkContext.broadcast(collected(targets, self.o))

    def matches(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """id and its exact matches, as an array of (b, e, pos)."""
        source = reads.select(F.col("id").alias("read_id"), normal(F.col("seq")).alias("seq"))
        runs = seeds.match_runs(seeds.seed_join(source, index.sized(self.kmers if self.kmers is not None else index.doubled_kmers(targets, self.o.min_seed), targets), self.o.min_seed), self.o.min_seed)
        return runs.groupBy("read_id").agg(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), F.col("e").cast("int").alias("e"), F.col("pos").cast("long").alias("pos"))).alias("runs")).withColumnRenamed("read_id", "id")

    def per_read(self, reads: DataFrame, targets: DataFrame, work, schema: str) -> DataFrame:
        """id, and a row of `schema` for each that work(runs, read, target, o) gives of a read."""
        targets, told = self.told(targets)
        o, names = self.o, [f.split()[0] for f in schema.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        types = [kinds[f.split()[1]] for f in schema.split(", ")]

        def run(batches):
            for batch in batches:
                ids, rows = [], []
                for id_, seq, found in zip(*(batch.column(c).to_pylist() for c in ("id", "seq", "runs"))):
                    if seq:
                        got = list(work(Runs.of(found or [], o.min_seed), kernels.codes(seq), told.value, o))
                        ids += [id_] * len(got)
                        rows += got
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", *names])

        return reads.select("id", "seq").join(self.matches(reads, targets), "id", "left").select("id", "seq", "runs").mapInArrow(run, f"id long, {schema}")

    def seeds(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """id, round (1 to 3), b, e, occ of the seeds of each read."""
        return self.per_read(reads, targets, lambda runs, read, target, o: [(k + 1, *s) for k, found in enumerate(rounds_of(runs, read, o)) for s in found], "round int, b int, e int, occ long")

    def seed_positions(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """id, b, e, pos: the occurrences of each seed that chains are built from."""
        return self.per_read(reads, targets, lambda runs, read, target, o: [(b, e, t) for b, e in sorted({s[:2] for s in seeds_of(runs, read, o)}) for t in positions_of(b, e, runs, target, o)], "b int, e int, pos long")

    def repetition(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """id, covered: bases under seeds above max_occ, of every read that has a base."""
        return self.per_read(reads, targets, lambda runs, read, target, o: [(repetitive(seeds_of(runs, read, o), o),)], "covered long")

    def chains(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """id, chain, rid, weight, kept (0: filtered), b, e, n_seeds of the chains of each read, in target order."""

        def work(runs, read, target, o):
            found = build_chains(seeds_of(runs, read, o), runs, len(read), target, o)
            filter_chains(found, target, o)
            return [(i, c.rid, c.weight, c.kept, *c.span, len(c.seeds)) for i, c in enumerate(found)]

        return self.per_read(reads, targets, work, "chain int, rid int, weight int, kept int, b int, e int, n_seeds int")

    def regions(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """The columns of reads, and their hits before ranking."""
        return self.regions_in(reads, *self.told(targets))

    def regions_in(self, reads: DataFrame, targets: DataFrame, told: Broadcast) -> DataFrame:
        """regions() of targets that told() gave."""
        o, k = self.o, self.o.min_seed
        rows = reads.join(self.matches(reads, targets), "id", "left")
        keep = reads.columns

        def run(batches):
            target = told.value
            for batch in batches:
                out = []
                for seq, found in zip(batch.column("seq").to_pylist(), batch.column("runs").to_pylist()):
                    if not found or not seq:
                        out.append([])
                        continue
                    out.append(as_rows(regions_of(Runs.of(found, k), kernels.codes(seq), target, o)))
                kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
                kind = pa.list_(pa.struct([(f.split()[0], kinds[f.split()[1]]) for f in REGION.split(", ")]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, kind)], [*keep, "regions"])

        return rows.mapInArrow(run, StructType([*reads.select(*keep).schema, *StructType.fromDDL(f"regions {REGIONS}")]))

    def profile(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """stage, workers, total, least, greatest, mean: seconds of each stage of single reads, over the tasks that had reads.

        The reads are aligned and the records thrown away. A task hands on one row per stage, so only tasks that ended count,
        each once. The join that finds the matches is Spark's and not among the stages."""
        targets, told = self.told(targets)
        o = self.o

        def run(batches):
            clock, any_read = profile.Clock(), False
            for batch in batches:
                for id_, seq, found in zip(*(batch.column(c).to_pylist() for c in ("id", "seq", "runs"))):
                    any_read = True
                    read = kernels.codes(seq or "")
                    regions = regions_of(Runs.of(found, o.min_seed), read, told.value, o, clock) if found and seq else []
                    regions, _ = clock("rank", assign_primaries, regions, o, id_)
                    clock("records", records.chosen, regions, read, told.value, o)
            stages = profile.STAGES if any_read else []
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(stages, pa.string()), pa.array([part] * len(stages), pa.int32()), pa.array([clock.seconds[s] for s in stages], pa.float64())], ["stage", "worker", "seconds"])

        spent = reads.select("id", "seq").join(self.matches(reads, targets), "id", "left").select("id", "seq", "runs").mapInArrow(run, "stage string, worker int, seconds double")
        return profile.summary(spent, "stage", "worker", F.col("seconds"))

    def align(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """Single-end records: id, name, and the fields of a SAM line."""
        o = self.o
        targets, told = self.told(targets)
        found = self.regions_in(reads, targets, told)
        found = found.select("id", "name", "seq", *[F.col(c) if c in reads.columns else F.lit(None).cast("string").alias(c) for c in ("qual", "comment")], "regions")

        def run(batches):
            target = told.value
            for batch in batches:
                out = []
                for id_, seq, rows in zip(*(batch.column(c).to_pylist() for c in ("id", "seq", "regions"))):
                    regions, _ = assign_primaries(from_rows(rows), o, id_)
                    if o.primary5:
                        regions = leftmost_first(regions, o)
                    out.append((records.chosen(regions, kernels.codes(seq or ""), target, o), None))
                yield shown_batch(target, out, [*(batch.column(c) for c in READ), pa.array([0] * len(out), pa.int32())])

        return records.sam_columns(found.mapInArrow(run, SHOWN), o)

    def run(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """Records of reads (ordinal, name, seq, ...) as a file has them; ids are twice the ordinal of a read or of the first mate,
        and one more for the second mate."""
        if not self.o.interleaved:
            return self.align(reads.withColumn("id", F.col("ordinal") * 2).drop("ordinal"), targets)
        told = smart_pairs(reads).withColumn("id", 2 * F.col("pair_id") + F.when(F.col("end") == 2, 1).otherwise(0))
        mates, single = (told.where(c).drop("ordinal", "pair_id", "end") for c in ("end > 0", "end = 0"))
        return self.align_pairs(mates, targets).unionByName(self.align(single, targets))

    def statistics(self, found: DataFrame, half: int) -> DataFrame:
        """Insert sizes per chunk of paired regions (pair_id, chunk_id, regions1, regions2)."""
        o = self.o

        def run(batches):
            for batch in batches:
                rows = [(c, e) for c, a, b in zip(*(batch.column(x).to_pylist() for x in ("chunk_id", "regions1", "regions2"))) if (e := pairs.evidence(from_rows(a), from_rows(b), half, o))]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([e[0] for _, e in rows], pa.int32()), pa.array([e[1] for _, e in rows], pa.int64())], ["chunk_id", "dir", "dist"])

        return pairs.insert_statistics(found.select("chunk_id", "regions1", "regions2").mapInArrow(run, "chunk_id long, dir int, dist long"))

    def align_pairs(self, reads: DataFrame, targets: DataFrame) -> DataFrame:
        """Paired records. Mates have ids 2 i and 2 i + 1 and equal names but for a closing /digit."""
        o = self.o
        targets, told = self.told(targets)
        optional = [F.col(c) if c in reads.columns else F.lit(None).cast("string").alias(c) for c in ("qual", "comment")]
        source = chunked(reads.select("id", trim_read_number(F.col("name")).alias("name"), "seq", *optional), o.chunk_bases)
        found = self.regions_in(source, targets, told).withColumn("pair_id", F.expr("id div 2"))
        end = lambda n: found.where(F.col("id") % 2 == n - 1).select("pair_id", *(["chunk_id"] if n == 1 else []), *[F.col(c).alias(f"{c}{n}") for c in ("name", "seq", "qual", "comment", "regions")])
        both = end(1).join(end(2), "pair_id").withColumn("_same", F.assert_true(F.col("name1") == F.col("name2"), F.lit("paired reads have different names"))).where("_same is null").drop("_same")
        if o.insert_stats:
            mean, *rest = o.insert_stats
            std = rest[0] if rest else 0.1 * mean
            high = int(rest[1] if len(rest) > 1 else mean + 4 * std + 0.499)
            low = int(rest[2] if len(rest) > 2 else max(1, mean - 4 * std + 0.499))
            fixed = [None, (low, high, mean, std), None, None]
            both = both.withColumn("stats", F.lit(None).cast("array<struct<dir:int,low:bigint,high:bigint,failed:boolean,avg:double,std:double>>"))
        else:
            fixed = None
            stats = self.statistics(both, told.value.half).groupBy("chunk_id").agg(F.collect_list(F.struct(F.col("dir").cast("int").alias("dir"), "low", "high", "failed", "avg", "std")).alias("stats"))
            both = both.join(stats, "chunk_id", "left")

        def run(batches):
            target = told.value
            for batch in batches:
                out, columns = [], {c: [] for c in READ}
                for row in batch.to_pylist():
                    stats = list(fixed or [None] * 4)
                    for s in row["stats"] or []:
                        if not s["failed"]:
                            stats[s["dir"]] = (s["low"], s["high"], s["avg"], s["std"])
                    out += pairs.pair_hits([from_rows(row["regions1"]), from_rows(row["regions2"])], [kernels.codes(row[f"seq{n}"] or "") for n in (1, 2)], stats, target, o, row["pair_id"])
                    for n in (1, 2):
                        for c, x in (("id", 2 * row["pair_id"] + n - 1), ("name", row["name1"]), *((c, row[f"{c}{n}"]) for c in READ[2:])):
                            columns[c].append(x)
                kinds = {"id": pa.int64()}
                yield shown_batch(target, out, [*(pa.array(columns[c], kinds.get(c, pa.string())) for c in READ), pa.array([1, 2] * (len(out) // 2), pa.int32())])

        return records.sam_columns(both.mapInArrow(run, SHOWN), o)


READ = ["id", "name", "seq", "qual", "comment"]
SHOWN = "id long, name string, seq string, qual string, comment string, end int, " + records.shown_type()


def shown_batch(target: Target, hits: list, columns: list) -> pa.RecordBatch:
    """hits: (shown, mate) of each row; columns: READ and end."""
    shown = pa.array([[a.row(target) for a in rows] for rows, _ in hits], pa.list_(records.HIT_TYPE))
    mate = pa.array([m.row(target) if m is not None else None for _, m in hits], records.HIT_TYPE)
    return pa.RecordBatch.from_arrays([*columns, shown, mate], [*READ, "end", "shown", "mate"])
