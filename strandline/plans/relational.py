"""Queries of the relational stages over the fixture tables, each with its SQL.

Targets are the items of `benchmark`, reads the texts of `documents`, both as base strings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bases, scores
from ..operators import hits, index, seeds
from ..operators.align import Aligner
from ..options import Options

K = 19
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
O = Options()


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are fewer than those; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reads(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("read_id"), bases.from_text(F.col("text")).alias("seq"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "benchmark")
    return t.select(F.col("item_id").alias("rid"), F.concat(F.lit("item"), F.col("item_id")).alias("name"), bases.from_text(F.col("text")).alias("seq"))


BASES = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'CGTACGTACGTACGTACGTACGTACG')"
READS = f"reads as (select doc_id as read_id, {BASES} as seq from documents)"
TARGETS = f"targets as (select item_id as rid, 'item' || item_id as name, {BASES} as seq from benchmark)"
CONTIGS = TARGETS + ", contigs as (select rid, name, length(seq) as len, sum(length(seq)) over (order by rid) - length(seq) as off from targets)"
WHOLE = TARGETS + ", fwd as (select string_agg(seq, '' order by rid) as s from targets), whole as (select s || translate(reverse(s), 'ACGT', 'TGCA') as s from fwd)"
RUNS = f"""{WHOLE}, {READS},
pz as (select unnest(range(0, length(s) - {K} + 1)) as pos, s from whole), idx as (select pos, substr(s, pos + 1, {K}) as kmer from pz),
qs as (select read_id, unnest(range(0, length(seq) - {K} + 1)) as q, seq from reads where length(seq) >= {K}),
seeds as (select read_id, q, pos from (select read_id, q, substr(seq, q + 1, {K}) as kmer from qs) join idx using (kmer)),
isl as (select read_id, pos - q as diag, q, q - row_number() over (partition by read_id, pos - q order by q) as island from seeds),
runs as (select read_id, min(q) as b, max(q) + {K} as e, diag + min(q) as pos from isl group by read_id, diag, island)"""
FIRST = RUNS + """, spans as (select distinct read_id, b, e from runs),
top as (select * from spans s where not exists (select 1 from spans o where o.read_id = s.read_id and o.b <= s.b and o.e >= s.e and (o.b, o.e) <> (s.b, s.e))),
first as (select t.read_id, t.b, t.e, count(*) as occ from top t join runs r on r.read_id = t.read_id and r.b <= t.b and r.e >= t.e group by all)"""


def seeds_of(spark: SparkSession, d: str) -> DataFrame:
    t = targets(spark, d)
    return seeds.seed_join(reads(spark, d), index.sized(index.doubled_kmers(t, K), t), K)


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    return seeds.match_runs(seeds_of(spark, d), K)


def long(df: DataFrame) -> DataFrame:
    """All whole-number columns as long."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint", "bigint") else F.col(c) for c, t in df.dtypes])


@query(f"with {READS} select read_id, length(seq) as n_bases, md5(seq) as seq_md5 from reads")
def encode_bases(spark, d):
    return reads(spark, d).select("read_id", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("seq_md5"))


@query(f"with {READS} select read_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) as rc_md5 from reads")
def revcomp(spark, d):
    return reads(spark, d).select("read_id", F.md5(bases.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query("""with n as (select doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGT]', 'N', 'g') as s from documents)
select doc_id, length(s) - length(replace(s, 'A', '')) as a, length(s) - length(replace(s, 'C', '')) as c, length(s) - length(replace(s, 'G', '')) as g, length(s) - length(replace(s, 'T', '')) as t, length(s) - length(replace(s, 'N', '')) as n from n""")
def base_counts(spark, d):
    s = table(spark, d, "documents").select("doc_id", bases.normal(F.col("text")).alias("s"))
    return s.select("doc_id", *[bases.count_of(F.col("s"), x).cast("long").alias(x.lower()) for x in "ACGTN"])


@query(f"with {CONTIGS} select rid, name, cast(len as bigint) as len, cast(off as bigint) as off from contigs")
def contig_offsets(spark, d):
    return index.contigs(targets(spark, d)).select("rid", "name", "len", "off")


POSITIONS = CONTIGS + ", total as (select sum(len) as half from contigs), p as (select l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % half as pos from lineitem, total)"


def positions(spark, d, doubled=False):
    c = index.contigs(targets(spark, d))
    total = c.agg(F.sum("len").alias("half"))
    space = (2 if doubled else 1) * F.col("half")
    li = table(spark, d, "lineitem").crossJoin(F.broadcast(total))  # one row
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "half", ((F.col("l_orderkey") * 7919 + F.col("l_linenumber").cast("long") * 104729 + F.col("l_partkey")) % space).alias("pos")), c


@query(f"with {POSITIONS} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(pos as bigint) as pos, rid, cast(pos - off as bigint) as contig_pos from p left join contigs on pos >= off and pos < off + len")
def pos_to_contig(spark, d):
    p, c = positions(spark, d)
    return index.locate(p, c, "pos").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "pos", "rid", (F.col("pos") - F.col("off")).alias("contig_pos"))


DOUBLED = POSITIONS.replace("% half as pos", "% (2 * half) as pos, half, cast(l_quantity as bigint) as size")


@query(f"with {DOUBLED} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(case when pos >= half then 2 * half - 1 - pos else pos end as bigint) as fwd, pos >= half as is_rev from p")
def strand_fold(spark, d):
    p, _ = positions(spark, d, True)
    return p.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), bases.fold(F.col("pos"), F.col("half")).alias("fwd"), (F.col("pos") >= F.col("half")).alias("is_rev"))


@query(f"""with {DOUBLED}, f as (select *, case when pos >= half then 2 * half - pos - size else pos end as lo from p), g as (select *, lo + size - 1 as hi from f)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(case when pos < half and pos + size > half then -2 when a.rid = b.rid then a.rid else -1 end as bigint) as rid
from g left join contigs a on lo >= a.off and lo < a.off + a.len left join contigs b on hi >= b.off and hi < b.off + b.len""")
def bridging_seeds(spark, d):
    p, c = positions(spark, d, True)
    lo = F.when(F.col("pos") >= F.col("half"), 2 * F.col("half") - F.col("pos") - F.col("size")).otherwise(F.col("pos"))
    p = p.withColumn("size", F.col("l_quantity").cast("long")).withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("size") - 1)
    p = index.locate(index.locate(p, c, "lo", "a_"), c, "hi", "b_")
    rid = F.when((F.col("pos") < F.col("half")) & (F.col("pos") + F.col("size") > F.col("half")), -2).when(F.col("a_rid") == F.col("b_rid"), F.col("a_rid")).otherwise(-1)
    return p.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), rid.cast("long").alias("rid"))


@query("""with c as (select item_id, unnest(range(1, length(text) + 1)) as i, text from benchmark), l as (select item_id, i, translate(substr(text, i, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as amb from c),
h as (select item_id, i, amb, i - row_number() over (partition by item_id, amb order by i) as g from l where amb not in ('A', 'C', 'G', 'T'))
select item_id, min(i) - 1 as off, count(*) as len, amb from h group by item_id, amb, g""")
def hole_runs(spark, d):
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("rid"), F.col("text").alias("seq"))
    return index.holes(t).withColumnRenamed("rid", "item_id")


KMERS = WHOLE + f", pz as (select unnest(range(0, length(s) - {K} + 1)) as pos, s from whole), idx as (select pos, substr(s, pos + 1, {K}) as kmer from pz)"


@query(f"with {KMERS} select kmer, count(*) as n, min(pos) as first_pos from idx group by kmer")
def kmer_occurrences(spark, d):
    return index.doubled_kmers(targets(spark, d), K).groupBy("kmer").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


PARTS = "p as (select p_partkey, translate(lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'CGTACGTACGTACGTACGTACGTACG') as s from part), pq as (select p_partkey, unnest(range(0, length(s) - 9 + 1)) as q, s from p where length(s) >= 9), pk as (select p_partkey, q, substr(s, q + 1, 9) as kmer from pq)"


def part_kmers(spark, d):
    p = table(spark, d, "part").select("p_partkey", bases.from_text(F.col("p_name")).alias("s"))
    return bases.with_kmers(p, ["p_partkey"], "s", 9).withColumn("q", F.col("q").cast("long"))


@query(f"with {PARTS} select kmer, count(*) as n, count(distinct p_partkey) as parts from pk group by kmer having count(*) > 20")
def heavy_kmers(spark, d):
    return part_kmers(spark, d).groupBy("kmer").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts")).where("n > 20")


@query(f"""with {PARTS}, r as (select *, count(*) over (partition by kmer) as occ, row_number() over (partition by kmer order by p_partkey, q) - 1 as rank from pk),
s as (select *, case when occ > 20 then occ // 20 else 1 end as step from r) select kmer, p_partkey, q, occ, rank from s where rank % step = 0 and rank // step < 20""")
def occ_stride_sample(spark, d):
    hits = part_kmers(spark, d).withColumn("at", F.struct("p_partkey", "q"))
    return long(seeds.occurrence_sample(hits, ["kmer"], "at", 20).select("kmer", "p_partkey", "q", "occ", "rank"))


@query(f"with {RUNS} select read_id, q, pos from seeds")
def seed_join(spark, d):
    return long(seeds_of(spark, d))


@query(f"with {RUNS} select * from runs")
def match_runs(spark, d):
    return long(runs_of(spark, d))


def seeds_by_round(spark, d, number):
    """The aligner's seeds of one round."""
    found = Aligner().seeds(reads(spark, d).withColumnRenamed("read_id", "id"), targets(spark, d))
    return long(found.where(F.col("round") == number).select(F.col("id").alias("read_id"), "b", "e", "occ"))


@query(f"with {FIRST} select * from first")
def smem_round1(spark, d):
    return seeds_by_round(spark, d, 1)


@query(f"""with {FIRST}, ch as (select read_id, b as sb, e as se, (b + e) // 2 as mid, occ + 1 as t from first where e - b >= 28 and occ <= 10),
st as (select *, unnest(range(-1, mid + 1)) as b from ch),
rk as (select st.*, r.e as re, row_number() over (partition by st.read_id, sb, se, st.b order by r.e desc) as n from st join runs r on r.read_id = st.read_id and r.b <= st.b and r.e - st.b >= {K}),
en as (select st.*, coalesce(rk.re, 0) as e from st left join rk on rk.read_id = st.read_id and rk.sb = st.sb and rk.se = st.se and rk.b = st.b and rk.n = st.t),
sd as (select read_id, sb, se, b, e from (select *, lag(e) over (partition by read_id, sb, se order by b) as before from en) where b >= 0 and e > before and e > mid)
select s.read_id, s.b, s.e, count(*) as occ from sd s join runs r on r.read_id = s.read_id and r.b <= s.b and r.e >= s.e group by s.read_id, s.sb, s.se, s.b, s.e""")
def reseed_round2(spark, d):
    return seeds_by_round(spark, d, 2)


# short seeds of the items on themselves: many occur several times, so all rounds have rows
SHORT, LONG, CAP, MEM = 9, 14, 2, 3
SMALL = Options(min_seed=SHORT, max_mem_intv=MEM, max_occ=CAP)
ITEMS = FIRST.replace(READS, "reads as (select rid as read_id, seq from targets)").replace(str(K), str(SHORT))
CHOSEN = f"""ch as (select read_id, b as sb, e as se, (b + e) // 2 as mid, occ + 1 as t from first where e - b >= {LONG} and occ <= 10),
st as (select *, unnest(range(-1, mid + 1)) as b from ch),
rk as (select st.*, r.e as re, row_number() over (partition by st.read_id, sb, se, st.b order by r.e desc) as n from st join runs r on r.read_id = st.read_id and r.b <= st.b and r.e - st.b >= {SHORT}),
en as (select st.*, coalesce(rk.re, 0) as e from st left join rk on rk.read_id = st.read_id and rk.sb = st.sb and rk.se = st.se and rk.b = st.b and rk.n = st.t),
sd as (select read_id, sb, se, b, e from (select *, lag(e) over (partition by read_id, sb, se order by b) as before from en) where b >= 0 and e > before and e > mid),
second as (select s.read_id, s.sb, s.se, s.b, s.e, count(*) as occ from sd s join runs r on r.read_id = s.read_id and r.b <= s.b and r.e >= s.e group by all)"""
STEPS = f"""xs as (select read_id, length(seq) as size, unnest(range(0, length(seq))) as x from reads),
near as (select xs.read_id, xs.x, r.e, row_number() over (partition by xs.read_id, xs.x order by r.e desc) as n from xs join runs r on r.read_id = xs.read_id and r.b <= xs.x and r.e - xs.x >= {SHORT}),
step as (select xs.read_id, xs.x, size, greatest(x + {SHORT} + 1, coalesce(max(e) filter (n = {MEM}), 0) + 1) as e, coalesce(max(e) filter (n = 1), 0) as far from xs left join near using (read_id, x) group by xs.read_id, xs.x, size),
walk(read_id, x, e, far) as (select read_id, x, e, far from step where x = 0 and e <= size union all select s.read_id, s.x, s.e, s.far from walk w join step s on s.read_id = w.read_id and s.x = w.e where s.e <= s.size),
third as (select w.read_id, w.x as b, w.e, count(*) as occ from walk w join runs r on r.read_id = w.read_id and r.b <= w.x and r.e >= w.e where w.e <= w.far group by all)"""


def item_reads(spark, d):
    return targets(spark, d).select(F.col("rid").alias("id"), "name", "seq")


def short_seeds(spark, d, number):
    found = Aligner(SMALL).seeds(item_reads(spark, d), targets(spark, d))
    return long(found.where(F.col("round") == number).select(F.col("id").alias("read_id"), "b", "e", "occ"))


@query(f"with {ITEMS}, {CHOSEN} select read_id, b, e, occ from second")
def reseed_items(spark, d):
    """Seeds through the middle of long rare ones, of the items on themselves."""
    return short_seeds(spark, d, 2)


@query(f"with recursive {ITEMS}, {STEPS} select read_id, b, e, occ from third")
def third_round_items(spark, d):
    """Seeds from left to right, each as short as makes it rare, of the items on themselves."""
    return short_seeds(spark, d, 3)


@query(f"""with recursive {ITEMS}, {CHOSEN}, {STEPS}, every as (select read_id, b, e from first union select read_id, b, e from second union select read_id, b, e from third),
places as (select v.read_id, v.b, v.e, r.pos + v.b - r.b as pos from every v join runs r on r.read_id = v.read_id and r.b <= v.b and r.e >= v.e),
ranked as (select places.*, count(*) over w as occ, row_number() over (partition by read_id, b, e order by substr(s, cast(pos as integer) + 1, cast(e - b + 256 as integer)), pos) - 1 as rank from places, whole window w as (partition by read_id, b, e))
select read_id, b, e, pos from ranked where rank % (case when occ > {CAP} then occ // {CAP} else 1 end) = 0 and (occ <= {CAP} or rank // (occ // {CAP}) < {CAP})""")
def seed_positions(spark, d):
    """Occurrences of the seeds of all rounds, at equal strides above the cap, of the items on themselves."""
    return long(Aligner(SMALL).seed_positions(item_reads(spark, d), targets(spark, d)).withColumnRenamed("id", "read_id"))


@query(f"""with {FIRST}, h as (select *, max(e) over (partition by read_id order by b, e rows between unbounded preceding and 1 preceding) as before from first where occ > 1),
u as (select read_id, sum(greatest(0, e - greatest(b, coalesce(before, b)))) as covered from h group by read_id)
select r.read_id, cast(coalesce(covered, 0) as bigint) as covered, round(coalesce(covered, 0) / length(seq), 9) as frac_rep from reads r left join u using (read_id) where length(seq) > 0""")
def rep_fraction(spark, d):
    """The share of a read that seeds above an occurrence cap cover; the cap is 1 here, and the seeds are those of round 1."""
    source = reads(spark, d)
    found = Aligner(Options(max_occ=1, split_width=0, max_mem_intv=0)).repetition(source.withColumnRenamed("read_id", "id"), targets(spark, d))
    sizes = source.select(F.col("read_id").alias("id"), F.length("seq").alias("n"))
    return found.join(sizes, "id").select(F.col("id").alias("read_id"), "covered", F.round(F.col("covered") / F.col("n"), 9).alias("frac_rep"))


@query(f"""with {RUNS}, b as (select read_id, b, e, case when r.pos >= (select length(s) from fwd) then 2 * (select length(s) from fwd) - pos - (e - b) else pos end as lo, pos >= (select length(s) from fwd) as is_rev from runs r),
c as (select rid, name, length(seq) as len, sum(length(seq)) over (order by rid) - length(seq) as off from targets)
select read_id, name, b as read_start, e - b as length, lo - off as target_start, is_rev from (select *, row_number() over (partition by read_id, rid order by e - b desc, b, lo, is_rev) as rn from b join c on lo >= off and lo < off + len) where rn = 1""")
def best_passage(spark, d):
    """The longest passage of each target that each read holds, and where."""
    t = targets(spark, d)
    c = index.contigs(t)
    half = c.agg(F.sum("len").alias("half"))
    runs = runs_of(spark, d).crossJoin(F.broadcast(half))  # one row
    lo = F.when(F.col("pos") >= F.col("half"), 2 * F.col("half") - F.col("pos") - (F.col("e") - F.col("b"))).otherwise(F.col("pos"))
    placed = index.locate(runs.withColumn("lo", lo).withColumn("is_rev", F.col("pos") >= F.col("half")), c, "lo").where("rid is not null")
    w = W.partitionBy("read_id", "rid").orderBy((F.col("b") - F.col("e")), "b", "lo", "is_rev")
    best = placed.withColumn("rn", F.row_number().over(w)).where("rn = 1").join(c.select("rid", "name"), "rid")
    return long(best.select("read_id", "name", F.col("b").alias("read_start"), (F.col("e") - F.col("b")).alias("length"), (F.col("lo") - F.col("off")).alias("target_start"), "is_rev"))


UNION = """u as (select *, max({e}) over (partition by {k} order by {b}, {e} rows between unbounded preceding and 1 preceding) as before from {t})
select {k}, cast(sum(greatest(0, {e} - greatest({b}, coalesce(before, {b})))) as bigint) as {n} from u group by {k}"""


@query(f"with {RUNS}, " + "w1 as (select read_id, cast(floor((pos - b) / 100.0) as bigint) as band, b, e, pos, pos + e - b as stop from runs), a as (select *, max(e) over (partition by read_id, band order by b, e rows between unbounded preceding and 1 preceding) as qb, max(stop) over (partition by read_id, band order by pos, stop rows between unbounded preceding and 1 preceding) as tb from w1) select read_id, band, cast(least(sum(greatest(0, e - greatest(b, coalesce(qb, b)))), sum(greatest(0, stop - greatest(pos, coalesce(tb, pos))))) as bigint) as weight from a group by read_id, band")
def chain_weight(spark, d):
    """Bases that the runs of a band of diagonals cover on the read or on the target, whichever are fewer."""
    r = runs_of(spark, d).withColumn("band", F.floor((F.col("pos") - F.col("b")) / 100)).withColumn("pos", F.col("pos").cast("long"))
    seeds_ = r.groupBy("read_id", "band").agg(F.collect_list(F.struct(F.col("b").cast("long").alias("q"), F.col("pos").alias("t"), (F.col("e") - F.col("b")).cast("long").alias("size"))).alias("seeds"))

    def run(batches):
        for batch in batches:
            weights = [hits.chain_weight([hits.Seed(x["q"], x["t"], x["size"], x["size"]) for x in row]) for row in batch.column("seeds").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), batch.column("band"), pa.array(weights, pa.int64())], ["read_id", "band", "weight"])

    return seeds_.mapInArrow(run, "read_id long, band long, weight long")


@query("with t as (select l_orderkey, l_partkey % 1000 as b, l_partkey % 1000 + cast(l_quantity as bigint) as e from lineitem), " + UNION.format(t="t", k="l_orderkey", b="b", e="e", n="covered"))
def interval_union(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1000).alias("b"), (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("long")).alias("e"))
    return long(seeds.union_length(t, ["l_orderkey"], "b", "e", "covered"))


@query("""with h as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) + 50 as q from lineitem)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, least(greatest(cast(trunc((q * 1 - 6) / 1.0 + 1) as bigint), 1), 200) as max_gap from h""")
def max_gap(spark, d):
    h = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") + 50).alias("q"))
    return long(h.select("l_orderkey", "l_linenumber", scores.max_gap(F.col("q"), O).alias("max_gap")))


@query("""with h as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) + 60 as l1, cast(l_quantity as bigint) + 60 + l_suppkey % 7 - 3 as l2, cast(l_quantity as bigint) + 20 + l_partkey % 40 as score from lineitem)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(case when l1 = l2 and l1 - score < 12 then 0 else greatest(trunc((least(l1, l2) - score - 6) / 1.0 + 2), abs(l1 - l2)) end as bigint) as band from h""")
def band_infer(spark, d):
    size = F.col("l_quantity").cast("long")
    h = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (size + 60).alias("l1"), (size + 60 + F.col("l_suppkey") % 7 - 3).alias("l2"), (size + 20 + F.col("l_partkey") % 40).alias("score"))
    return long(h.select("l_orderkey", "l_linenumber", scores.infer_band(F.col("l1"), F.col("l2"), F.col("score"), O.match, O.open_del, O.ext_del).alias("band")))


@query("""with h as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) + 60 as span, cast(l_quantity as bigint) + 30 + l_partkey % 30 as score, l_suppkey % 60 as sub, l_partkey % 45 as csub, l_linenumber % 4 as sub_n, (l_partkey % 10) / 20.0 as frac from lineitem),
g as (select *, greatest(case when sub = 0 then 19 else sub end, csub) as other, 1.0 - cast(span - score as double) / 5 / span as ident from h),
m as (select *, case when span < 50 then 1.0 else 3 / ln(span) end * ident * ident as t from g),
q as (select *, trunc(6.02 * (score - other) / 1 * t * t + .499) - case when sub_n > 0 then trunc(4.343 * ln(sub_n + 1) + .499) else 0 end as q0 from m)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(case when other >= score then 0 else trunc(greatest(least(q0, 60), 0) * (1.0 - cast(frac as double)) + .499) end as bigint) as mapq from q""")
def se_mapq(spark, d):
    size = F.col("l_quantity").cast("long")
    h = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (size + 60).alias("span"), (size + 30 + F.col("l_partkey") % 30).alias("score"), (F.col("l_suppkey") % 60).alias("sub"), (F.col("l_partkey") % 45).alias("csub"), (F.col("l_linenumber") % 4).alias("sub_n"), ((F.col("l_partkey") % 10) / 20.0).cast("double").alias("frac"))
    q = scores.single_mapq(F.col("score"), F.col("sub"), F.col("csub"), F.col("sub_n"), F.col("span"), F.col("span"), F.col("frac"), O)
    return long(h.select("l_orderkey", "l_linenumber", q.alias("mapq")))


@query("""with recursive x(k, v) as (select c_custkey, cast(c_custkey as hugeint) from customer), m as (select cast(18446744073709551615 as hugeint) as w),
a as (select k, (v + (w - ((v << 32) % (w + 1)))) % (w + 1) as v, w from x, m), b as (select k, xor(v, v >> 22) as v, w from a), c as (select k, (v + (w - (v * 8192) % (w + 1))) % (w + 1) as v, w from b),
d as (select k, xor(v, v >> 8) as v, w from c), e as (select k, (v * 9) % (w + 1) as v, w from d), f as (select k, xor(v, v >> 15) as v, w from e),
g as (select k, (v + (w - (v * 134217728) % (w + 1))) % (w + 1) as v, w from f), h as (select k, xor(v, v >> 31) as v from g)
select k as c_custkey, cast(v as varchar) as mixed from h""")
def hash_mix(spark, d):
    """The 64-bit mix that breaks ties, as a decimal string."""
    from ..operators.kernels import mixed_column

    return table(spark, d, "customer").select("c_custkey", mixed_column(F.col("c_custkey")).alias("mixed"))
