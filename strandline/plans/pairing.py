"""Queries of pairing, records and read handling over the fixture tables, each with its SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bases, sam, scores
from ..operators import align, index, kernels, pairs, profile, records
from ..operators.hits import Region
from ..options import Options
from .relational import READS, TARGETS, long, reads, table, targets

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


HALF = 100_000
ENDS = f"ends as (select l_orderkey, l_linenumber, (l_partkey * 7919) % {HALF} as b1, case when l_suppkey % 8 = 0 then (l_partkey * 7919) % {HALF} + cast(l_quantity as bigint) * 10 else 2 * {HALF} - 1 - ((l_partkey * 7919) % {HALF} + cast(l_quantity as bigint) * 10) end as b2 from lineitem)"
DIRS = f"{ENDS}, p2 as (select *, (b1 >= {HALF}) <> (b2 >= {HALF}) as apart, case when (b1 >= {HALF}) <> (b2 >= {HALF}) then 2 * {HALF} - 1 - b2 else b2 end as p from ends), dirs as (select l_orderkey, l_linenumber, xor(case when apart then 1 else 0 end, case when p > b1 then 0 else 3 end) as dir, abs(p - b1) as dist from p2)"


def directions(spark, d):
    b1 = (F.col("l_partkey") * 7919) % HALF
    far = b1 + F.col("l_quantity").cast("long") * 10
    ends = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b1.alias("b1"), F.when(F.col("l_suppkey") % 8 == 0, far).otherwise(2 * HALF - 1 - far).alias("b2"))
    way, dist = scores.orientation(F.lit(HALF), F.col("b1"), F.col("b2"))
    return ends.select("l_orderkey", "l_linenumber", way.alias("dir"), dist.alias("dist"))


@query(f"with {DIRS} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(dir as bigint) as dir, dist from dirs")
def pair_orientation(spark, d):
    return long(directions(spark, d))


STATS = f"""with {DIRS}, ck as (select l_orderkey % 3 as chunk_id, dir, dist from dirs where dist > 0),
rk as (select *, row_number() over (partition by chunk_id, dir order by dist) - 1 as i, count(*) over (partition by chunk_id, dir) as n from ck),
qt as (select chunk_id, dir, n, min(dist) filter (i = cast(trunc(.25 * n + .499) as bigint)) as p25, min(dist) filter (i = cast(trunc(.75 * n + .499) as bigint)) as p75 from rk group by chunk_id, dir, n),
mo as (select q.chunk_id, q.dir, q.n, p25, p75, avg(dist) as avg, stddev_pop(dist) as std from qt q join ck c on c.chunk_id = q.chunk_id and c.dir = q.dir
  where dist >= greatest(1, cast(trunc(p25 - 2.0 * (p75 - p25) + .499) as bigint)) and dist <= cast(trunc(p75 + 2.0 * (p75 - p25) + .499) as bigint) group by all),
st as (select chunk_id, dir, n, avg, std, greatest(1, least(cast(trunc(p25 - 3.0 * (p75 - p25) + .499) as bigint), case when n >= 10 then cast(trunc(avg - 4.0 * std + .499) as bigint) end)) as low,
  greatest(cast(trunc(p75 + 3.0 * (p75 - p25) + .499) as bigint), cast(trunc(avg + 4.0 * std + .499) as bigint)) as high, n < 10 or n < .05 * max(n) over (partition by chunk_id) as failed from mo)"""


def statistics(spark, d):
    dirs = directions(spark, d).select((F.col("l_orderkey") % 3).alias("chunk_id"), "dir", "dist").where("dist > 0")
    return pairs.insert_statistics(dirs)


@query(STATS + " select chunk_id, cast(dir as bigint) as dir, low, high, failed, round(avg, 6) as avg, round(std, 6) as std, n from st")
def insert_stats(spark, d):
    s = statistics(spark, d)
    return long(s.select("chunk_id", "dir", "low", "high", "failed", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"), "n"))


@query(STATS + " select d.l_orderkey, cast(d.l_linenumber as bigint) as l_linenumber, cast(d.dir as bigint) as dir, d.dist from dirs d join st s on s.chunk_id = d.l_orderkey % 3 and s.dir = d.dir where not failed and dist between low and high")
def proper_pairs(spark, d):
    """Pairs at a distance that their chunk's insert sizes expect: a broadcast of four rows per chunk and a band."""
    s = statistics(spark, d).where("not failed").select("chunk_id", "dir", "low", "high")
    rows = directions(spark, d).withColumn("chunk_id", F.col("l_orderkey") % 3)
    return long(rows.join(s, ["chunk_id", "dir"]).where("dist between low and high").select("l_orderkey", "l_linenumber", "dir", "dist"))


CIGARS = "c as (select l_orderkey, l_linenumber, (case when l_suppkey % 3 = 0 then (l_suppkey % 20 + 1) || 'S' else '' end) || (cast(l_quantity as bigint) + 10) || 'M' || (case when l_partkey % 4 = 0 then '2I30M' when l_partkey % 4 = 1 then '3D25M' else '' end) || (case when l_linenumber % 2 = 0 then (l_linenumber + 4) || 'H' else '' end) as cigar from lineitem)"


def cigars(spark, d):
    t = table(spark, d, "lineitem")
    text = lambda c: c.cast("string")
    cigar = F.concat(
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(text(F.col("l_suppkey") % 20 + 1), F.lit("S"))).otherwise(""), text(F.col("l_quantity").cast("long") + 10), F.lit("M"),
        F.when(F.col("l_partkey") % 4 == 0, "2I30M").when(F.col("l_partkey") % 4 == 1, "3D25M").otherwise(""), F.when(F.col("l_linenumber") % 2 == 0, F.concat(text(F.col("l_linenumber") + 4), F.lit("H"))).otherwise(""),
    )
    return t.select("l_orderkey", "l_linenumber", cigar.alias("cigar"))


@query(f"with {CIGARS}, o as (select l_orderkey, l_linenumber, regexp_extract_all(cigar, '[0-9]+[MIDSH]') as parts from c), u as (select l_orderkey, l_linenumber, unnest(range(0, len(parts))) as i, parts from o) select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, i, right(parts[i + 1], 1) as op, cast(regexp_extract(parts[i + 1], '[0-9]+') as bigint) as len from u")
def cigar_explode(spark, d):
    rows = cigars(spark, d).select("l_orderkey", "l_linenumber", F.posexplode(sam.cigar_ops(F.col("cigar"))).alias("i", "o"))
    return long(rows.select("l_orderkey", "l_linenumber", "i", "o.op", "o.len"))


@query("with " + CIGARS + """, o as (select l_orderkey, l_linenumber, regexp_extract_all(cigar, '[0-9]+[MIDSH]') as parts from c)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, """ + ", ".join(f"cast(list_sum(list_transform(parts, lambda p: case when right(p, 1) in ({ops}) then cast(regexp_extract(p, '[0-9]+') as bigint) else 0 end)) as bigint) as {n}" for ops, n in (("'M', 'D'", "target_len"), ("'M', 'I', 'S'", "seq_len"), ("'M', 'I', 'S', 'H'", "read_len"))) + " from o")
def cigar_lengths(spark, d):
    c = cigars(spark, d)
    return long(c.select("l_orderkey", "l_linenumber", *[sam.length_of(F.col("cigar"), ops).alias(n) for ops, n in (("MD", "target_len"), ("MIS", "seq_len"), ("MISH", "read_len"))]))


MD_WHOLE = """with q as (select item_id, t, translate(t, 'A', 'C') as s from (select item_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'CGTACGTACGTACGTACGTACGTACG') as t from benchmark)),
x as (select item_id, unnest(range(1, length(t) + 1)) as i, t, s from q), m as (select item_id, i, substr(t, i, 1) as b, substr(t, i, 1) <> substr(s, i, 1) as diff, length(t) as n from x),
k as (select item_id, i, b, n, i - coalesce(lag(i) over (partition by item_id order by i), 0) - 1 as run from m where diff),
g as (select item_id, string_agg(run || b, '' order by i) as head, max(n) - max(i) as tail, count(*) as nm from k group by item_id)
select q.item_id, coalesce(head || tail, cast(length(t) as varchar)) as md, coalesce(nm, 0) as nm from q left join g using (item_id)"""


@query(MD_WHOLE)
def md_tag_whole(spark, d):
    """MD and NM of whole items, with differences over all their length, by the kernel that records are made with."""
    q = table(spark, d, "benchmark").select("item_id", bases.from_text(F.col("text")).alias("t")).withColumn("s", F.translate("t", "A", "C"))

    def run(batches):
        for batch in batches:
            got = [kernels.edits(kernels.codes(s), kernels.codes(t), [("M", len(t))]) for t, s in zip(batch.column("t").to_pylist(), batch.column("s").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([md for _, md in got], pa.string()), pa.array([nm for nm, _ in got], pa.int64())], ["item_id", "md", "nm"])

    return q.mapInArrow(run, "item_id long, md string, nm long")


@query("select o_orderkey, (o_custkey * 37) % 4096 as flag, ((o_custkey * 37) % 4096 & 4) <> 0 as unmapped, ((o_custkey * 37) % 4096 & 16) <> 0 as is_rev, ((o_custkey * 37) % 4096 & 256) <> 0 as secondary, ((o_custkey * 37) % 4096 & 2048) <> 0 as supplementary from orders")
def sam_flags(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", ((F.col("o_custkey") * 37) % 4096).alias("flag"))
    return t.select("*", *sam.flag_bits(F.col("flag"))).select("o_orderkey", "flag", "unmapped", "is_rev", "secondary", "supplementary")


@query("select o_orderkey, concat_ws(chr(9), 'read' || o_orderkey, (o_custkey * 37) % 4096, 'item' || o_custkey % 40, o_custkey % 1000 + 1, o_custkey % 61, '50M', '*', 0, 0, '*', '*', 'NM:i:' || o_custkey % 5, 'AS:i:' || 50 - 5 * (o_custkey % 5)) as line from orders")
def sam_records(spark, d):
    t = table(spark, d, "orders")
    text = lambda c: c.cast("string")
    c = F.col("o_custkey")
    rows = t.select("o_orderkey", F.concat(F.lit("read"), text(F.col("o_orderkey"))).alias("name"), ((c * 37) % 4096).alias("flag"), F.concat(F.lit("item"), text(c % 40)).alias("rname"), (c % 1000 + 1).alias("pos"), (c % 61).alias("mapq"), F.lit("50M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), F.array(F.concat(F.lit("NM:i:"), text(c % 5)), F.concat(F.lit("AS:i:"), text(50 - 5 * (c % 5)))).alias("tags"))
    return rows.select("o_orderkey", sam.line(rows).alias("line"))


@query(f"with {TARGETS} select rid as n, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || length(seq) as line from targets union all select 1099511627776, '@PG' || chr(9) || 'ID:strandline' || chr(9) || 'PN:strandline'")
def sam_header(spark, d):
    return sam.header(spark, index.contigs(targets(spark, d)))


FAMILIES = "f as (select o_custkey as read_id, o_orderkey as hit, cast(trunc(o_totalprice) as bigint) % 60 + 40 as score, row_number() over (partition by o_custkey order by cast(trunc(o_totalprice) as bigint) % 60 desc, o_orderkey) as rank from orders), p as (select read_id, score as best from f where rank = 1)"


def families(spark, d):
    """Hits of a read; the best one is the parent of the rest."""
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("read_id"), F.col("o_orderkey").alias("hit"), (F.col("o_totalprice").cast("long") % 60 + 40).alias("score"))
    w = W.partitionBy("read_id").orderBy(F.desc("score"), "hit")
    return f.withColumn("rank", F.row_number().over(w)).withColumn("best", F.first("score").over(w))


@query(f"with {FAMILIES} select read_id, count(*) as n, string_agg('c' || hit % 7 || ',+' || hit || ',50M,' || score % 5 || ';', '' order by rank) as xa from f join p using (read_id) where rank > 1 and score >= 0.8 * best group by read_id having count(*) <= 5")
def xa_tags(spark, d):
    """Alternative hits of nearly the best score, of reads with at most five of them, as records choose them."""
    text = F.concat(F.lit("c"), (F.col("hit") % 7).cast("string"), F.lit(",+"), F.col("hit").cast("string"), F.lit(",50M,"), (F.col("score") % 5).cast("string"), F.lit(";"))
    g = families(spark, d).where("read_id is not null").groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("score").cast("long").alias("score"), text.alias("t")))).alias("hits"))
    o = Options()

    def run(batches):
        for batch in batches:
            out = []
            for id_, hits in zip(batch.column("read_id").to_pylist(), batch.column("hits").to_pylist()):
                regions = [Region(score=h["score"], secondary_all=0 if i else -1) for i, h in enumerate(hits)]
                out += [(id_, len(few), "".join(hits[i]["t"] for i in few)) for few in records.families(regions, o).values()]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], ["read_id", "n", "xa"])

    return g.mapInArrow(run, "read_id long, n long, xa string")


@query(f"with {FAMILIES} select a.read_id, a.hit, string_agg('c' || b.hit % 7 || ',' || b.hit || ',+,50M,' || b.score || ';', '' order by b.rank) as sa from f a join f b on a.read_id = b.read_id and a.hit <> b.hit group by a.read_id, a.hit")
def sa_tags_all(spark, d):
    """Of each hit of a read all other ones: an array per read, which every hit takes without its own entry."""
    text = F.concat(F.lit("c"), (F.col("hit") % 7).cast("string"), F.lit(","), F.col("hit").cast("string"), F.lit(",+,50M,"), F.col("score").cast("string"), F.lit(";"))
    found = families(spark, d).where("read_id is not null").groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hit", text.alias("t"), F.lit(False).alias("secondary")))).alias("all")).where("size(all) > 1")
    own = found.select("read_id", "all", F.posexplode("all.hit").alias("which", "hit"))
    return own.select("read_id", "hit", F.array_join(F.transform(records.others(F.col("all"), F.col("which")), lambda x: x["t"]), "").alias("sa"))


@query("select conv_id, turn, regexp_replace(role || conv_id || '/' || (turn % 12), '(.)/[0-9]$', '\\1') as name from conversations")
def trim_readno(spark, d):
    c = table(spark, d, "conversations")
    raw = F.concat(F.col("role"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") % 12).cast("string"))
    return c.select("conv_id", "turn", bases.trim_read_number(raw).alias("name"))


@query("""with o as (select row_number() over (order by conv_id, turn) - 1 as ordinal, cast(conv_id as varchar) as name from conversations), r as (select *, sum(case when lag_name = name then 0 else 1 end) over (order by ordinal) as run from (select *, lag(name) over (order by ordinal) as lag_name from o)),
k as (select *, row_number() over (partition by run order by ordinal) - 1 as k, count(*) over (partition by run) as n from r)
select ordinal, name, case when k < n - n % 2 then ordinal - k % 2 else ordinal end as pair_id, case when k < n - n % 2 then k % 2 + 1 else 0 end as "end" from k""")
def smart_pairs(spark, d):
    c = table(spark, d, "conversations")
    o = c.select((F.row_number().over(W.orderBy("conv_id", "turn")) - 1).cast("long").alias("ordinal"), F.col("conv_id").cast("string").alias("name"))
    return long(align.smart_pairs(o).select("ordinal", "name", "pair_id", "end"))


@query(f"""with {READS}, p as (select read_id // 2 as pair, sum(length(seq)) as n from reads group by 1), b as (select pair, sum(n) over (order by pair) - n as before from p)
select read_id as id, cast(before // 100000 as bigint) as chunk_id from reads join b on pair = read_id // 2""")
def chunk_assign(spark, d):
    r = reads(spark, d).withColumnRenamed("read_id", "id")
    return align.chunked(r, 100_000).select("id", "chunk_id")


@query("""with w as (select l_returnflag as stage, l_suppkey % 16 as worker, sum(cast(l_quantity as bigint)) as amount from lineitem group by 1, 2)
select stage, count(*) as workers, cast(sum(amount) as bigint) as total, cast(min(amount) as bigint) as least, cast(max(amount) as bigint) as greatest, cast(sum(amount) as double) / count(*) as mean from w group by stage""")
def profile_summary(spark, d):
    """The spread of what workers spent on each stage, of return flags as stages and suppliers in turn as workers."""
    spent = table(spark, d, "lineitem").withColumn("worker", F.col("l_suppkey") % 16)
    return long(profile.summary(spent, "l_returnflag", "worker", F.col("l_quantity").cast("long")))


# kernels: no SQL says what they do; tests hold them against brute force


def windows(spark, d, size=150):
    """Stretches of all documents, each `size` bases, as reads."""
    r = reads(spark, d)
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("seq") - 1), F.lit(size))
    w = r.where("length(seq) > 0").select("read_id", F.posexplode(F.transform(at, lambda i: F.substring("seq", i + 1, F.lit(size)))).alias("k", "seq"))
    return w.select((F.col("read_id") * 100_000 + F.col("k")).alias("id"), F.concat(F.lit("d"), "read_id", F.lit("."), "k").alias("name"), "seq")


def mates(spark, d, size=150):
    """Both ends of stretches of all documents, as mates of up to `size` bases, the second on the other strand. Together they hold every base."""
    w = windows(spark, d, 2 * size)
    one = w.select((F.col("id") * 2).alias("id"), "name", F.substring("seq", 1, size).alias("seq"))
    two = w.select((F.col("id") * 2 + 1).alias("id"), "name", bases.reverse_complement(F.expr(f"right(seq, {size})")).alias("seq"))
    return one.unionByName(two)


@query(None)
def chains(spark, d):
    """Chains of the seeds of stretches of the documents, with what the filter makes of them."""
    return long(align.Aligner().chains(windows(spark, d), targets(spark, d)))


@query(None)
def extensions(spark, d):
    """Extensions, from an anchor of score 20, of each part's name along itself with two bases left out, followed by its reverse."""
    p = table(spark, d, "part").select("p_partkey", bases.from_text(F.col("p_name")).alias("q")).withColumn("t", F.concat(F.substring("q", 1, 6), F.substring("q", 9, 400), F.reverse("q")))
    o = Options()

    def run(batches):
        import numpy as np

        mat = np.array(o.matrix)
        for batch in batches:
            got = [kernels.extend(kernels.codes(q), kernels.codes(t), mat, o, o.band, o.clip3, 20) for q, t in zip(batch.column("q").to_pylist(), batch.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), *(pa.array([g[i] for g in got], pa.int64()) for i in range(6))], ["p_partkey", "score", "qle", "tle", "gtle", "gscore", "max_off"])

    return p.where("q != ''").mapInArrow(run, "p_partkey long, score long, qle long, tle long, gtle long, gscore long, max_off long")


@query(None)
def regions(spark, d):
    """Hits of stretches of the documents on the benchmark items, before ranking."""
    found = align.Aligner().regions(windows(spark, d), targets(spark, d))
    return found.select("id", F.explode("regions").alias("r")).select("id", "r.tb", "r.te", "r.qb", "r.qe", "r.rid", "r.score", "r.covered")


@query(None)
def alignments(spark, d):
    """SAM records of stretches of the documents on the benchmark items that map."""
    return align.Aligner().align(windows(spark, d), targets(spark, d)).where("rname != '*'")


@query(None)
def paired_alignments(spark, d):
    """SAM records of mates from the whole documents on the benchmark items."""
    return align.Aligner().align_pairs(mates(spark, d), targets(spark, d))
