"""The aligner's queries against brute force: chains, extensions, regions, records."""

import random
import re

import numpy as np
import pytest

from strandline.functions import scores
from strandline.operators.align import Aligner
from strandline.options import Options
from strandline.plans import pairing, relational

LETTERS = "abcdefghijklmnopqrstuvwxyz"
TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s.translate(TURN)[::-1]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies of items, changed here and there, in both places of a text."""
    rng, d = random.Random(8), str(tmp_path_factory.mktemp("hits"))
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    items = [word(n) for n in (260, 200, 150)]
    items.append(items[0][100:170] + word(90))
    docs = []
    for i in range(24):
        s = list(rng.choice(items))
        at = rng.randrange(len(s) - 100)
        s = s[at : at + 100]
        for _ in range(i % 5):
            s[rng.randrange(100)] = rng.choice(LETTERS)
        if i % 4 == 3:
            del s[50:52]
        docs.append((i, word(rng.randrange(25)) + "".join(s) + word(10)))
    docs += [(50, ""), (51, None), (52, "xy")]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, word(n)) for i, n in enumerate([1, 7, 12, 25, 40, 40, 60])], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    return d


def best_local(q, t):
    """The best local score with affine gaps, by full matrices."""
    o = Options()
    h, e, best = [0] * (len(q) + 1), [0] * (len(q) + 1), 0
    for c in t:
        new, f, diag = [0] * (len(q) + 1), 0, 0
        for j in range(1, len(q) + 1):
            e[j] = max(e[j] - o.ext_del, h[j] - o.open_del - o.ext_del, 0)
            f = max(f - o.ext_ins, new[j - 1] - o.open_ins - o.ext_ins, 0)
            new[j] = max(0, h[j - 1] + (o.match if q[j - 1] == c else -o.mismatch), e[j], f)
            best = max(best, new[j])
        h = new
    return best


def test_the_best_region_has_the_best_local_score(spark, tables):
    reads = {r.id: r.seq for r in pairing.windows(spark, tables).collect()}
    targets = [r.seq for r in relational.targets(spark, tables).collect()]
    found = {}
    for r in pairing.regions(spark, tables).collect():
        found[r.id] = max(found.get(r.id, 0), r.score)
    assert len(found) >= 20
    for id_, seq in reads.items():
        best = max(best_local(seq, s) for t in targets for s in (t, turned(t)))
        seeded = any(seq[i : i + 19] in s for i in range(len(seq) - 18) for t in targets for s in (t, turned(t)))
        assert (id_ in found) == seeded
        if seeded:
            # an end is extended to the read's end where that costs less than the clip, so the score may be lower by it
            assert best - 5 <= found[id_] <= best


def checked(r, targets):
    """Fields of a mapped record, made again from its sequence and its CIGAR."""
    o = Options()
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDSH])", r.cigar)]
    assert "".join(f"{n}{op}" for n, op in ops) == r.cigar
    assert sum(n for n, op in ops if op in "MIS") == len(r.seq)
    t = targets[r.rname]
    x, y, nm, score, md, run = 0, r.pos - 1, 0, 0, "", 0
    for n, op in ops:
        if op == "M":
            for k in range(n):
                if r.seq[x + k] == t[y + k]:
                    score, run = score + o.match, run + 1
                else:
                    score, nm, md, run = score - o.mismatch, nm + 1, f"{md}{run}{t[y + k]}", 0
            x, y = x + n, y + n
        elif op == "I":
            x, nm, score = x + n, nm + n, score - o.open_ins - n * o.ext_ins
        elif op == "D":
            md, run = f"{md}{run}^{t[y : y + n]}", 0
            y, nm, score = y + n, nm + n, score - o.open_del - n * o.ext_del
        elif op == "S":
            x += n
    tags = dict(x.split(":", 1) for x in r.tags)
    assert tags["NM"] == f"i:{nm}" and tags["MD"] == f"Z:{md}{run}"
    assert int(tags["AS"][2:]) >= score  # the best score on the way to a clipped end, or that of the whole
    assert 0 <= r.mapq <= 60
    return sum(n for n, op in ops if op in "MD")


def test_records_say_what_their_sequences_do(spark, tables):
    targets = {r["name"]: r.seq for r in relational.targets(spark, tables).collect()}
    reads = {r.id: r.seq for r in pairing.windows(spark, tables).collect()}
    rows = pairing.alignments(spark, tables).collect()
    assert len({r.id for r in rows}) >= 20
    for r in rows:
        checked(r, targets)
        if not r.flag & 0x900:
            assert r.seq == (turned(reads[r.id]) if r.flag & 16 else reads[r.id])


def test_records_of_mates_agree(spark, tables):
    targets = {r["name"]: r.seq for r in relational.targets(spark, tables).collect()}
    ends = {}
    for r in pairing.paired_alignments(spark, tables).collect():
        assert bool(r.flag & 0x40) == (r.id % 2 == 0) and r.flag & 1
        if not r.flag & 0x900:
            ends[r.id] = r
    for i in {k // 2 for k in ends}:
        a, b = ends[2 * i], ends[2 * i + 1]
        assert bool(a.flag & 8) == bool(b.flag & 4) and bool(b.flag & 8) == bool(a.flag & 4)
        assert bool(a.flag & 32) == bool(b.flag & 16) and bool(b.flag & 32) == bool(a.flag & 16)
        assert (a.pnext, b.pnext) == (b.pos, a.pos) and a.tlen == -b.tlen
        if not (a.flag | b.flag) & 4 and a.rname == b.rname:
            spans = [checked(r, targets) for r in (a, b)]
            starts = [r.pos + (n - 1 if r.flag & 16 else 0) for r, n in zip((a, b), spans)]
            gap = starts[1] - starts[0]
            assert a.tlen == gap + (gap > 0) - (gap < 0)


def test_chains_by_definition(spark, tables):
    small = Aligner(min_seed=7, max_chain_gap=60, max_mem_intv=0)
    reads, targets = pairing.windows(spark, tables), relational.targets(spark, tables)
    chains = small.chains(reads, targets).collect()
    reads_with = {}
    for c in chains:
        reads_with.setdefault(c.id, []).append(c)
        assert c.weight >= 7 and c.n_seeds >= 1  # a chain spans from its first seed to the end of its last one
    assert any(len(x) > 3 for x in reads_with.values()) and {c.kept for c in chains} >= {0, 3}
    for rows in reads_with.values():
        top = max(rows, key=lambda c: (c.weight, -c.chain))
        assert top.kept == 3  # nothing is above the heaviest
        kept = [c for c in rows if c.kept >= 2]
        for c in rows:
            under = [k for k in kept if k.weight > c.weight and 0 < min(c.e, k.e) - max(c.b, k.b) >= min(c.e - c.b, k.e - k.b) * 0.5 and min(c.e - c.b, k.e - k.b) < 60]
            if c.kept == 3:
                assert not under
            if c.kept == 0:
                assert any(k.weight >= c.weight and 0 < min(c.e, k.e) - max(c.b, k.b) for k in rows if k.kept)
    assert pairing.chains(spark, tables).count() >= 20


def full_extension(q, t, h0):
    """Score, and the score to the query's end, of an extension by full matrices; a cell of 0 ends."""
    o, n = Options(), len(q)
    h = [h0] + [max(0, h0 - o.open_ins - j * o.ext_ins) for j in range(1, n + 1)]
    e, best, to_end = [0] * (n + 1), h0, -1
    for i, c in enumerate(t):
        new, f = [max(0, h0 - o.open_del - (i + 1) * o.ext_del)] + [0] * n, 0
        for j in range(1, n + 1):
            m = h[j - 1] + (o.match if q[j - 1] == c else -o.mismatch) if h[j - 1] > 0 else 0
            new[j] = max(m, e[j], f, 0)
            e[j] = max(m - o.open_del - o.ext_del, e[j] - o.ext_del, 0)
            f = max(m - o.open_ins - o.ext_ins, f - o.ext_ins, 0)
        if n and max(new[1:]) == 0:
            break
        best, to_end, h = max(best, *new[1:]), max(to_end, new[n]), new
    return best, to_end


def test_extensions_equal_full_matrices(spark, tables):
    o = Options()
    names = {r.p_partkey: r.q for r in spark.read.parquet(f"{tables}/part.parquet").select("p_partkey", relational.bases.from_text(__import__("pyspark.sql.functions", fromlist=["x"]).col("p_name")).alias("q")).collect()}
    got = {r.p_partkey: r for r in pairing.extensions(spark, tables).collect()}
    assert set(got) == set(names)
    for k, q in names.items():
        t = q[:6] + q[8:] + q[::-1]
        best, to_end = full_extension(q, t, 20)
        assert got[k].score == best and got[k].gscore == to_end
    assert o.band > 60


def test_formulas_are_the_same_for_columns_and_numbers(spark):
    from pyspark.sql import functions as F

    rng, o = random.Random(1), Options()
    rows = [tuple(rng.randrange(1, 200) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    a, b, c, d = map(F.col, "abcd")
    frac = lambda x: x % 7 / 10.0
    got = df.select(scores.max_gap(a, o), scores.infer_band(a, b, c, 1, 6, 1), scores.single_mapq(a, b, c, d % 3, a, b, frac(d), o), *scores.orientation(F.lit(100), a, b)).collect()
    for r, (a, b, c, d) in zip(got, rows):
        m = scores.PLAIN
        assert tuple(r) == (scores.max_gap(a, o, m), scores.infer_band(a, b, c, 1, 6, 1, m), scores.single_mapq(a, b, c, d % 3, a, b, frac(d), o, m), *scores.orientation(100, a, b, m))
    assert np.isfinite([float(x) for r in got for x in r]).all()
