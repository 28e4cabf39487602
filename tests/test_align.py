"""Alignment end to end on simulated reads, and properties that records must keep."""

import random
import re

import pytest

from strandline.functions import sam
from strandline.operators.align import Aligner, chunked, smart_pairs, with_substitutes
from strandline.sources import sequences

TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s.translate(TURN)[::-1]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(9)
    contigs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1500, 900)]
    contigs[1] = contigs[1][:700] + contigs[0][200:400]  # a repeat between contigs
    targets = spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(contigs)], "rid int, name string, seq string")
    return rng, contigs, targets


def test_reads_go_back_to_where_they_are_from(spark, world):
    rng, contigs, targets = world
    rows, truth = [], {}
    for i in range(24):
        at = rng.randrange(450, 1300)
        s = list(contigs[0][at : at + 120])
        for _ in range(3):
            j = rng.randrange(120)
            s[j] = rng.choice("ACGT")
        s = "".join(s)
        if i % 6 == 1:
            s = s[:50] + s[53:]
        if i % 6 == 2:
            s = s[:50] + "ACG" + s[50:]
        rev = rng.random() < 0.5
        rows.append((i, f"r{i}", turned(s) if rev else s))
        truth[i] = (at + 1, rev)
    rows += [(100, "none", "N" * 50), (101, "short", "ACGT"), (102, "empty", "")]
    reads = spark.createDataFrame(rows, "id long, name string, seq string")
    got = Aligner().align(reads, targets).collect()
    again = Aligner().align(reads.repartition(3), targets).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = {r.id: r for r in got if not r.flag & 0x900}
    for i, (pos, rev) in truth.items():
        r = by[i]
        assert r.rname == "c0" and abs(r.pos - pos) <= 3 and bool(r.flag & 16) == rev
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDSH])", r.cigar)]
        assert sum(n for n, op in ops if op in "MIS") == len(r.seq)
        stretch = contigs[0][r.pos - 1 : r.pos - 1 + sum(n for n, op in ops if op in "MD")]
        x = y = nm = 0
        for n, op in ops:
            if op == "M":
                nm += sum(a != b for a, b in zip(r.seq[x : x + n], stretch[y : y + n]))
            nm += n * (op in "ID")
            x, y = x + n * (op in "MIS"), y + n * (op in "MD")
        assert f"NM:i:{nm}" in r.tags
    for i in (100, 101, 102):
        assert by[i].flag == 4 and by[i].rname == "*"


def test_a_repeat_has_quality_0_and_an_alternative(spark, world):
    _, contigs, targets = world
    reads = spark.createDataFrame([(0, "rep", contigs[0][240:360])], "id long, name string, seq string")
    (r,) = Aligner().align(reads, targets).collect()
    assert r.mapq == 0 and any(t.startswith("XA:Z:") for t in r.tags)


def test_a_split_read_has_a_supplementary_record(spark, world):
    _, contigs, targets = world
    reads = spark.createDataFrame([(0, "split", contigs[0][900:980] + contigs[1][100:160])], "id long, name string, seq string")
    first, second = sorted(Aligner().align(reads, targets).collect(), key=lambda r: r.flag)
    assert first.flag == 0 and second.flag == 0x800
    assert "S" in first.cigar and "H" in second.cigar
    assert any(t.startswith("SA:Z:c1,") for t in first.tags)


def test_pairs_are_proper_and_mates_are_rescued(spark, world):
    rng, contigs, targets = world
    rows = []
    for i in range(30):
        size = int(rng.gauss(300, 15))
        at = rng.randrange(420, 1490 - size)
        a, b = contigs[0][at : at + 80], turned(contigs[0][at + size - 80 : at + size])
        if i == 5:  # too many differences for a seed
            b = "".join(("A" if c != "A" else "C") if j % 14 == 7 else c for j, c in enumerate(b))
        rows += [(2 * i, f"p{i}/1", a), (2 * i + 1, f"p{i}/2", b)]
    reads = spark.createDataFrame(rows, "id long, name string, seq string")
    got = {r.id: r for r in Aligner().align_pairs(reads, targets).collect() if not r.flag & 0x900}
    assert len(got) == 60
    proper = [r for r in got.values() if r.flag & 2]
    assert len(proper) >= 56 and got[11].flag & 2
    assert all(got[2 * i].tlen == -got[2 * i + 1].tlen for i in range(30))


def test_mates_of_different_names_are_an_error(spark, world):
    targets = world[2]
    reads = spark.createDataFrame([(0, "a", "ACGT" * 10), (1, "b", "ACGT" * 10)], "id long, name string, seq string")
    with pytest.raises(Exception, match="different names"):
        Aligner().align_pairs(reads, targets).collect()


def test_smart_pairs_and_chunks(spark):
    names = ["a/1", "a/2", "b", "c", "c", "c", "d", "d", "d", "d"]
    df = spark.createDataFrame(list(enumerate(names)), "ordinal long, name string")
    got = [(r.pair_id, r.end) for r in smart_pairs(df).orderBy("ordinal").collect()]
    assert got == [(0, 1), (0, 2), (2, 0), (3, 1), (3, 2), (5, 0), (6, 1), (6, 2), (8, 1), (8, 2)]
    reads = spark.createDataFrame([(i, "A" * 30) for i in range(10)], "id long, seq string")
    assert [r.chunk_id for r in chunked(reads, 100).orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_substitutes_run_on_over_contigs(spark):
    seqs = ["acgtNNRACG", "", None, "ACGT", "n" * 300 + "A", "ßY", "GNG"]
    rows = [(i, f"c{i}", s, i == 1) for i, s in enumerate(seqs)]
    targets = spark.createDataFrame(rows, "rid int, name string, seq string, is_alt boolean").repartition(3)
    state, want = (11 << 16) + 0x330E, []
    for s in seqs:
        out = None if s is None else ""
        for c in s or "":
            if c not in "ACGTacgt":
                state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
                c = "ACGT"[state >> 17 & 3]
            out += c.upper()
        want.append(out)
    got = with_substitutes(targets)
    assert got.schema == targets.schema
    assert [(r.rid, r.name, r.seq, r.is_alt) for r in got.orderBy("rid").collect()] == [(i, f"c{i}", s, i == 1) for i, s in enumerate(want)]
    plain = targets.where("rid = 3")
    assert with_substitutes(plain) is plain


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first one\r\nACGT\nAC GT\n>c2\nTTTT\n")
    rows = sequences.read_sequences(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()
    assert [(r.name, r.comment, r.seq) for r in rows] == [("c1", "first one", "ACGTACGT"), ("c2", None, "TTTT")]
    (tmp_path / "1.fq").write_text("@r1/1\nACGT\n+\n@III\n@r2/1\nAC\n+r2\nII\n@r3/1\nA\n+\nI\n")
    (tmp_path / "2.fq").write_text("@r1/2\nTTTT\n+\nIIII\n@r2/2\nGG\n+\nII\n")
    got = sequences.read_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).orderBy("id").collect()
    assert [(r.id, r.name, r.seq) for r in got] == [(0, "r1", "ACGT"), (1, "r1", "TTTT"), (2, "r2", "AC"), (3, "r2", "GG")]
    with pytest.raises(sequences.Truncated):
        list(sequences.parse("@r\nACGT\n+\nII\n"))


def test_sam_text(spark, tmp_path, world):
    _, contigs, targets = world
    from strandline.operators.index import contigs as laid

    reads = spark.createDataFrame([(1, "b", contigs[0][500:600]), (0, "a", contigs[1][100:200])], "id long, name string, seq string")
    sequences.write_sam(Aligner().align(reads, targets), laid(targets), str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert lines[0] == "@SQ\tSN:c0\tLN:1500" and lines[2].startswith("@PG")
    assert [x.split("\t")[0] for x in lines[3:]] == ["a", "b"]
    assert sam.read_group("@RG\\tID:x\\tSM:y") == ("@RG\tID:x\tSM:y", "x")
    with pytest.raises(ValueError):
        sam.read_group("ID:x")


def test_a_saved_index_and_comments(spark, tmp_path, world):
    from strandline.operators import index

    _, contigs, targets = world
    named = targets.selectExpr("*", "'a\tb' as anno", "rid = 1 as is_alt")
    index.save(named, str(tmp_path / "index"), 19)
    saved = index.load(spark, str(tmp_path / "index"))
    reads = spark.createDataFrame([(0, "a", contigs[0][600:700])], "id long, name string, seq string")
    (r,) = Aligner(kmers=saved["kmers"], ref_comment=True).align(reads, saved["targets"]).collect()
    assert r.pos == 601 and r.tags[-1] == "XR:Z:a b"
    assert saved["contigs"].count() == 2 and saved["holes"].count() == 0
    odd = spark.createDataFrame([(0, "x", "ACGNNnRRACG")], "rid int, name string, seq string")
    found = index.holes(odd)
    assert [(h.off, h.len, h.amb) for h in found.orderBy("off").collect()] == [(3, 3, "N"), (6, 2, "R")]
    spans = spark.createDataFrame([(0, 0, 3), (0, 2, 7), (0, 0, 11)], "rid int, b int, e int")
    assert {(s.b, s.e): s.n_ambiguous for s in index.ambiguous_in(spans, found).collect()} == {(0, 3): 0, (2, 7): 4, (0, 11): 5}


def test_a_stream_of_reads_is_aligned_by_batch(spark, tmp_path, world):
    from strandline.streaming.chunks import align_stream

    _, contigs, targets = world
    spark.createDataFrame([(i, f"r{i}", contigs[0][450 + 20 * i : 550 + 20 * i]) for i in range(4)], "id long, name string, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, name string, seq string").parquet(str(tmp_path / "in"))
    align_stream(stream, targets, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_the_profile_tells_the_seconds_of_each_stage(spark, world):
    from strandline.operators import profile

    _, contigs, targets = world
    reads = spark.createDataFrame([(i, f"r{i}", contigs[0][50 * i : 50 * i + 120]) for i in range(12)] + [(99, "none", "")], "id long, name string, seq string")
    got = {r.stage: r for r in Aligner().profile(reads, targets).collect()}
    assert set(got) == set(profile.STAGES)
    for r in got.values():
        assert 0 <= r.least <= r.mean <= r.greatest <= r.total and r.workers >= 1
    assert got["extend"].total > 0 and got["records"].total > 0
    assert Aligner().profile(reads.where("id < 0"), targets).count() == 0
