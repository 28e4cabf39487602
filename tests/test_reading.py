"""Readers by byte ranges, mates of several files, options as a command line gives them."""

import random
import warnings

import pytest

from strandline.operators.align import BLOCK, Aligner, smart_pairs
from strandline.operators.index import contigs as laid
from strandline.options import PRESETS, Options
from strandline.sources import sequences


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plain(df):
    return sorted((r.ordinal, r.name, r.comment, r.seq, r.qual) for r in df.collect())


def test_byte_ranges_give_the_rows_of_the_whole_file(small_ranges, tmp_path):
    spark, rng = small_ranges, random.Random(1)
    bases = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    with open(tmp_path / "a.fa", "w", newline="") as f:
        for i in range(40):
            f.write(f">c{i}" + (" about it" if i % 2 else "") + ("\r\n" if i % 3 else "\n") + "\n".join(bases(rng.randrange(1, 60)) for _ in range(i % 4)) + "\n")
    path = str(tmp_path / "a.fa")
    got = sequences.read_fasta(spark, path)
    assert plain(got) == plain(sequences.read_sequences(spark, path))
    with open(tmp_path / "a.fq", "w") as f:
        for i in range(60):
            s = bases(rng.randrange(20, 50))
            f.write(f"@r{i}/1 x\n{s}\n+\n" + "".join(rng.choice("@+I#") for _ in s) + "\n")
    path = str(tmp_path / "a.fq")
    got = sequences.read_fastq(spark, path)
    assert plain(got) == plain(sequences.read_sequences(spark, path))
    assert spark.read.text(path).rdd.getNumPartitions() > 3
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="four lines"):
        sequences.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_mates_of_several_files_meet_by_file(spark, tmp_path):
    for end, counts in ((1, (3, 2)), (2, (3, 4))):
        (tmp_path / str(end)).mkdir()
        for k, n in enumerate(counts):
            (tmp_path / str(end) / f"{k}.fq").write_text("".join(f"@f{k}r{i}/{end}\nAC\n+\nII\n" for i in range(n)))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = sequences.read_pairs(spark, str(tmp_path / "1"), str(tmp_path / "2"), sequences.read_fastq).orderBy("id").collect()
    assert [r.name for r in got] == [f"f{k}r{i}" for k, n in ((0, 3), (1, 2)) for i in range(n) for _ in (1, 2)]
    assert [r.id for r in got] == list(range(10)) and any("2 reads have no mate" in str(w.message) for w in said)


def test_smart_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("strandline.operators.align.BLOCK", 4)
    assert BLOCK > 4
    rng = random.Random(2)
    names = [f"n{k}" for k, n in enumerate(rng.choice([1, 1, 2, 2, 3, 9, 14]) for _ in range(40)) for _ in range(n)]
    got = smart_pairs(spark.createDataFrame(list(enumerate(names)), "ordinal long, name string")).orderBy("ordinal").collect()
    expected, i = [], 0
    while i < len(names):
        if i + 1 < len(names) and names[i] == names[i + 1]:
            expected += [(i, 1), (i, 2)]
            i += 2
        else:
            expected.append((i, 0))
            i += 1
    assert [(r.pair_id, r.end) for r in got] == expected
    assert smart_pairs(spark.createDataFrame([], "ordinal long, name string")).count() == 0


def test_interleaved_reads_and_headers(spark, tmp_path):
    rng = random.Random(5)
    target = "".join(rng.choice("ACGT") for _ in range(1200))
    turn = str.maketrans("ACGT", "TGCA")
    rows = [(0, "a/1", target[100:180]), (1, "a/2", target[300:380].translate(turn)[::-1]), (2, "b", target[500:580]), (3, "c", target[10:90]), (4, "c", target[210:290].translate(turn)[::-1])]
    targets = spark.createDataFrame([(0, "t", target)], "rid int, name string, seq string")
    reads = spark.createDataFrame(rows, "ordinal long, name string, seq string")
    o = Options.of(interleaved=True, read_group_line=r"@RG\tID:g\tSM:s", header=("@CO\tx",))
    found = Aligner(o).run(reads, targets)
    got = {r.id: r for r in found.collect()}
    assert {k: r.flag & 0xC1 for k, r in got.items()} == {0: 0x41, 1: 0x81, 4: 0, 6: 0x41, 7: 0x81}
    assert [got[k].pos for k in (0, 1, 4, 6, 7)] == [101, 301, 501, 11, 211] and all("RG:Z:g" in r.tags for r in got.values())
    sequences.write_sam(found, laid(targets), str(tmp_path / "out"), options=o)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert [x.split("\t")[0] for x in lines[:4]] == ["@SQ", "@CO", "@RG", "@PG"] and lines[2] == "@RG\tID:g\tSM:s"
    long_reads = Options.of("ont2d", match=2)
    assert long_reads.min_seed == PRESETS["ont2d"]["min_seed"] and long_reads.mismatch == 1 and Options.of(match=2).mismatch == 8
