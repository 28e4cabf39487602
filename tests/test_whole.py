"""Queries over all of their tables: no row and no stretch of a text is left out."""

import random

import pytest

from strandline.plans import pairing

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents that hold benchmark items behind base 600, under high ids and as short texts."""
    rng, d = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    items = [words(rng, n) for n in (310, 200)]
    docs = [(0, words(rng, 900) + items[0]), (5000, words(rng, 700)), (6000, items[1]), (7000, "ab"), (8000, "1 2"), (9000, None)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_mates_hold_every_base(spark, tables):
    seq = {r.read_id: r.seq for r in pairing.reads(spark, tables).collect()}
    covered = {}
    for r in pairing.mates(spark, tables).collect():
        doc, k = divmod(r.id // 2, 100_000)
        s = r.seq[::-1].translate(str.maketrans("ACGT", "TGCA")) if r.id % 2 else r.seq
        stretch = seq[doc][300 * k : 300 * k + 300]
        at = 300 * k + (len(stretch) - len(s) if r.id % 2 else 0)
        assert seq[doc][at : at + len(s)] == s and 0 < len(s) <= 150
        covered.setdefault(doc, set()).update(range(at, at + len(s)))
    assert covered == {i: set(range(len(s))) for i, s in seq.items() if s}


def test_pairs_of_late_and_short_documents_map(spark, tables):
    got = pairing.paired_alignments(spark, tables).collect()
    mapped = {(r.id // 200_000, r.rname) for r in got if r.rname != "*" and not r.flag & 4}
    assert mapped == {(0, "item0"), (6000, "item1")}
    assert {r.id for r in got} == {r.id for r in pairing.mates(spark, tables).collect()}


def test_tags_name_all_other_hits(spark, tmp_path):
    rows = [(7, h, float(60 - h)) for h in range(1, 13)] + [(8, 20, 5.0), (None, 30, 5.0), (None, 31, 5.0)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.hit: [int(x.split(",")[1]) for x in r.sa.split(";")[:-1]] for r in pairing.sa_tags_all(spark, str(tmp_path)).collect()}
    assert got == {h: [x for x in range(1, 13) if x != h] for h in range(1, 13)}


def test_md_goes_over_whole_items(spark, tmp_path):
    text = "b" * 150 + "d" + "c" * 99 + "h" + "b" * 49  # d and h are A
    spark.createDataFrame([(1, text), (2, "bcb"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.md, r.nm) for r in pairing.md_tag_whole(spark, str(tmp_path)).collect()}
    assert got == {1: ("150A99A49", 2), 2: ("3", 0), 3: ("0", 0)}
