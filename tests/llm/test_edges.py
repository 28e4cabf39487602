"""Fingerprints against brute force, damaged files, hot and repeated ids, replicas with offsets of their own."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from strandline.llm import fingerprints, jaccard, langid, merkle, quality, tokenfile
from strandline.llm.shingles import MinHash


def sig(text, size=128, width=5):
    """The 128 minima of a text's shingles, word by word, with the hashes of the operator."""
    import pyarrow as pa

    return fingerprints.signatures(pa.array([text]), MinHash(size, 11), width)[0]


def brute(rows):
    """Rows in descending id, ties by descending hash of the text (given as third value)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[2]), reverse=True)
    out = []
    for (i, t, _), (_, u, _) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        a, b, c = sig(t), sig(new), sig(u)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=str)


def test_edits_equal_brute_force(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["ab", "ün", "x", "Zeile", "日本"]) + str(rng.randrange(9)) for _ in range(n))
    rows = [(i * 3, words(rng.randrange(40))) for i in range(30)]
    rows += [(7, words(12)) for _ in range(9)] + [(9, "the same text again and again")] * 6 + [(None, "a null id"), (None, None), (None, None), (40, ""), (41, "one"), (42, words(4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as part", "1 as times", "2 as at", "'y' as fingerprint")
    ties = df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as tie").collect()
    got = sorted((tuple(r) for r in fingerprints.edits(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text, r.tie) for r in ties])
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(df).collect()}
    assert plain == {(g[0], g[3]) for g in got}
    assert fingerprints.edits(df.limit(0)).count() == 0
    (single,) = fingerprints.edits(df.where("doc_id = 41")).collect()
    assert single.near_next == 1.0


def test_likeness_estimates_jaccard_and_bands_find_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    changed = [*base[:300], *(f"v{rng.randrange(900)}" for _ in range(100))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, changed)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    got = (sig(" ".join(base)) == sig(" ".join(changed))).mean()
    assert abs(got - true) < 4 * (true * (1 - true) / 128) ** 0.5
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:-3])), (3, " ".join(changed))], "doc_id long, text string")
    assert sorted(tuple(r) for r in fingerprints.duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    assert (MinHash(5, 11).a == MinHash(128, 11).a[:5]).all()


def test_damage_names_its_block_and_blocks_stand_alone():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 10_000).clip(0, 999).astype(np.uint16)
    data = tokenfile.write_segment([1, None], [4000, 6000], ids, 1000)
    assert (tokenfile.read_segment(data, 1000)[2] == ids).all()
    assert (tokenfile.read_block(data, 1, 1000) == ids[tokenfile.BLOCK : 2 * tokenfile.BLOCK]).all()
    _, table, ends, _ = tokenfile.head_of(data)
    hurt = bytearray(data)
    hurt[int(ends[1]) - int(table[1, 2]) + 9] ^= 64
    with pytest.raises(ValueError, match="block 1: wrong checksum"):
        tokenfile.read_segment(bytes(hurt), 1000)
    assert (tokenfile.read_block(bytes(hurt), 0, 1000) == ids[: tokenfile.BLOCK]).all()
    for wrong in (b"", data[:30], b"XXXX" + data[4:], data[:-9], data[:-4] + struct.pack("<I", zlib.crc32(data[:-4]) ^ 1)):
        with pytest.raises(ValueError, match="segment"):
            tokenfile.read_segment(wrong, 1000)


def test_token_files_of_repeated_ids(spark):
    rows = [(5, f"text number {i}") for i in range(20)] + [(None, None), (None, ""), (1, "word " * 3000), (5, "text number 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'z' as segment", "0 as n_tokens")
    got = tokenfile.round_trip(df).collect()
    assert len(got) == len(rows)
    ends = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    ids = [e[2] for e in ends]
    assert ids == [None, None, 1] + [5] * 21 and {r.n_tokens for r in got if r.doc_id is None} == {1}
    assert tokenfile.round_trip(df.limit(0)).count() == 0


def test_models_do_not_depend_on_how_rows_lie(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    a, b = langid.fit(docs, per_language=30), langid.fit(docs.repartition(7).orderBy("n_chars"), per_language=30)
    assert (a.weights == b.weights).all() and a.temperature == b.temperature
    a, b = quality.fit(docs, labels, 60), quality.fit(docs.repartition(5), labels.repartition(3), 60)
    assert (a.weights == b.weights).all() and (a.slope, a.level) == (b.slope, b.level)


def test_letters_of_all_planes():
    import pyarrow as pa

    c, bounds = langid.codes(pa.array(["\U00020000\U00030000 x", "\U0001f600"]))
    assert "".join(map(chr, c[bounds[0] : bounds[1]])).split() == ["\U00020000\U00030000", "x"] and not "".join(map(chr, c[bounds[1] :])).strip()


def test_scores_of_texts_with_very_many_lines():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=49), np.ones(49), rng.normal(size=(49, 2)) / 9, rng.normal(size=(2, 2)), 1.0, 0.0)
    text = "\n".join(" ".join("ab c. D"[: rng.integers(1, 7)] for _ in range(rng.integers(0, 4))) for _ in range(6000))
    texts = pa.array([text, "", "one line", text])
    x, length, lines = quality.line_features(texts)
    marginals = quality.forward_backward((x - model.mean) @ model.weights, lines, model.trans)[0][:, 1]
    at = np.cumsum(lines) - lines
    p = np.add.reduceat(marginals * (length + 1), at) / np.add.reduceat(length + 1, at)
    assert np.allclose(model.scores(texts), np.clip(p, 1e-4, 1 - 1e-4), atol=1e-9) and lines[0] > quality.LONG


def test_replicas_have_offsets_of_their_own(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, f"u{i}", "h" * (i % 7)) for i in range(60)] + [(None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as offset", "2 as status")
    text = merkle.record(F.col("page_id"), F.col("url"), F.col("html"))
    page = F.coalesce(F.col("page_id"), F.lit(-1))
    replicas = {"a": F.when(page != 9, text), "b": F.when(page != 21, F.when(page == 33, F.concat(text, F.lit("!"))).otherwise(text))}
    kept = merkle.catalogue(pages, replicas, 20)
    got = {r.page_id: (r.status, r.offset) for r in merkle.audit(kept, "a", "b", 4).collect()}
    assert {k: v[0] for k, v in got.items() if v[0] != "intact"} == {9: "extra", 21: "missing", 33: "corrupt"} and len(got) == 61
    size = {r.page_id: len(r.t) for r in pages.select("page_id", text.alias("t")).collect()}
    assert got[10][1] == sum(size[i] for i in range(9)) and got[9][1] == sum(size[i] for i in range(9)) and got[22][1] == size[20] + size[21]


def test_large_groups_of_near_copies_are_counted_exactly(spark):
    from test_sets import brute as pairs

    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(200)] = f"y{rng.randrange(99)}"
        rows.append((i, " ".join(w[: 200 - (i % 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.similarity_join(df, block=9).collect()), key=str)
    assert got == pairs(rows)
