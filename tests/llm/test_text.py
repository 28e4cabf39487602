"""BPE, chunk reuse, shingles, fingerprints, token files."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import chunks, fingerprints, shingles, tokenfile
from strandline.llm.bpe import encoder, vocabulary
from strandline.llm.common import string_array, views

ODD = ["", "a", " ", "Hello it's <|endoftext|> WE'LL 42²x", "  a\n\tb c É ÉCOLE İx ŉ é 日本語 ١٢", "don't'd 'sx x'S", "x" * 5000, " " * 300, "ab " * 900 + "q" * 3000 + "éé " * 500, " lead", "trail ", "e\u0301 combining", "ſ ﬁ ǅ", "a\u00a0b\u2003c\x85d\x1ce"]


@pytest.fixture(scope="module")
def words():
    return encoder(vocabulary())


def plain(words, text):
    return words.whole.encode(text, add_special_tokens=False).ids


def parts(ids, counts):
    return [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]


def test_words_encode_as_the_library_does(words):
    assert parts(*words.encode(pa.array(ODD))) == [plain(words, t) for t in ODD]


def test_a_full_table_starts_anew(words):
    from strandline.llm.bpe import WordEncoder

    small = WordEncoder(vocabulary(), most_words=5)
    for _ in range(3):
        assert parts(*small.encode(pa.array(["one two three four", "five six seven one"]))) == [plain(words, "one two three four"), plain(words, "five six seven one")]


@pytest.mark.parametrize("bits", [1, 3, 6, 9])
def test_chunks_encode_exactly(words, bits):
    rng = np.random.default_rng(bits)
    texts = ODD + ["".join(rng.choice(list("abc é.’ X<|\n"), 400)) for _ in range(30)]
    texts += texts[-3:]
    reused = chunks.ChunkEncoder(words, bits, chunk_bytes=2000)
    for _ in range(2):
        assert parts(*reused.encode(pa.array(texts))) == [plain(words, t) for t in texts]


def test_digests_are_those_of_the_library(spark, words):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (1, ODD[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as ids_sha256")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunks.encode_decode(df).collect())
    expected = []
    for i, t in rows:
        ids = plain(words, t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(words.whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected)


def test_shingles_are_those_of_the_words():
    texts = ["", " \n", "one", "a b c d", "A b c d e", "a b c d e f\ng  a b c d e", "é x"]
    words, counts = shingles.word_hashes(*views(pa.array(texts)))
    assert counts.tolist() == [len(t.split()) for t in texts]
    sh, n = shingles.shingle_hashes(words, counts)
    assert n.tolist() == [0, 0, 1, 1, 1, 8, 1]
    sets, sizes = shingles.distinct(sh, n)
    assert sizes.tolist() == [0, 0, 1, 1, 1, 7, 1]
    ends = np.cumsum(sizes)
    assert sets[ends[3]] in sets[ends[4] : ends[5]]  # the words of the fifth text stand in the sixth


def test_signatures_estimate_jaccard():
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(100, 500))
    sig = fingerprints.signatures(pa.array([a, b, a.upper().lower()]), shingles.MinHash(512))
    exact = 296 / 496
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.07 and (sig[0] == sig[2]).all()
    assert shingles.bands_for(0.8, 0.9999) == (24, 5)


@pytest.mark.parametrize("rows", [[], [(1, "only one text here")], [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (50, None), (3, ODD[3])]])
def test_edits_follow_the_next_document(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edits(df).collect()]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] if r[0] is not None else -(1 << 63), r[1].encode()), reverse=True)
    expected = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, n).clip(0, 49407).astype(np.uint16) for n in (1, 5000, 33, 64, 700)] + [np.zeros(3000, np.uint16), np.arange(0, 49408, 5, dtype=np.uint16)]
    payloads = tokenfile.compress(blocks, 49408)
    for a, b in zip(blocks, tokenfile.expand(payloads, [len(x) for x in blocks], 49408)):
        assert np.array_equal(a, b)
    assert len(payloads[5]) < 200


def test_segments_find_damage():
    ids = np.arange(20_000, dtype=np.uint16)
    data = tokenfile.write_segment([7, None], [15_000, 5_000], ids, 49408)
    docs, counts, back = tokenfile.read_segment(data, 49408)
    assert docs == [7, None] and counts == [15_000, 5_000] and np.array_equal(back, ids)
    with pytest.raises(ValueError):
        tokenfile.read_segment(data[:100] + bytes([data[100] ^ 1]) + data[101:], 49408)


def test_files_give_back_all_ids(spark, words):
    rows = [(5, "the quick brown fox"), (3, None), (9, ""), (1, "fox fox fox fox"), (None, "none"), (5, "again")] + [(100 + i, f"text number {i} of many") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.round_trip(df).collect())
    start, expected = 0, []
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] if r[0] is not None else -1, r[1])):
        ids = np.array(plain(words, t) + [2], "<u4")
        expected.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert tokenfile.round_trip(df.limit(0)).count() == 0


def test_string_arrays_take_nulls_and_slices():
    a = pa.array(["x", None, "yz"])
    raw, off = views(string_array(a[1:]))
    assert bytes(raw) == b"yz" and off.tolist() == [0, 0, 2]
