"""The coder of the tables (TokenCoder.java) against the one in numpy: the same bytes, the same documents, the same complaints."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import bpe, packing, tokenfile
from strandline.llm.bpe import Counter, FastEncoder, encoder, vocabulary

RNG = np.random.default_rng(4)
ROWS = "array<struct<doc_id: bigint, place: bigint, n_tokens: bigint, ids_crc32: bigint>>"
CASES = {
    "skewed": (49408, RNG.zipf(1.2, 30_000).clip(0, 49407), [0, 12_000, 0, 4_000, 14_000, 0]),
    "even": (49408, RNG.integers(0, 49408, 9_000), [9_000]),
    "every id of 16 bits": (1 << 16, np.arange(1 << 16), [1 << 16]),
    "repeats": (49408, np.tile(RNG.integers(0, 49408, 50), 300), [15_000]),
    "one id": (49408, np.zeros(tokenfile.BLOCK), [tokenfile.BLOCK]),
    "few ids": (3, RNG.integers(0, 3, 5_000), [4_999, 1]),
    "no ids": (49408, np.zeros(0), [0]),
    "no documents": (49408, np.zeros(0), []),
}


def documents(spark, data, size):
    df = spark.createDataFrame([(bytearray(data),)], "segment binary")
    return [tuple(r) for r in df.select(tokenfile.java(spark, "Reader", ROWS, size, "segment")).head()[0]]


@pytest.mark.parametrize("case", CASES)
def test_both_coders_write_the_same_bytes_and_read_them(spark, case):
    size, ids, counts = CASES[case]
    ids, doc_ids = ids.astype(np.uint16), [None if i == 1 else i - 3 for i in range(len(counts))]
    expected = tokenfile.write_segment(doc_ids, counts, ids, size)
    docs = np.array([(i or 0, i is None, c) for i, c in zip(doc_ids, counts)], tokenfile.DOCUMENT)
    df = spark.createDataFrame([(bytearray(docs.tobytes()), bytearray(ids.astype("<u2").tobytes()))], "docs binary, ids binary")
    assert bytes(df.select(tokenfile.java(spark, "Writer", "binary", size, "docs", "ids")).head()[0]) == expected
    ends = np.cumsum([0, *counts])
    assert documents(spark, expected, size) == [(i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for i, a, b in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist())]


def test_the_tables_reader_finds_damage(spark):
    ids = RNG.zipf(1.3, 10_000).clip(0, 999).astype(np.uint16)
    data = tokenfile.write_segment([1, None], [4000, 6000], ids, 1000)
    _, table, ends, _ = tokenfile.head_of(data)
    hurt = bytearray(data)
    hurt[int(ends[1]) - int(table[1, 2]) + 9] ^= 64
    with pytest.raises(Exception, match="block 1: wrong checksum"):
        documents(spark, hurt, 1000)
    for wrong in (b"", data[:30], b"XXXX" + data[4:], data[:-9], data[:-1] + bytes([data[-1] ^ 1])):
        with pytest.raises(Exception, match="segment: "):
            documents(spark, wrong, 1000)


def test_the_numpy_coder_reads_the_files(spark, tmp_path):
    rows = [(2, "a long text of many words " * 8_000), (1, "short"), (None, None)]
    folder = str(tmp_path / "files")
    tokenfile.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    size, whole = len(encoder(vocabulary()).tokens), encoder(vocabulary()).whole
    found = {}
    for r in spark.read.parquet(folder).collect():
        doc_ids, counts, ids = tokenfile.read_segment(bytes(r.segment), size)
        found |= zip(doc_ids, (p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])))
    assert found == {i: whole.encode(t or "", add_special_tokens=False).ids + [tokenfile.END] for i, t in rows}


def test_the_fast_encoder_gives_the_same_ids():
    words = "".join(map(chr, RNG.choice(list(range(33, 127)) + [32] * 30 + list(range(0xC0, 0x100)), 60_000)))
    texts = pa.array([words[:30_000], "", words[30_000:], "Hello it's <|endoftext|> WE'LL 42²x 日本語"])
    for a, b in zip(FastEncoder(vocabulary()).encode(texts), encoder(vocabulary()).encode(texts)):
        assert np.array_equal(a, b)


def test_the_fast_encoder_cuts_words_as_the_library_does():
    whole = encoder(vocabulary()).whole
    bits = ["a", "B", "é", "É", "ß", "ÿ", "×", "÷", "²", "¡", "ı", "İ", "Σ", "e\u0301", "\u200b", "\xa0", "\x85", "\x0b", "日本", "ﬁ", "٣", "0", "19", "'s", "'", "'LL", "<", "|", "<|endoftext|>", "<|ENDOFTEXT|>", ".", "!?", "-", " ", "  ", "\n", "\t", "\r", "Ġ", "</w>"]
    texts = ["".join(RNG.choice(bits, RNG.integers(0, 30))) for _ in range(1500)] + ["", " ", "\n", "<", "|", "é", "É'"]
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for e in (FastEncoder(vocabulary()), FastEncoder(vocabulary(), 40), FastEncoder(vocabulary(), 600_000, 300)):
        for some in (slice(0, 3), slice(0, 700), slice(500, None)):
            ids, counts = e.encode(pa.array(texts)[some])
            assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == expected[some]


def test_the_fast_encoder_keeps_what_it_learned_within_bounds(monkeypatch):
    e, texts = encoder(vocabulary(), FastEncoder), pa.array(["One two, ONE Two? été", "two one."])
    first = e.encode(texts)
    bpe.emptied()  # as at the end of a task
    for library in ("whole", "merges", "bytewise"):
        monkeypatch.setattr(e, library, None, raising=False)  # not asked again
    assert all(np.array_equal(a, b) for a, b in zip(first, e.encode(texts)))
    small = FastEncoder(vocabulary(), 600_000, 200)
    small.encode(pa.array(["word " + "x" * 1_000]))
    assert len(small.values) == 2
    small.clear()
    assert not len(small.values)
    with pytest.raises(UnicodeDecodeError):
        small.encode(pa.array([b"new \xff"], pa.binary()).view(pa.string()))
    assert np.array_equal(small.encode(texts)[0], first[0])


def test_the_counter_counts_the_ids_of_whole_texts():
    rng, whole = np.random.default_rng(8), encoder(vocabulary()).whole
    bits = ["a", "B", "é", "×", "²", "ı", "İ", "e\u0301", "\u200b", "\xa0", "日本", "0", "19", "'s", "'", "<", "|", "<|endoftext|>", ".", "!?", " ", "  ", "\n", "</w>"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(800)] + ["", " ", "\n", "it's " * 5_000, ""]
    expected = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    for e in (Counter(vocabulary()), Counter(vocabulary(), 40), Counter(vocabulary(), 600_000, 300)):
        for some in (slice(0, 0), slice(0, 300), slice(200, None), slice(803, 804)):
            assert e.counts(pa.array(texts, pa.string())[some]).tolist() == expected[some]
            bpe.emptied()
            e.clear()


def test_token_counts_hold_neither_ids_nor_words_as_objects(spark, monkeypatch):
    """Of 8 MB of texts, with 131,072 different words: 40 MB of Python and numpy at most (19 as measured; 105 before)."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
    run = packing.token_counts(docs, ["doc_id"])
    rng = np.random.default_rng(9)
    letters = rng.integers(97, 123, (1 << 20, 8)).astype(np.uint8)
    letters[:, 7] = 32
    letters[1 << 17 :] = letters[rng.integers(0, 1 << 17, len(letters) - (1 << 17))]
    texts = [r.tobytes().decode() for r in np.split(letters, 64)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(texts)], ["doc_id", "text"])
    next(run(iter([batch.slice(0, 1)])))  # the vocabulary is read
    tracemalloc.start()
    got = [n for b in run(iter([batch])) for n in b.column("n_tokens").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = encoder(vocabulary()).whole
    assert len(got) == 64 and got[:2] == [len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in texts[:2]]
    assert peak < 40e6


def test_a_segment_ends_with_the_document_that_fills_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 10)
    folder = str(tmp_path / "files")
    rows = [(i, "one two three") for i in range(20)]
    tokenfile.write_ids(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), folder)
    got = spark.read.parquet(folder).orderBy("part", "number").collect()
    assert sum(r.n_ids for r in got) == 80 and all(r.n_ids <= 12 for r in got)
    assert [r.before for r in got if r.part == got[0].part] == [12 * i for i in range(sum(r.part == got[0].part for r in got))]
