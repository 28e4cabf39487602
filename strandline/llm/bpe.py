"""Exact byte-pair encoding of whole texts with the tokenizers library, paid once per distinct word.

White space ends a pre-token in the word_bpe vocabulary, so a text's ids are the ids of its words in order. Each
task keeps a bounded table word -> ids; only words that are new to it reach the library. Words outside plain
Latin letters, or that hold the mark of a special token, go through the library's whole pipeline; all others are split
by the vocabulary's own pattern and only their merges are left to the library. FastEncoder does the same for parts of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import AT_END, from_views, views

#: Fixed values of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space that separates words; a subset of what the pattern treats so.
SPACES = (9, 10, 13)


class WordEncoder:
    """encode(array of texts) -> (flat uint16 ids, ids per text), as encode(text, add_special_tokens=False).

    most_words bounds the table: beyond it the table starts anew, which costs time and changes no result."""

    def __init__(self, path: str, most_words: int = 300_000):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        assert len(self.tokens) <= 1 << 16
        self.ends = np.array([t.endswith("</w>") for t in self.tokens])
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile(PATTERN + r"|\n").findall
        self.odd = regex.compile(r"[^\x20-\x7e¡-įı-ňŊ-ž]|<\|").search
        self.most_words = most_words
        self.clear()
        self.clear_parts()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.word_ids = Pool()

    def clear_parts(self) -> None:
        self.parts: dict[str, int] = {"\n": 0}
        self.part_ids = Pool()
        self.part_ids.put(np.zeros(0, np.uint16), np.zeros(1, np.int64))

    def _merged(self, parts: str) -> list[int]:
        return self.merges.encode(parts, add_special_tokens=False).ids

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain Latin letters."""
        found = self.split("\n".join(words).lower())
        if new := list({p for p in found if p not in self.parts}):
            if len(self.parts) + len(new) > self.most_words:
                self.clear_parts()
                new = [p for p in set(found) if p != "\n"]
            ids = np.array(self._merged(" ".join(new)), np.uint16)
            ends = np.flatnonzero(self.ends[ids]) + 1
            assert len(ends) == len(new)
            self.parts.update(zip(new, range(len(self.parts), len(self.parts) + len(new))))
            self.part_ids.put(ids, np.diff(ends, prepend=0))
        at = np.fromiter(map(self.parts.__getitem__, found), np.int64, len(found))
        ids, counts = self.part_ids.get(at)
        return ids, np.bincount(np.cumsum(at == 0), counts, len(words)).astype(np.int64)

    def _coded(self, words: list[str]):
        """(some of the words, their ids, ids per word), again and again."""
        odd = [w for w in words if self.odd(w)] if self.odd(" ".join(words)) else []
        plain = words
        if odd:
            plain = list(set(words).difference(odd))
        for i in range(0, len(plain), 50_000):
            yield (part := plain[i : i + 50_000]), *self._plain(part)
        if odd:
            got = [np.array(self.whole.encode(w, add_special_tokens=False).ids, np.uint16) for w in odd]
            yield odd, np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, words: list[str]) -> None:
        for part in self._coded(words):
            self._put(*part)

    def _put(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.word_ids.put(ids, counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = views(texts)
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(len(off) - 1, np.int64)
        raw = raw.copy()
        for s in SPACES:
            raw[raw == s] = 32
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:] = raw == 32
        cut[off] = True
        cut[0] = cut[-1] = True
        bounds = np.flatnonzero(cut)
        coded = from_views(raw, bounds).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.words) + len(words) > self.most_words:
            self.clear()
        if new := [w for w in words if w not in self.words]:
            self._learn(new)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices)]
        ids, counts = self.word_ids.get(at)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(bounds, off)])


#: Kinds of bytes in a text; each digit is a pre-token, letters and other signs are in runs.
SPACE, LETTER, SIGN, DIGIT, ODD = range(5)


def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte, the kind of C3 and each byte after it (letters from \u00c0 to \u00ff), and each ASCII byte in lower case."""
    first, second = np.full(256, ODD, np.uint8), np.full(256, ODD, np.uint8)
    first[33:127] = SIGN
    first[[ord("'")]] = ODD  # may begin a pre-token of letters
    first[[32, *SPACES]] = SPACE
    lower = np.arange(256, dtype=np.uint8)
    for a, z, kind in (("0", "9", DIGIT), ("A", "Z", LETTER), ("a", "z", LETTER)):
        first[ord(a) : ord(z) + 1] = kind
    lower[ord("A") : ord("Z") + 1] += 32
    second[0x80:0xC0] = LETTER
    second[[0x97, 0xB7]] = ODD
    return first, second, lower


def alphabet() -> np.ndarray:
    """The character that stands for each byte in a vocabulary of bytes; a space stays one."""
    out = np.arange(256, dtype="<u2")
    hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173)]
    out[hidden] = 256 + np.arange(len(hidden))
    out[32] = 32
    return out


KIND, KIND_C3, LOWER = kinds()
ALPHABET = alphabet()


class FastEncoder(WordEncoder):
    """The same ids in less time: bytes are cut into pre-tokens in arrays and equal ones met once, by Arrow.

    Words of ASCII and Latin-1 letters only are cut as the vocabulary's pattern cuts them; a word with any other character, an
    apostrophe or the mark of a special token is one value and goes the way of WordEncoder. The table value -> ids holds most_words
    values and most_bytes bytes of them, and stays for the worker's next task; beyond that it starts anew."""

    def __init__(self, path: str, most_words: int = 600_000, most_bytes: int = 16 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, most_words)
        self.bytewise = Tokenizer(self.whole.model)
        self.bytewise.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        self.values, self.value_ids = pa.array([], pa.string()), Pool()

    def clear(self) -> None:
        super().clear()
        if hasattr(self, "values") and self.values.nbytes > self.most_bytes:
            self.forget()

    def _cut(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes without white space, where values begin there and in `raw`, and the numbers of those that are odd words."""
        kind, low = KIND[raw], LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        after = raw[lead + 1]
        kind[lead] = kind[lead + 1] = KIND_C3[after]
        low[lead + 1] += ((after >= 0x80) & (after <= 0x9E)).astype(np.uint8) << 5
        marks = np.flatnonzero(raw[:-1] == ord("<"))
        kind[marks[raw[marks + 1] == ord("|")]] = ODD
        begin = np.zeros(len(raw), bool)
        begin[off[:-1][off[:-1] < len(raw)]] = True
        keep = kind != SPACE
        cut = begin | (kind == DIGIT)
        cut[1:] |= kind[1:] != kind[:-1]
        cut &= keep
        odd_at = np.zeros(0, np.int64)
        if len(odd := np.flatnonzero(kind == ODD)):
            words = keep.copy()
            words[1:] &= begin[1:] | ~keep[:-1]
            words = np.flatnonzero(words)
            ends = keep.copy()
            ends[:-1] &= begin[1:] | ~keep[1:]
            which = np.unique(np.searchsorted(words, odd, side="right") - 1)
            odd_at = words[which]
            step = np.zeros(len(raw) + 1, np.int8)
            step[odd_at] = 1
            step[np.flatnonzero(ends)[which] + 1] -= 1
            inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            cut &= ~inside
            cut[odd_at] = True
            low[inside] = raw[inside]
        starts = np.flatnonzero(cut)
        return low[keep], np.flatnonzero(cut[keep]), starts, np.searchsorted(starts, odd_at)

    def _value_ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of values that are no odd words."""
        raw, off = views(values)
        raw = np.insert(raw, off[1:-1], 32)
        text = raw.tobytes().decode("ascii") if not len(raw) or raw.max() < 128 else ALPHABET[raw].tobytes().decode("utf-16-le")
        ids = np.array(self.bytewise.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.ends[ids]) + 1
        assert len(ends) == len(values)
        return ids, np.diff(ends, prepend=0)

    def _places(self, values: pa.Array, odd: np.ndarray) -> np.ndarray:
        """Where the table has each of the distinct values; new ones come into it. odd: the numbers of the odd words."""
        place = np.full(len(values), -1, np.int64)
        if len(self.values):
            place = pc.fill_null(pc.index_in(values, value_set=self.values), -1).to_numpy().astype(np.int64)
        new = place < 0
        if not new.any():
            return place
        if len(self.values) + new.sum() > self.most_words or self.values.nbytes + values.nbytes > self.most_bytes:
            self.forget()
            new[:] = True
        try:
            added = self._added(values, new, odd)
        except BaseException:
            self.forget()  # it may hold ids without their values
            raise
        place[added] = len(self.values) + np.arange(len(added))
        self.values = pa.concat_arrays([self.values, values.take(pa.array(added))])
        return place

    def _added(self, values: pa.Array, new: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Puts the ids of new values into the table; the numbers of these values in that order."""
        is_odd = np.zeros(len(values), bool)
        is_odd[odd] = True
        plain, whole = np.flatnonzero(new & ~is_odd), np.flatnonzero(new & is_odd)
        for i in range(0, len(plain), 10_000):
            self._keep(*self._value_ids(values.take(pa.array(plain[i : i + 10_000]))))
        order = plain.tolist()
        if len(whole):
            words = values.take(pa.array(whole)).to_pylist()
            number = dict(zip(words, whole.tolist()))
            for part, ids, counts in self._coded(words):
                order += [number[w] for w in part]
                self._keep(ids, counts)
        return np.array(order)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.value_ids.put(ids, counts)

    def _located(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the table has the distinct values of texts, which of them each value is, and the first value of each text and
        at last their number."""
        raw, off = views(texts)
        kept, bounds, starts, odd = self._cut(raw, off) if len(raw) else (raw, off[:0], off[:0], off[:0])
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        first = np.searchsorted(starts, off)
        del starts, raw
        coded = from_views(kept, np.append(bounds, len(kept)).astype(np.int32)).dictionary_encode()
        at = np.asarray(coded.indices)
        return self._places(coded.dictionary, at[odd]), at, first  # may put another table in place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        place, at, first = self._located(texts)
        if not len(at):
            return np.zeros(0, np.uint16), np.zeros(len(first) - 1, np.int64)
        place, known = place[at], self.value_ids
        counts = known.count[place]
        ids, _ = gather(known.flat, known.start[place], counts, np.int32 if max(len(known.flat), counts.sum()) < 1 << 31 else np.int64)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[first])


class Counter(FastEncoder):
    """counts(array of texts) -> ids per text, as encode() of the other encoders gives them. The table has the number of ids of
    each value, not the ids, and no id of a text is held."""

    def forget(self) -> None:
        self.values, self.n_ids = pa.array([], pa.string()), np.zeros(0, np.int32)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.n_ids = np.concatenate([self.n_ids, counts.astype(np.int32)])

    def counts(self, texts: pa.Array) -> np.ndarray:
        place, at, first = self._located(texts)
        n = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.n_ids[place][at], out=n[1:])
        return np.diff(n[first])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError("a Counter holds no ids")


class Pool:
    """Runs of ids, kept one after another in arrays that double."""

    def __init__(self):
        self.start, self.count, self.flat = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.uint16)
        self.runs = self.used = 0

    def put(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.runs + len(counts) > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.runs : self.runs + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.runs : self.runs + len(counts)] = counts
        self.runs, self.used = self.runs + len(counts), self.used + len(ids)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.start[at], self.count[at])


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[start : start + count], one after another, and their lengths. kind: of the places in the pool and the result."""
    ends = np.cumsum(count)
    at = np.repeat((start - (ends - count)).astype(kind), count)
    at += np.arange(len(at), dtype=kind)
    return pool[at], count


_encoders: dict[tuple[type, str], WordEncoder] = {}


def encoder(path: str, kind: type[WordEncoder] = WordEncoder) -> WordEncoder:
    """This Python worker's encoder for a vocabulary file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def emptied() -> None:
    """The words of a task are not kept for the next one; the vocabulary is."""
    for e in _encoders.values():
        e.clear()
        e.clear_parts()


AT_END.append(emptied)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
