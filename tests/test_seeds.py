"""Seeds against substring search on the doubled target."""

import random

import numpy as np

from strandline.operators.hits import Runs, maximal, seeds_of, third_round
from strandline.operators.kernels import codes, complement
from strandline.options import Options

LETTERS = "ACGTN"


def both(target):
    c = codes(target)
    return "".join(LETTERS[x] for x in np.concatenate([c, complement(c)]))


def count(text, part):
    return sum(text.startswith(part, i) for i in range(len(text) - len(part) + 1)) if part and "N" not in part else 0


def runs_of(read, text, k):
    b, e, t = [], [], []
    for diag in range(-len(read), len(text)):
        i = 0
        while i < len(read):
            j = i
            while j < len(read) and 0 <= diag + j < len(text) and read[j] == text[diag + j] != "N":
                j += 1
            if j - i >= k:
                b.append(i), e.append(j), t.append(diag + i)
            i = max(j, i + 1)
    return Runs(np.array(b, np.int64), np.array(e, np.int64), np.array(t, np.int64), k)


def case(rng):
    text = both("".join(rng.choice("ACGT" if rng.random() < 0.7 else "AC") for _ in range(rng.randrange(15, 60))))
    at = rng.randrange(len(text) - 8)
    read = list(text[at : at + rng.randrange(8, 30)])
    for i in range(len(read)):
        if rng.random() < 0.08:
            read[i] = rng.choice("ACGTN")
    return "".join(read), text


def longest(read, text, x, times):
    e = x
    while e < len(read) and count(text, read[x : e + 1]) >= times:
        e += 1
    return e


def test_maximal_stretches_by_occurrence():
    rng = random.Random(2)
    for _ in range(150):
        read, text = case(rng)
        k = rng.choice([3, 4, 5])
        runs = runs_of(read, text, k)
        for times in (1, 2, 3):
            ends = [longest(read, text, x, times) for x in range(len(read))]
            expected = [(x, e) for x, e in enumerate(ends) if e - x >= k and not any(ends[y] >= e for y in range(x))]
            assert maximal(runs, times, 0, len(read)) == expected
            for b, e in expected:
                assert len(runs.occurrences(b, e)) == count(text, read[b:e])


def test_third_round_takes_the_shortest_rare_stretches():
    rng = random.Random(3)
    for _ in range(150):
        read, text = case(rng)
        k, most = rng.choice([3, 4]), rng.choice([2, 3])
        o = Options(min_seed=k, max_mem_intv=most)
        got = third_round(runs_of(read, text, k), codes(read) > 3, len(read), o)
        expected, x = [], 0
        while x < len(read):
            if read[x] == "N":
                x += 1
                continue
            e = x
            while True:
                e += 1
                if e > len(read) or read[e - 1] == "N":
                    x = e
                    break
                n = count(text, read[x:e])
                if n < most and e - x >= k + 1:
                    if n > 0:
                        expected.append((x, e))
                    x = e
                    break
        assert got == expected


def test_reseeding_goes_through_the_middle_of_long_rare_seeds():
    text = both("ACGTACCATGGTTACAGGACCATGGTTCCA")
    read = text[2:26]
    o = Options(min_seed=4, split_factor=1.5, max_mem_intv=0)
    found = seeds_of(runs_of(read, text, 4), codes(read), o)
    assert (0, len(read), 1) in found
    assert all(n >= 1 and e - b >= 4 for b, e, n in found)
