"""Similarity join, components, packing, neighbours."""

import random

import numpy as np
import pytest

from strandline.llm import components, jaccard, neighbours, packing


def brute(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    near = [[i != j and bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for i, x in enumerate(label):
        ids = [rows[k][0] for k in range(n) if label[k] == x and rows[k][0] is not None]
        least[x] = min(ids) if ids else None
    return sorted(((rows[i][0], least[label[i]], sum(near[i])) for i in range(n)), key=str)


@pytest.mark.parametrize("block", [1000, 7])
def test_join_equals_brute_force(spark, block):
    rng = random.Random(block)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(4)]
    rows = [(i, " ".join(f"x{rng.randrange(5000)}" for _ in range(30))) for i in range(10)]
    for i in range(40):  # a large group of near copies, and chains of them
        w = list(base[i % 4])
        for _ in range(i % 3):
            w[rng.randrange(60)] = f"y{rng.randrange(99)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(900, ""), (901, None), (902, " \n"), (903, "short"), (904, "Short"), (905, rows[12][1]), (None, rows[13][1]), (12, rows[2][1]), (906, "z" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as node", "0 as class_id")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.similarity_join(df, block=block).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("block", [1000, 2])
def test_join_of_near_copies_without_an_id(spark, block):
    rng = random.Random(5)
    w = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(3)]
    near = lambda k, i: " ".join([*w[k][:i], "new", *w[k][i + 1 :]])
    rows = [(1, " ".join(w[0])), (None, near(0, 59)), (None, near(0, 0)), (2, " ".join(w[1])), (None, near(1, 59)), (None, near(1, 59)), (None, " ".join(w[2])), (None, near(2, 0)), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.similarity_join(df, block=block).collect()), key=str)
    assert got == brute(rows) and sum(n for _, _, n in got) > 10


def test_join_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similarity_join(df).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(201, 200), (200, 201)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(20)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fit(lengths, sources, clusters, capacity, per_source):
    bins, of = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [b for b, x in enumerate(bins) if capacity - sum(lengths[k] for k in x) >= lengths[i] and not any(clusters[i] is not None and clusters[k] == clusters[i] for k in x) and (sources[i] is None or sum(sources[k] == sources[i] for k in x) < per_source)]
        if fits:
            b = min(fits, key=lambda b: (capacity - sum(lengths[k] for k in bins[b]), b))
        else:
            bins.append([])
            b = len(bins) - 1
        bins[b].append(i)
        of[i] = b
    return of


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    for per_source in (1, 2, 3):
        for _ in range(20):
            n = rng.randrange(0, 60)
            lengths, sources, clusters = [rng.randrange(1, 101) for _ in range(n)], [rng.choice([None, "a", "a", "b", "c"]) for _ in range(n)], [rng.choice([None, 1, 2, 3, 4 + rng.randrange(50)]) for _ in range(n)]
            of, fill = packing.best_fit(lengths, sources, clusters, 100, per_source)
            assert of == slow_fit(lengths, sources, clusters, 100, per_source)
            assert all(f <= 100 for f in fill)


def test_packing_keeps_all_tokens(spark):
    rows = [(i, f"s{i % 3}", "word " * (i * 7 % 90)) for i in range(60)] + [(70, None, None), (71, "s0", ""), (72, "s0", "word " * 500), (72, "s0", "word " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as bin_id", "2 as length")
    got = packing.pack_documents(df, capacity=100, shard=20).collect()
    fill, sources = {}, {}
    for r in got:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.length
    assert all(fill[r.bin_id] == r.bin_fill <= 100 for r in got)
    want = {}
    for i, _, t in rows:
        want[i] = want.get(i, 0) + len((t or "").split()) + 1
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want
    assert packing.pack_documents(df.limit(0)).count() == 0


def nearest(ids, x, k):
    out = []
    for i, a in enumerate(ids):
        if a % 20 == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out += [(int(a), r + 1, int(ids[j])) for r, j in enumerate(order)]
    return sorted(out)


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6)).astype(np.float32)
    x[5] = x[7] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(100, None), (120, [0.0] * 6), (140, [float("nan")] + [1.0] * 5), (160, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (180, [1.0, 2.0]), (200, [float("inf")] * 6), (220, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, lambda c: c % 20 == 0).collect())
    assert got == nearest(np.arange(40), x.astype(float), 20)
    assert neighbours.nearest(df.where("vec_id > 100"), lambda c: c % 20 == 0).count() == 0


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 32)) * 1.5
    x = (centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 32))).astype(np.float32)
    x[300:700] = x[300]  # a large group of copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, lambda c: c % 20 == 0, rounds=2).collect()}
    want = {(q, v) for q, _, v in nearest(np.arange(1500), x.astype(float), 20)}
    assert len(got & want) / len(want) >= 0.9


def test_the_stage_keeps_one_row_of_each_class_whatever_the_ids(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(6)]
    t = [" ".join(w) for w in words]
    near = lambda k, i: " ".join([*words[k][:i], "new", *words[k][i + 1 :]])
    rows = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (3, near(2, 59)), (None, t[4]), (None, t[4]), (None, near(4, 59)), (8, t[5]), (8, t[5]), (9, near(5, 0)), (10, ""), (10, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "cast(null as string) as lang", "1 as node")
    out = corpus_pipeline.distinct(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    either = [(None, t[4]), (None, near(4, 59))]
    assert sum(x in either for x in got) == 1
    assert sorted((x for x in got if x not in either), key=str) == sorted([(None, t[0]), (None, t[1]), (3, near(2, 59)), (7, t[3]), (8, t[5]), (10, ""), (10, None)], key=str)
