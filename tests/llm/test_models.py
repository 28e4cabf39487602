"""Language ID, line quality, URL rules, fixity, queries and pipeline."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, merkle, quality, queries, urlrules
from strandline.llm.common import remainder

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def test_languages_are_told_apart_on_held_out_documents(spark):
    got = queries.op2_language(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and held["score"].between(0, 1).all()


def test_language_edge_cases(spark):
    train = spark.createDataFrame([("the and of to in", "en"), ("der die das und", "de"), (None, "en"), ("x", None)] * 30, "text string, lang string")
    model = langid.fit(train)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and"), (4, "the and"), (5, "der die " * 9000)], "doc_id long, text string").selectExpr("*", "1 as lang_pred", "0 as _text")
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.predict(df, model, ["doc_id"]).collect())
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")] and got[3] == got[4] and got[0][2] == 0
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.limit(0), model, ["doc_id"]).count() == 0


def test_ftrl_sparsifies_and_separates():
    rng = np.random.default_rng(0)
    x = [(np.array([i % 3, 3 + rng.integers(0, 50)]), np.array([0.8, 0.6])) for i in range(300)]
    w, b = langid.ftrl(x, np.arange(300) % 3, 64, 3, l1=0.5)
    assert (w[3:] == 0).mean() > 0.5
    assert all((v @ w[at] + b).argmax() == i % 3 for i, (at, v) in enumerate(x))


def chain_brute(emit, trans):
    from itertools import product

    n = len(emit)
    total, marg = 0.0, np.zeros((n, 2))
    for path in product((0, 1), repeat=n):
        p = np.exp(sum(emit[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, s in enumerate(path):
            marg[i, s] += p
    return marg / total, np.log(total)


def test_marginals_equal_a_sum_over_all_paths():
    rng = np.random.default_rng(2)
    lines = np.array([1, 5, 3, 5])
    emit, trans = rng.standard_normal((lines.sum(), 2)), rng.standard_normal((2, 2))
    m, pairs, log_z = quality.forward_backward(emit, lines, trans)
    at = 0
    for i, n in enumerate(lines):
        want, z = chain_brute(emit[at : at + n], trans)
        assert np.allclose(m[at : at + n], want) and np.isclose(log_z[i], z)
        at += n
    assert np.isclose(pairs.sum(), (lines - 1).sum())


def test_quality_on_held_out_documents(spark):
    got = queries.op3_quality(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, "Good line of words.\nAnother one." if i % 2 else "BAD!! BAD!!\nBAD!! BAD!!") for i in range(80)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n\n"), (4, "x " * 30000), (5, "a\n" * 3000), (5, "a\n" * 3000)], "doc_id long, text string").selectExpr("*", "1 as score")
    got = quality.score(odd, model, ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(docs, labels.where("quality = 1")).constant == 1.0
    x, length, lines = quality.line_features(pa.array(["", "a", "a\n", "a\nb\n\n", "\n"]))
    assert lines.tolist() == [1, 1, 1, 3, 1] and length.sum() == 9


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or pd.isna(v) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(queries.ORACLE[name]).df())


def slow_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fit = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, key=lambda r: (-len(r[0]) - len(r[1]), r)) if fit else None
    return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"


def test_rules_nest_and_hot_hosts_are_salted(spark):
    rules = [("com", "/", "block"), ("example.com", "/a", "allow"), ("a.example.com", "/a", "block"), ("b.example.com", "/", "block"), ("org", "/x/", "block"), ("example.com", "/ab", "block")]
    urls = [None, "", "no scheme", "://", "http://", "HTTP://Example.COM/abc?x#y", "http://example.com", "http://a.example.com/a/b", "http://b.example.com/", "http://c.example.com/abz", "http://xexample.com/a", "ftp://org/x/y", "http://ORG#/x/", "http://a.b.org/x/", "s://com:80/", "http://é.com/É", "http://zz.net/q\nr/s"]
    pages = [(i, u) for i, u in enumerate(urls * 3)] + [(1000 + i, f"http://hot.example.com/a{i % 5}") for i in range(300)] + [(None, "http://com/")]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "'x' as html")
    got = urlrules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), sample=50)
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()))) == sorted(str((i, *slow_judge(u, rules))) for i, u in pages)
    empty = urlrules.judge(df.limit(0), urlrules.rules_table(spark))
    assert empty.count() == 0
    assert not [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Python" in x or "Arrow" in x]


CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_the_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    rules = [(rule[: rule.index("/")], rule[rule.index("/") :], verdict) for verdict, rule in (r.split() for r in CONTRACT.split(", "))]
    assert sorted(tuple(r) for r in urlrules.rules_table(spark).collect()) == sorted(rules)
    urls = [f"http://{host}{path}" for host in ("com", "a.example.com", "net", "b.net", "example.net", "c.example.net", "xexample.net", "d.org") for path in ("/en/1", "/en/7", "/de/", "/de/1", "/de/8", "/es/2", "/de")]
    pages = list(enumerate([None, "no scheme", *urls]))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op8_url_rules"](spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *slow_judge(u, rules))) for i, u in pages)
    assert {r.rule for r in got} == {None, *(h + p for h, p, _ in rules)}


def test_fixity_names_what_differs(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(2500)] + [(None, None, None), (7, "http://x/7b", "twice"), (7, "http://x/7b", "twice")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as length", "2 as status")
    rec = merkle.record(F.col("page_id"), F.col("url"), F.col("html"))
    other = F.when(F.col("page_id").isin(3, 1999), F.concat(F.substring(rec, 1, 20), F.lit("#"), F.expr("substring(html, 1, 1)"))).when(F.coalesce(F.col("page_id"), F.lit(0)) != 2400, rec)
    got = merkle.audit(merkle.written(merkle.catalogue(df, {"a": rec, "b": other}), "t"), "a", "b").toPandas()
    assert len(got) == 2503
    bad = got[got.status != "intact"]
    assert sorted(zip(bad.page_id, bad.status)) == [(3, "corrupt"), (1999, "corrupt"), (2400, "missing")]
    same = merkle.audit(merkle.written(merkle.catalogue(df, {"a": rec, "b": rec}), "t"), "a", "b")
    assert same.where("status != 'intact'").count() == 0
    assert merkle.audit_pages(df.limit(0).select("page_id", "url", "html")).count() == 0


def test_remainders_are_those_of_crc32(spark):
    import zlib

    got = spark.range(50).select("id", remainder("id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34", None, None, 5), (10_003, docs.first()["text"], "en", "s", 1)], docs.schema)
    docs = docs.union(odd).withColumn("score", F.lit(1))
    kept = c.language(spark, docs, DATA)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 10_001 not in ids and 10_002 not in ids and len(ids) >= 195
    good = c.good(spark, kept, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    left = good.join(labels, "doc_id").toPandas()
    assert (left["quality"] == 1).mean() > 0.95 and good.columns == docs.columns
    one = c.distinct(spark, good, DATA)
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r.class_id for r in c.jaccard.similarity_join(good).select("class_id").collect()}
    bins = c.packed(spark, one, DATA)
    assert {r.doc_id for r in bins.select("doc_id").collect()} == {r.doc_id for r in one.select("doc_id").collect()}
    assert c.run(spark, DATA).count() > 0
