import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import retrieval as R


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "v string").select(col(F.col("v")).alias("o")).first().o


def test_terms_and_slugs(spark):
    assert one(spark, T.terms, "parseHTTPRequest of the lease_token to") == ["parse", "http", "request", "lease", "token"]
    assert one(spark, T.terms, "") == [] and one(spark, T.terms, None) is None
    assert one(spark, T.slug, "  Hello, World! ") == "hello-world"
    assert [one(spark, T.stem, w) for w in ("policies", "classes", "leases", "shipment", "class")] == ["policy", "class", "leas", "ship", "class"]


def test_grounding(spark):
    df = spark.createDataFrame([("a  b", "x a b c"), ("a b", "ab"), ("", "x"), (None, "x"), ("a", None)], "q string, s string")
    assert [r.v for r in df.select(T.grounded(F.col("q"), F.col("s")).alias("v")).collect()] == ["grounded", "ungrounded", "unsupported", "unsupported", "ungrounded"]


def test_globs():
    import re

    for glob, path, hit in (("**/*.py", "a/b/c.py", 1), ("**/*.py", "c.py", 1), ("a/*.py", "a/b/c.py", 0), ("a?c", "abc", 1), ("a/**", "a/b/c", 1), ("x.y", "xzy", 0)):
        assert bool(re.match(T.glob_regex(glob), path)) == bool(hit)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "lease lease token"), (2, "token journal"), (3, None), (4, "other words here")], "doc_id bigint, text string")
    q = spark.createDataFrame([("q", "lease"), ("q", "token"), ("q", "absent")], "query_id string, term string")
    got = {r.doc_id: r.score for r in R.bm25(docs, q).collect()}
    avg = (3 + 2 + 0 + 3) / 4
    part = lambda tf, df, n: math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    assert got == {1: round(part(2, 1, 3) + part(1, 2, 3), 6), 2: round(part(1, 2, 2), 6)}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id bigint, score double, rank int")


def test_fusions(spark):
    a, b = ranked(spark, [("q", 1, 2.0, 1), ("q", 2, 1.0, 2)]), ranked(spark, [("q", 2, 0.9, 1), ("q", 3, -0.5, 2)])
    got = {r.doc_id: (r.score, r.rank) for r in R.rrf(a, b).collect()}
    assert got == {2: (round(1 / 62 + 1 / 61, 6), 1), 1: (round(1 / 61, 6), 2), 3: (round(1 / 62, 6), 3)}
    assert {r.doc_id: r.score for r in R.weighted_fusion(a, b).collect()} == {1: 0.5, 2: 0.7}
    assert [r.doc_id for r in R.interleave(a, b).orderBy("place").collect()] == [3, 1, 2]


def test_budget_and_metrics(spark):
    items = spark.createDataFrame([("g", 1, "x" * 8), ("g", 2, None), ("g", 3, "x" * 5), ("g", 4, "x" * 99), ("h", 5, "x" * 99)], "g string, i int, t string")
    assert [(r.i, r.used) for r in R.budget_prefix(items, group="g", order=[F.col("i")], text="t", budget=5).orderBy("i").collect()] == [(1, 2), (2, 2), (3, 4)]
    m = R.ranking_metrics(ranked(spark, [("q", 1, 1.0, 1), ("q", 2, 1.0, 2), ("q", 3, 1.0, 3)]), spark.createDataFrame([("q", 2), ("q", 9), ("z", 1)], "query_id string, doc_id bigint"), k=3).collect()
    by = {r.query_id: r for r in m}
    assert (by["q"].recall, by["q"].mrr, by["q"].precision) == (0.5, 0.5, 0.333333) and by["z"].recall == 0
    assert by["q"].ndcg == round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)


def test_cosine_in_blocks_equals_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist()) for i in range(120)] + [(500, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(x.query_id, x.near) for x in R.cosine_topk(v, v.filter("vec_id % 10 = 0 and embedding is not null"), k=3, block=5).collect()}
    m = np.array([x for _, x in rows[:-1]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    assert got == {(i, int(j)) for i in range(0, 120, 10) for j in np.argsort(-s[i])[:3]}


def test_tfidf_links_are_between_distinct_texts(spark):
    left = spark.createDataFrame([("lease token rules",), ("lease token rules",), (None,)], "text string")
    right = spark.createDataFrame([("parseLease",), ("parseLease",), ("leaseToken",), ("other",)], "text string")
    got = R.tfidf_links(left, right).collect()
    assert [(r.right_text, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [("leaseToken", 1), ("parseLease", 2)]


def test_char_vectors(spark):
    v = R.char_ngram_vector("parseLease")
    assert abs(float(np.linalg.norm(v)) - 1) < 1e-6 and float(v @ R.char_ngram_vector("parseLeases")) > float(v @ R.char_ngram_vector("zzz"))
    assert R.fnv1a(b"a") == 0xE40C292C and not R.char_ngram_vector("").any()
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "name string")
    assert R.embed_names(df).count() == 1


def test_rerank_by_what_the_query_asks(spark):
    s = "query_id string, query string, id string, kind string, name string, degree int, score double"
    rows = [("a", "where is the hash verified", "s", "symbol", "verifyHash", 7, 1.0), ("a", "where is the hash verified", "f", "file", "other", 0, 1.0), ("b", "hash", "s", "symbol", "plain", 0, 1.0), ("b", "hash", "d", "doc-section", None, None, 1.0), ("c", "Which hash", "r", "route", "x", -3, 1.0)]
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in R.structural_rerank(spark.createDataFrame(rows, s)).collect()}
    assert got == {("a", "s"): (round(1.09 * 1.2 * 1.1, 5), 1), ("a", "f"): (0.9, 2), ("b", "d"): (1.0, 1), ("b", "s"): (1.0, 2), ("c", "r"): (1.08, 1)}


def test_terms_match_beginnings(spark):
    docs = spark.createDataFrame([(1, "exported leases"), (2, "export"), (3, "an exporter exports"), (4, "porter"), (5, None)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in R.bm25(docs, spark.createDataFrame([("q", "export")], "query_id string, term string")).collect()}
    assert set(got) == {1, 2, 3} and got[3] > got[1]  # two different tokens score each


def test_seeds_and_their_fusion(spark):
    nodes = spark.createDataFrame([("n1", "settledOrders"), ("n2", "settlement"), ("n3", "order"), ("n4", None), ("n1", "settledOrders"), ("n5", "unrelated")], "id string, text string")
    q = spark.createDataFrame([("q", "settle the order"), ("none", "the of")], "query_id string, q string")
    seeds = R.graph_seeds(nodes, q)
    assert [(r.id, r.score) for r in seeds.orderBy("rank").collect()] == [("n1", 1.0), ("n2", 0.5), ("n3", 0.5)]
    other = spark.createDataFrame([("q", "n2", 1), ("q", "n9", 2)], "query_id string, id string, rank int")
    fused = R.fuse_seeds(seeds, other).orderBy("rank").collect()
    assert fused[0].id == "n2" and fused[0].score == 1.0 and {r.id for r in fused} == {"n1", "n2", "n3", "n9"}


def test_exact_hits_come_first_then_the_page(spark):
    s = "query_id string, id string, rank int"
    exact, ranked = spark.createDataFrame([("q", "e", 1)], s), spark.createDataFrame([("q", "a", 1), ("q", "e", 2), ("q", "b", 3)], s)
    assert [r.id for r in R.exact_first(exact, ranked).orderBy("place").collect()] == ["e", "a", "b"]
    assert [r.id for r in R.exact_first(exact, ranked, offset=1, limit=1).collect()] == ["a"]


def test_query_words(spark):
    from tidemark.functions import text as T

    words = "settles settled settling settlement settle retries retry boxes bus class ies ties".split()
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert {got[w] for w in words[:5]} == {"settl"} and got["retries"] == got["retry"] == "retry" and got["boxes"] == "box" and got["bus"] == "bus" and got["class"] == "class" and got["ties"] == "tie"[:3]
    r = spark.createDataFrame([("the of", "fix DTI now"), ("lease", "DTIs")], "q string, t string").select(T.query_terms(F.col("q"), {"lease": ["rental"]}).alias("q"), T.alias_rewrite(F.col("t"), {"DTI": "debt to income"}).alias("t")).collect()
    assert [x.q for x in r] == [["the", "of"], ["lease", "rental"]] and [x.t for x in r] == ["fix DTI now debt to income", "DTIs"]
