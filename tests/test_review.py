from pyspark.sql import functions as F

from tidemark.operators import review as R

N = "id string, kind string, file string, name string, heading string, lang string, cluster_id string"


def nodes(spark):
    rows = [("s1", "symbol", "a/x.py", "run", None, "python", "c1"), ("s2", "symbol", "a/y.py", "stop", None, "python", "c1"), ("s2", "symbol", "a/y.py", "stop", None, "python", "c1"), ("f", "file", "a/x.py", None, None, None, None), ("g", "file", "b/z.go", None, None, "go", "c2"), (None, "symbol", "a/x.py", "run", None, None, None)]
    return spark.createDataFrame(rows, N)


def edges(spark):
    rows = [("e1", "s1", "s2", "calls"), ("e2", "s2", "s1", "calls"), ("e3", "g", "s1", " Calls"), ("e4", "g", "f", "imports"), ("e5", None, "f", "imports")]
    return spark.createDataFrame(rows, "id string, src string, dst string, rel string")


def test_changes_and_review(spark):
    changed = spark.createDataFrame([("a/x.py",), ("a/x.py",)], "file string")
    got = {tuple(r) for r in R.detect_changes(nodes(spark), edges(spark), changed).collect()}
    assert got == {("node", "s1", "changed"), ("node", "f", "changed"), ("edge", "e1", "outgoing"), ("edge", "e2", "incoming"), ("edge", "e3", "incoming"), ("edge", "e4", "incoming"), ("edge", "e5", "incoming")}
    assert [tuple(r) for r in R.review(nodes(spark), edges(spark), changed).collect()] == [("s1", 2, 1)]


def test_rename_and_dossier(spark):
    src = spark.createDataFrame([("a/x.py", "run() + rerun(run)"), ("a/x.py", "run() + rerun(run)"), ("b", None)], "file string, body string")
    (r,) = R.rename_plan(nodes(spark), edges(spark), src, spark.createDataFrame([("run",), (None,)], "name string")).collect()
    assert (r.n_symbols, r.n_references, r.n_files, r.n_occurrences) == (1, 2, 1, 2)
    assert {(r.id, r.n_calls, r.n_callers) for r in R.dossier(nodes(spark), edges(spark)).collect()} == {("s1", 1, 2), ("s2", 1, 1)}


def test_buckets_labels_inheritance(spark):
    assert {tuple(r) for r in R.directory_buckets(nodes(spark)).collect()} == {("a", 1), ("b", 1)}
    assert {tuple(r) for r in R.directory_buckets(nodes(spark).filter("file like 'a/%'")).collect()} == {("a/x.py", 1)}
    assert {tuple(r) for r in R.cluster_label(nodes(spark)).collect()} == {("c1", "a", "python"), ("c2", "b", "go")}
    own = spark.createDataFrame([("s1", 7), ("s1", 9)], "id string, doc_id bigint")
    assert {tuple(r) for r in R.inherited(own, nodes(spark)).collect()} == {("s1", 7, "own"), ("f", 7, "file"), ("s2", 7, "cluster")}


def test_redaction(spark):
    df = spark.createDataFrame([("password = hunter2, user=x",), ("api_key: ${KEY}",), ("the secret is out",), (None,)], "t string")
    assert [r[0] for r in df.select(R.redact(F.col("t"))).collect()] == ["password = [redacted], user=x", "api_key: ${KEY}", "the secret is out", None]
    assert df.select(R.source_policy(F.lit("binary"), F.col("t")).alias("x")).filter("x is not null").count() == 0


def test_queue_match_rerank(spark):
    q = spark.createDataFrame([("g", 1, 99), ("g", 2, 1), ("h", 3, 2), ("h", 4, 3)], "g string, i int, c int")
    assert sorted(r.i for r in R.work_queue(q, group="g", order=[F.col("i")], cost=F.col("c"), budget=4).collect()) == [1, 3]
    assert [tuple(r) for r in R.text_match(nodes(spark).dropna(subset=["id"]).dropDuplicates(["id"]), ["Run", "run", "py"], {"name": 4, "file": 1}).collect()] == [("s1", 5, 1), ("f", 1, 2), ("s2", 1, 3)]
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "query_id string, doc_id int, rank int")
    again = spark.createDataFrame([("q", 2, 9.0), ("q", 1, 1.0), ("q", 3, 99.0)], "query_id string, doc_id int, again double")
    assert [r.doc_id for r in R.minmax_rerank(hits, again, window=2).orderBy("place").collect()] == [2, 1, 3]
