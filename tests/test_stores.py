import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, ledger, stores

N = "id string, kind string, file string, hash string, cluster_id string, node_type string, heading string"
E = "id string, src string, dst string, rel string, method string, provenance string, confidence double, place string"


def nodes(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], N)


def edges(spark, *rows):
    return spark.createDataFrame([(f"e{i}", *r, "static", "EXTRACTED", 0.5, "x") for i, r in enumerate(rows)], E)


@pytest.fixture
def small(spark):
    n = nodes(spark, ("a", "symbol", "f1", "1", "c1", "class"), ("b", "symbol", "f1", "1", "c1", "method"), ("c", "symbol", "f2", "2", "c2"), ("c", "symbol", "f2", "2", "c9"), ("r", "route", "f3", None), ("c1", "cluster"), ("c3", "cluster"), (None, "symbol", "f1", "1"), ("d", "doc-section", "f4", "1", None, None, "Head"))
    e = edges(spark, ("b", "a", " Member-Of "), ("c", "b", "calls"), ("r", "a", "calls"), ("a", "c", "produces"), ("b", "c", "imports"), ("d", "a", "describes"), (None, "a", "calls"), ("c", "b", "calls"), ("a", "a", "member-of"))
    return n, e


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_scans(spark, small):
    n, e = small
    assert {r.id for r in stores.scan(n, kinds=["route"]).collect()} == {"r"}
    assert stores.scan(e, rels=["member-of"]).count() == 2
    assert stores.scan(n, ids=spark.createDataFrame([("c",), (None,), ("zz",)], "id string")).count() == 2
    low = spark.createDataFrame([("1", "EXTRACTED", 0.4), ("2", "EXTRACTED", 0.39), ("3", "INFERRED", 0.9), ("4", None, None)], "id string, provenance string, confidence double")
    assert {r.id for r in stores.confident(low).collect()} == {"1"} and {r.id for r in stores.confident(low, extracted_only=False).collect()} == {"1", "3"}


def test_values_and_ids(spark):
    j = spark.createDataFrame([('{"b": 1, "a": {"c": 2}}',), ("[1]",), (None,), ("{}",), ("no",)], "j string")
    assert [r[0] for r in j.select(stores.redact_values(F.col("j"))).collect()] == ['{"a": null, "b": null}', None, None, "{}", None]
    i = spark.createDataFrame([("sym:a/b.py#X.y@L12",), ("file:a.py",), ("odd",), (None,)], "id string").select(*stores.id_parts(F.col("id")).values())
    assert [tuple(r) for r in i.collect()] == [("sym", "a/b.py", "X.y", 12), ("file", "a.py", None, None), (None, None, None, None), (None, None, None, None)]
    k = spark.createDataFrame([("symbol", "inner_class"), ("symbol", "ClassMethod"), ("symbol", None), ("file", "class"), (None, None)], "k string, t string")
    assert [r[0] for r in k.select(graph.derived_kind(F.col("k"), F.col("t"))).collect()] == ["class", "class", "symbol", "file", None]


def test_changes_of_files(spark, small):
    n, e = small
    changed = spark.createDataFrame([("f2",), ("f2",), (None,)], "file string")
    left, kept = stores.without_files(n, e, changed)
    assert left.count() == 7 and rows(kept.select("src", "dst")) == {("b", "a"), ("r", "a"), ("d", "a"), (None, "a"), ("a", "a")}
    assert rows(stores.update_scope(n, e, changed)) == {("f2", "changed"), ("f1", "dependent")}
    assert rows(stores.update_scope(n, e, changed.limit(0))) == set()
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", [1.0]), ("zz", [1.0])], "id string, vec array<double>")
    after, good = stores.apply_delta(n.filter("kind = 'symbol'"), spark.createDataFrame([("b",)], "id string"), spark.createDataFrame([("c", "3"), ("new", "1")], "id string, hash string"), vectors)
    assert rows(after.select("id", "hash")) == {("a", "1"), ("c", "3"), ("new", "1")} and {r.id for r in good.collect()} == {"a"}


def test_integrity(spark, small):
    n, _ = small
    assert rows(stores.cluster_issues(n)) == {("unknown-cluster", "c"), ("several-clusters", "c"), ("empty-cluster", "c3")}
    assert {r.id for r in stores.orphans(spark.createDataFrame([("a",), ("q",), (None,)], "id string"), n).collect()} == {"q", None}
    s = "k string, v string, w int"
    a, b = spark.createDataFrame([("x", "1", None), ("y", "1", 1), ("z", "1", 1), ("x", "1", None), (None, "1", 1)], s), spark.createDataFrame([("x", "1", None), ("y", "1", 2), ("n", None, None)], s)
    assert rows(stores.merge_records(a, b, key="k", content=["v", "w"])) == {("x", "same"), ("y", "conflict"), ("z", "ours"), ("n", "theirs")}


def test_pages(spark):
    df = spark.createDataFrame([("k", i) for i in range(200)] + [("one", 5)], "k string, i int")
    got = stores.page(df, key=["k"], order=[F.col("i")], cursor="i", limit=3).collect()
    assert {(r.k, r.i, r.place, r.truncated, r.next_cursor) for r in got} == {("k", 0, 1, False, None), ("k", 1, 2, False, None), ("k", 2, 3, True, 2), ("one", 5, 1, False, None)}
    assert {r.i for r in stores.page(df, key=["k"], order=[F.col("i")], cursor="i", limit=2, offset=198).collect()} == {198, 199}
    r = stores.nearest_rank(df, ["k"], "i").filter("k = 'k'").first()
    assert (r.n, r.total, r.least, r.p50, r.p95, r.most) == (200, 19900, 0, 99, 189, 199)


def test_artifacts_and_links(spark, small):
    n, e = small
    s = "artifact_id string, target string, schema string, made_at bigint, target_hash string"
    art = spark.createDataFrame([("1", "a", "v1", 9, "1"), ("2", "a", "v2", 1, "1"), ("3", "a", "v2", 2, "0"), ("4", "gone", "v2", None, None), ("5", None, "v2", 1, "1"), ("6", "r", "v2", 1, None)], s)
    assert rows(stores.latest_artifact(art, n, "v2")) == {("a", "3", True), ("gone", "4", True), ("r", "6", False)}
    assert rows(stores.doc_links(n, e)) == {("a", "d", "Head", "describes")}
    assert rows(stores.class_facts(n, e)) == {("a", 1, 1, 1, 1, 2)}
    d = {r.scope: r for r in stores.scope_dossier(n, F.col("file"), limit=1).collect()}
    assert (d["f1"].n_nodes, d["f1"].first_ids, d["f1"].truncated) == (2, "a", True) and not d["f3"].truncated and set(d) == {"f1", "f2", "f3", "f4"}


def test_guards(spark):
    s = "id string, cfg_path array<string>, branch string, in_loop boolean, in_exception boolean"
    df = spark.createDataFrame([("1", ["x", "y"], "THEN", True, None), ("1", ["x", "y"], "THEN", None, None), ("2", None, None, None, None), ("3", [], None, None, None), ("4", ["z"], None, None, True)], s)
    assert rows(stores.guard_chains(df)) == {("1", 2, "x", "y", "THEN", True, False), ("4", 1, "z", "z", "", False, True)}


def test_assertion_graph(spark):
    s = "id string, subject string, object string, predicate string, valid_at bigint, known_at bigint, supported_by array<string>"
    a = spark.createDataFrame([("1", "s", "o1", "part-of", 1, 1, ["x"]), ("2", "s", "o2", "part-of", 5, 5, None), ("3", "s", "o3", "part-of", 9, 99, []), ("4", "s", "o1", "affects", 1, 1, None), ("5", "o1", "s", "supersedes", 2, 2, None), ("6", "q", "s", "supersedes", None, 2, None), ("7", None, "s", "about", 1, 1, None)], s)
    assert {r.id for r in ledger.current(a, 10).collect()} == {"2", "4", "5", "7"}
    assert rows(ledger.relations_among(a, spark.createDataFrame([("s",), ("o1",), (None,)], "ref string"), 10).select("id")) == {("4",), ("5",)}
    assert rows(ledger.adjacency(a, 10)) == {("s", 2, 1, 2), ("o1", 1, 1, 1), ("o2", 0, 1, 1)}
    assert rows(ledger.superseded_by(a)) == {("s", 2, "5", "o1")}
    assert rows(ledger.timeline(a)) == {("1", "s", 1, "4"), ("4", "s", 2, "2"), ("2", "s", 3, "3"), ("3", "s", 4, None), ("5", "o1", 1, None)}
    assert rows(ledger.provenance_counts(a, spark.createDataFrame([("x", "repo"), (None, "r")], "id string, repo_id string"), 10)) == {("repo", 1, 0, 1), (None, 6, 4, 0)}


def test_aliases_in_force(spark):
    s = "id string, kind string, entity_a string, entity_b string, at bigint"
    d = spark.createDataFrame([("1", "establish", "a", "b", 1), ("2", "reverse", "b", "a", 2), ("3", "establish", "c", "b", 1), ("4", "reverse", "d", "c", 1), ("5", "establish", "c", "d", 1), ("6", "establish", "x", "x", 1), ("7", "establish", None, "x", 1)], s)
    assert rows(ledger.alias_links(d)) == {("b", "c"), ("c", "d")}
    assert rows(ledger.alias_canonical(ledger.alias_links(d))) == {("b", "b"), ("c", "b"), ("d", "b")}


def test_communities_by_group(spark):
    two = [(a, b) for part in ("abcd", "wxyz") for a in part for b in part if a < b] + [("a", "w")]
    w = spark.createDataFrame([("g", a, b, 1) for a, b in two] + [("h", "p", "q", 2)], "root string, a string, b string, w bigint")
    for max_edges in (100, 5):
        got = {(r.root, r.node_id): r.community for r in graph.communities_by_group(w, "root", max_edges=max_edges).collect()}
        assert {got["g", c] for c in "bcd"} == {got["g", "b"]} and {got["g", c] for c in "xyz"} == {got["g", "x"]} and got["h", "p"] == got["h", "q"] == "p"
    assert graph.communities_by_group(w.limit(0), "root").collect() == []


def test_empty_tables(spark, small):
    n, e = (t.limit(0) for t in small)
    for df in (stores.cluster_issues(n), stores.doc_links(n, e), stores.class_facts(n, e), stores.scope_dossier(n, F.col("file")), stores.without_files(n, e, n.select("file"))[1]):
        assert df.collect() == []
