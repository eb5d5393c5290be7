from tidemark.operators import linking as L
from tidemark.operators import merging as M


def test_explicit_links_cascade(spark):
    docs = spark.createDataFrame([(1, "see `A.run()` and `a/b.py`, `solo` or `twice` or `none`"), (2, None)], "doc_id bigint, text string")
    nodes = spark.createDataFrame([("s1", "symbol", "run", "A.run", "a/b.py"), ("s2", "symbol", "solo", None, "a/b.py"), ("s3", "symbol", "twice", "X.twice", "c"), ("s4", "symbol", "twice", "Y.twice", "c"), ("f", "file", None, None, "a/b.py")], "id string, kind string, name string, qualified_name string, file string")
    assert {(r.ref, r.id) for r in L.explicit_links(docs, nodes).collect()} == {("A.run", "s1"), ("a/b.py", "f"), ("solo", "s2")}


def test_identifier_links(spark):
    sec = spark.createDataFrame([(1, "the run and stop calls of it"), (2, "run only")], "section_id bigint, text string")
    sym = spark.createDataFrame([("r", "run", "f1"), ("s", "stop", "f1"), ("c", "calls", "f2"), ("i", "it", "f2")], "id string, name string, file string")
    got = {(r.section_id, r.id): r.confidence for r in L.identifier_links(sec, sym).collect()}
    assert got == {(1, "r"): 0.8, (1, "s"): 0.8, (1, "c"): 0.6, (2, "r"): 0.6}


def test_innermost_span_across_blocks(spark):
    spans = spark.createDataFrame([("out", "f", 1, 500), ("mid", "f", 60, 200), ("in", "f", 100, 130), ("in2", "f", 100, 120), ("bad", "f", 9, 3), ("other", "g", 1, 9)], "span_id string, file string, start int, end int")
    points = spark.createDataFrame([("p1", "f", 110), ("p2", "f", 129), ("p3", "f", 400), ("p4", "f", 501), ("p5", "h", 1), ("p6", "f", None)], "point_id string, file string, line int")
    assert {(r.point_id, r.span_id) for r in L.enclosing(points, spans, block=16).collect()} == {("p1", "in2"), ("p2", "in"), ("p3", "out")}
    blame = spark.createDataFrame([("f", 101, "b"), ("f", 102, "a"), ("f", 103, "b"), ("f", 104, "a"), ("f", 300, "c")], "file string, line int, owner string")
    got = {r.span_id: (r.owner, r.n_lines) for r in L.majority_owner(blame, spans, block=16).collect()}
    assert got["in"] == ("a", 2) and got["out"] == ("a", 2)


def test_longest_prefix_and_ignores(spark):
    f = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",), ("ab/c.py",)], "file string")
    p = spark.createDataFrame([("a",), ("a/b",), ("b",)], "prefix string")
    assert {(r.file, r.prefix) for r in L.longest_prefix(f, p).collect()} == {("a/b/c.py", "a/b"), ("a/x.py", "a")}
    got = {r.file: r.ignored for r in L.ignore_match(f, [("^a/", False), (r"x\.py$", True)]).collect()}
    assert got == {"a/b/c.py": True, "a/x.py": False, "z.py": False, "ab/c.py": False}


def test_edge_conflicts(spark):
    rows = [("e1", "a", "b", "calls", "path", "INFERRED", 0.9), ("e2", "a", "b", " CALLS", "path", "EXTRACTED", 0.5), ("e4", "c", "d", "calls", "path", "EXTRACTED", 0.5), ("e3", "c", "d", "calls", "static", "EXTRACTED", 0.5), ("e6", "x", "y", "calls", "static", "EXTRACTED", None), ("e5", "x", "y", "calls", "static", "EXTRACTED", None), ("e7", None, "y", "calls", "static", "EXTRACTED", 1.0)]
    df = spark.createDataFrame([(*r, {"k": r[0]}) for r in rows], "id string, src string, dst string, rel string, method string, provenance string, confidence double, evidence map<string,string>")
    assert {(r.src, r.id, r.n_derived) for r in M.upsert_edges(df).collect()} == {("a", "e2", 2), ("c", "e3", 2), ("x", "e5", 2)}
    tie = [("t2", {"k": "2", "b": "2"}), ("t1", {"k": "1"}), ("t3", {"b": "3", "c": "3"}), ("t0", None)]
    df = spark.createDataFrame([(i, "a", "b", "calls", "static", "EXTRACTED", 0.5, m) for i, m in tie], df.schema)
    assert [(r.id, r.evidence) for r in M.upsert_edges(df).collect()] == [("t0", {"k": "1", "b": "2", "c": "3"})]


def test_edges_that_both_sides_changed_go_by_the_rule(spark):
    s = "id string, hash string, provenance string, confidence double, method string"
    mk = lambda *r: spark.createDataFrame(list(r), s).withColumn("m", M.merit())
    base = mk(("e1", "b", "INFERRED", 0.1, "path"), ("e2", "b", "INFERRED", 0.1, "path"), ("e3", "b", "INFERRED", 0.1, "path"))
    ours = mk(("e1", "o", "INFERRED", 0.9, "path"), ("e2", "o", "EXTRACTED", 0.5, "path"), ("e3", "o", "EXTRACTED", 0.5, "path"), ("e4", "o", "INFERRED", 0.2, "path"))
    theirs = mk(("e1", "t", "EXTRACTED", 0.2, "path"), ("e2", "t", "EXTRACTED", 0.5, "path"), ("e3", "t", "EXTRACTED", 0.5, "static"), ("e4", "t", "INFERRED", 0.3, "path"))
    got = {r.id: (r.hash, r.outcome) for r in M.merge3(base, ours, theirs, better="m").collect()}
    assert got == {"e1": ("t", "resolved"), "e2": ("o", "resolved"), "e3": ("t", "resolved"), "e4": ("t", "resolved")}


def test_three_way_merge(spark):
    mk = lambda d: spark.createDataFrame(list(d.items()), "id string, hash string")
    base = {"same": "1", "ours": "1", "theirs": "1", "both": "1", "clash": "1", "del": "1", "delmod": "1", "moddel": "1", "gone": "1"}
    ours = {"same": "1", "ours": "2", "theirs": "1", "both": "3", "clash": "2", "moddel": "2", "del": "1", "add": "a", "addclash": "x"}
    theirs = {"same": "1", "ours": "1", "theirs": "2", "both": "3", "clash": "4", "delmod": "2", "add": "a", "addclash": "y", "new": "n"}
    got = {r.id: (r.hash, r.outcome) for r in M.merge3(mk(base), mk(ours), mk(theirs)).collect()}
    assert got == {"same": ("1", "same"), "ours": ("2", "ours"), "theirs": ("2", "theirs"), "both": ("3", "both"), "clash": ("2", "conflict"), "delmod": ("2", "kept-theirs"), "moddel": ("2", "kept-ours"), "add": ("a", "added"), "addclash": ("x", "conflict"), "new": ("n", "added")}


def test_delta_parity_upsert(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), (None, "x")], "id string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "id string, hash string")
    assert {(r.id, r.change) for r in M.delta(a, b).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert {(r.id, r.hash) for r in M.upsert_nodes(a.filter("id is not null"), b).collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", "1")}
    x, y = spark.createDataFrame([("s",), ("s",), ("t",)], "sig string"), spark.createDataFrame([("s",), ("u",)], "sig string")
    assert {tuple(r) for r in M.parity(x, y, ["sig"]).collect()} == {("s", 1, 1, 0), ("t", 0, 1, 0), ("u", 0, 0, 1)}


def test_composite_and_entries(spark):
    n = lambda *i: spark.createDataFrame([(x,) for x in i], "id string")
    e = lambda *r: spark.createDataFrame(list(r), "id string, src string, dst string")
    nodes, edges = M.composite(n("a", "b"), n("b", "c"), e(("1", "a", "b")), e(("2", "b", "c"), ("3", "c", "zz"), ("1", "c", "a")))
    assert nodes.count() == 3 and sorted(r.id for r in edges.collect()) == ["1", "2"]
    a = spark.createDataFrame([("x", ["b", "a"], 3), ("x", ["c", "a"], 5)], "id string, supported_by array<string>, known_at int")
    assert [tuple(r) for r in M.entry_merge(a).collect()] == [("x", ["a", "b", "c"], 5)]


def test_relocation(spark):
    cols = "id string, kind string, qualified_name string, name string, signature string, file string, anchor string, hash string"
    lost = spark.createDataFrame([("old", "symbol", "A.run", "run", "run(x)", "a/b.py", None, "h")], cols)
    nodes = spark.createDataFrame([("n1", "symbol", "A.run", "run", "run(x)", "c/b.py", None, "h2"), ("n2", "symbol", "B.run", "run", "run(y)", "a/b.py", None, None), ("n3", "symbol", "Z", "z", None, "q/b.py", None, None), ("n4", "file", None, "run", None, "a/b.py", None, None)], cols)
    assert [(r.id, r.score, r.rank) for r in L.relocate(lost, nodes).orderBy("rank").collect()] == [("n1", 83, 1), ("n2", 70, 2)]
