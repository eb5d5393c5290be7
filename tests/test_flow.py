from tidemark.operators import flow as W


def test_control_dependence_of_a_branch_and_a_loop():
    # 1 branches to 2 or 3, both go to 4; 4 loops back to 1 or leaves to 5
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5)]
    dom = W.post_dominators([1, 2, 3, 4, 5], edges)
    assert dom[1] == {1, 4, 5, W.EXIT} and dom[2] == {2, 4, 5, W.EXIT}
    got = W.control_dependence([1, 2, 3, 4, 5], edges)
    assert {(1, 2), (1, 3), (4, 1)} <= got and (1, 5) not in got and (1, 4) not in got


def test_reaching_definitions_stop_at_a_new_one():
    defs, uses = {1: {"x"}, 2: {"x"}, 3: {"y"}}, {3: {"x"}, 4: {"x", "y"}}
    assert W.reaching_definitions(defs, uses, [(1, 2), (2, 3), (3, 4)]) == {(2, 3, "x"), (2, 4, "x"), (3, 4, "y")}
    assert W.reaching_definitions(defs, uses, [(1, 3), (2, 3), (3, 4)]) >= {(1, 3, "x"), (2, 3, "x"), (1, 4, "x")}
    assert W.reaching_definitions({1: {"x"}}, {1: {"x"}}, [(1, 1)]) == {(1, 1, "x")}


def test_taint_by_context():
    texts = {1: "const a = req.query.id", 2: "const b = encodeURIComponent(a)", 3: "fetch(b)", 4: "db.query(b)", 5: "const c = schema.safeParse(a)", 6: "db.execute(c)", 7: "eval(a)", 8: "spawn(q)", 9: "exec(process.env.CMD)"}
    data = {(1, 2, "a"), (2, 3, "b"), (2, 4, "b"), (1, 5, "a"), (5, 6, "c"), (1, 7, "a")}
    assert W.taint_paths(texts, data) == [
        (1, 4, "source.http-input", "sink.sql-concat", "sql", [1, 2, 4]),
        (1, 7, "source.http-input", "sink.code-eval", "code", [1, 7]),
        (9, 9, "source.env", "sink.shell-exec", "shell", [9]),
    ]
    own = (W.Rule("s", "source", ("secret",), ("url",)), W.Rule("k", "sink", ("send(",), ("url",)))
    assert W.taint_paths({1: "x = SECRET", 2: "y = x", 3: "y = x", 4: "send(y)"}, {(1, 2, "x"), (1, 3, "x"), (2, 4, "y"), (3, 4, "y"), (4, 1, "z")}, own) == [(1, 4, "s", "k", "url", [1, 2, 4])]


def test_by_function(spark):
    s = spark.createDataFrame([("f", 1, "x = req.body", ["x"], []), ("f", 2, "eval(x)", [], ["x"]), ("g", 1, "y = 1", ["y"], None), ("g", 2, None, None, ["y"])], "fn string, id bigint, text string, defs array<string>, uses array<string>")
    f = spark.createDataFrame([("f", 1, 2), ("g", 1, 2)], "fn string, src bigint, dst bigint")
    data = W.data_edges(s, f)
    assert {tuple(r) for r in data.collect()} == {("f", 1, 2, "x"), ("g", 1, 2, "y")}
    assert [tuple(r) for r in W.taint(s, data).collect()] == [("f", 1, 2, "source.http-input", "sink.code-eval", "code", [1, 2])]
    assert W.data_edges(s.limit(0), f.limit(0)).collect() == [] and W.control_edges(f.limit(0)).collect() == []
