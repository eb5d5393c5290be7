import random

import pytest

from tidemark.operators.hierarchy import descendants, hierarchy

S = "child string, parent string, depth string, _k int"


def brute(links):
    par = {}
    for c, p, *_ in links:
        if c is not None and p is not None:
            par[c] = min(par.get(c, p), p)
    out = {}
    for n in {*par, *par.values()}:
        path, x = [n], n
        while x in par and par[x] not in path:
            x = par[x]
            path.append(x)
        out[n] = ("cycle", -1, None) if x in par else (x, len(path) - 1, path[::-1])
    return out


def forest(seed, n=400):
    r = random.Random(seed)
    links = [(f"n{i}", "n0" if r.random() < 0.3 else f"n{r.randrange(i)}", "x", 1) for i in range(5, n)]
    links += [(f"d{i}", f"d{i + 1}", "x", 1) for i in range(60)]  # deep
    links += [("c1", "c2", "x", 1), ("c2", "c3", "x", 1), ("c3", "c1", "x", 1), ("t", "c1", "x", 1), ("u", "t", "x", 1), ("s", "s", "x", 1)]
    links += [("two", "n9", "x", 1), ("two", "n8", "x", 1), (None, "n1", "x", 1), ("n1x", None, "x", 1), *links[:20]]
    return links


@pytest.mark.parametrize("rest_rows", [0, 30, 100_000])
def test_against_brute_force(spark, rest_rows):
    links = forest(rest_rows, 120 if rest_rows == 0 else 400)
    if rest_rows == 0:
        links = [x for x in links if not str(x[0]).startswith("d") or int(x[0][1:]) < 8]
    want = brute(links)
    got = {x.node_id: x for x in hierarchy(spark.createDataFrame(links, S), with_path=True, rest_rows=rest_rows).collect()}
    assert {n: (x.root_id, x.depth, x.path) for n, x in got.items()} == want
    below = {n: {m for m, (_, _, p) in want.items() if p and n in p[:-1]} for n in want}
    for n, x in got.items():
        if x.lo is None:
            assert x.root_id == "cycle"
            continue
        assert {m for m, y in got.items() if y.root_id == x.root_id and x.lo < y.lo <= x.hi} == below[n]
        assert x.n_descendants == len(below[n])


def test_descendants(spark):
    links = forest(7, 200)
    want = brute(links)
    df = spark.createDataFrame(links, S)
    asked = spark.createDataFrame([("n0",), ("d60",), ("c1",), ("unknown",), ("n0",)], "node_id string")
    got = {tuple(x) for x in descendants(hierarchy(df), asked, width=16).collect()}
    assert got == {(a, m, len(p) - 1 - p.index(a)) for a in ("n0", "d60") for m, (_, _, p) in want.items() if p and a in p[:-1]}


def test_empty_and_only_cycles(spark):
    assert hierarchy(spark.createDataFrame([], S)).collect() == []
    two = spark.createDataFrame([("a", "b", "", 1), ("b", "a", "", 1)], S)
    for rest in (0, 10):
        assert {tuple(x)[:3] for x in hierarchy(two, rest_rows=rest).collect()} == {("a", "cycle", -1), ("b", "cycle", -1)}


def test_paths_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [("x", "y"), ("y", "x"), ("z", "x")], "child string, parent string")
    got = {r.node_id: r for r in hierarchy(links, with_path=True).collect()}
    assert got[f"c{n - 1}"].path == [f"c{i}" for i in range(n)] and got["c0"].path == ["c0"] and got["c7"].depth == 7
    assert got["z"].path is None and got["x"].root_id == "cycle"
