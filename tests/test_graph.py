from collections import deque

import pytest

from tidemark.operators import graph as G

E = "src string, dst string, rel string, confidence double, node_id string"


@pytest.fixture(scope="module")
def diamond(spark):
    rows = [("a", "b", "calls"), ("a", "c", "calls"), ("b", "d", " Calls"), ("c", "d", "calls"), ("d", "a", "calls"), ("e", "e", "calls"), ("a", "b", "CALLS "), (None, "a", "calls"), ("a", None, "calls")]
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], E)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def test_reach_stops_at_cycles_and_gives_each_node_once(spark, diamond):
    got = {(r.node_id, r.distance) for r in G.reach(diamond, ids(spark, "a", "a"), depth=9).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.node_id, r.distance) for r in G.reach(diamond, ids(spark, "d"), direction="in", depth=1).collect()} == {("d", 0), ("b", 1), ("c", 1)}
    assert {r.node_id for r in G.reach(diamond, ids(spark, "b"), direction="both", depth=1).collect()} == {"a", "b", "d"}
    assert G.reach(diamond.limit(0), ids(spark), depth=3).collect() == []


def test_shortest_path_takes_the_least_predecessor(spark, diamond):
    (r,) = G.shortest_paths(diamond, ids(spark, "a"), ids(spark, "d", "zz")).collect()
    assert (r.hops, r.path) == (2, ["a", "b", "d"])


def test_degree_and_neighbours(spark, diamond):
    assert {r.node_id: (r.n_out, r.n_in) for r in G.degree(diamond).collect()} == {"a": (2, 1), "b": (1, 1), "c": (1, 1), "d": (1, 2), "e": (1, 1)}
    got = {(r.neighbour, r.direction) for r in G.neighbours(diamond, ids(spark, "b")).collect()}
    assert got == {("a", "in"), ("d", "out")}


def test_components_against_search(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("x", "y"), ("y", "x"), ("hub", "n010"), *[("hub", f"h{i}") for i in range(50)], ("z", "z")]
    got = {r.node_id: r.component for r in G.components(spark.createDataFrame([(a, b, "calls", 1.0, "x") for a, b in chain], E)).collect()}
    near = {}
    for a, b in chain:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n in near:
        seen, work = {n}, deque([n])
        while work:
            for m in near[work.popleft()] - seen:
                seen.add(m)
                work.append(m)
        assert got[n] == min(seen)


def cliques():
    one = [(a, b, 1.0) for a in range(4) for b in range(a + 1, 4)]
    return one + [(a + 4, b + 4, w) for a, b, w in one] + [(3, 4, 1.0)]


def test_louvain_finds_two_cliques_whatever_the_order():
    assert G.louvain(cliques(), 8) == [0, 0, 0, 0, 1, 1, 1, 1]
    assert G.louvain(cliques()[::-1], 8) == G.louvain(cliques(), 8)
    assert G.louvain([], 3) == [0, 1, 2]


def test_communities(spark):
    w = spark.createDataFrame([("g", f"n{a}", f"n{b}", int(x)) for a, b, x in cliques()], "grp string, a string, b string, w bigint")
    got = {r.node_id: r.community for r in G.community_kernel(w, "grp").collect()}
    assert len({got[f"n{i}"] for i in range(4)}) == 1 and got["n0"] != got["n7"]
    spread = G.label_communities(w.select("a", "b", "w")).collect()
    assert len(spread) == 8
    with pytest.raises(Exception, match="has 13 edges"):
        G.community_kernel(w, "grp", max_edges=5).collect()


def test_expansion_is_bounded_and_decays(spark, diamond):
    seeds = spark.createDataFrame([("a", 1.0), ("a", 0.5)], "node_id string, score double")
    got = {r.node_id: (r.distance, r.rank) for r in G.expand_from_seeds(diamond, seeds).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.5), "c": (1, 0.5), "d": (1, 0.5)}
    assert sorted(r.node_id for r in G.expand_from_seeds(diamond, seeds, max_nodes=3).collect()) == ["a", "b", "c"]


def test_expansion_runs_from_every_seed_where_seeds_exceed_the_bound(spark):
    e = spark.createDataFrame([(f"s{i:03d}", f"t{i:03d}", "calls", 0.5, "x") for i in range(250)] + [("u", "t249", "calls", 0.5, "x")], E)
    seeds = spark.createDataFrame([(f"s{i:03d}", 1.0) for i in range(250)], "node_id string, score double")
    got = {r.node_id: (r.distance, r.rank) for r in G.expand_from_seeds(e, seeds).collect()}
    scores = spark.createDataFrame([("s249", 0.1), ("u", 1.0)], "node_id string, score double")
    near = {r.node_id: (r.distance, r.rank) for r in G.expand_from_seeds(e, scores).collect()}
    assert near == {"s249": (0, 0.1), "u": (0, 1.0), "t249": (1, 0.5)}
    assert len(got) == 501 and got["s249"] == (0, 1.0) and got["t249"] == (1, 0.5) and got["u"] == (2, 0.25)


def test_expansion_passes_hubs_without_pairs_of_seeds_and_neighbours(spark, monkeypatch):
    # some seeds have seen the hub's least neighbours, some have no room after a hop; edges repeat
    links = [("hub", f"n{i:04d}") for i in range(2000)] + [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(0, 100, 3)] + [("hub", "hub"), ("n1999", "hub")]
    links += [("n1500", f"a{i:02d}") for i in range(40)] + [("n1600", f"n{i:04d}") for i in range(12)]
    e = spark.createDataFrame([(a, b, r, 0.5, "x") for a, b in links for r in ("calls", "imports")], E)
    names, bound, sizes, kept = [f"n{i:04d}" for i in [*range(0, 400, 2), 1500, 1600]] + ["hub"], 20, [], G.top_ranked
    monkeypatch.setattr(G, "top_ranked", lambda df, *a: sizes.append(df.count()) or kept(df, *a))
    seeds = spark.createDataFrame([(s, 1.0 + (i % 3)) for i, s in enumerate(names)], "node_id string, score double")
    got = {(r.node_id, r.distance, r.rank) for r in G.expand_from_seeds(e, seeds, max_nodes=bound).collect()}
    assert len(sizes) == 2 and max(sizes) <= len(names) * bound * 2
    near, best = {}, {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i, s in enumerate(names):
        seen = {s: 0}
        for h in (1, 2):
            new = sorted({b for a, d in seen.items() if d == h - 1 for b in near[a]} - seen.keys())
            seen |= dict.fromkeys(new[: bound - len(seen)], h)
        for v, d in seen.items():
            best[v] = max(best.get(v, (-9, 0)), (-d, (1.0 + i % 3) * 0.5**d))
    assert got == {(v, -d, rank) for v, (d, rank) in best.items()}


def test_route_bridge_has_no_square_of_pairs(spark):
    rows = [(f"r{i}", "one", "route", "get", "/a/{id}?q=1") for i in range(20)] + [(f"s{i}", "two", "route", "GET", "/a/:key/") for i in range(20)] + [("t", "one", "route", None, "/b"), ("u", "two", "symbol", "GET", "/b")]
    n = spark.createDataFrame(rows, "id string, root string, kind string, http_method string, route_path string")
    got = G.route_bridge(n).collect()
    assert len(got) == 40 and {r.b for r in got} == {"r0", "s0"}


def test_federated_reach_finds_every_matching_route_of_other_roots(spark):
    rows = [("a", "one", "get", "/x/{id}"), ("a2", "one", "get", "/x/:k"), ("b1", "two", "GET", "/x/:id/"), ("b2", "two", "GET", "/x/{n}?q=1"), ("c", "two", None, "/x/{id}"), ("d", "two", "POST", "/x/{id}"), ("e", "one", "GET", "/y/7"), ("f", "three", "GET", "/y/{id}"), ("g", "three", "GET", "/{p}/{q}"), ("h", "three", "GET", "/y/8"), ("k", "three", "GET", "/y")]
    n = spark.createDataFrame([(i, r, "route", m, p) for i, r, m, p in rows], "id string, root string, kind string, http_method string, route_path string")
    e = spark.createDataFrame([("b2", "z", "calls", 0.5, "x")], E)
    got = {s: {(r.node_id, r.distance) for r in G.federated_reach(n, e, ids(spark, s), depth=1).collect()} - {(s, 0)} for s in ("a", "e", "f", "c")}
    assert got["a"] == {("b1", 1), ("b2", 1), ("c", 1), ("g", 1)}
    assert got["e"] == {("f", 1), ("g", 1)} and got["f"] == set() and got["c"] == set()
    assert ("z", 2) in {(r.node_id, r.distance) for r in G.federated_reach(n, e, ids(spark, "a"), depth=2).collect()}


def test_dangling(spark, diamond):
    nodes = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    kept, dropped = G.dangling(nodes, diamond)
    assert kept.count() == 2 and dropped.count() == 7
