import numpy as np
import pytest

from tidemark.llm import neighbours as N
from tidemark.llm import vamana

S = "id string, vec array<float>, dim int, embedder string, key string"


def brute(rows, k, min_cos):
    best = {}
    for i, v, d, *_ in rows:
        if i is None or v is None or d is None or len(v) != d or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = min(best.get(i, (d, v)), (d, v))
    ids = sorted(best)
    unit = {i: np.array(best[i][1], float) / np.linalg.norm(best[i][1]) for i in ids}
    out = set()
    for a in ids:
        near = sorted(((-round(float(unit[a] @ unit[b]), 6), b) for b in ids if b != a and best[a][0] == best[b][0]))[:k]
        out |= {tuple(sorted((a, b))) for c, b in near if -c >= min_cos}
    return out


def clustered(n=240, dim=12, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n // 4):
        centre = r.normal(size=dim)
        rows += [(f"v{c}-{i}", (centre + 0.25 * r.normal(size=dim)).astype(np.float32).tolist(), dim, "e", "x") for i in range(4)]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard_rows": 40}, {"shard_rows": 60, "assign": 1, "probe": 4}])
def test_pairs_against_brute_force(spark, how):
    rows = clustered()
    rows += [("bad1", None, 12, "e", "x"), ("bad2", [1.0] * 11, 12, "e", "x"), ("bad3", [float("nan")] + [1.0] * 11, 12, "e", "x"), ("bad4", [0.0] * 12, 12, "e", "x"), ("bad5", [float("inf")] + [1.0] * 11, 12, "e", "x"), (None, [1.0] * 12, 12, "e", "x"), ("bad6", [1.0] * 12, None, "e", "x"), rows[0]]
    rows += [(f"small{i}", [1.0, float(i)], 2, "f", "x") for i in range(4)]
    got = {tuple(x) for x in N.similar_pairs(spark.createDataFrame(rows, S), **how).collect()}
    want = brute(rows, 5, 0.8)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_a_group_of_copies_stays_linear(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0], 3, "e", "x") for i in range(60)] + [("scaled", [2.0, 4.0, 6.0], 3, "e", "x"), ("near", [1.0, 2.0, 3.1], 3, "e", "x"), ("far", [-1.0, 0.0, 0.0], 3, "e", "x")]
    got = N.neighbours(spark.createDataFrame(rows, S), k=5).collect()
    by = {}
    for x in got:
        by.setdefault(x.id, []).append((x.rank, x.near))
    assert [n for _, n in sorted(by["c030"])] == ["c000", "c001", "c002", "c003", "c004"]
    assert [n for _, n in sorted(by["c000"])] == ["c001", "c002", "c003", "c004", "c005"]
    assert len(by["near"]) == 5 and max(map(len, by.values())) == 5 and len(by) == 63


def test_empty_and_alone(spark):
    assert N.neighbours(spark.createDataFrame([], S)).collect() == []
    assert N.similar_pairs(spark.createDataFrame([("a", [1.0], 1, "e", "x")], S)).collect() == []


def test_recall_of_the_graph():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, entries = vamana.build(x)
    q = x[:200]
    ids, _ = vamana.beam_search(x, graph, q, np.broadcast_to(entries, (200, len(entries))))
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    recall = np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)])
    assert recall >= 0.9
    assert (graph >= 0).sum(1).max() <= vamana.DEGREE


def test_one_dense_region_is_split_into_bounded_groups(spark, monkeypatch, tmp_path):
    """All vectors within a narrow cone, cells of four at a time: several levels, bounded groups, linear work."""
    from tidemark.runtime import Scratch

    monkeypatch.setattr(N, "FANOUT", 4)
    n, dim, shard_rows = 3000, 8, 60
    r = np.random.default_rng(5)
    centre = r.normal(size=dim)
    x = centre + 0.01 * np.repeat(r.normal(size=(n // 3, dim)), 3, axis=0) + 0.0003 * r.normal(size=(n, dim))
    rows = [(f"v{i}", v.tolist(), dim, "e", "x") for i, v in enumerate(x)]
    scratch = Scratch(spark, "dense")
    ids, units = N.classes(spark.createDataFrame(rows, S), scratch)
    placed = N.place_in_cells(units, scratch, assign=2, probe=4, shard_rows=shard_rows, sample_rows=500)
    sent = N.shards(placed, scratch, shard_rows).selectExpr("cell", "shard", "slice", "int(member) as m", "int(query) as q").groupBy("cell", "shard", "slice").sum("m", "q").collect()
    assert len(sent) > n / shard_rows and max(x["sum(m)"] for x in sent) <= 2 * shard_rows and max(x["sum(q)"] for x in sent) <= 2 * N.SLICE * shard_rows
    assert sum(x["sum(q)"] for x in sent) <= 60 * n and sum(x["sum(m)"] for x in sent) <= 30 * n
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = ((unit[:, None] - unit[None]) ** 2).sum(-1)
    np.fill_diagonal(d, 9)
    want = {(f"v{a}", f"v{b}") for a in range(n) for b in np.argsort(d[a])[:2]}
    got = {(x.id, x.near) for x in N.neighbours(spark.createDataFrame(rows, S), k=2, shard_rows=shard_rows, sample_rows=500).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_rows_of_one_id_that_differ(spark):
    rows = [("a", [1.0, 0.0], 2, "e", "x"), ("a", [0.0, 1.0], 2, "e", "x"), ("b", [1.0, 0.1], 2, "e", "x"), ("c", [0.1, 1.0], 2, "e", "x")]
    got = N.neighbours(spark.createDataFrame(rows, S), k=5).collect()
    assert sorted((x.id, x.near) for x in got) == sorted((a, b) for a in "abc" for b in "abc" if a != b)
