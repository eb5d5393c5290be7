import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators.skew import degree_stats, following, numbered, offset_chunks, prefix_sums, run_stats, running_sum

S = "side string, node_id string, edge_id string, confidence double, _chunk string"


def rows():
    r = random.Random(2)
    out = [(r.choice(["src", "dst"]), "hub" if r.random() < 0.4 else f"n{r.randrange(50)}", f"e{i}", r.choice([None, 0.5, 0.25]), "x") for i in range(900)]
    return out + [("src", None, "e", 1.0, "x"), ("src", "lonely", "e", None, "x"), out[0]]


def test_numbers_are_exact_and_chunks_equal(spark):
    df = spark.createDataFrame(rows(), S).drop("_chunk")
    got = offset_chunks(df, ["side", "node_id"], ["edge_id", "confidence"], chunk_rows=20).collect()
    by, sizes = defaultdict(list), defaultdict(int)
    for x in got:
        by[x.side, x.node_id].append(x._n)
        sizes[x.side, x.node_id, x._chunk] += 1
    assert len(got) == len(rows()) - 1
    placed = defaultdict(list)
    for x in got:
        placed[x.side, x.node_id].append((x._n, x.edge_id))
    for at in placed.values():
        if len(at) > 20:
            assert [e for _, e in sorted(at)] == sorted(e for _, e in at)
    for numbers in by.values():
        assert sorted(numbers) == list(range(len(numbers))) if len(numbers) > 20 else set(numbers) == {None}
    assert max(sizes.values()) == 20


def test_degree_stats(spark):
    want = defaultdict(list)
    for side, n, _, c, _ in rows():
        if n is not None:
            want[side, n].append(c)
    got = degree_stats(spark.createDataFrame(rows(), S), chunk_rows=20).collect()
    assert len(got) == len(want)
    for x in got:
        c = [v for v in want[x.side, x.node_id] if v is not None]
        assert x.n_edges == len(want[x.side, x.node_id])
        assert x.mean_confidence is None if not c else abs(x.mean_confidence - sum(c) / len(c)) < 1e-12
    assert max(x.n_chunks for x in got) > 3
    assert degree_stats(spark.createDataFrame([], S)).collect() == []


def test_prefix_sums(spark):
    data = [(k, i, (i * 7) % 5) for k in ("a", "b") for i in range(50)]
    got = prefix_sums(spark.createDataFrame(data, "k string, i int, v bigint"), ["k"], ["i"], F.col("v"), F.floor(F.col("i") / 6), "before").collect()
    for x in got:
        assert x.before == sum(v for k, i, v in data if k == x.k and i < x.i)


def test_runs_over_the_borders_of_chunks(spark):
    r = random.Random(4)
    data = [("hub", i, None if i % 90 == 3 else "ab"[(i // r.choice([37, 61])) % 2]) for i in range(700)]
    data += [("one", i, "same") for i in range(150)] + [(f"n{i % 9}", i, r.choice(["x", "y", None])) for i in range(120)] + [(None, 1, "x"), ("twice", 5, "x"), ("twice", 5, "x")]
    want = {}
    for k in {k for k, _, _ in data if k}:
        vs = [v for _, v in sorted((i, v or "") for kk, i, v in data if kk == k)]
        best = n = 1
        for a, b in zip(vs, vs[1:], strict=False):
            n = n + 1 if a == b else 1
            best = max(best, n)
        ends = sorted(i for kk, i, _ in data if kk == k)
        want[k] = (len(vs), best, str(ends[0]), str(ends[-1]))
    df = spark.createDataFrame(data, "k string, i int, v string")
    for chunk_rows in (10, 64, None):
        got = {x.k: (x.n_rows, x.longest_run, x.head, x.tail) for x in run_stats(df, ["k"], ["i"], "v", chunk_rows=chunk_rows).collect()}
        assert got == want
    assert run_stats(df.limit(0), ["k"], ["i"], "v").collect() == []


def test_rows_that_are_equal_throughout_are_cut_too(spark):
    df = spark.range(500).selectExpr("'k' as k", "1 as i", "'v' as v")
    sizes = [x["count"] for x in offset_chunks(df, ["k"], ["i", "v"], chunk_rows=50).groupBy("_chunk").count().collect()]
    assert sizes == [50] * 10
    assert run_stats(df, ["k"], ["i"], "v", chunk_rows=50).first().longest_run == 500


def test_order_within_busy_keys(spark):
    r = random.Random(8)
    data = [(r.choice(["hub", "hub", "hub", "a", None]), i, r.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, v bigint")
    by = defaultdict(list)
    for k, i, v in sorted(data, key=lambda t: t[1]):
        by[k].append((i, v))
    for chunk_rows in (7, None):
        n = {(x.k, x.i): x.n for x in numbered(df, ["k"], [F.col("i")], "n", chunk_rows=chunk_rows).collect()}
        s = {(x.k, x.i): x.s for x in running_sum(df, ["k"], [F.col("i")], F.col("v"), "s", chunk_rows=chunk_rows).collect()}
        f = {(x.k, x.i): x.f for x in following(df, ["k"], [F.col("i")], "i", "f", chunk_rows=chunk_rows).collect()}
        assert len(n) == len(s) == len(f) == 400
        for k, line in by.items():
            for j, (i, _) in enumerate(line):
                assert n[k, i] == j + 1 and s[k, i] == sum(v for _, v in line[: j + 1]) and f[k, i] == (line[j + 1][0] if j + 1 < len(line) else None)
