import bisect
import random
from collections import defaultdict

import pytest

from tidemark.llm.packing import pack, plan_runs

S = "doc_id bigint, n_tokens bigint, bin_id string, piece string"


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, gap - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_best_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [min(100, max(1, int(r.lognormvariate(3, 1)))) for _ in range(700)]
    plan, opened = plan_runs({s: sizes.count(s) for s in set(sizes)}, 100)
    assert opened == best_fit_decreasing(sizes, 100)


def test_every_item_is_placed_once_and_fits(spark):
    r = random.Random(9)
    rows = [(i, r.choice([None, 0, -3, 1, 50, 99, 100, 101, 200, 351, r.randrange(1, 400)]), "x", "y") for i in range(500)]
    rows += [(None, 30, "x", "y"), (None, 30, "x", "y"), (7, 30, "x", "y"), (7, 30, "x", "y")]
    got = pack(spark.createDataFrame(rows, S), capacity=100).collect()
    load, pieces = defaultdict(int), defaultdict(list)
    for x in got:
        assert 0 <= x.n_tokens <= 100 and (x.bin_id is None) == (x.n_tokens == 0)
        if x.bin_id is not None:
            load[x.bin_id] += x.n_tokens
        pieces[x.doc_id].append((x.start, x.n_tokens))
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    for i, n, *_ in rows[:500]:
        if i == 7:
            continue
        p = sorted(pieces[i])
        n = max(n or 0, 0)
        assert sum(s for _, s in p) == n and [s for s, _ in p] == [100 * k for k in range(len(p))] and len(p) == max(1, -(-n // 100))
    total = sum(load.values())
    assert len(pieces[None]) == 2 and len(load) <= 1.05 * -(-total // 100) + 1


def test_empty_and_only_full(spark):
    assert pack(spark.createDataFrame([], S)).collect() == []
    got = pack(spark.createDataFrame([(1, 300, "x", "y"), (2, 100, "x", "y")], S), capacity=100).collect()
    assert len({x.bin_id for x in got}) == 4 and all(x.n_tokens == 100 for x in got)


def test_large_capacity():
    """Every size up to 131,072 several times: the sweep does not look at the gaps it cannot use."""
    import time

    capacity = 131_072
    r = random.Random(3)
    counts = {s: r.randrange(1, 4) for s in range(1, capacity + 1)}
    start = time.time()
    plan, opened = plan_runs(counts, capacity)
    assert time.time() - start < 60
    total = sum(s * n for s, n in counts.items())
    assert -(-total // capacity) <= opened <= 1.001 * total / capacity + 1
    size, rank, first, per = plan.T
    assert len(set(zip(size.tolist(), rank.tolist(), strict=True))) == len(plan)


@pytest.mark.parametrize("seed", range(3))
def test_large_items_of_many_sizes(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 5_000) for _ in range(1_500)]
    plan, opened = plan_runs({s: sizes.count(s) for s in set(sizes)}, 5_000)
    assert opened == best_fit_decreasing(sizes, 5_000)


def test_capacity_has_a_bound(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], S), capacity=1 << 21)
