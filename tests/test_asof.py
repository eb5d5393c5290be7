import random

import pytest

from tidemark.operators.asof import bitemporal_asof

E = "event_id string, entity string, at bigint, valid_at string"
V = "version_id string, entity string, valid_at bigint, known_at bigint, event_id int"


def brute(events, versions):
    out = []
    for i, e, t, _ in events:
        if None in (i, e, t):
            continue
        ok = [v for v in versions if None not in v[:4] and v[1] == e and v[2] <= t and v[3] <= t]
        if ok:
            out.append((i, min(ok, key=lambda v: (-v[2], -v[3], v[0]))[0]))
    return sorted(out)


@pytest.mark.parametrize("chunk_rows", [10, 40, 100_000])
def test_against_brute_force_with_a_busy_entity(spark, chunk_rows):
    r = random.Random(chunk_rows)
    entity = lambda: "hot" if r.random() < 0.4 else r.choice("abcdefg")
    events = [(f"e{i}", entity(), r.randrange(200), "x") for i in range(300)]
    versions = [(f"v{r.randrange(900)}", entity(), r.randrange(200), r.randrange(200), 1) for _ in range(300)]
    versions += versions[:40] + [("v1", None, 1, 1, 1), ("v2", "a", None, 1, 1), (None, "a", 1, 1, 1), ("v3", "a", 1, None, 1)]
    events += [("n1", None, 1, "x"), ("n2", "a", None, "x"), (None, "a", 100, "x")]
    got = bitemporal_asof(spark.createDataFrame(events, E), spark.createDataFrame(versions, V), chunk_rows=chunk_rows, group_rows=50, slot_us=7)
    assert sorted(map(tuple, got.collect())) == brute(events, versions)


def test_all_events_at_one_instant_are_spread(spark):
    events = [(f"e{i}", "hot", 5, "x") for i in range(200)]
    versions = [(f"v{i}", "hot", i, 9 - i, 1) for i in range(10)]
    got = bitemporal_asof(spark.createDataFrame(events, E), spark.createDataFrame(versions, V), chunk_rows=20, slot_us=1)
    assert sorted(map(tuple, got.collect())) == brute(events, versions)


def test_never_a_version_learned_later_and_ties_go_to_the_smallest_id(spark):
    events = [("e", "a", 10, ""), ("f", "a", 12, "")]
    versions = [("late", "a", 9, 11, 1), ("z", "a", 5, 6, 1), ("y", "a", 5, 6, 1), ("old", "a", 1, 1, 1)]
    got = bitemporal_asof(spark.createDataFrame(events, E), spark.createDataFrame(versions, V))
    assert dict(map(tuple, got.collect())) == {"e": "y", "f": "late"}


def test_empty(spark):
    none_e, none_v = spark.createDataFrame([], E), spark.createDataFrame([], V)
    some_e, some_v = spark.createDataFrame([("e", "a", 1, "")], E), spark.createDataFrame([("v", "a", 1, 1, 1)], V)
    for e, v in ((none_e, none_v), (some_e, none_v), (none_e, some_v)):
        assert bitemporal_asof(e, v).collect() == []
