import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions.times import iso_micros
from tidemark.operators.late import corrected_totals, first_delivery, replay

H, D = 3_600_000_000, 86_400_000_000
S = "key string, occurred bigint, arrived bigint, _slot string"


def brute(rows):
    on, all_ = Counter(), Counter()
    for k, o, a, _ in rows:
        if None in (k, o, a) or a - o > 72 * H:
            continue
        day = o // D * D
        all_[k, day] += 1
        on[k, day] += a < day + D + 6 * H
    return sorted((k, d, on[k, d], n) for (k, d), n in all_.items())


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for _ in range(800):
        o = r.randrange(5 * D)
        rows.append(("hot" if r.random() < 0.4 else r.choice("abc"), o, o + r.choice([-H, 0, H, 20 * H, 30 * H, 71 * H, 72 * H, 72 * H + 1, 300 * H]), "x"))
    rows += [(None, 1, 1, "x"), ("a", None, 1, "x"), ("a", 1, None, "x")]
    got = corrected_totals(spark.createDataFrame(rows, S)).select("key", "period_start", "total_at_close", "total_final")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_replay_starts_at_the_first_late_slot_and_boundaries(spark):
    rows = [("a", 3 * H, 4 * H, ""), ("a", 5 * H, D + 6 * H - 1, ""), ("a", 7 * H, D + 6 * H, ""), ("b", 0, 72 * H, ""), ("b", 0, 72 * H + 1, "")]
    got = {r["key"]: tuple(r)[1:] for r in corrected_totals(spark.createDataFrame(rows, S)).collect()}
    assert got == {"a": (0, 2, 3, 1, 7 * H), "b": (0, 0, 1, 1, 0)}


def test_amounts_and_empty(spark):
    rows = [("a", 0, 0, 2.5), ("a", 1, 40 * H, None), ("a", 2, 41 * H, 4.0)]
    (r,) = corrected_totals(spark.createDataFrame(rows, "key string, occurred bigint, arrived bigint, amount double")).collect()
    assert (r.total_at_close, r.total_final, r.n_late) == (2.5, 6.5, 2)
    assert corrected_totals(spark.createDataFrame([], S)).collect() == []


def test_first_delivery_keeps_the_earliest(spark):
    rows = [("k", 5, 1, "late"), ("k", 3, 2, "b"), ("k", 3, 1, "a"), ("k", None, 0, "none"), ("m", None, 1, "only")]
    df = spark.createDataFrame(rows, "id string, arrived bigint, line bigint, what string")
    got = first_delivery(df, F.col("id"), F.col("arrived"), F.col("line"), {"what": F.col("what")}).collect()
    assert sorted(map(tuple, got)) == [("k", "a"), ("m", "only")]


def test_replay_of_a_stored_state(spark):
    cp = spark.createDataFrame([("a", 0, 0, 0), ("a", 0, 1, 3), ("a", 0, 2, 5), ("b", 0, 0, 0)], "key string, period_start bigint, slot bigint, before bigint")
    log = spark.createDataFrame([("a", 0, 0, 3), ("a", 0, 1, 2), ("a", 0, 2, 1), ("b", 0, 0, 9)], "key string, period_start bigint, slot bigint, amount bigint")
    late = spark.createDataFrame([("a", 0, 1, 10), ("c", 0, 4, 1)], "key string, period_start bigint, slot bigint, amount bigint")
    got = sorted(map(tuple, replay(cp, log, late).collect()))
    assert got == [("a", 0, 1, 3, 12), ("a", 0, 2, 15, 1), ("c", 0, 4, 0, 1)]


def test_time_notations(spark):
    texts = {
        "2021-03-01T12:05:47.503Z": 1614600347503000, "2021-03-01 12:05:47.503Z": 1614600347503000, "2021-03-01T14:05:47.503+02:00": 1614600347503000,
        "2021-03-01T06:35:47.503-05:30": 1614600347503000, "2021-03-01T12:05:47.503": 1614600347503000, " 2021-03-01T12:05:47.503z ": 1614600347503000,
        "2021-03-01T14:05:47.503+0200": 1614600347503000, "2021-03-01T14:05:47,503+02": 1614600347503000, "2021-03-01": 1614556800000000, "2021-03-01T12:05": 1614600300000000,
        "2021-13-45T10:00:00Z": None, "2021-02-30T25:61:00Z": None, "yesterday": None, "": None, "  ": None, "n/a": None, "12:05": None, "2021": None, "2021-03-01T12:05:47Zjunk": None,
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", iso_micros(F.col("t")).alias("us"))
    assert {r.t: r.us for r in df.collect()} == texts | {None: None}
