import random

from pyspark.sql import functions as F

from tidemark.operators.delivery import first_copies, ranked_copies

S = "line bigint, id string, arrived bigint, _key string, tie int"


def rank(df, **k):
    return ranked_copies(df, key=F.col("id"), arrived=F.col("arrived"), tie=F.col("line"), **k)


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "hot" if r.random() < 0.3 else f"k{r.randrange(60)}", r.choice([None, *range(9)]), "x", 1) for i in range(600)]
    rows += [(700, None, 1, "x", 1), (701, "", 1, "x", 1), (702, " \t", 1, "x", 1)]
    kept = {}
    for line, k, a, *_ in rows[:600]:
        kept[k] = min(kept.get(k, (True, 99, 999)), (a is None, a or 0, line))
    want = {line: kept[k][2] == line for line, k, *_ in rows[:600]}
    for salts in (1, 3, 64):
        assert {x.tie: x.keep for x in rank(spark.createDataFrame(rows, S), salts=salts).collect()} == want


def test_rows_equal_in_everything_leave_one(spark):
    got = rank(spark.createDataFrame([(1, "a", 5, "", 1)] * 4 + [(None, "b", None, "", 1)] * 2, S)).collect()
    assert sorted(x.keep for x in got if x.tie == 1) == [False, False, False, True]
    assert sorted(x.keep for x in got if x.tie is None) == [False, True]


def test_batches_against_stored(spark):
    batch = spark.createDataFrame([(1, "a", 5, "", 1), (2, "a", 4, "", 1), (3, "b", 1, "", 1), (4, None, 1, "", 1), (5, " ", 1, "", 1)], S)
    stored = spark.createDataFrame([("b", 1), ("b", 2), (None, 3)], "id string, other int")
    got = first_copies(batch, key="id", arrived="arrived", tie="line", stored=stored)
    assert got.columns == batch.columns and sorted(x.line for x in got.collect()) == [2, 4, 5]


def test_empty(spark):
    e = spark.createDataFrame([], S)
    assert rank(e).collect() == [] and first_copies(e, key="id", arrived="arrived", tie="line").collect() == []
