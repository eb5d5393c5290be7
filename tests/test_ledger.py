import json

from pyspark.sql import functions as F

from tidemark.operators import ledger as L

DAY = 86_400_000_000


def raw(spark, rows):
    return spark.createDataFrame([(i, s, o, p, json.dumps({"validAt": v, "knownAt": k, "supportedBy": by}) if v != "broken" else '{"id": "x", "val') for i, s, o, p, v, k, by in rows], "id string, subject_ref string, object_ref string, predicate string, assertion_json string")


def test_assertions_and_as_of(spark):
    a = L.assertions(raw(spark, [
        ("a1", "s", "x", "part-of", "2021-01-01T00:00:00Z", "2021-01-02T00:00:00Z", ["m"]), ("a2", "s", "y", "part-of", "2021-01-05", "2021-03-01T00:00:00Z", ["m", "n"]),
        ("a3", "s", "z", "part-of", "broken", None, []), ("a4", "s", "w", "part-of", "nonsense", "2021-01-01", None), ("a1", "s", "x", "part-of", "2021-01-01T00:00:00Z", "2021-01-02T00:00:00Z", ["m"]),
    ]))
    assert a.count() == 3
    at = lambda d: F.unix_micros(F.to_timestamp(F.lit(d)))
    feb = spark.range(1).select(at("2021-02-01 00:00:00").alias("t")).first().t
    apr = spark.range(1).select(at("2021-04-01 00:00:00").alias("t")).first().t
    assert [r.id for r in L.as_of(a, feb).collect()] == ["a1"] and [r.id for r in L.as_of(a, apr).collect()] == ["a2"]
    w = {r.id: (r.valid_from, r.valid_to) for r in L.valid_windows(a).collect()}
    assert w["a1"][1] == w["a2"][0] and w["a2"][1] is None and set(w) == {"a1", "a2"}
    src = spark.createDataFrame([("m",), ("m",)], "id string")
    assert {(r.id, r.n_supporters, r.n_found) for r in L.supported(a, src).collect()} == {("a1", 1, 1), ("a2", 2, 1), ("a4", 0, 0)}


def test_half_open_windows(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 5), (1, 5, 0), (1, None, 9), (None, 5, 2), (5, 5, 5), (6, 5, 5)], "f bigint, t bigint, at bigint")
    got = [tuple(r) for r in df.select(L.holds(F.col("f"), F.col("t"), F.col("at")), L.window_shape(F.col("f"), F.col("t"))).collect()]
    assert got == [(True, "valid"), (False, "valid"), (False, "valid"), (True, "valid"), (False, "unparseable"), (False, "inverted"), (False, "inverted")]


def test_conflicts_and_contradictions(spark):
    a = L.assertions(raw(spark, [("1", "s", "x", "part-of", "2021-01-01", "2021-01-01", []), ("2", "s", "y", "part-of", "2021-01-01", "2021-01-01", []), ("3", "s", "x", "affects", "2021-01-01", "2021-01-01", []), ("4", "s", "y", "affects", "2021-01-01", "2021-01-01", []), ("5", "p", "q", "contradicts", "2021-01-01", "2021-01-01", []), ("6", "q", "p", "contradicts", "2021-01-02", "2021-01-01", [])]))
    assert [(r.subject, r.predicate, r.n_objects) for r in L.conflict_groups(a).collect()] == [("s", "part-of", 2)]
    assert [tuple(r) for r in L.contradictions(a).collect()] == [("p", "q", 2)]


def test_decisions_overlay(spark):
    rows = [("s", "internal", "p1", 1), ("s", "restricted", "p1", 2), ("t", "internal", "p1", 1), ("t", "internal", "p2", 1), ("u", "public", "p1", 1), ("u", "confidential", "p1", 1), (None, "internal", "p", 1), ("v", None, "p", 1)]
    d = L.decisions(spark.createDataFrame(rows, "entity string, sensitivity string, project string, at bigint"))
    assert {(r.subject, r.lifecycle, r.quarantined) for r in L.believed(d).collect()} == {("s", "retracted", False), ("t", "superseded", False), ("u", "active", True)}
    assert {(r.subject, r.n_successors) for r in L.decision_conflicts(d).collect()} == {("s", 1), ("t", 2)}


def test_exclusion_takes_the_first_clause(spark):
    df = spark.createDataFrame([(True, True, True, True, False), (False, False, True, True, True), (True, True, None, True, True), (True, True, True, True, True), (True, True, True, False, None)], "a boolean, b boolean, c boolean, d boolean, e boolean")
    assert [r[0] for r in df.select(L.exclusion(*[F.col(c) for c in "abcde"])).collect()] == [None, "trust", "applicability", "quarantined", "lifecycle"]


def test_expiry_feedback_scrub(spark):
    df = spark.createDataFrame([(0, 1, False), (0, 1, True), (0, 2, None), (None, 1, False), (0, None, False)], "o bigint, d int, p boolean")
    assert [r[0] for r in df.select(L.expired(F.col("o"), F.col("d"), F.col("p"), DAY)).collect()] == [True, False, False, True, True]
    e = spark.createDataFrame([("s", "memory.observed")] * 5 + [("t", "file.changed"), (None, "file.changed"), ("u", "other")], "entity string, kind string")
    assert {tuple(r) for r in L.net_feedback(e).collect()} == {("s", 3), ("t", -1)}
    p = spark.createDataFrame([('{"a": 1, "authToken": "x", "n": {"b": 2}}',), (None,)], "p string").select(L.scrub(F.col("p")).alias("m")).collect()
    assert set(p[0].m) == {"a", "n"} and p[1].m is None


def test_sessions(spark):
    rows = [("p", "s1", 1, "a", 10 * DAY), ("p", "s1", 2, "b", 11 * DAY), ("p", "s2", 3, "c", 20 * DAY), (None, "s3", 4, "d", 1), ("p", None, 5, "e", 1)]
    e = spark.createDataFrame(rows, "project string, session string, line_no bigint, kind string, arrived bigint")
    got = {r.session: (r.last_kind, r.n, r.kinds, r.idle_days, r.stale) for r in L.session_projection(e, 30 * DAY).collect()}
    assert got["s1"] == ("b", 2, "a,b", 19, True) and got["s2"] == ("c", 1, "c", 10, False)
    assert {(r.session, r.other_session) for r in L.last_other_session(e).collect()} == {("s1", None), ("s2", "s1")}


def test_aliases_fold_to_the_least(spark):
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("y", "x")], "src string, dst string")
    assert {r.node_id: r.component for r in L.alias_canonical(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
