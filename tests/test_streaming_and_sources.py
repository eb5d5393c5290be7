import json
import time

from pyspark.sql import functions as F

from tidemark.sources import markdown, stores
from tidemark.streaming import journal

S = "line bigint, id string, arrived bigint"


def drop(spark, folder, name, rows, schema=S):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)


def test_journal_keeps_one_copy_over_all_batches(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    drop(spark, inbox, "1", [(1, "a", 5), (2, "a", 4), (3, None, 1)])
    stream = lambda: journal.journal_stream(spark.readStream.schema(S).parquet(str(inbox)), out, key="id", arrived="arrived", tie="line")
    stream().awaitTermination(120)
    drop(spark, inbox, "2", [(4, "a", 1), (5, "b", 1), (6, "b", 1), (7, " ", 2)])
    stream().awaitTermination(120)
    assert sorted(r.line for r in spark.read.parquet(f"{out}/rows").collect()) == [2, 3, 5, 7]
    # the same batch again replaces its own rows
    sink = journal.append_once(spark, out, key="id", arrived="arrived", tie="line")
    sink(spark.createDataFrame([(4, "a", 1), (5, "b", 1), (6, "b", 1), (7, " ", 2)], S), 1)
    assert sorted(r.line for r in spark.read.parquet(f"{out}/rows").collect()) == [2, 3, 5, 7]


def test_late_rows_replay_the_stored_totals(spark, tmp_path):
    path = str(tmp_path / "state")
    sink = journal.late_stream(spark, path, period_us=100, slot_us=10, close_after_us=20, cutoff_us=300)
    s = "key string, occurred bigint, arrived bigint"
    batches = [[("a", 5, 6), ("a", 95, 96), ("b", 20, 21), (None, 1, 1)], [("a", 15, 119), ("a", 16, 120), ("c", 250, 250), ("a", 5, 306)], [("a", 5, 300), ("a", None, 1), ("a", 1, None)]]
    for i, b in enumerate(batches):
        sink(spark.createDataFrame(b, s), i)
    sink(spark.createDataFrame(batches[2], s), 2)  # tried again
    sink(spark.createDataFrame([], s), 3)
    got = {(r.key, r.period_start): (r.total_at_close, r.total) for r in journal.stream_totals(spark, path).collect()}
    assert got == {("a", 0): (3, 5), ("b", 0): (1, 1), ("c", 200): (1, 1)}
    newest = journal._newest(spark.read.schema(journal._STATE).parquet(f"{path}/state")).filter("key = 'a'").collect()
    assert {(r.slot, r.before, r.amount) for r in newest} == {(0, 0, 2), (10, 2, 2), (90, 4, 1)}
    # only what changed was written again
    assert spark.read.parquet(f"{path}/state").filter("key <> 'a' and epoch = 2").count() == 0


def test_a_store_that_cannot_be_read_is_not_taken_for_empty(spark, tmp_path):
    import pytest

    (tmp_path / "rows").mkdir()
    (tmp_path / "rows" / "part.parquet").write_text("no parquet")
    sink = journal.append_once(spark, str(tmp_path), key="id", arrived="arrived", tie="line")
    with pytest.raises(Exception, match="(?i)parquet|malformed|footer"):
        sink(spark.createDataFrame([(1, "a", 5)], S), 0)


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    import pytest

    from tidemark import runtime

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_windowed_counts_match_batch(spark, tmp_path):
    rows = [(f"2021-03-0{d} 0{h}:00:00", k) for d in (1, 2) for h in range(4) for k in "ab"]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = journal.windowed_counts(stream, time="t", key="k").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("select * from wc").collect()) == [4, 4, 4, 4]


def test_outbox_dies_after_three_failures(spark, tmp_path):
    rows = [("x", False)] * 3 + [("y", False), ("y", True), ("z", False)]
    spark.createDataFrame(rows, "job string, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, ok boolean").parquet(str(tmp_path / "in"))
    q = journal.outbox_states(stream).writeStream.format("memory").queryName("ob").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("select * from ob").collect()} == {("x", "dead", 3), ("y", "done", 1), ("z", "pending", 1)}


def test_markdown(spark):
    text = "intro `a`\n# One\ntext [l](x.md) `b()`\n```\n# not a heading\n```\n## One\n~~~\n```\n~~~\n# Two #\nend"
    got = markdown.split_sections(text)
    assert [(s["heading"], s["level"], s["anchor"], s["parent"], s["start"], s["end"]) for s in got] == [("", 0, "", -1, 1, 1), ("One", 1, "one", -1, 2, 6), ("One", 2, "one-1", 1, 7, 10), ("Two", 1, "two", -1, 11, 12)]
    assert got[1]["links"] == ["x.md"] and got[1]["code_refs"] == ["b()"] and "not a heading" not in got[1]["prose"]
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 50_000)], "doc_id bigint, text string")
    assert {(r.doc_id, r.n) for r in markdown.sections(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {("1", 4), ("4", 1)}


def test_json_lines_with_quarantine(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab/1.jsonl").write_text(json.dumps({"id": "n1", "kind": "file", "span": {"start": 1, "end": 2}}) + "\n\n{broken\n" + json.dumps({"kind": "file"}) + "\n")
    (tmp_path / "2.jsonl").write_text(json.dumps({"id": "n2", "kind": "odd"}) + "\n")
    rows, bad = stores.read_lines(spark, str(tmp_path), stores.NODE)
    assert sorted(r.id for r in rows.collect()) == ["n1", "n2"] and bad.count() == 2
    valid, invalid = stores.valid_nodes(rows)
    assert [r.id for r in valid.collect()] == ["n1"] and [r.id for r in invalid.collect()] == ["n2"]


def test_spans_trees_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("a\nb\nc\nd", 2, 3), ("a", 1, 9), ("a\nb", 0, 1), (None, 1, 1), ("a", 5, 4)], "body string, s int, e int")
    got = [r.t for r in df.select(stores.span_text(F.col("body"), F.col("s"), F.col("e"), 3).alias("t")).collect()]
    assert [t.text for t in got] == ["b\nc", "a", "a", None, ""]
    (tmp_path / "src/x").mkdir(parents=True)
    (tmp_path / "src/x/a.py").write_text("print(1)\n")
    (tmp_path / "src/b.bin").write_text("x")
    assert [(r.lang, r.body) for r in stores.source_tree(spark, str(tmp_path / "src"), {".py": "python"}).collect()] == [("python", "print(1)\n")]
    n, e = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int"), spark.createDataFrame([("e",)], "id string")
    one = {r.part: (r.n, r.digest) for r in stores.export_json(n, e, str(tmp_path / "out")).collect()}
    two = {r.part: (r.n, r.digest) for r in stores.export_json(n.orderBy(F.desc("id")), e, str(tmp_path / "out2")).collect()}
    assert one == two and one["nodes"][0] == 2
    stores.write_store(n, str(tmp_path / "store"), shard="id")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
