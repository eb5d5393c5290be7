import io
import tarfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import extensions
from tidemark.functions import text as T
from tidemark.operators.linking import ignore_match
from tidemark.sources import files, stores


def test_ignore_files(spark):
    rules = files.parse_ignore("# remark\n\n*.log\n!keep.log\n/dist\nbuild/\ndocs/**/*.tmp\n\\#odd\n")
    names = ["a.log", "x/b.log", "x/keep.log", "dist", "dist/a.js", "x/dist/a.js", "build/a", "x/build/b/c", "buildx", "docs/a.tmp", "docs/q/r.tmp", "x/docs/a.tmp", "#odd", "ok.py"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    assert {r.file for r in ignore_match(df, rules).filter("ignored").collect()} == {"a.log", "x/b.log", "dist", "dist/a.js", "build/a", "x/build/b/c", "docs/a.tmp", "docs/q/r.tmp", "#odd"}


def test_discovery_and_packages(spark):
    names = ["a/x.py", "a/node_modules/y.js", "a/z.min.js", "b/q.TS", "b/noext", "b/c/w.go", "package.json", "b/go.mod", "b/c/d/e.md", None]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    assert {tuple(r) for r in files.discover(df, [("^b/c/d/.*$", False)]).collect()} == {("a/x.py", "py"), ("b/q.TS", "ts"), ("b/c/w.go", "go")}
    got = {r.file: r.package for r in files.packages(df).collect()}
    assert got["a/x.py"] == "" and got["b/c/w.go"] == "b" and got["b/go.mod"] == "b" and got["package.json"] == ""
    assert {r.package for r in files.packages(df.filter("file = 'a/x.py'")).collect()} == {None}


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ok.txt", "text")
        f.writestr("../up.txt", "no")
        f.writestr("dir/", "")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        for name, kind in (("a/b.txt", tarfile.REGTYPE), ("/etc/x", tarfile.REGTYPE), ("link", tarfile.SYMTYPE)):
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname = kind, 2 if kind == tarfile.REGTYPE else 0, "/etc/passwd" if kind == tarfile.SYMTYPE else ""
            f.addfile(info, io.BytesIO(b"hi") if kind == tarfile.REGTYPE else None)
    df = spark.createDataFrame([("z.zip", z.getvalue()), ("t.tgz", t.getvalue()), ("bad.zip", b"no"), ("empty.tar", None)], "path string, content binary")
    got = {(r.path, r.member): (bytes(r.content) if r.content is not None else None, r.problem) for r in files.archive_members(df).collect()}
    assert got == {("z.zip", "ok.txt"): (b"text", None), ("z.zip", "../up.txt"): (None, "outside"), ("t.tgz", "a/b.txt"): (b"hi", None), ("t.tgz", "/etc/x"): (None, "outside"), ("t.tgz", "link"): (None, "not a file"), ("bad.zip", None): (None, "unreadable"), ("empty.tar", None): (None, "unreadable")}


def test_commits(spark, tmp_path):
    log = "\0c1\t2021-01-01T00:00:00+01:00\n\na.py\nb.py\n\0c2\t2021-01-02T00:00:00Z\n\na.py\n\0c3\tx\n\n" + "\n".join(f"f{i}" for i in range(30)) + "\n\0c4\t2021-01-03T00:00:00Z\n"
    (tmp_path / "log").write_text(log)
    h = files.commits(spark, str(tmp_path / "log"))
    assert h.count() == 33 and h.filter("commit = 'c1'").select(F.date_format("at", "HH")).first()[0] == "23"
    c = {r.file: (r.n_commits, r.w) for r in files.churn(h).collect()}
    assert c["a.py"] == (2, 1.0) and c["b.py"] == (1, 0.63093)
    assert [tuple(r) for r in files.cochanged(h).collect()] == [("a.py", "b.py", 1)]


class Lines:
    def supports(self, file, lang):
        return lang == "txt"

    def extract(self, file, body):
        if "boom" in body:
            raise ValueError("boom")
        return [(f"{file}:{i}", "line", x, i, i) for i, x in enumerate(body.split("\n"), 1)]


def test_extractors(spark):
    df = spark.createDataFrame([("a", "txt", "x\ny"), ("b", "txt", "boom"), ("c", "py", "x"), ("d", "txt", None), (None, "txt", "x")], "file string, lang string, body string")
    got = {(r.file, r.id, r.span_start, r.problem) for r in extensions.extract(df, [Lines()]).collect()}
    assert got == {("a", "a:1", 1, None), ("a", "a:2", 2, None), ("b", None, None, "ValueError: boom")}


def test_rerankers_and_scorers(spark):
    rows = [("q", i, i, "want", f"t{'want' if i == 3 else ''}") for i in range(1, 6)]
    hits = spark.createDataFrame(rows, "query_id string, doc_id int, rank int, query string, text string")
    got = extensions.rerank(hits, lambda q, ts: [float(q in t) for t in ts], window=3).orderBy("place").collect()
    assert [r.doc_id for r in got] == [3, 1, 2, 4, 5]
    with pytest.raises(Exception, match="scores for"):
        extensions.rerank(hits, lambda q, ts: [1.0]).collect()
    docs = spark.createDataFrame([("a", "x x"), ("b", "x"), ("c", None), (None, "x"), ("d", "x")], "id string, text string")
    got = extensions.lexical(docs, [("q", "x")], lambda q, s: s.str.count(q), k=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 2.0), ("b", 1.0)]


def test_forms_of_text(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one(T.etag, '{"b":1, "a":[2]}') == one(T.etag, '{ "a":[2],"b":1}') and one(T.etag, "{no") is None
    assert one(T.expand_negation, "It doesn't, can't and WON’T") == "it does not, can not and will not"
    assert one(T.negated, "It isn't so") and not one(T.negated, "a note, notable") and one(T.negated, None) is None
    assert one(T.without_negation, "It does not work") == one(T.without_negation, "it doesn't work") == "it work"
    assert one(T.expression_form, "( A  <> 'x y' )") == "a!='x y'" and one(T.expression_form, "a === b;") == "a=b"


def test_exports(spark, tmp_path):
    n = spark.createDataFrame([("a", 1), ("b", None)], "id string, v int")
    manifest = stores.export_json(n, n, str(tmp_path / "x"))
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    schemas = {"nodes": "id string, v int", "edges": "id string, v int"}
    assert {tuple(r) for r in stores.verify_export(spark, str(tmp_path / "x"), manifest, schemas).collect()} == {("nodes", True), ("edges", True)}
    n.limit(1).write.mode("append").json(str(tmp_path / "x" / "edges"))
    assert {tuple(r) for r in stores.verify_export(spark, str(tmp_path / "x"), manifest, schemas).collect()} == {("nodes", True), ("edges", False)}
    stores.write_notes(spark.createDataFrame([("fact", "s\n1", "c"), ("fact", None, None)], "kind string, subject string, claim string"), str(tmp_path / "notes"))
    assert "## s 1" in {r.value for r in spark.read.text(str(tmp_path / "notes")).collect()}
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    stores.materialize(n, e, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "nodes")).count() == 2
