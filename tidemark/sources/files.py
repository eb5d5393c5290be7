"""Files around a graph: folders, ignore rules, packages, archives and the history of commits."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import glob_regex

# fixed values: folders and names that hold no source of one's own, and files that make a folder a package
SKIPPED = r"(^|/)(\.git|node_modules|dist|build|target|__pycache__|\.venv|vendor)/|\.min\.(js|css)$"
MANIFESTS = ("package.json", "pyproject.toml", "pom.xml", "go.mod", "Cargo.toml", "composer.json")
LANGUAGES = {".ts": "ts", ".tsx": "ts", ".js": "js", ".jsx": "js", ".py": "py", ".java": "java", ".go": "go", ".rs": "rust", ".cs": "csharp", ".php": "php", ".sql": "sql", ".md": "md"}


def language(file: Column) -> Column:
    """The language of a file name's extension, or null."""
    ext = F.lower(F.regexp_extract(file, r"(\.[A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[ext]


def parse_ignore(text: str) -> list[tuple[str, bool]]:
    """(pattern, negated) of the lines of an ignore file, in order, as ``linking.ignore_match`` takes them.

    A rule without an inner slash matches at any depth, one with it from the top; a last slash means a folder
    and what is in it.  ``!`` takes back what an earlier rule ignored, ``#`` begins a remark.
    """
    out = []
    for line in text.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        rule = rule[1:] if negated else rule.removeprefix("\\")
        folder, rule = rule.endswith("/"), rule.strip("/") if rule.strip("/") == rule.rstrip("/") else "/" + rule.strip("/")
        anchored = "/" in rule
        body = glob_regex(rule.lstrip("/"))[1:-1]
        out.append((("^" if anchored else "(?:^|.*/)") + body + ("/.*" if folder else "(?:/.*)?") + "$", negated))
    return out


def discover(files: DataFrame, rules: list[tuple[str, bool]] | None = None) -> DataFrame:
    """file, lang of the files (column file) with a known language that neither ``SKIPPED`` nor the rules leave out."""
    f = files.select("file").filter("file is not null").distinct().withColumn("lang", language(F.col("file"))).filter("lang is not null")
    f = f.filter(~F.col("file").rlike(SKIPPED))
    verdict = F.lit(False)
    for pattern, negated in rules or []:
        verdict = F.when(F.col("file").rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return f.filter(~verdict)


def packages(files: DataFrame) -> DataFrame:
    """file, package: the nearest folder above a file that holds a manifest, '' for the top one, null without any.

    A file is joined with its own folders, so the work grows with the depth of paths, not with the packages.
    """
    f = files.select("file").filter("file is not null").distinct()
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    folder = F.regexp_replace("file", r"(^|/)[^/]*$", "")
    roots = f.filter(name.isin(*MANIFESTS)).select(folder.alias("package")).distinct()
    parts = F.split("file", "/")
    above = f.select("file", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("package"))
    near = above.join(roots, "package", "left_semi").groupBy("file").agg(F.max_by("package", F.length("package")).alias("package"))
    return f.join(near, "file", "left")


def _members(kind: str, content: bytes) -> list[tuple[str, bytes | None, str | None]]:
    def problem(name: str, plain: bool) -> str | None:
        if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or name[1:2] == ":":
            return "outside"
        return None if plain else "not a file"

    out: list[tuple[str, bytes | None, str | None]] = []
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    p = problem(i.filename, (i.external_attr >> 28) in (0, 8))
                    out.append((i.filename, None if p else z.read(i), p))
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for i in t:
                if not i.isdir():
                    p = problem(i.name, i.isreg())
                    out.append((i.name, None if p else t.extractfile(i).read(), p))
    return out


def archive_members(archives: DataFrame) -> DataFrame:
    """path, member, content, problem of every member of zip and tar archives (columns path, content).

    Nothing is written anywhere.  Members that point outside the archive's folder, links and devices have a
    problem and no content; an archive that cannot be read gives one row with problem 'unreadable'.
    """

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, *m) for m in _members("zip" if path.lower().endswith((".zip", ".jar")) else "tar", content)]
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, TypeError, RuntimeError):
                    rows.append((path, None, None, "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "member", "content", "problem"])

    return archives.select("path", "content").filter("path is not null").mapInPandas(run, "path string, member string, content binary, problem string")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """commit, at, file of a history written by ``git log --format='%x00%H%x09%aI' --name-only``.

    Commits are divided by the zero byte, so a log of any length is read by many tasks.
    """
    raw = spark.read.option("lineSep", "\0").text(path).filter("trim(value) <> ''")
    lines = F.split("value", "\n")
    head = F.split(lines[0], "\t")
    files = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(head[0].alias("commit"), F.try_to_timestamp(head[1]).alias("at"), F.explode(files).alias("file")).distinct()


def churn(history: DataFrame) -> DataFrame:
    """file, n_commits, w: how often a file was touched, and that on a logarithmic scale from 0 to 1."""
    c = history.groupBy("file").agg(F.countDistinct("commit").alias("n_commits"))
    top = c.agg(F.max("n_commits").alias("_top"))
    return c.crossJoin(F.broadcast(top)).select("file", "n_commits", F.round(F.log1p("n_commits") / F.log1p("_top"), 6).alias("w"))  # one number


def cochanged(history: DataFrame, *, least: int = 2, most: int = 20) -> DataFrame:
    """a < b, support: files changed together in commits of ``least`` to ``most`` files, so a commit gives few pairs."""
    sized = history.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most)).select("commit")
    h = history.select("commit", "file").distinct().join(sized, "commit")
    return h.withColumnRenamed("file", "a").join(h.withColumnRenamed("file", "b"), "commit").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))
