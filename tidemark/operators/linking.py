"""Entity linking: cascades of equi joins, range joins in blocks, longest prefixes, scored re-attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines to a block of the range joins.
BLOCK = 64


def code_refs(text: Column) -> Column:
    """What a text names in back quotes, without a call's parentheses."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda r: F.regexp_replace(r, r"\(\)$", "")))


def explicit_links(docs: DataFrame, symbols: DataFrame, *, confidence: float = 0.95) -> DataFrame:
    """doc_id, ref, id, confidence: back-quoted names resolved to symbols.

    ``docs``: doc_id, text.  ``symbols``: id, name, qualified_name, file.  A name is a qualified name, else a
    file, else a plain name that only one symbol bears.  Of several symbols with a qualified name the least id.
    """
    refs = docs.select("doc_id", F.explode(code_refs(F.col("text"))).alias("ref")).distinct()
    by_qn = symbols.filter("qualified_name is not null").groupBy(F.col("qualified_name").alias("ref")).agg(F.min("id").alias("q"))
    by_file = symbols.filter("kind = 'file'").groupBy(F.col("file").alias("ref")).agg(F.min("id").alias("f"))
    by_name = symbols.filter("name is not null").groupBy(F.col("name").alias("ref")).agg(F.min("id").alias("n"), F.countDistinct("id").alias("c")).filter("c = 1").drop("c")
    hit = refs.join(by_qn, "ref", "left").join(by_file, "ref", "left").join(by_name, "ref", "left").withColumn("id", F.coalesce("q", "f", "n"))
    return hit.filter("id is not null").select("doc_id", "ref", "id", F.lit(confidence).alias("confidence"))


def identifier_links(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """section_id, id, confidence: words of three letters or more of a section that are a symbol's name.

    0.8 where the section's words name two symbols or more of the same file, else 0.6.
    """
    words = sections.select("section_id", F.explode(F.array_distinct(F.filter(F.split("text", "[^A-Za-z0-9_]+"), lambda w: F.length(w) >= 3))).alias("name"))
    hit = words.join(symbols.select("id", "name", "file").dropna().distinct(), "name").select("section_id", "id", "file").distinct()
    near = F.count(F.lit(1)).over(Window.partitionBy("section_id", "file"))
    return hit.withColumn("n", near).groupBy("section_id", "id").agg(F.when(F.max("n") >= 2, 0.8).otherwise(0.6).alias("confidence"))


def enclosing(points: DataFrame, spans: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """point_id, span_id: the innermost span of the same file that holds each point's line.

    ``points``: point_id, file, line.  ``spans``: span_id, file, start, end, lines inclusive.  Spans are cut into
    the line blocks they meet, so a join compares a point with the spans of its block only.  Innermost is the
    latest start, then the earliest end, then the least id.
    """
    s = spans.filter("start <= end").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    p = points.withColumn("b", F.floor(F.col("line") / block))
    hit = p.join(s, ["file", "b"]).filter("line >= start and line <= end")
    best = hit.groupBy("point_id").agg(F.min(F.struct((-F.col("start")).alias("s"), F.col("end").alias("e"), F.col("span_id").alias("id"))).alias("b"))
    return best.select("point_id", F.col("b.id").alias("span_id"))


def majority_owner(blame: DataFrame, spans: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """span_id, owner, n_lines: who has most of the blamed lines inside each span; ties to the first name."""
    s = spans.filter("start <= end").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    hit = blame.withColumn("b", F.floor(F.col("line") / block)).join(s, ["file", "b"]).filter("line >= start and line <= end")
    n = hit.groupBy("span_id", "owner").agg(F.count(F.lit(1)).alias("n_lines"))
    return n.groupBy("span_id").agg(F.min(F.struct((-F.col("n_lines")).alias("n"), "owner")).alias("b")).select("span_id", F.col("b.owner").alias("owner"), (-F.col("b.n")).alias("n_lines"))


def longest_prefix(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """file, prefix: the longest folder in ``prefixes`` that holds each file.

    A file is joined with each of its own folders, an equi join, in place of comparing it with every prefix.
    """
    parts = F.split("file", "/")
    own = files.select("file").distinct().withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    hit = own.join(prefixes.select("prefix").distinct(), "prefix")
    return hit.groupBy("file").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


# fixed values: what agreement in each signal is worth, and the least sum that re-attaches
LOCATOR = {"kind": 30, "qualified_name": 30, "name": 25, "signature": 15, "file": 15, "base": 8, "anchor": 10, "hash": 10}
ATTACH = 50


def relocate(lost: DataFrame, nodes: DataFrame, *, top: int = 8) -> DataFrame:
    """lost_id, id, score, rank: candidates for signals that no node bears any more.

    Both sides carry id, kind, name, qualified_name, signature, file, anchor, hash.  Candidates share the kind
    and the name or the file's base name; the score is the sum of the signals they agree in.
    """
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    cols = ["kind", "qualified_name", "name", "signature", "file", "anchor", "hash"]
    a = lost.select(F.col("id").alias("lost_id"), *[F.col(c).alias(f"l_{c}") for c in cols], base(F.col("file")).alias("l_base"))
    b = nodes.select("id", *cols, base(F.col("file")).alias("base")).dropDuplicates(["id"])
    by_name = a.join(b, (F.col("l_kind") == F.col("kind")) & (F.col("l_name") == F.col("name")))
    by_base = a.join(b, (F.col("l_kind") == F.col("kind")) & (F.col("l_base") == F.col("base")) & ~F.col("l_name").eqNullSafe(F.col("name")))
    both = by_name.unionByName(by_base)
    same = lambda c: F.coalesce(F.col(f"l_{c}") == F.col(c), F.lit(False))
    pts = lambda c: F.when(same(c), LOCATOR[c]).otherwise(0)
    score = pts("kind") + F.when(same("qualified_name"), 30).otherwise(pts("name")) + pts("signature") + F.when(same("file"), 15).otherwise(pts("base")) + pts("anchor") + pts("hash")
    s = both.select("lost_id", "id", score.alias("score")).filter(F.col("score") >= ATTACH)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("lost_id").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= top)


def ignore_match(files: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """file, ignored by a list of (pattern, negated) of which the last that matches wins; none matching keeps."""
    verdict = F.lit(False)
    for pattern, negated in rules:
        verdict = F.when(F.col("file").rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return files.select("file").distinct().withColumn("ignored", verdict)
