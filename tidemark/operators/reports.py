"""Reports over the code graph: coverage, gaps, functional maps, rules, dossiers, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph


def _nodes(nodes: DataFrame) -> DataFrame:
    cols = [c for c in nodes.columns if c not in ("id", "meta")]
    return nodes.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in cols], F.min("meta").alias("meta"))


def callable_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, counts of what hangs below each symbol by kind, readiness: complete, partial or unimplemented."""
    e = graph.tidy_edges(edges).filter("rel = 'member-of'").select("src", "dst").distinct()
    n = _nodes(nodes).select("id", "kind")
    parts = e.join(n.select(F.col("id").alias("src"), F.col("kind").alias("k")), "src").groupBy(F.col("dst").alias("id"))
    c = parts.agg(*[F.count_if(F.col("k") == k).alias(name) for k, name in (("statement", "n_statements"), ("raise", "n_raises"), ("cursor", "n_cursors"), ("condition", "n_conditions"), ("exception-handler", "n_handlers"), ("assignment", "n_assignments"))])
    out = n.filter("kind = 'symbol'").select("id").join(c, "id", "left").fillna(0)
    body = F.col("n_statements") + F.col("n_assignments")
    return out.withColumn("readiness", F.when((body > 0) & (F.col("n_conditions") > 0), "complete").when(body + F.col("n_conditions") + F.col("n_cursors") > 0, "partial").otherwise("unimplemented"))


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, gap: calls to no symbol, symbols that execute nothing, routes without a handler, statements in no symbol."""
    n, e = _nodes(nodes).select("id", "kind"), graph.tidy_edges(edges)
    sym = n.filter("kind = 'symbol'").select("id")
    unresolved = e.filter("rel = 'calls'").select(F.col("dst").alias("id")).distinct().join(n.select("id"), "id", "left_anti").select("id", F.lit("unresolved-call").alias("gap"))
    idle = sym.join(e.filter("rel = 'executes'").select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit("executes-nothing").alias("gap"))
    routes = n.filter("kind = 'route'").select("id").join(e.filter("rel = 'calls'").select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit("route-without-call").alias("gap"))
    loose = n.filter("kind = 'statement'").select("id").join(e.filter("rel = 'member-of'").select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit("loose-statement").alias("gap"))
    return unresolved.unionByName(idle).unionByName(routes).unionByName(loose)


def functional_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """module, counts by kind, importance, top_symbol: each top folder of the graph in order of importance."""
    n = _nodes(nodes).filter("file is not null").select("id", "kind", "name", F.split_part("file", F.lit("/"), F.lit(1)).alias("module"))
    imp = graph.importance(nodes, edges).select(F.col("node_id").alias("id"), "importance")
    j = n.join(imp, "id", "left").fillna(0.0, ["importance"])
    g = j.groupBy("module").agg(
        F.count_if(F.col("kind") == "file").alias("n_files"), F.count_if(F.col("kind") == "symbol").alias("n_symbols"), F.count_if(F.col("kind") == "route").alias("n_routes"), F.count_if(F.col("kind") == "doc-section").alias("n_docs"),
        F.round(F.sum("importance"), 4).alias("importance"), F.min(F.struct((-F.col("importance")).alias("i"), "id")).alias("t"),
    )
    return g.select("module", "n_files", "n_symbols", "n_routes", "n_docs", "importance", F.col("t.id").alias("top_id"))


def decision_rules(edges: DataFrame) -> DataFrame:
    """src, action, rel, conditions, innermost, polarity: guarded calls and executions with their conditions in order."""
    e = edges.filter("cfg_path is not null and src is not null and dst is not null").withColumn("rel", F.lower(F.trim("rel"))).filter("rel in ('calls', 'executes')")
    row = F.struct(F.array_join("cfg_path", ";").alias("conditions"), F.element_at("cfg_path", -1).alias("innermost"), F.coalesce("branch", F.lit("")).alias("polarity"), F.coalesce("in_loop", F.lit(False)).alias("in_loop"))
    return e.select("src", F.col("dst").alias("action"), "rel", row.alias("r")).distinct().select("src", "action", "rel", "r.*")


def owner_module(nodes: DataFrame) -> DataFrame:
    """cluster_id, module, n: the top folder that most of a cluster's files lie in; ties to the least name."""
    n = _nodes(nodes).filter("cluster_id is not null and file is not null")
    c = n.groupBy("cluster_id", F.split_part("file", F.lit("/"), F.lit(1)).alias("module")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "module")).alias("b")).select("cluster_id", F.col("b.module").alias("module"), (-F.col("b.n")).alias("n"))


def cluster_digest(nodes: DataFrame) -> DataFrame:
    """cluster_id, n_members, digest: a hash over the sorted hashes of a cluster's members.

    Members are hashed within 256 buckets first and the bucket digests then, so no cluster is gathered whole.
    """
    n = _nodes(nodes).filter("cluster_id is not null").select("cluster_id", "id", F.coalesce("hash", F.lit("")).alias("h"))
    part = n.groupBy("cluster_id", F.substring(F.md5("id"), 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "id", "h"))), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return part.groupBy("cluster_id").agg(F.sum("n").alias("n_members"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "b", "d"))), "\n"), 256).alias("digest"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: nodes by kind and edges by relation."""
    a = _nodes(nodes).groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    b = graph.tidy_edges(edges).groupBy(F.lit("edge").alias("what"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def recursion(edges: DataFrame) -> DataFrame:
    """id of every node that calls itself."""
    return graph.tidy_edges(edges).filter("rel = 'calls' and src = dst").select(F.col("src").alias("id")).distinct()


def basic_blocks(nodes: DataFrame) -> DataFrame:
    """file, block, start, end, n: runs of statements and assignments of a file between conditions and handlers."""
    n = _nodes(nodes).filter("kind in ('statement', 'assignment', 'raise', 'condition', 'exception-handler') and file is not null and span_start is not null")
    line = Window.partitionBy("file").orderBy("span_start", "id")
    cut = F.col("kind").isin("condition", "exception-handler")
    b = n.withColumn("block", F.sum(cut.cast("int")).over(line)).filter(~cut)
    return b.groupBy("file", "block").agg(F.min("span_start").alias("start"), F.max("span_start").alias("end"), F.count(F.lit(1)).alias("n"))


def file_category(nodes: DataFrame) -> DataFrame:
    """category, n: files under tests, fixtures or the project itself."""
    f = nodes.filter("kind = 'file' and file is not null").select("file").distinct()
    c = F.when(F.col("file").rlike(r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$"), "tests").when(F.col("file").rlike("(^|/)fixtures?/"), "fixtures").otherwise("project")
    return f.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def mermaid(edges: DataFrame, rel: str) -> DataFrame:
    """src, lines: each node's edges of a relation as diagram lines; the busiest node's lines stay apart in chunks."""
    e = graph.tidy_edges(edges).filter(F.col("rel") == rel).withColumn("chunk", F.pmod(F.xxhash64("dst"), F.lit(16)))
    line = F.concat_ws(" --> ", F.concat(F.lit('"'), F.col("src"), F.lit('"')), F.concat(F.lit('"'), F.col("dst"), F.lit('"')))
    return e.groupBy("src", "chunk").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def ranked(df: DataFrame, part: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
