"""Scans, filters, set operations and maintenance over node, edge and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph

# fixed values: the least confidence of a link that is kept, and relations along which a change spreads
LINK_THRESHOLD = 0.4
DEPENDENT_RELS = ("calls", "imports", "inherits", "implements", "references", "injects")


def scan(rows: DataFrame, *, kinds: list[str] | None = None, rels: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rows of some kinds, relations or ids (column id); equality filters reach the scan, ids are a semi join."""
    if kinds is not None:
        rows = rows.filter(F.col("kind").isin(*kinds))
    if rels is not None:
        rows = rows.filter(F.lower(F.trim("rel")).isin(*rels))
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def confident(edges: DataFrame, *, extracted_only: bool = True, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """Edges at or above a confidence, of extracted provenance where asked; a null confidence is below any."""
    e = edges.filter(F.col("confidence") >= threshold)
    return e.filter("provenance = 'EXTRACTED'") if extracted_only else e


def redact_values(json: Column) -> Column:
    """A JSON object with its keys in order and every value null; null where it is not an object."""
    keys = F.array_sort(F.json_object_keys(json))
    return F.when(keys.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('": null'))), ", "), F.lit("}")))


def id_parts(id_: Column) -> dict[str, Column]:
    """prefix, path, name and line of a node id ``prefix:path#name@Lline``; parts that are missing are null."""
    part = lambda p: F.nullif(F.regexp_extract(id_, p, 1), F.lit(""))
    return {"prefix": part(r"^([a-z]+):"), "path": part(r"^[a-z]+:([^#@]+)"), "name": part(r"#([^@]+)"), "line": part(r"@L(\d+)$").cast("int")}


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when ``files`` (column file) go: their nodes, and every edge that touches one of those."""
    gone = files.select("file").distinct()
    lost = nodes.join(gone, "file", "left_semi").select("id").filter("id is not null").distinct()
    left = nodes.join(gone, "file", "left_anti")
    kept = edges.join(lost.select(F.col("id").alias("src")), "src", "left_anti").join(lost.select(F.col("id").alias("dst")), "dst", "left_anti")
    return left, kept


def update_scope(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """file, reason of what a change of ``changed`` (column file) touches: itself, and files that depend on it."""
    c = changed.select("file").dropna().distinct()
    place = nodes.filter("id is not null and file is not null").groupBy("id").agg(F.min("file").alias("file"))
    hit = place.join(c, "file", "left_semi").select(F.col("id").alias("dst"))
    e = graph.tidy_edges(edges).filter(F.col("rel").isin(*DEPENDENT_RELS))
    users = e.join(hit, "dst", "left_semi").select("src").distinct().join(place.withColumnRenamed("id", "src"), "src").select("file").distinct()
    return c.withColumn("reason", F.lit("changed")).unionByName(users.join(c, "file", "left_anti").withColumn("reason", F.lit("dependent")))


def apply_delta(nodes: DataFrame, removed: DataFrame, changed: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Nodes (id, hash) with ``removed`` (id) taken out and ``changed`` (id, hash) put in, and vectors still good.

    A vector is stale when its node was removed or came with another hash.  Repeated rows count once.
    """
    old = nodes.filter("id is not null").groupBy("id").agg(F.min("hash").alias("hash"))
    new = changed.groupBy("id").agg(F.min("hash").alias("hash"))
    left = old.join(removed.select("id").distinct(), "id", "left_anti").join(new.select("id"), "id", "left_anti").unionByName(new)
    if vectors is None:
        return left, None
    same = left.join(old.withColumnRenamed("hash", "_h"), "id").filter(F.col("hash").eqNullSafe(F.col("_h"))).select("id")
    return left, vectors.join(same, "id", "left_semi")


def cluster_issues(nodes: DataFrame) -> DataFrame:
    """issue, id: members of clusters that are not there, nodes of several clusters, clusters without a member."""
    n = nodes.filter("id is not null").select("id", "kind", "cluster_id").distinct()
    clusters = n.filter("kind = 'cluster'").select("id").distinct()
    members = n.filter("kind <> 'cluster' and cluster_id is not null")
    unknown = members.select("id", F.col("cluster_id").alias("c")).join(clusters.withColumnRenamed("id", "c"), "c", "left_anti").select("id").distinct()
    several = members.groupBy("id").agg(F.countDistinct("cluster_id").alias("n")).filter("n > 1").select("id")
    empty = clusters.join(members.select(F.col("cluster_id").alias("id")), "id", "left_anti")
    tag = lambda df, t: df.select(F.lit(t).alias("issue"), "id")
    return tag(unknown, "unknown-cluster").unionByName(tag(several, "several-clusters")).unionByName(tag(empty, "empty-cluster"))


def orphans(rows: DataFrame, nodes: DataFrame, id_: str = "id") -> DataFrame:
    """Rows whose id is no node's; rows without an id are orphans too."""
    alive = nodes.select(F.col("id").alias(id_)).filter(F.col(id_).isNotNull()).distinct()
    return rows.join(alive, id_, "left_anti")


def merge_records(ours: DataFrame, theirs: DataFrame, *, key: str, content: list[str]) -> DataFrame:
    """key, outcome of a merge of records that never change: 'same', 'ours', 'theirs', or 'conflict' where they differ.

    Of rows that repeat a key the least content counts; null is a value like others.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content]), 256)
    a = ours.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("a"))
    b = theirs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("b"))
    return a.join(b, key, "full").select(key, F.when(F.col("b").isNull(), "ours").when(F.col("a").isNull(), "theirs").when(F.col("a") == F.col("b"), "same").otherwise("conflict").alias("outcome"))


def page(rows: DataFrame, *, key: list[str], order: list[Column], cursor: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows of one page of every key with ``place``; ``truncated`` where more follow, ``next_cursor`` on its last row."""
    w = Window.partitionBy(*key).orderBy(*order)
    # of a busy key only what the page and one row more may need goes to the last window
    salt = Window.partitionBy(*key, F.pmod(F.xxhash64(cursor), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(salt)).filter(F.col("_r") <= offset + limit + 1).drop("_r")
    r = rows.withColumn("place", F.row_number().over(w)).withColumn("_more", F.lead(F.lit(True)).over(w))
    r = r.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
    last = F.col("place") == offset + limit
    return r.withColumn("truncated", last & F.coalesce("_more", F.lit(False))).withColumn("next_cursor", F.when(F.col("truncated"), F.col(cursor))).drop("_more")


def nearest_rank(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, n, total, mean, least, p50, p95, most of a number; percentiles are values that occur, by nearest rank."""
    v = F.col(value)
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by `{value}`)")
    return rows.groupBy(*key).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), at(0.5).cast("bigint").alias("p50"), at(0.95).cast("bigint").alias("p95"), F.max(v).alias("most"))


def latest_artifact(artifacts: DataFrame, nodes: DataFrame, schema: str) -> DataFrame:
    """target, artifact_id, stale: of each target's artifacts those of the current schema first, then the latest.

    ``artifacts``: artifact_id, target, schema, made_at, target_hash.  Stale are those made of another hash of
    the target, or of a target that is gone.  Ties go to the least artifact_id.
    """
    merit = F.struct(~F.col("schema").eqNullSafe(schema), (-F.coalesce("made_at", F.lit(0))).alias("t"), "artifact_id")
    best = artifacts.filter("target is not null").groupBy("target").agg(F.min_by(F.struct("artifact_id", "target_hash"), merit).alias("b")).select("target", "b.*")
    live = nodes.filter("id is not null").groupBy(F.col("id").alias("target")).agg(F.min("hash").alias("_h"), F.lit(True).alias("_live"))
    return best.join(live, "target", "left").select("target", "artifact_id", (F.col("_live").isNull() | ~F.col("_h").eqNullSafe(F.col("target_hash"))).alias("stale"))


def doc_links(nodes: DataFrame, edges: DataFrame, rels: tuple[str, ...] = ("describes", "references")) -> DataFrame:
    """node_id, doc_id, heading, rel: the sections that speak of a node."""
    docs = nodes.filter("kind = 'doc-section' and id is not null").groupBy(F.col("id").alias("doc_id")).agg(F.min("heading").alias("heading"))
    e = graph.tidy_edges(edges).filter(F.col("rel").isin(*rels)).select(F.col("src").alias("doc_id"), F.col("dst").alias("node_id"), "rel")
    return e.join(docs, "doc_id").select("node_id", "doc_id", "heading", "rel")


def class_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """class_id, n_members, n_routes, n_produces, n_dependencies, n_dependents of every class and interface.

    The scope of a class is itself and what is a member of it.  Routes are those that call into the scope;
    dependencies and dependents are the distinct nodes outside it that it uses, and that use it.
    """
    n = nodes.filter("id is not null").groupBy("id").agg(F.min("kind").alias("kind"), F.min("node_type").alias("t"))
    classes = n.filter(graph.derived_kind(F.col("kind"), F.col("t")).isin("class", "interface")).select(F.col("id").alias("class_id"))
    e = graph.tidy_edges(edges)
    members = e.filter("rel = 'member-of' and src <> dst").select(F.col("dst").alias("class_id"), F.col("src").alias("id")).join(classes, "class_id", "left_semi")
    scope = members.unionByName(classes.select("class_id", F.col("class_id").alias("id"))).distinct()
    uses = e.filter(F.col("rel").isin("calls", "imports", "inherits", "implements", "injects")).select("src", "dst").distinct()
    routes = n.filter("kind = 'route'").select(F.col("id").alias("src"), F.lit(True).alias("_r"))
    out = scope.join(uses, F.col("id") == F.col("src")).select("class_id", F.col("dst").alias("other"))
    into = scope.join(uses, F.col("id") == F.col("dst")).select("class_id", F.col("src").alias("other"))
    outside = lambda df: df.distinct().join(scope.select("class_id", F.col("id").alias("other")), ["class_id", "other"], "left_anti")
    into = outside(into).join(routes, F.col("other") == F.col("src"), "left")
    made = scope.join(e.filter("rel = 'produces'"), F.col("id") == F.col("src")).groupBy("class_id").agg(F.countDistinct("dst").alias("n_produces"))
    facts = (
        classes.join(members.groupBy("class_id").agg(F.countDistinct("id").alias("n_members")), "class_id", "left")
        .join(into.groupBy("class_id").agg(F.count("_r").alias("n_routes"), F.count(F.lit(1)).alias("n_dependents")), "class_id", "left")
        .join(made, "class_id", "left")
        .join(outside(out).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_dependencies")), "class_id", "left")
    )
    return facts.fillna(0).select("class_id", "n_members", "n_routes", "n_produces", "n_dependencies", "n_dependents")


def guard_chains(edges: DataFrame) -> DataFrame:
    """id, depth, outermost, guard, branch, in_loop, in_exception of every edge under conditions; the guard is the innermost."""
    e = edges.filter("id is not null and cfg_path is not null and size(cfg_path) > 0")
    e = e.groupBy("id").agg(F.min(F.struct("cfg_path", "branch")).alias("r"), F.bool_or(F.coalesce("in_loop", F.lit(False))).alias("in_loop"), F.bool_or(F.coalesce("in_exception", F.lit(False))).alias("in_exception"))
    path = F.col("r.cfg_path")
    return e.select("id", F.size(path).alias("depth"), path[0].alias("outermost"), F.element_at(path, -1).alias("guard"), F.coalesce("r.branch", F.lit("")).alias("branch"), "in_loop", "in_exception")


def scope_dossier(nodes: DataFrame, scope: Column, *, limit: int = 5) -> DataFrame:
    """scope, n_nodes, n_symbols, n_routes, first_ids, truncated: what stands in a scope, with its first ids.

    Ids are ranked within salts first, so a scope of any size is spread over tasks.
    """
    n = nodes.filter("id is not null").select("id", "kind", scope.alias("scope")).filter("scope is not null").groupBy("scope", "id").agg(F.min("kind").alias("kind"))
    counts = n.groupBy("scope").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("kind") == "symbol", 1)).alias("n_symbols"), F.count(F.when(F.col("kind") == "route", 1)).alias("n_routes"))
    few = graph.top_ranked(n.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64))), ["scope", "_s"], [F.col("id")], limit, "_r")
    first = graph.top_ranked(few, ["scope"], [F.col("id")], limit, "_r").groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))
    return counts.join(first, "scope").select("scope", "n_nodes", "n_symbols", "n_routes", "first_ids", (F.col("n_nodes") > limit).alias("truncated"))
