"""Change review and lookups over the code graph: what changed, who calls it, renames, dossiers, redaction, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph, skew


def one_per_id(nodes: DataFrame, *cols: str) -> DataFrame:
    return nodes.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in cols])


def detect_changes(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """what ('node' or 'edge'), id, role of everything that touches a changed file (column file)."""
    n = one_per_id(nodes, "file").join(changed.select("file").distinct(), "file", "left_semi").select("id")
    e = edges.filter("id is not null").select("id", "src", "dst").distinct()
    out = e.join(n.select(F.col("id").alias("src")), "src", "left_semi").select("id", F.lit("outgoing").alias("role"))
    into = e.join(n.select(F.col("id").alias("dst")), "dst", "left_semi").select("id", F.lit("incoming").alias("role"))
    touched = out.unionByName(into).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("role"))
    return n.select(F.lit("node").alias("what"), "id", F.lit("changed").alias("role")).unionByName(touched.select(F.lit("edge").alias("what"), "id", "role"))


def review(nodes: DataFrame, edges: DataFrame, changed: DataFrame, k: int = 50) -> DataFrame:
    """id, n_callers, rank: the k changed symbols with the most callers; ties by id."""
    n = one_per_id(nodes.filter("kind = 'symbol'"), "file").join(changed.select("file").distinct(), "file", "left_semi").select("id")
    calls = graph.tidy_edges(edges).filter("rel = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_callers"))
    top = n.join(calls, "id", "left").fillna(0, ["n_callers"]).orderBy(F.col("n_callers").desc(), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_callers").desc(), "id")))  # k rows


def rename_plan(nodes: DataFrame, edges: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """name, n_symbols, n_references, n_files, n_occurrences: what renaming each symbol name would touch.

    References are edges into symbols of that name, occurrences whole words in source texts.  Words are found
    by splitting each text once, not by searching it for every name.
    """
    asked = names.select("name").dropna().distinct()
    sym = one_per_id(nodes.filter("kind = 'symbol'"), "name").join(asked, "name", "left_semi")
    refs = graph.tidy_edges(edges).filter("rel in ('calls', 'references', 'imports')").join(sym.select(F.col("id").alias("dst"), "name"), "dst").groupBy("name").agg(F.count(F.lit(1)).alias("n_references"))
    words = sources.filter("body is not null").groupBy("file").agg(F.min("body").alias("body")).select("file", F.explode(F.split("body", "[^A-Za-z0-9_]+")).alias("name"))
    occ = words.join(asked, "name", "left_semi").groupBy("name").agg(F.countDistinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_occurrences"))
    n = sym.groupBy("name").agg(F.count(F.lit(1)).alias("n_symbols"))
    return n.join(refs, "name", "left").join(occ, "name", "left").fillna(0)


def dossier(nodes: DataFrame, edges: DataFrame, kind: str = "symbol") -> DataFrame:
    """id, relation counts both ways, n_docs and guards of every node of a kind."""
    n = one_per_id(nodes.filter(F.col("kind") == kind), "file").select("id")
    e = graph.tidy_edges(edges)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("rel") == "calls").alias("n_calls"), F.count_if(F.col("rel") == "reads").alias("n_reads"), F.count_if(F.col("rel") == "writes").alias("n_writes"), F.count_if(F.col("rel") == "raises").alias("n_raises"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("rel") == "calls").alias("n_callers"), F.count_if(F.col("rel").isin("describes", "references")).alias("n_docs"))
    return n.join(out, "id", "left").join(into, "id", "left").fillna(0)


def directory_buckets(nodes: DataFrame, share: float = 0.8) -> DataFrame:
    """bucket, n_files: files by top folder, by two folders if one top folder holds more than ``share`` of them."""
    f = nodes.filter("kind = 'file' and file is not null").select("file").distinct()
    one = F.split_part("file", F.lit("/"), F.lit(1))
    deep = F.concat_ws("/", one, F.split_part("file", F.lit("/"), F.lit(2)))
    top = f.groupBy(one.alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    b = f.crossJoin(F.broadcast(top)).select(F.when(F.col("most") > share * F.col("total"), deep).otherwise(one).alias("bucket"))  # one row of two numbers
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_files"))


def cluster_label(nodes: DataFrame) -> DataFrame:
    """cluster_id, prefix, dominant: the folders all files of a cluster share, and the commonest language."""
    n = one_per_id(nodes.filter("cluster_id is not null and file is not null"), "cluster_id", "file", "lang").withColumn("parts", F.split("file", "/"))
    size = n.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    part = n.select("cluster_id", F.posexplode(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("pos", "part"))
    shared = part.groupBy("cluster_id", "pos").agg(F.countDistinct("part").alias("d"), F.count(F.lit(1)).alias("c"), F.min("part").alias("part")).join(size, "cluster_id").filter("d = 1 and c = n")
    run = shared.withColumn("ok", F.col("pos") == F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos")) - 1).filter("ok")
    prefix = run.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda p: p["part"]), "/").alias("prefix"))
    lang = n.groupBy("cluster_id", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count(F.lit(1)).alias("c")).groupBy("cluster_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "lang")).alias("b"))
    return size.join(prefix, "cluster_id", "left").join(lang, "cluster_id").select("cluster_id", F.coalesce("prefix", F.lit("")).alias("prefix"), F.col("b.lang").alias("dominant"))


def redact(text: Column) -> Column:
    """Values of attributes that look secret replaced, placeholders ``${...}`` kept."""
    return F.regexp_replace(text, r"(?i)((?:password|secret|api_?key|credential)[a-z_]*\s*[=:]\s*)(?!\$\{)[^\s,;]+", "$1[redacted]")


def source_policy(lang: Column, text: Column) -> Column:
    """Denied text is null, restricted text is redacted, other text stays."""
    return F.when(lang.isin("binary", "minified"), F.lit(None).cast("string")).otherwise(redact(text))


def work_queue(items: DataFrame, *, group: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The prefix of each group whose costs stay within the budget; the first item always.

    Callers pass only the columns they need; ``cost`` is taken first.
    """
    q = skew.running_sum(skew.numbered(items.withColumn("_cost", cost), [group], order, "place"), [group], order, F.col("_cost"), "used").drop("_cost")
    return q.filter((F.col("used") <= budget) | (F.col("place") == 1))


def text_match(texts: DataFrame, words: list[str], fields: dict[str, int], k: int = 100) -> DataFrame:
    """id, score, rank: how many stated words each field contains, weighted by field; the k best, ties by id."""
    score = F.lit(0)
    for w in dict.fromkeys(x.lower() for x in words):
        for c, weight in fields.items():
            score = score + F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w)), weight).otherwise(0)
    top = texts.select("id", score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))  # k rows


def inherited(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, doc_id, from: a node's own document, else its file's, else its cluster's; ``own``: id, doc_id."""
    n = one_per_id(nodes, "file", "cluster_id")
    d = own.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    by_file = n.join(d, "id").groupBy("file").agg(F.min("doc_id").alias("f"))
    by_cluster = n.join(d, "id").filter("cluster_id is not null").groupBy("cluster_id").agg(F.min("doc_id").alias("c"))
    j = n.join(d, "id", "left").join(by_file, "file", "left").join(by_cluster, "cluster_id", "left")
    source = F.when(F.col("doc_id").isNotNull(), "own").when(F.col("f").isNotNull(), "file").when(F.col("c").isNotNull(), "cluster")
    return j.select("id", F.coalesce("doc_id", "f", "c").alias("doc_id"), source.alias("from")).filter("doc_id is not null")


def minmax_rerank(hits: DataFrame, again: DataFrame, *, key: str = "query_id", item: str = "doc_id", window: int = 50) -> DataFrame:
    """key, item, place: the first ``window`` hits in order of a second score (column again), the tail as it was."""
    h = hits.join(again.select(key, item, "again"), [key, item], "left")
    head = F.col("rank") <= window
    order = [F.when(head, 0).otherwise(1), F.when(head, -F.coalesce("again", F.lit(float("-inf")))), F.col("rank")]
    return h.select(key, item, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("place"))
