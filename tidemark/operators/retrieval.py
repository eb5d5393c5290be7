"""Ranked retrieval: BM25, TF-IDF, cosine, rank fusion, reranking, budgets and quality metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import skew

K1, B = 1.2, 0.75
RRF_K = 60


def bm25(docs: DataFrame, queries: DataFrame, *, k: int = 10, fields: dict[str, float] | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc id, score, rank: the k best documents of each query by Okapi BM25; ties by id.

    ``queries``: query_id, term; a stated set of queries.  A term of three letters or more matches every token
    that begins with it, and each such token scores by its own frequency, once a query.  ``fields`` weighs the
    term frequencies of several columns.  Only tokens that some query asks for leave the scan; lengths are
    counted where the text is read.
    """
    fields = fields or {text: 1.0}
    weighted = [(T.terms(F.coalesce(F.col(c), F.lit(""))), w) for c, w in fields.items()]
    d = docs.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("_id"), *[t.alias(f"_t{i}") for i, (t, _) in enumerate(weighted)])
    length = sum((F.size(f"_t{i}") * w for i, (_, w) in enumerate(weighted)), F.lit(0.0))
    d = d.withColumn("_len", length)
    asked = queries.select(F.col("term").alias("_ask"), F.substring("term", 1, 3).alias("_h")).distinct()
    begins = lambda q: (F.substring("term", 1, 3) == q["_h"]) & F.col("term").startswith(q["_ask"])
    few = F.broadcast(asked)  # a stated query set
    posted = None
    for i, (_, w) in enumerate(weighted):
        p = d.select("_id", "_len", F.explode(f"_t{i}").alias("term")).join(few, begins(few), "left_semi").groupBy("_id", "_len", "term").agg((F.count(F.lit(1)) * w).alias("tf"))
        posted = p if posted is None else posted.unionByName(p)
    posted = posted.groupBy("_id", "_len", "term").agg(F.sum("tf").alias("tf"))
    stats = d.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    s = posted.join(df, "term").crossJoin(F.broadcast(stats))  # one row of two numbers
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    wants = F.broadcast(queries.select("query_id", F.col("term").alias("_ask"), F.substring("term", 1, 3).alias("_h")).distinct())
    asks = df.select("term").join(wants, begins(wants)).select("query_id", "term").distinct()
    scored = s.select("_id", "term", part.alias("part")).join(asks, "term")
    total = scored.groupBy("query_id", "_id").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_id"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("_id").alias(id_), "score", "rank")


def document_frequency(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """term, df, idf = ln(1 + N / (1 + df)) over all documents with a text."""
    d = docs.filter(F.col(text).isNotNull())
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    df = d.select(F.explode(F.array_distinct(T.terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log(1 + F.col("_n") / (1 + F.col("df"))), 6).alias("idf"))


def tfidf_links(left: DataFrame, right: DataFrame, *, k: int = 5, floor: float = 0.1) -> DataFrame:
    """left_text, right_text, similarity, rank: the k most similar right texts of each left text.

    Both sides have a column ``text``; equal texts are one class, so copies multiply nothing.  Cosine of
    tf-idf vectors over the terms of the distinct texts of both sides; below ``floor`` nothing is linked.
    """
    sides = left.select("text", F.lit(0).alias("side")).unionByName(right.select("text", F.lit(1).alias("side"))).dropna().distinct()
    n = sides.agg(F.count(F.lit(1)).alias("_n"))
    tf = sides.select("text", "side", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("text", "side", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    w = tf.join(df, "term").select("text", "side", "term", (F.col("tf") * F.log(1 + F.col("_n") / (1 + F.col("df")))).alias("w"))
    norm = w.groupBy("text", "side").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    u = w.join(norm, ["text", "side"]).select("text", "side", "term", (F.col("w") / F.col("norm")).alias("u"))
    a = u.filter("side = 0").select(F.col("text").alias("left_text"), "term", F.col("u").alias("ua"))
    b = u.filter("side = 1").select(F.col("text").alias("right_text"), "term", F.col("u").alias("ub"))
    sim = a.join(b, "term").groupBy("left_text", "right_text").agg(F.round(F.sum(F.col("ua") * F.col("ub")), 6).alias("similarity")).filter(F.col("similarity") >= floor)
    rank = F.row_number().over(Window.partitionBy("left_text").orderBy(F.col("similarity").desc(), "right_text"))
    return sim.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, *, k: int = 5, block: int = 50_000, id_: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, id, cosine, rank: exact k nearest rows of a stated set of queries, in blocks of queries.

    Each block is held by every task as one matrix of bounded size; a task keeps k rows a query and the
    merges are small.  A query's own row is left out.
    """
    ids = [r[0] for r in queries.select(id_).distinct().orderBy(id_).collect()]
    out = None
    for i in range(0, len(ids), block):
        part = queries.filter(F.col(id_).isin(*ids[i : i + block])) if len(ids) > block else queries
        pdf = part.select(id_, vec).dropDuplicates([id_]).toPandas()
        q = _unit(np.array(pdf[vec].tolist(), np.float64).reshape(len(pdf), -1))
        qid = pdf[id_].to_numpy()
        found = _topk_against(vectors, vectors.sparkSession.sparkContext.broadcast((qid, q)), k, id_, vec)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, near bigint, cosine double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "near"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _topk_against(vectors: DataFrame, shared, k: int, id_: str, vec: str) -> DataFrame:
    def run(frames):
        qid, q = shared.value
        for f in frames:
            if not len(f):
                continue
            x, ids = _unit(np.array(f["_v"].tolist(), np.float64)), f["_id"].to_numpy()
            for j in range(0, len(qid), 256):
                sims = np.round(q[j : j + 256] @ x.T, 6)
                sims[qid[j : j + 256, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
                s = np.take_along_axis(sims, order, 1)
                r, c = np.nonzero(np.isfinite(s))
                yield pd.DataFrame({"query_id": qid[j : j + 256][r], "near": ids[order[r, c]], "cosine": s[r, c]})

    v = vectors.select(F.col(id_).cast("bigint").alias("_id"), F.col(vec).alias("_v")).dropna()
    return v.mapInPandas(run, "query_id bigint, near bigint, cosine double")


def rrf(*ranked: DataFrame, key: str = "query_id", item: str = "doc_id", k: int = RRF_K, limit: int = 10) -> DataFrame:
    """key, item, score, rank: reciprocal rank fusion of lists with a column ``rank`` from 1."""
    both = None
    for r in ranked:
        r = r.select(key, item, "rank")
        both = r if both is None else both.unionByName(r)
    s = both.groupBy(key, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), item))
    return s.withColumn("rank", rank).filter(F.col("rank") <= limit)


def weighted_fusion(lexical: DataFrame, semantic: DataFrame, *, alpha: float = 0.5, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """key, item, score: alpha times the lexical score over its best, and the rest times the positive semantic one."""
    a = lexical.select(key, item, (F.col("score") / F.max("score").over(Window.partitionBy(key))).alias("a"))
    b = semantic.select(key, item, F.greatest(F.col("score"), F.lit(0.0)).alias("b"))
    s = a.join(b, [key, item], "full").select(key, item, F.round(alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    return s.filter("score > 0")


def interleave(first: DataFrame, second: DataFrame, *, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """key, item, place: two ranked lists dealt alternately, the second's own items first; an item is listed once."""
    own = second.join(first.select(key, item), [key, item], "left_anti").select(key, item, "rank")
    own = own.select(key, item, F.row_number().over(Window.partitionBy(key).orderBy("rank")).alias("n"), F.lit(0).alias("s"))
    both = own.unionByName(first.select(key, item, F.col("rank").alias("n"), F.lit(1).alias("s")))
    return both.select(key, item, F.row_number().over(Window.partitionBy(key).orderBy("n", "s")).alias("place"))


# fixed values: stems that mark an action, and what a kind is worth by what a query asks for
ACTION_STEMS = (
    "assess", "valid", "process", "evalu", "decid", "decise", "class", "classif", "auth", "grant", "hash", "verif", "verify", "issue", "login",
    "approve", "approv", "deny", "review", "make", "creat", "handle", "handl", "route", "push", "authoriz", "evaluate",
)
INTENTS = (("location", r"\bwhere\b"), ("behavior", r"\bhow\b"), ("entity", r"\b(what|which)\b"))
KIND_PRIOR = {
    "location": {"symbol": 1.1, "route": 1.05, "file": 0.9, "doc-section": 0.85},
    "behavior": {"symbol": 1.08, "route": 1.04, "file": 0.9, "doc-section": 0.85},
    "entity": {"symbol": 1.08, "route": 1.08, "component": 1.04, "file": 0.92, "doc-section": 0.88},
}


def intent(query: Column) -> Column:
    """What a query asks for, by its first matching question word; 'unknown' without one."""
    out = F.lit("unknown")
    for name, pattern in reversed(INTENTS):
        out = F.when(F.lower(query).rlike(pattern), name).otherwise(out)
    return out


def structural_rerank(hits: DataFrame, *, key: str = "query_id", query: str = "query") -> DataFrame:
    """key, id, score, rank of hits (key, query, id, kind, name, degree, score) with structural priors; ties by id.

    A hit gains with its degree, by a fifth if a stem of an action stands both in the query and in its name, and
    by its kind as the intent of the query values it.
    """
    prior = F.lit(1.0)
    for name, kinds in KIND_PRIOR.items():
        for kind, v in kinds.items():
            prior = F.when((F.col("_intent") == name) & (F.col("kind") == kind), v).otherwise(prior)
    q, n = F.lower(F.coalesce(F.col(query), F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    action = F.lit(False)
    for s in ACTION_STEMS:
        action = action | (F.contains(q, F.lit(s)) & F.contains(n, F.lit(s)))
    degree = F.greatest(F.coalesce("degree", F.lit(0)), F.lit(0))
    score = F.col("score") * (1 + 0.03 * F.log2(1 + degree)) * F.when(action, 1.2).otherwise(1.0) * prior
    s = hits.withColumn("_intent", intent(F.col(query))).select(key, "id", F.round(score, 5).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "id")))


def exact_first(exact: DataFrame, ranked: DataFrame, *, key: str = "query_id", item: str = "id", offset: int = 0, limit: int = 10) -> DataFrame:
    """key, item, place: exact hits in their order, then the ranked ones that are not among them, then the page."""
    rest = ranked.join(exact.select(key, item), [key, item], "left_anti").select(key, item, F.lit(1).alias("_s"), "rank")
    both = exact.select(key, item, F.lit(0).alias("_s"), "rank").unionByName(rest)
    place = both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_s", "rank", item)))
    return place.filter((F.col("place") > offset) & (F.col("place") <= offset + limit)).select(key, item, "place")


def graph_seeds(nodes: DataFrame, queries: DataFrame, *, k: int = 5, id_: str = "id", text: str = "text") -> DataFrame:
    """query_id, id, score, rank: the k nodes that share most stemmed terms with a query, as a share of the query's.

    ``queries``: query_id, q; a stated set.  Nodes without a text, and with no term in common, are none.
    """
    stems = lambda c: F.array_distinct(F.transform(T.terms(c), T.stem))
    q = queries.select("query_id", stems(F.col("q")).alias("_t")).withColumn("_n", F.size("_t")).filter("_n > 0").select("query_id", "_n", F.explode("_t").alias("term"))
    n = nodes.filter(F.col(id_).isNotNull() & F.col(text).isNotNull()).groupBy(id_).agg(F.min(text).alias("_x")).select(id_, F.explode(stems(F.col("_x"))).alias("term"))
    hit = n.join(F.broadcast(q), "term").groupBy("query_id", id_, "_n").agg(F.count(F.lit(1)).alias("_m"))  # a stated query set
    s = hit.select("query_id", id_, F.round(F.col("_m") / F.col("_n"), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_))).filter(F.col("rank") <= k)


def fuse_seeds(*channels: DataFrame, k: int = 5, key: str = "query_id", item: str = "id") -> DataFrame:
    """key, item, score, rank: ranks of all channels fused by reciprocals; the best seed of a query scores 1."""
    every = channels[0].select(key, item, "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select(key, item, "rank"))
    s = every.groupBy(key, item).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("_s"))
    s = s.select(key, item, F.round(F.col("_s") / F.max("_s").over(Window.partitionBy(key)), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), item))).filter(F.col("rank") <= k)


def file_prior(hits: DataFrame, weights: DataFrame, *, key: str = "query_id") -> DataFrame:
    """key, id, score: ``1 / (9 + rank) * (1 + w)`` with w, from 0 to 1, of the hit's file (columns file, w)."""
    h = hits.join(weights.select("file", "w"), "file", "left")
    return h.select(key, "id", F.round((1.0 / (9 + F.col("rank"))) * (1 + F.least(F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))), 6).alias("score"))


def budget_prefix(items: DataFrame, *, group: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """``items`` of each group in order as long as their running token estimate stays within the budget.

    ``used`` is the running sum.  The first item that does not fit ends its group's prefix.  Null texts cost 0,
    items without a group are a group.  The texts themselves are dropped before anything moves.
    """
    costed = items.withColumn("_cost", F.coalesce(T.token_estimate(F.col(text)), F.lit(0))).drop(text)
    return skew.running_sum(costed, [group], order, F.col("_cost"), "used").drop("_cost").filter(F.col("used") <= budget)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, *, k: int = 10, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """key, n_relevant, recall, precision, mrr, ndcg at k; queries without a relevant item are left out."""
    rel = relevant.select(key, item).distinct()
    n = rel.groupBy(key).agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = ranked.filter(F.col("rank") <= k).join(rel, [key, item]).groupBy(key).agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    m = n.join(hit, key, "left").fillna(0, ["h", "dcg"])
    return m.select(
        key, "n_relevant", F.round(F.col("h") / F.col("n_relevant"), 6).alias("recall"), F.round(F.col("h") / F.lit(k), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def fnv1a(windows: np.ndarray | bytes) -> np.ndarray | int:
    """32-bit FNV-1a of every row of an array of bytes, or of one text of bytes."""
    if isinstance(windows, bytes):
        return int(fnv1a(np.frombuffer(windows, np.uint8).reshape(1, -1))[0])
    h = np.full(len(windows), 0x811C9DC5, np.uint64)
    for column in windows.T:
        h = ((h ^ column.astype(np.uint64)) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    return h


def char_ngram_vectors(texts: list[str], dim: int = 512, low: int = 3, high: int = 6) -> np.ndarray:
    """[texts, dim] unit vectors of signed hash buckets of the character n-grams of lower-cased texts with borders.

    All n-grams of a length are hashed at once; characters of several bytes are grouped by their length in bytes.
    """
    out = np.zeros((len(texts), dim), np.float32)
    for n in range(low, high + 1):
        grams: dict[int, tuple[list[bytes], list[int]]] = {}
        for i, text in enumerate(texts):
            t = f" {text.lower().strip()} "
            for j in range(len(t) - n + 1):
                g = t[j : j + n].encode("utf-8", "surrogatepass")
                parts, owners = grams.setdefault(len(g), ([], []))
                parts.append(g)
                owners.append(i)
        for width, (parts, owners) in grams.items():
            h = fnv1a(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width))
            np.add.at(out, (owners, (h % np.uint64(dim)).astype(np.int64)), np.where(h & np.uint64(0x80000000), 1.0, -1.0).astype(np.float32))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 0, out / np.maximum(norm, 1e-30), 0)


def char_ngram_vector(text: str, dim: int = 512, low: int = 3, high: int = 6) -> np.ndarray:
    return char_ngram_vectors([text], dim, low, high)[0]


def embed_names(names: DataFrame, *, text: str = "name", dim: int = 512) -> DataFrame:
    """text, vector of every distinct non-null text."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({text: f[text], "vector": list(char_ngram_vectors(f[text].tolist(), dim))})

    return names.select(text).dropna().distinct().mapInPandas(run, f"{text} string, vector array<float>")
