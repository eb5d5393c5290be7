"""Queries of the retrieval operators over the whole document, node and embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph, retrieval
from tidemark.sources import table

#: The stated queries of the ranking operators.
STATED = {"q1": "why is the lease export blocked", "q2": "digest changed after replay", "q3": "rejected alternative memory cost", "q4": "child process killed outage", "q5": "customer asked premium charter export"}

#: What kind of document each of them asks for.
WANTED = {"q1": "review-thread", "q2": "memory-claim", "q3": "decision", "q4": "checkpoint", "q5": "intake"}


def _queries(spark):
    q = spark.createDataFrame(list(STATED.items()), "query_id string, q string")
    return q.select("query_id", F.explode(F.array_distinct(T.terms(F.col("q")))).alias("term"))


def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _queries(spark))


def _bm25_kind(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), _queries(spark), fields={"text": 1.0, "doc_kind": 10.0})


def bm25_fields(spark, d):
    return _bm25_kind(spark, d)


def term_stats(spark, d):
    return retrieval.document_frequency(table(spark, d, "documents"))


def tfidf_link(spark, d):
    n = table(spark, d, "nodes")
    return retrieval.tfidf_links(n.filter("kind = 'doc-section'").select(F.col("heading").alias("text")), n.filter("kind = 'symbol'").select(F.col("name").alias("text")))


def rrf(spark, d):
    return retrieval.rrf(bm25_topk(spark, d), _bm25_kind(spark, d))


def weighted_fusion(spark, d):
    return retrieval.weighted_fusion(bm25_topk(spark, d), _bm25_kind(spark, d).withColumn("score", F.col("score") / 100))


def interleave(spark, d):
    return retrieval.interleave(bm25_topk(spark, d), _bm25_kind(spark, d))


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.cosine_topk(e, e.filter("vec_id % 50 = 0"))


def retrieval_metrics(spark, d):
    docs = table(spark, d, "documents")
    kinds = spark.createDataFrame(list(WANTED.items()), "query_id string, doc_kind string")
    relevant = docs.join(F.broadcast(kinds), "doc_kind").select("query_id", "doc_id")  # the stated queries
    return retrieval.ranking_metrics(bm25_topk(spark, d), relevant)


def token_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return retrieval.budget_prefix(docs, group="source", order=[F.col("doc_id")], text="text", budget=2_000).select("source", "doc_id", "used")


def exact_name(spark, d):
    """Names of all symbols looked up among all nodes: qualified, plain, then either without letter case."""
    cols = ("kind", "file", "name", "qualified_name")
    n = table(spark, d, "nodes").filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in cols])
    asked = n.filter("kind = 'symbol' and name is not null").select(F.col("name").alias("asked")).distinct()
    names = n.select("id", "kind", "file", F.explode(F.array(F.struct(F.lit(1).alias("t"), F.col("qualified_name").alias("k")), F.struct(F.lit(2).alias("t"), F.col("name").alias("k")), F.struct(F.lit(3).alias("t"), F.lower("qualified_name").alias("k")), F.struct(F.lit(4).alias("t"), F.lower("name").alias("k")))).alias("x")).select("id", "kind", "file", "x.t", "x.k")
    keys = asked.select("asked", F.explode(F.array(F.struct(F.lit(False).alias("ci"), F.col("asked").alias("k")), F.struct(F.lit(True).alias("ci"), F.lower("asked").alias("k")))).alias("x")).select("asked", "x.ci", "x.k")
    hit = names.join(keys, "k").filter((F.col("t") <= 2) != F.col("ci")).groupBy("asked", "id", "kind", "file").agg(F.min("t").alias("tier"))
    hit = hit.join(graph.degree(table(spark, d, "edges")).select(F.col("node_id").alias("id"), "degree"), "id", "left").fillna(0, ["degree"])
    order = [F.col("tier"), (F.col("kind") != "symbol"), F.coalesce("file", F.lit("")).rlike("(^|/)tests?/"), F.col("degree").desc(), F.col("id")]
    return graph.top_ranked(hit, ["asked"], order, 20).select("asked", "id", "tier", "degree", "rank")


#: How a name is asked for, by the length of the name, so that every intent occurs.
QUESTIONS = ("where is {} defined", "how does {} work", "what is {}", "{}")


def structural_rerank(spark, d):
    h = exact_name(spark, d).join(table(spark, d, "nodes").groupBy("id").agg(F.min("kind").alias("kind"), F.min("name").alias("name")), "id")
    asked, query = F.col("asked"), F.lit("")
    for i, q in enumerate(QUESTIONS):
        before, after = q.split("{}")
        query = F.when(F.length(asked) % len(QUESTIONS) == i, F.concat(F.lit(before), asked, F.lit(after))).otherwise(query)
    h = h.select(asked.alias("query_id"), query.alias("query"), "id", "kind", "name", "degree", (1.0 / F.col("rank")).alias("score"))
    return retrieval.structural_rerank(h)


def file_prior(spark, d):
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    files = n.groupBy("id").agg(F.min("file").alias("file"))
    churn = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("c")).join(files, "id").groupBy("file").agg(F.sum("c").alias("c"))
    top = churn.agg(F.max("c").alias("top"))
    w = churn.crossJoin(F.broadcast(top)).select("file", (F.log1p("c") / F.log1p("top")).alias("w"))  # one number
    h = exact_name(spark, d).select(F.col("asked").alias("query_id"), "id", "rank").join(files, "id")
    return retrieval.file_prior(h, w)


def name_vectors(spark, d):
    n = table(spark, d, "nodes").filter("kind = 'symbol'")
    return retrieval.embed_names(n)


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_fields, term_stats, tfidf_link, rrf, weighted_fusion, interleave, cosine_topk, retrieval_metrics, token_budget, exact_name, structural_rerank, file_prior, name_vectors)}

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _terms(x: str) -> str:
    return rf"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: len(w) >= 3 and w not in ({_STOP}))"""


_Q = "select query_id, unnest(list_distinct(" + _terms("q") + ")) as term from (values " + ", ".join(f"('{k}', '{v}')" for k, v in STATED.items()) + ") t(query_id, q)"


def _bm25(parts: str, length: str) -> str:
    return f"""with q as ({_Q}), l as (select doc_id, {length} as len from documents), p as ({parts}),
  x as (select distinct query_id, p.term from (select distinct term from p) p join q on starts_with(p.term, q.term)),
  t as (select p.doc_id, term, sum(w) as tf from p where term in (select term from x) group by all),
  f as (select term, count(*) df from t group by term), n as (select count(*) n, avg(len) a from l),
  s as (select query_id, t.doc_id, round(sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / n.a))), 6) as score
        from t join f using (term) join l using (doc_id) join x using (term), n group by all)
  select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 10"""


_TX = _terms("coalesce(text, '')")
_KX = _terms("coalesce(doc_kind, '')")
_BM25 = _bm25(f"select doc_id, unnest({_TX}) as term, 1.0 as w from documents", f"cast(len({_TX}) as double)")
_BM25K = _bm25(f"select doc_id, unnest({_TX}) as term, 1.0 as w from documents union all select doc_id, unnest({_KX}), 10.0 from documents", f"len({_TX}) * 1.0 + len({_KX}) * 10.0")
_NODES1 = "select id, min(kind) kind, min(file) file, min(name) name, min(qualified_name) qn, min(lang) lang from nodes where id is not null group by id"
_EXACT = f"""with n as ({_NODES1}), a as (select distinct name as asked from n where kind = 'symbol' and name is not null),
  g as (select node_id, count(*) degree from (select src as node_id, dst, rel2 from (select distinct src, dst, lower(trim(rel)) rel2 from edges) union all select dst, src, rel2 from (select distinct src, dst, lower(trim(rel)) rel2 from edges)) group by 1),
  h as (select asked, id, min(t) tier from (
      select asked, id, 1 t from a join n on n.qn = asked union all select asked, id, 2 from a join n on n.name = asked
      union all select asked, id, 3 from a join n on lower(n.qn) = lower(asked) union all select asked, id, 4 from a join n on lower(n.name) = lower(asked)) group by all),
  r as (select asked, h.id, tier, coalesce(degree, 0) as degree, row_number() over (partition by asked order by tier, kind <> 'symbol', regexp_matches(coalesce(file, ''), '(^|/)tests?/'), coalesce(degree, 0) desc, h.id) as rank
        from h join n using (id) left join g on g.node_id = h.id)
  select * from r where rank <= 20"""
_QUERY = "case " + " ".join(f"when length(asked) % {len(QUESTIONS)} = {i} then '" + q.replace("{}", "' || asked || '") + "'" for i, q in enumerate(QUESTIONS)) + " end"
_ACTION = " or ".join(f"(contains(lower(q), '{s}') and contains(lower(coalesce(name, '')), '{s}'))" for s in retrieval.ACTION_STEMS)
_INTENT = "case " + " ".join(f"when regexp_matches(lower(q), '{p}') then '{n}'" for n, p in retrieval.INTENTS) + " else 'unknown' end"
_PRIOR = "case " + " ".join(f"when intent = '{i}' and kind = '{k}' then {v}" for i, kinds in retrieval.KIND_PRIOR.items() for k, v in kinds.items()) + " else 1.0 end"
_WANTED = ", ".join(f"('{q}', '{k}')" for q, k in WANTED.items())

SQL = {
    "bm25_topk": _BM25,
    "bm25_fields": _BM25K,
    "term_stats": f"""with d as (select {_terms('text')} as t from documents where text is not null)
  select term, count(*) as df, round(ln(1 + (select count(*) from d) / (1 + count(*))), 6) as idf from (select unnest(list_distinct(t)) as term from d) group by term""",
    "tfidf_link": f"""with s as (select distinct heading as text, 0 as side from nodes where kind = 'doc-section' and heading is not null union select distinct name, 1 from nodes where kind = 'symbol' and name is not null),
  tf as (select text, side, term, count(*) tf from (select text, side, unnest({_terms('text')}) as term from s) group by all),
  df as (select term, count(*) df from tf group by term), n as (select count(*) n from s),
  w as (select text, side, term, tf * ln(1 + n.n / (1 + df.df)) as w from tf join df using (term), n),
  u as (select text, side, term, w / sqrt(sum(w * w) over (partition by text, side)) as u from w),
  m as (select a.text as left_text, b.text as right_text, round(sum(a.u * b.u), 6) as similarity from u a join u b on a.term = b.term and a.side = 0 and b.side = 1 group by all having round(sum(a.u * b.u), 6) >= 0.1)
  select * from (select *, row_number() over (partition by left_text order by similarity desc, right_text) as rank from m) where rank <= 5""",
    "rrf": f"""select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (
  select query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as score from (select * from ({_BM25}) union all select * from ({_BM25K})) group by all)) where rank <= 10""",
    "weighted_fusion": f"""with a as (select query_id, doc_id, score / max(score) over (partition by query_id) as a from ({_BM25})), b as (select query_id, doc_id, score / 100 as b from ({_BM25K}))
  select query_id, doc_id, round(0.5 * coalesce(a, 0) + 0.5 * coalesce(b, 0), 6) as score from a full join b using (query_id, doc_id)""",
    "interleave": f"""with a as ({_BM25}), b as ({_BM25K}),
  o as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as n, 0 as s from b where not exists (select 1 from a where a.query_id = b.query_id and a.doc_id = b.doc_id)),
  u as (select * from o union all select query_id, doc_id, rank, 1 from a)
  select query_id, doc_id, row_number() over (partition by query_id order by n, s) as place from u""",
    "cosine_topk": """with s as (select q.vec_id as query_id, e.vec_id as near, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 6) as cosine
    from embeddings q, embeddings e where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)
  select * from (select *, row_number() over (partition by query_id order by cosine desc, near) as rank from s) where rank <= 5""",
    "retrieval_metrics": f"""with r as ({_BM25}), w as (select * from (values {_WANTED}) t(query_id, doc_kind)), rel as (select query_id, doc_id from documents join w using (doc_kind)), c as (select query_id, count(*) n from rel group by 1),
  h as (select query_id, count(*) h, min(rank) first, sum(1 / log2(rank + 1)) dcg from r join rel using (query_id, doc_id) group by 1)
  select query_id, c.n as n_relevant, round(coalesce(h, 0) / c.n, 6) as recall, round(coalesce(h, 0) / 10, 6) as precision, round(coalesce(1.0 / first, 0), 6) as mrr,
    round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(c.n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from c left join h using (query_id)""",
    "token_budget": """select source, doc_id, used from (select source, doc_id, cast(sum(coalesce(cast(ceil(length(text) / 4) as bigint), 0)) over (partition by source order by doc_id rows unbounded preceding) as bigint) as used from documents) where used <= 2000""",
    "exact_name": _EXACT,
    "structural_rerank": f"""with h as (select asked as query_id, {_QUERY} as q, x.id, rank, degree, kind, name from ({_EXACT}) x join ({_NODES1}) n using (id)), i as (select *, {_INTENT} as intent from h)
  select *, row_number() over (partition by query_id order by score desc, id) as rank from (
    select query_id, id, round((1.0 / rank) * (1 + 0.03 * log2(1 + degree)) * (case when {_ACTION} then 1.2 else 1.0 end) * ({_PRIOR}), 5) as score from i)""",
    "file_prior": f"""with f as (select id, min(file) file from nodes group by id), c as (select file, sum(c) c from (select src as id, count(*) c from edges group by 1) join f using (id) group by file),
  w as (select file, ln(1 + c) / ln(1 + (select max(c) from c)) as w from c)
  select asked as query_id, x.id, round((1.0 / (9 + rank)) * (1 + least(greatest(coalesce(w, 0), 0), 1)), 6) as score from ({_EXACT}) x join f using (id) left join w using (file)""",
}
