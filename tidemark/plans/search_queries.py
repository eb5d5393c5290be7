"""Queries of assertion graphs, seeds, hybrid search and communities over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph, ledger, retrieval
from tidemark.plans import ledger_queries, text_queries
from tidemark.plans.ledger_queries import NOW
from tidemark.sources import table

#: The stated synonyms and aliases of the rewritten queries.
SYNONYMS = {"outage": ["crash", "downtime"], "blocked": ["stuck"]}
ALIASES = {"export": "outbox publish", "charter": "premium tariff"}


def _a(spark, d):
    return ledger.assertions(table(spark, d, "memory_graph_assertions"))


def relations_among(spark, d):
    a = _a(spark, d)
    refs = a.filter("subject like 'entity:%'").select(F.col("subject").alias("ref")).unionByName(a.filter("object like 'topic:%'").select(F.col("object").alias("ref")))
    return ledger.relations_among(a, refs, NOW)


def assertion_adjacency(spark, d):
    return ledger.adjacency(_a(spark, d), NOW)


def superseded_by(spark, d):
    return ledger.superseded_by(_a(spark, d))


def timeline(spark, d):
    return ledger.timeline(_a(spark, d))


def provenance_counts(spark, d):
    return ledger.provenance_counts(_a(spark, d), table(spark, d, "capture_sources"), NOW)


def _named(spark, d):
    n = table(spark, d, "nodes").filter("id is not null")
    return n.groupBy("id").agg(F.min(F.coalesce("name", "heading")).alias("text"), F.min("kind").alias("kind"), F.min("name").alias("name"))


def _stated(spark):
    return spark.createDataFrame(list(text_queries.STATED.items()), "query_id string, q string")


def graph_seeds(spark, d):
    return retrieval.graph_seeds(_named(spark, d), _stated(spark))


def _node_bm25(spark, d, k=50):
    q = text_queries._queries(spark)
    return retrieval.bm25(_named(spark, d), q, k=k, id_="id")


def seed_fusion(spark, d):
    return retrieval.fuse_seeds(graph_seeds(spark, d), _node_bm25(spark, d, 5))


def rewritten_bm25(spark, d):
    """The stated queries with aliases expanded and synonyms added."""
    q = _stated(spark).select("query_id", T.alias_rewrite(F.col("q"), ALIASES).alias("q"))
    q = q.select("query_id", F.explode(T.query_terms(F.col("q"), SYNONYMS)).alias("term"))
    return retrieval.bm25(table(spark, d, "documents"), q)


def hybrid_search(spark, d):
    """Symbols like a stated one, which is the least id of each embedder: by name and by vector, exact names first, a page of ten.

    Lexical ranks are BM25 over names, semantic ones cosine within the embedder; both fused by reciprocal ranks.
    """
    v = table(spark, d, "vectors").filter("id is not null and vec is not null and size(vec) = dim and dim > 0 and exists(vec, x -> x <> 0) and forall(vec, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    v = v.groupBy("id", "dim").agg(F.min("vec").alias("vec"))
    named = _named(spark, d)
    asked = v.join(named.filter("name is not null").select("id", "name"), "id").groupBy("dim").agg(F.min_by(F.struct("id", "name", "vec"), "id").alias("q"))
    q = asked.select(F.col("q.id").alias("query_id"), "dim", F.col("q.name").alias("name"), F.col("q.vec").alias("qv"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = F.round(dot(F.col("vec"), F.col("qv")) / F.sqrt(dot(F.col("vec"), F.col("vec"))) / F.sqrt(dot(F.col("qv"), F.col("qv"))), 6)
    near = v.join(F.broadcast(q), "dim").filter("id <> query_id").select("query_id", "id", cos.alias("score")).filter("score > 0")  # one stated query an embedder
    semantic = graph.top_ranked(near, ["query_id"], [F.col("score").desc(), F.col("id")], 50)
    terms = q.select("query_id", F.explode(F.array_distinct(T.terms(F.col("name")))).alias("term"))
    lexical = retrieval.bm25(named, terms, k=50, id_="id").filter("id <> query_id")
    fused = retrieval.rrf(lexical.select("query_id", "id", "rank"), semantic.select("query_id", "id", "rank"), item="id", limit=50)
    exact = named.join(F.broadcast(q.select("query_id", "name")), "name").filter("id <> query_id")
    exact = graph.top_ranked(exact.select("query_id", "id"), ["query_id"], [F.col("id")], 50)
    return retrieval.exact_first(exact, fused.select("query_id", "id", "rank"))


def louvain_clusters(spark, d):
    """Communities of the structural graph of every repository by greedy modularity, those of one node left out."""
    n = table(spark, d, "nodes").filter("id is not null and root is not null").groupBy("id").agg(F.min("root").alias("root"))
    w = graph.structural_weights(table(spark, d, "edges"))
    w = w.join(n.select(F.col("id").alias("a"), "root"), "a").join(n.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").filter("root = rb")
    return graph.communities_by_group(w.select("root", "a", "b", "w"), "root")


QUERIES = {f.__name__: f for f in (relations_among, assertion_adjacency, superseded_by, timeline, provenance_counts, graph_seeds, seed_fusion, rewritten_bm25, hybrid_search, louvain_clusters)}

_A = ledger_queries._A
_CUR = f"""select * from ({_A}) where valid_at <= {NOW} and known_at <= {NOW} and (predicate in ('supported-by', 'affects', 'contradicts') or id in (select id from ({ledger_queries._ASOF})))"""


def _stem(x: str) -> str:
    one = rf"case when regexp_matches({x}, '^.{{3,}}ies$') then regexp_replace({x}, 'ies$', 'y') when regexp_matches({x}, '(ss|x|z|ch|sh)es$') then case when length({x}) >= 5 then regexp_replace({x}, 'es$', '') else {x} end when regexp_matches({x}, '^.{{3,}}s$') and not regexp_matches({x}, '(ss|us|is)$') then regexp_replace({x}, 's$', '') else {x} end"
    two = rf"regexp_replace({one}, '^(.{{3,}}?)(ment|ing|ed)$', '\1')"
    return f"case when length({two}) > 3 then regexp_replace({two}, 'e$', '') else {two} end"


_STATED = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in text_queries.STATED.items()) + ") t(query_id, q)"
_NAMED = "select id, min(coalesce(name, heading)) as text, min(kind) kind, min(name) as name from nodes where id is not null group by id"
_SEEDS = f"""with q as (select query_id, list_distinct(list_transform({text_queries._terms('q')}, lambda w: {_stem('w')})) ts from {_STATED}),
  n as (select id, unnest(list_distinct(list_transform({text_queries._terms('text')}, lambda w: {_stem('w')}))) as term from ({_NAMED}) where text is not null),
  u as (select query_id, len(ts) c, unnest(ts) term from q where len(ts) > 0),
  s as (select query_id, id, round(count(*) / c, 6) as score from n join u using (term) group by query_id, id, c)
  select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 5"""


def _bm25(queries: str, docs: str, id_: str, k: int) -> str:
    """Okapi BM25 of queries (query_id, term) over documents (id, text), terms matching beginnings of tokens."""
    x = text_queries._terms("coalesce(text, '')")
    return f"""with q as ({queries}), l as (select {id_}, cast(len({x}) as double) as len from {docs}), p as (select {id_}, unnest({x}) as term from {docs}),
  x as (select distinct query_id, p.term from (select distinct term from p) p join q on starts_with(p.term, q.term)),
  t as (select {id_}, term, count(*) * 1.0 as tf from p where term in (select term from x) group by all), f as (select term, count(*) df from t group by term), n as (select count(*) n, avg(len) a from l),
  s as (select query_id, t.{id_}, round(sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / n.a))), 6) as score
        from t join f using (term) join l using ({id_}) join x using (term), n group by all)
  select query_id, {id_}, score, rank from (select *, row_number() over (partition by query_id order by score desc, {id_}) as rank from s) where rank <= {k}"""


_SYN = "case " + " ".join(f"when w = '{k}' then ['{k}', " + ", ".join(f"'{i}'" for i in v) + "]" for k, v in SYNONYMS.items()) + " else [w] end"
_REWRITE = "concat_ws(' ', q, " + ", ".join(f"case when regexp_matches(q, '(^|[^A-Za-z0-9_]){a}($|[^A-Za-z0-9_])') then '{e}' end" for a, e in ALIASES.items()) + ")"
_REWRITTEN = f"select query_id, unnest(list_distinct(flatten(list_transform({text_queries._terms('q')}, lambda w: {_SYN})))) as term from (select query_id, {_REWRITE} as q from {_STATED})"
_GOOD = "id is not null and vec is not null and len(vec) = dim and dim > 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0"
_ASK = f"""select min_by(id, id) as query_id, dim, min_by(name, id) as name, min_by(vec, id) as qv from (select v.id, dim, name, min(vec) vec from vectors v join ({_NAMED}) n on n.id = v.id and n.name is not null where {_GOOD.replace('id is', 'v.id is')} group by all) group by dim"""

SQL = {
    "relations_among": f"""with c as ({_CUR}), r as (select subject as ref from ({_A}) where subject like 'entity:%' union select object from ({_A}) where object like 'topic:%')
  select id, subject, predicate, object from c where subject in (select ref from r) and object in (select ref from r)""",
    "assertion_adjacency": f"""with c as (select subject, object from ({_CUR}) where subject is not null and object is not null),
  e as (select subject as ref, object as other, 1 as o from c union all select object, subject, 0 from c)
  select ref, cast(sum(o) as bigint) as n_out, cast(sum(1 - o) as bigint) as n_in, count(distinct other) as n_neighbours from e group by ref""",
    "superseded_by": f"""select object as ref, count(*) as n, min_by(id, (-coalesce(valid_at, 0), id)) as latest_id, min_by(subject, (-coalesce(valid_at, 0), id)) as latest_subject from ({_A}) where predicate = 'supersedes' and object is not null group by object""",
    "timeline": f"select id, subject, row_number() over w as place, lead(id) over w as next_id from ({_A}) where subject is not null and valid_at is not null window w as (partition by subject order by valid_at, id)",
    "provenance_counts": f"""with a as ({_A}), c as (select distinct id from ({_CUR})), r as (select id, min(repo_id) repo from capture_sources where id is not null group by id)
  select repo, count(*) as n_considered, count(c.id) as n_current, count(*) filter (len(s) > 0) as n_supported from a left join r on r.id = a.s[1] left join c on c.id = a.id group by repo""",
    "graph_seeds": _SEEDS,
    "seed_fusion": f"""with u as (select query_id, id, rank from ({_SEEDS}) union all select query_id, id, rank from ({_bm25(text_queries._Q, f'({_NAMED})', 'id', 5)})),
  s as (select query_id, id, sum(1.0 / (60 + rank)) as s from u group by all), m as (select query_id, id, round(s / max(s) over (partition by query_id), 6) as score from s)
  select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from m) where rank <= 5""",
    "rewritten_bm25": _bm25(_REWRITTEN, "documents", "doc_id", 10),
    "hybrid_search": f"""with a as ({_ASK}), v as (select id, dim, min(vec) vec from vectors where {_GOOD} group by all),
  c as (select query_id, v.id, round(list_cosine_similarity(cast(vec as double[]), cast(qv as double[])), 6) as score from v join a using (dim) where v.id <> query_id),
  sem as (select * from (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from c where score > 0) where rank <= 50),
  lex as (select query_id, id, rank from ({_bm25("select query_id, unnest(list_distinct(" + text_queries._terms('name') + f")) as term from ({_ASK})", f'({_NAMED})', 'id', 50)}) where id <> query_id),
  fus as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, id, round(sum(1.0 / (60 + rank)), 6) as score from (select * from sem union all select * from lex) group by all)),
  ex as (select a.query_id, n.id, row_number() over (partition by a.query_id order by n.id) as rank from ({_NAMED}) n join a on a.name = n.name where n.id <> a.query_id),
  al as (select query_id, id, 0 as s, rank from ex where rank <= 50 union all select query_id, id, 1, rank from fus f where rank <= 50 and not exists (select 1 from ex where ex.query_id = f.query_id and ex.id = f.id and ex.rank <= 50))
  select query_id, id, place from (select query_id, id, row_number() over (partition by query_id order by s, rank, id) as place from al) where place <= 10""",
}
