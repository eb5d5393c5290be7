"""Queries of change review and lookups over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import glob_regex
from tidemark.operators import linking, review
from tidemark.sources import table

WORDS = ["lease", "digest", "merge"]
RULES = [("**/*.md", False), ("storage/**", False), ("storage/util/*", True), ("**/*_1?.py", False)]


def _ne(spark, d):
    return table(spark, d, "nodes"), table(spark, d, "edges")


def _changed(n):
    return n.filter("kind = 'file' and root = 'claims-core'").select("file")


def detect_changes(spark, d):
    n, e = _ne(spark, d)
    return review.detect_changes(n, e, _changed(n))


def review_selection(spark, d):
    n, e = _ne(spark, d)
    return review.review(n, e, _changed(n))


def rename_plan(spark, d):
    n, e = _ne(spark, d)
    return review.rename_plan(n, e, table(spark, d, "source_files"), n.filter("kind = 'symbol' and lang = 'python'").select("name"))


def dossier(spark, d):
    return review.dossier(*_ne(spark, d))


def directory_buckets(spark, d):
    return review.directory_buckets(table(spark, d, "nodes"))


def cluster_label(spark, d):
    return review.cluster_label(table(spark, d, "nodes"))


def redacted_documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(review.source_policy(F.col("lang"), F.col("text"))).alias("digest"))


def work_queue(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_kind", "doc_id", F.ceil(F.length("text") / 4).alias("cost"))
    q = review.work_queue(docs, group="doc_kind", order=[F.col("doc_id")], cost=F.col("cost"), budget=1_000)
    return q.select("doc_kind", "doc_id", "place", "used")


def text_match(spark, d):
    n = review.one_per_id(table(spark, d, "nodes"), "name", "heading", "file")
    return review.text_match(n, WORDS, {"name": 4, "heading": 3, "file": 1})


def inherited_docs(spark, d):
    own = table(spark, d, "documents").filter("anchor_id is not null").select(F.col("anchor_id").alias("id"), "doc_id")
    return review.inherited(own, table(spark, d, "nodes"))


def ignore_rules(spark, d):
    return linking.ignore_match(table(spark, d, "nodes").filter("file is not null"), [(glob_regex(g), n) for g, n in RULES])


def file_churn(spark, d):
    n, e = _ne(spark, d)
    f = review.one_per_id(n, "file")
    return e.select(F.col("src").alias("id")).join(f, "id").groupBy("file").agg(F.count(F.lit(1)).alias("touches"))


QUERIES = {f.__name__: f for f in (detect_changes, review_selection, rename_plan, dossier, directory_buckets, cluster_label, redacted_documents, work_queue, text_match, inherited_docs, ignore_rules, file_churn)}

_E = "select distinct src, dst, lower(trim(rel)) as rel from edges where src is not null and dst is not null and rel is not null"
_N = "select id, min(kind) kind, min(file) file, min(name) as name, min(heading) heading, min(lang) lang, min(cluster_id) cluster_id from nodes where id is not null group by id"
_CH = "select distinct file from nodes where kind = 'file' and root = 'claims-core'"
_MATCH = " + ".join(f"case when contains(lower(coalesce({c}, '')), '{w}') then {k} else 0 end" for w in WORDS for c, k in (("name", 4), ("heading", 3), ("file", 1)))
_IGN = "false"
for _g, _neg in RULES:
    _IGN = f"case when regexp_matches(file, '{glob_regex(_g)}') then {'false' if _neg else 'true'} else {_IGN} end"

SQL = {
    "detect_changes": f"""with c as (select id from ({_N}) where file in ({_CH})), t as (select id, 'outgoing' as role from edges where id is not null and src in (select id from c) union select id, 'incoming' from edges where id is not null and dst in (select id from c))
  select 'node' as what, id, 'changed' as role from c union all select 'edge', id, array_to_string(list_sort(list(distinct role)), '+') from t group by id""",
    "review_selection": f"""with c as (select id, min(file) file from nodes where kind = 'symbol' and id is not null group by id), k as (select dst, count(*) n from ({_E}) where rel = 'calls' group by dst)
  select id, coalesce(n, 0) as n_callers, row_number() over (order by coalesce(n, 0) desc, id) as rank from c left join k on k.dst = id where file in ({_CH}) order by rank limit 50""",
    "rename_plan": f"""with a as (select distinct name from nodes where kind = 'symbol' and lang = 'python' and name is not null), s as (select id, min(name) as name from nodes where kind = 'symbol' and id is not null group by id),
  f as (select file, min(body) body from source_files where body is not null group by file), w as (select file, unnest(string_split_regex(body, '[^A-Za-z0-9_]+')) as name from f),
  o as (select name, count(distinct file) n_files, count(*) n_occurrences from w where name in (select name from a) group by name),
  r as (select s.name, count(*) n_references from ({_E}) e join s on s.id = e.dst where rel in ('calls', 'references', 'imports') group by 1)
  select s.name, count(*) as n_symbols, coalesce(any_value(n_references), 0) as n_references, coalesce(any_value(n_files), 0) as n_files, coalesce(any_value(n_occurrences), 0) as n_occurrences
  from s left join r using (name) left join o using (name) where s.name in (select name from a) group by s.name""",
    "dossier": f"""with e as ({_E}), n as (select distinct id from nodes where kind = 'symbol' and id is not null),
  o as (select src as id, count(*) filter (rel = 'calls') n_calls, count(*) filter (rel = 'reads') n_reads, count(*) filter (rel = 'writes') n_writes, count(*) filter (rel = 'raises') n_raises from e group by 1),
  i as (select dst as id, count(*) filter (rel = 'calls') n_callers, count(*) filter (rel in ('describes', 'references')) n_docs from e group by 1)
  select id, coalesce(n_calls, 0) as n_calls, coalesce(n_reads, 0) as n_reads, coalesce(n_writes, 0) as n_writes, coalesce(n_raises, 0) as n_raises, coalesce(n_callers, 0) as n_callers, coalesce(n_docs, 0) as n_docs
  from n left join o using (id) left join i using (id)""",
    "directory_buckets": """with f as (select distinct file from nodes where kind = 'file' and file is not null), t as (select split_part(file, '/', 1) t, count(*) n from f group by 1), m as (select max(n) > 0.8 * sum(n) as deep from t)
  select case when deep then split_part(file, '/', 1) || '/' || split_part(file, '/', 2) else split_part(file, '/', 1) end as bucket, count(*) as n_files from f, m group by 1""",
    "cluster_label": """with n as (select id, min(cluster_id) cluster_id, min(file) file, coalesce(min(lang), '') lang from nodes where id is not null and cluster_id is not null and file is not null group by id),
  p as (select cluster_id, id, string_split(file, '/') as parts from n), x as (select cluster_id, id, unnest(range(1, len(parts))) as i, parts from p),
  s as (select cluster_id, i, count(distinct parts[i]) d, count(*) c, min(parts[i]) part from x group by all), z as (select cluster_id, count(*) n from n group by 1),
  ok as (select s.cluster_id, i, part from s join z using (cluster_id) where d = 1 and c = n), run as (select * from ok o where (select count(*) from ok q where q.cluster_id = o.cluster_id and q.i <= o.i) = o.i),
  pre as (select cluster_id, string_agg(part, '/' order by i) as prefix from run group by 1), l as (select cluster_id, lang, row_number() over (partition by cluster_id order by count(*) desc, lang) k from n group by cluster_id, lang)
  select z.cluster_id, coalesce(prefix, '') as prefix, lang as dominant from z left join pre using (cluster_id) join l on l.cluster_id = z.cluster_id and k = 1""",
    "work_queue": """select * from (select doc_kind, doc_id, row_number() over w as place, cast(sum(cast(ceil(length(text) / 4) as bigint)) over (partition by doc_kind order by doc_id rows unbounded preceding) as bigint) as used
  from documents where text is not null window w as (partition by doc_kind order by doc_id)) where used <= 1000 or place = 1""",
    "text_match": f"select id, score, row_number() over (order by score desc, id) as rank from (select id, {_MATCH} as score from ({_N})) where score > 0 order by rank limit 100",
    "inherited_docs": f"""with n as ({_N}), d as (select anchor_id id, min(doc_id) doc_id from documents where anchor_id is not null group by 1), f as (select file, min(doc_id) f from n join d using (id) group by file),
  c as (select cluster_id, min(doc_id) c from n join d using (id) where cluster_id is not null group by 1)
  select id, coalesce(doc_id, f, c) as doc_id, case when doc_id is not null then 'own' when f is not null then 'file' else 'cluster' end as "from" from n left join d using (id) left join f using (file) left join c using (cluster_id) where coalesce(doc_id, f, c) is not null""",
    "ignore_rules": f"select distinct file, {_IGN} as ignored from nodes where file is not null",
    "file_churn": f"select file, count(*) as touches from edges join ({_N}) n on n.id = src group by file",
}

SQL["redacted_documents"] = r"""select doc_id, md5(case when coalesce(lang, '') in ('binary', 'minified') then null else regexp_replace(text, '(?i)((?:password|secret|api_?key|credential)[a-z_]*\s*[=:]\s*)(?:[^\s,;$][^\s,;]*|\$[^{\s,;][^\s,;]*)', '\1[redacted]', 'g') end) as digest from documents"""
