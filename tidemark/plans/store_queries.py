"""Queries of the scan, filter, set and maintenance operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph, reports, stores
from tidemark.plans import graph_queries, ledger_queries
from tidemark.sources import files, table

#: The stated ignore file.
IGNORED = "# generated\n/export/\n*.sql\n!ledger/**/*.sql\nvector_*\n"


def scan_kind(spark, d):
    return stores.scan(table(spark, d, "nodes"), kinds=["route", "cursor"]).select("id", "kind", "file").distinct()


def scan_rel(spark, d):
    return stores.scan(table(spark, d, "edges"), rels=["imports", "injects"]).groupBy(F.lower(F.trim("rel")).alias("rel"), "method").agg(F.count(F.lit(1)).alias("n"))


def point_get(spark, d):
    n = table(spark, d, "nodes")
    asked = table(spark, d, "vectors").select("id").filter("id is not null")
    return stores.scan(n, ids=asked).groupBy("id").agg(F.min("kind").alias("kind"), F.min("name").alias("name"))


def confident_edges(spark, d):
    return stores.confident(table(spark, d, "edges")).select("id", "src", "dst", F.lower(F.trim("rel")).alias("rel"), "confidence").distinct()


def redacted_meta(spark, d):
    n = table(spark, d, "nodes").filter("id is not null and meta is not null").groupBy("id").agg(F.min("meta").alias("meta"))
    return n.select("id", stores.redact_values(F.col("meta")).alias("meta"))


def derived_kinds(spark, d):
    n = table(spark, d, "nodes").filter("id is not null").groupBy("id").agg(F.min("kind").alias("kind"), F.min("node_type").alias("t"))
    return n.select("id", graph.derived_kind(F.col("kind"), F.col("t")).alias("kind"))


def parsed_ids(spark, d):
    n = table(spark, d, "nodes").select("id").filter("id is not null").distinct()
    return n.select("id", *[c.alias(k) for k, c in stores.id_parts(F.col("id")).items()])


def _changed_files(spark, d):
    """The files that hold a cursor stand for what changed."""
    return table(spark, d, "nodes").filter("kind = 'cursor' and file is not null").select("file").distinct()


def remove_by_file(spark, d):
    n, e = stores.without_files(table(spark, d, "nodes"), table(spark, d, "edges"), _changed_files(spark, d))
    nodes = n.groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(e.groupBy(F.lit("edge").alias("what"), F.lower(F.trim("rel")).alias("name")).agg(F.count(F.lit(1)).alias("n")))


def update_scope(spark, d):
    return stores.update_scope(table(spark, d, "nodes"), table(spark, d, "edges"), _changed_files(spark, d))


def apply_delta(spark, d):
    n = table(spark, d, "nodes").filter("id is not null")
    changed = n.filter("kind = 'symbol' and lang = 'go'").select("id", F.concat("hash", F.lit("-new")).alias("hash"))
    left, vectors = stores.apply_delta(n, n.filter("kind = 'statement'"), changed, table(spark, d, "vectors"))
    return left.join(vectors.select("id", F.lit(True).alias("v")).distinct(), "id", "left").select("id", "hash", F.coalesce("v", F.lit(False)).alias("has_vector"))


def cluster_issues(spark, d):
    return stores.cluster_issues(table(spark, d, "nodes"))


def orphan_vectors(spark, d):
    return stores.orphans(table(spark, d, "vectors"), table(spark, d, "nodes").filter("kind = 'symbol'")).select("id", "embedder").distinct()


def record_merge(spark, d):
    e = table(spark, d, "edges").withColumn("rel", F.lower(F.trim("rel")))
    return stores.merge_records(e.filter("provenance = 'EXTRACTED'"), e.filter("provenance = 'INFERRED'"), key="id", content=["src", "dst", "rel", "method"])


def gap_summary(spark, d):
    return reports.gaps(table(spark, d, "nodes"), table(spark, d, "edges")).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def size_percentiles(spark, d):
    e = table(spark, d, "intelligence_events").select("kind", F.try_variant_get(F.try_parse_json("payload"), "$.size", "bigint").alias("size"))
    return stores.nearest_rank(e.filter("size is not null"), ["kind"], "size")


def neighbour_pages(spark, d):
    n = table(spark, d, "nodes")
    near = graph.neighbours(table(spark, d, "edges"), n.filter("kind in ('route', 'file')").select(F.col("id").alias("node_id")))
    order = [F.col("direction"), F.col("rel"), F.col("neighbour")]
    p = stores.page(near, key=["node_id"], order=order, cursor="neighbour", limit=5)
    return p.select("node_id", "neighbour", "rel", "direction", "place", "truncated", "next_cursor")


def doc_links(spark, d):
    return stores.doc_links(table(spark, d, "nodes"), table(spark, d, "edges"))


def class_facts(spark, d):
    return stores.class_facts(table(spark, d, "nodes"), table(spark, d, "edges"))


def guard_chains(spark, d):
    return stores.guard_chains(table(spark, d, "edges"))


def payload_etag(spark, d):
    e = table(spark, d, "intelligence_events").filter("payload is not null")
    return e.select("line_no", T.etag(F.col("payload")).alias("etag"))


def claim_form(spark, d):
    docs = table(spark, d, "documents").filter("doc_kind = 'memory-claim' and text is not null")
    return docs.select("doc_id", T.negated(F.col("text")).alias("negated"), F.md5(T.without_negation(F.col("text"))).alias("form"))


def expression_parity(spark, d):
    n = table(spark, d, "nodes").filter("expr is not null and id is not null").groupBy("id").agg(F.min("expr").alias("expr"))
    return n.groupBy(T.expression_form(F.col("expr")).alias("form")).agg(F.count(F.lit(1)).alias("n"))


def discovered_files(spark, d):
    return files.discover(table(spark, d, "source_files"), files.parse_ignore(IGNORED))


def package_dossier(spark, d):
    n = table(spark, d, "nodes")
    return stores.scope_dossier(n, F.nullif(F.regexp_extract("file", "^([^/]+/[^/]+)/", 1), F.lit("")))


QUERIES = {
    f.__name__: f
    for f in (
        scan_kind, scan_rel, point_get, confident_edges, redacted_meta, derived_kinds, parsed_ids, remove_by_file, update_scope, apply_delta, cluster_issues, orphan_vectors,
        record_merge, gap_summary, size_percentiles, neighbour_pages, doc_links, class_facts, guard_chains, package_dossier,
        payload_etag, claim_form, expression_parity, discovered_files,
    )
}

_E = graph_queries._E
_CHANGED = "select distinct file from nodes where kind = 'cursor' and file is not null"
_SCOPE = f"""n as (select id, min(kind) kind, min(node_type) node_type from nodes where id is not null group by id), e as ({_E}),
  c as (select id as class_id from (select n.id, {graph_queries._KIND} as k from n) where k in ('class', 'interface')),
  m as (select distinct dst as class_id, src as id from e where rel = 'member-of' and src <> dst and dst in (select class_id from c)),
  s as (select * from m union select class_id, class_id from c),
  u as (select distinct src, dst from e where rel in ('calls', 'imports', 'inherits', 'implements', 'injects')),
  o as (select distinct class_id, dst as other from s join u on u.src = s.id where not exists (select 1 from s z where z.class_id = s.class_id and z.id = u.dst)),
  i as (select distinct class_id, src as other from s join u on u.dst = s.id where not exists (select 1 from s z where z.class_id = s.class_id and z.id = u.src))"""

SQL = {
    "scan_kind": "select distinct id, kind, file from nodes where kind in ('route', 'cursor')",
    "scan_rel": "select lower(trim(rel)) as rel, method, count(*) as n from edges where lower(trim(rel)) in ('imports', 'injects') group by 1, 2",
    "point_get": "select id, min(kind) as kind, min(name) as name from nodes where id in (select id from vectors) group by id",
    "confident_edges": "select distinct id, src, dst, lower(trim(rel)) as rel, confidence from edges where confidence >= 0.4 and provenance = 'EXTRACTED'",
    "redacted_meta": "select id, '{' || array_to_string(list_transform(list_sort(json_keys(m)), lambda k: '\"' || k || '\": null'), ', ') || '}' as meta from (select id, min(meta) m from nodes where id is not null and meta is not null group by id)",
    "derived_kinds": f"select n.id, {graph_queries._KIND} as kind from (select id, min(kind) kind, min(node_type) node_type from nodes where id is not null group by id) n",
    "parsed_ids": r"""select id, nullif(regexp_extract(id, '^([a-z]+):', 1), '') as prefix, nullif(regexp_extract(id, '^[a-z]+:([^#@]+)', 1), '') as path, nullif(regexp_extract(id, '#([^@]+)', 1), '') as name,
  try_cast(nullif(regexp_extract(id, '@L(\d+)$', 1), '') as integer) as line from (select distinct id from nodes where id is not null)""",
    "remove_by_file": f"""with g as ({_CHANGED}), l as (select distinct id from nodes where file in (select file from g) and id is not null)
  select 'node' as what, kind as name, count(*) as n from nodes where file is null or file not in (select file from g) group by kind
  union all select 'edge', lower(trim(rel)), count(*) from edges where (src is null or src not in (select id from l)) and (dst is null or dst not in (select id from l)) group by 2""",
    "update_scope": f"""with c as ({_CHANGED}), p as (select id, min(file) file from nodes where id is not null and file is not null group by id),
  u as (select distinct p.file from ({_E}) e join p on p.id = e.src where rel in ('calls', 'imports', 'inherits', 'implements', 'references', 'injects') and dst in (select id from p where file in (select file from c)))
  select file, 'changed' as reason from c union all select file, 'dependent' from u where file not in (select file from c)""",
    "apply_delta": """with o as (select id, min(hash) hash from nodes where id is not null group by id), g as (select distinct id from nodes where kind = 'statement' and id is not null),
  c as (select id, min(hash || '-new') hash from nodes where kind = 'symbol' and lang = 'go' and id is not null group by id),
  l as (select * from o where id not in (select id from g) and id not in (select id from c) union all select * from c)
  select l.id, l.hash, l.hash is not distinct from o.hash and o.id is not null and l.id in (select id from vectors where id is not null) as has_vector from l left join o using (id)""",
    "cluster_issues": """with n as (select distinct id, kind, cluster_id from nodes where id is not null), c as (select distinct id from n where kind = 'cluster'), m as (select * from n where kind <> 'cluster' and cluster_id is not null)
  select distinct 'unknown-cluster' as issue, id from m where cluster_id not in (select id from c)
  union all select 'several-clusters', id from m group by id having count(distinct cluster_id) > 1
  union all select 'empty-cluster', id from c where id not in (select cluster_id from m)""",
    "orphan_vectors": "select distinct id, embedder from vectors v where not exists (select 1 from nodes n where n.id = v.id and kind = 'symbol')",
    "record_merge": """with e as (select id, provenance, concat_ws('|', coalesce(src, '-'), coalesce(dst, '-'), coalesce(lower(trim(rel)), '-'), coalesce(method, '-')) as c from edges where id is not null),
  a as (select id, list_sort(list(distinct c)) c from e where provenance = 'EXTRACTED' group by id), b as (select id, list_sort(list(distinct c)) c from e where provenance = 'INFERRED' group by id)
  select coalesce(a.id, b.id) as id, case when b.id is null then 'ours' when a.id is null then 'theirs' when a.c = b.c then 'same' else 'conflict' end as outcome from a full join b on a.id = b.id""",
    "size_percentiles": """with e as (select kind, try_cast(json_extract(payload, '$.size') as bigint) as s from intelligence_events)
  select kind, count(*) as n, cast(sum(s) as bigint) as total, round(avg(s), 6) as mean, min(s) as least, quantile_disc(s, 0.5) as p50, quantile_disc(s, 0.95) as p95, max(s) as most from e where s is not null group by kind""",
    "neighbour_pages": f"""with r as (select distinct id from nodes where kind in ('route', 'file')), e as ({_E}),
  x as (select src as node_id, dst as neighbour, rel, 'out' as direction from e where src in (select id from r) union all select dst, src, rel, 'in' from e where dst in (select id from r)),
  p as (select *, row_number() over w as place, lead(true) over w as more from x window w as (partition by node_id order by direction, rel, neighbour))
  select node_id, neighbour, rel, direction, place, place = 5 and coalesce(more, false) as truncated, case when place = 5 and coalesce(more, false) then neighbour end as next_cursor from p where place <= 5""",
    "doc_links": f"select dst as node_id, src as doc_id, heading, rel from ({_E}) e join (select id, min(heading) heading from nodes where kind = 'doc-section' and id is not null group by id) n on n.id = e.src where rel in ('describes', 'references')",
    "class_facts": f"""with {_SCOPE}
  select c.class_id, (select count(*) from m where m.class_id = c.class_id) as n_members, (select count(*) from i join n on n.id = i.other where i.class_id = c.class_id and kind = 'route') as n_routes,
    (select count(distinct e.dst) from s join e on e.src = s.id and e.rel = 'produces' where s.class_id = c.class_id) as n_produces,
    (select count(*) from o where o.class_id = c.class_id) as n_dependencies, (select count(*) from i where i.class_id = c.class_id) as n_dependents from c""",
    "guard_chains": """select id, len(p) as depth, p[1] as outermost, p[-1] as guard, coalesce(b, '') as branch, in_loop, in_exception from (
  select id, r.p as p, r.b as b, in_loop, in_exception from (select id, min(struct_pack(p := cfg_path, b := branch)) r, bool_or(coalesce(in_loop, false)) in_loop, bool_or(coalesce(in_exception, false)) in_exception
    from edges where id is not null and len(cfg_path) > 0 group by id))""",
    "package_dossier": """with n as (select scope, id, min(kind) kind from (select *, nullif(regexp_extract(file, '^([^/]+/[^/]+)/', 1), '') as scope from nodes) where id is not null and scope is not null group by all),
  f as (select scope, string_agg(id, ',' order by id) first_ids from (select *, row_number() over (partition by scope order by id) k from n) where k <= 5 group by scope)
  select scope, count(*) as n_nodes, count(*) filter (kind = 'symbol') as n_symbols, count(*) filter (kind = 'route') as n_routes, any_value(first_ids) as first_ids, count(*) > 5 as truncated from n join f using (scope) group by scope""",
}

def _expanded(x: str) -> str:
    out = f"replace(lower({x}), chr(8217), chr(39))"
    for short, full in T._SHORT:
        out = f"regexp_replace({out}, '\\b{short.replace(chr(39), chr(39) * 2)}\\b', '{full}', 'g')"
    return f"regexp_replace({out}, '\\b([a-z]+)n''t\\b', '\\1 not', 'g')"


_X = _expanded("text")
_FORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(expr, '\s+', ' ', 'g'))), '<>|!==', '!=', 'g'), '===?', '=', 'g'), '\s*([^\w\s''\"]+)\s*', '\1', 'g'), ';+$', ''), '^$', '')"
SQL["payload_etag"] = """select line_no, case when json_valid(payload) then sha256('{' || array_to_string(list_transform(list_sort(json_keys(payload)), lambda k: '"' || k || '":' || cast(json_extract(payload, '$.' || k) as varchar)), ',') || '}') end as etag
  from intelligence_events where payload is not null"""
SQL["claim_form"] = f"""select doc_id, regexp_matches({_X}, '{T._NEGATIONS}') as negated, md5(trim(regexp_replace(regexp_replace(regexp_replace({_X}, '\\b(?:does|do|did) not\\b', 'not', 'g'), '{T._NEGATIONS}', ' ', 'g'), '\\s+', ' ', 'g'))) as form
  from documents where doc_kind = 'memory-claim' and text is not null"""
SQL["expression_parity"] = f"""select case when regexp_matches(f, '^\\([^()]*\\)$') then regexp_replace(f, '^\\(|\\)$', '', 'g') else f end as form, count(*) as n from (
  select {_FORM} as f from (select id, min(expr) expr from nodes where expr is not null and id is not null group by id)) group by 1"""
SQL["discovered_files"] = r"""select file, case e when '.ts' then 'ts' when '.js' then 'js' when '.py' then 'py' when '.java' then 'java' when '.go' then 'go' when '.sql' then 'sql' when '.md' then 'md' end as lang
  from (select distinct file, lower(regexp_extract(file, '(\.[A-Za-z0-9]+)$', 1)) e from source_files where file is not null) where e in ('.ts', '.js', '.py', '.java', '.go', '.sql', '.md')
  and not regexp_matches(file, '(^|/)(\.git|node_modules|dist|build|target|__pycache__|\.venv|vendor)/|\.min\.(js|css)$')
  and not case when regexp_matches(file, '(^|/)vector_[^/]*(/|$)') then true when regexp_matches(file, '^ledger/.*[^/]*\.sql$') then false when file like '%.sql' then true else file like 'export/%' end"""
SQL["gap_summary"] = f"select gap, count(*) as n from ({ledger_queries.SQL['gaps']}) group by gap"
